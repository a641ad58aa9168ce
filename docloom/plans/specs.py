"""Plans of retrieval and their rewrites; plain values on the driver, no data."""

from __future__ import annotations

import datetime as dt
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass, replace

import regex

from docloom.functions.dates import MONTHS
from docloom.schemas import FilterGuess, PlannedSpec, RetrievalPlan, RetrievalSpec, SearchFilters

MAX_SPECS = 8


def raw_rag_plan(query: str) -> RetrievalPlan:
    """One semantic search with the question and one keyword search with its words."""
    return RetrievalPlan((PlannedSpec("semantic", semantic=query, rationale="question"), PlannedSpec("keyword", keywords=tuple(query.split()), rationale="words")))


def broad_plan(query: str, rationale: str) -> RetrievalPlan:
    return RetrievalPlan((PlannedSpec("semantic", semantic=query, rationale=rationale),))


def broaden(plan: RetrievalPlan) -> RetrievalPlan:
    """The plan without filter guesses."""
    return replace(plan, specs=tuple(replace(s, filter_guess=FilterGuess()) for s in plan.specs))


def later(a: str | None, b: str | None) -> str | None:
    return max((x for x in (a, b) if x is not None), default=None)


def earlier(a: str | None, b: str | None) -> str | None:
    return min((x for x in (a, b) if x is not None), default=None)


def intersect(spec: SearchFilters, ui: SearchFilters | None) -> SearchFilters:
    """Both filters: the narrower dates, the user's ids before the spec's, all tags."""
    if ui is None:
        return spec
    return SearchFilters(
        later(spec.date_from, ui.date_from),
        earlier(spec.date_to, ui.date_to),
        spec.correspondent_id if ui.correspondent_id is None else ui.correspondent_id,
        spec.document_type_id if ui.document_type_id is None else ui.document_type_id,
        tuple(dict.fromkeys(spec.tag_ids + ui.tag_ids)),
    )


@dataclass(frozen=True)
class NameMatch:
    id: int | None
    method: str
    candidates: tuple[str, ...] = ()


#: fixed values: words of a name that say nothing
CONNECTIVES = frozenset(("of", "the", "and", "for", "to"))


def _plain(name: str) -> str:
    return unicodedata.normalize("NFKC", name).lower()


def _key(name: str) -> str:
    return regex.sub("[^a-z0-9]", "", _plain(name))


def _content(name: str) -> frozenset[str]:
    return frozenset(regex.split("[^a-z0-9]+", _plain(name))) - CONNECTIVES - {""}


def match_name(guess: str, entries: Sequence[tuple[int, str]]) -> NameMatch:
    """The driver's form of operators.names.match_names, for a handful of guesses. entries: (id, name)."""
    for method, same in (("exact", lambda n: n == guess), ("normalised", lambda n: _key(n) == _key(guess))):
        if (hit := next((i for i, n in entries if same(n)), None)) is not None:
            return NameMatch(hit, method)
    words = _content(guess)
    shared = sorted(((len(words & _content(n)), i, n) for i, n in entries if words & _content(n)), key=lambda x: -x[0])
    equal = [(i, n) for _, i, n in shared if _content(n) == words]
    if len(equal) == 1:
        return NameMatch(equal[0][0], "loose")
    if equal:
        return NameMatch(None, "ambiguous", tuple(n for _, n in equal))
    return NameMatch(None, "near_miss", tuple(n for _, _, n in shared[:5])) if shared else NameMatch(None, "none")


def _span(year: int, month: int, months: int) -> tuple[str, str] | None:
    try:
        first = dt.date(year, month, 1)
        end = dt.date(year + (month + months - 1) // 12, (month + months - 1) % 12 + 1, 1) - dt.timedelta(days=1)
    except ValueError:
        return None
    return first.isoformat(), end.isoformat()


def period(text: str, today: dt.date) -> tuple[str | None, str | None]:
    """The driver's form of functions.dates.date_range, for one question."""
    if m := regex.search(r"\b\d{4}-\d{2}-\d{2}\b", text):
        try:
            day = dt.date.fromisoformat(m[0]).isoformat()
            return day, day
        except ValueError:
            pass
    names = dict(MONTHS)
    last = today.replace(day=1) - dt.timedelta(days=1)
    rules = (
        (r"(?i)\bq([1-4])\s+(\d{4})\b", lambda m: _span(int(m[2]), 3 * int(m[1]) - 2, 3)),
        (rf"(?i)\b({'|'.join(sorted(names, key=len, reverse=True))})\s+(\d{{4}})\b", lambda m: _span(int(m[2]), names[m[1].lower()], 1)),
        (r"\b((?:19|20|21)\d{2})\b(?!-)", lambda m: _span(int(m[1]), 1, 12)),
        (r"(?i)\blast\s+month\b", lambda m: _span(last.year, last.month, 1)),
        (r"(?i)\bthis\s+month\b", lambda m: _span(today.year, today.month, 1)),
        (r"(?i)\blast\s+year\b", lambda m: _span(today.year - 1, 1, 12)),
        (r"(?i)\bthis\s+year\b", lambda m: _span(today.year, 1, 12)),
    )
    for pattern, make in rules:
        if (m := regex.search(pattern, text)) and (found := make(m)):
            return found
    return None, None


def _guess_dates(guess: FilterGuess, today: dt.date) -> tuple[str | None, str | None]:
    """Bounds that are dates stand; a phrase gives its period's bound; anything else goes."""

    def bound(text: str | None, side: int) -> str | None:
        if text is None:
            return None
        try:
            return dt.date.fromisoformat(text[:10]).isoformat() if len(text) >= 10 else period(text, today)[side]
        except ValueError:
            return period(text, today)[side]

    return bound(guess.date_from, 0), bound(guess.date_to, 1)


def resolve(plan: RetrievalPlan, taxonomy: dict[str, Sequence[tuple[int, str]]], ui: SearchFilters | None, today: dt.date, query: str = "", max_specs: int | None = None, strict: bool = False) -> list[RetrievalSpec]:
    """Specs with real filters: names become ids if they match, dates are read, the user's filters narrow.

    If no spec has a date and the question names a period, a spec for that period is added. With
    max_specs, filtered specs get twins without filters up to that number, so that a wrong filter
    loses nothing; strict keeps the user's filters on the twins."""
    specs = []
    for s in plan.specs:
        g = s.filter_guess
        named = lambda text, kind: match_name(text, taxonomy.get(kind, ())).id if text is not None else None
        tags = tuple(t for t in (named(x, "tag") for x in g.tags) if t is not None)
        date_from, date_to = _guess_dates(g, today)
        own = SearchFilters(date_from, date_to, named(g.correspondent, "correspondent"), named(g.document_type, "document_type"), tags)
        specs.append(RetrievalSpec(s.mode, s.semantic, s.keywords, intersect(own, ui), s.rationale))
    if query and not any(s.filters.date_from or s.filters.date_to for s in specs):
        date_from, date_to = period(query, today)
        if date_from or date_to:
            semantic = [s for s in specs if s.mode == "semantic"]
            base = (semantic or specs or [RetrievalSpec("semantic", query, (), SearchFilters(), "question")])[0]
            dated = replace(base.filters, date_from=later(base.filters.date_from, date_from), date_to=earlier(base.filters.date_to, date_to))
            specs.append(replace(base, filters=intersect(dated, ui), rationale="the question names a period"))
    if max_specs is not None:
        free = (ui or SearchFilters()) if strict else SearchFilters()
        seen = {replace(s, rationale="") for s in specs}
        for s in list(specs):
            twin = replace(s, filters=free)
            if len(specs) < max_specs and not s.filters.is_empty() and replace(twin, rationale="") not in seen:
                seen.add(replace(twin, rationale=""))
                specs.append(twin)
    return specs


def call_budget(judge: bool, refinements: int) -> int:
    """Most model calls of a deep query: plan and answer, a judge if on, and the same for each refinement."""
    j = int(judge)
    return 2 + j + refinements * (2 + j)
