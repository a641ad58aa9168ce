"""External models as protocols, with deterministic stand-ins."""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Sequence
from typing import Any, Protocol

from pyspark.sql import DataFrame

from docloom.plans.specs import MAX_SPECS, broad_plan, raw_rag_plan
from docloom.schemas import FilterGuess, PlannedSpec, RetrievalPlan


class Embedder(Protocol):
    def __call__(self, texts: Sequence[str]) -> list[list[float]]: ...


class Planner(Protocol):
    def plan(self, query: str) -> RetrievalPlan: ...


class Judge(Protocol):
    def judge(self, query: str, documents: Sequence[tuple[int, str]]) -> list[dict]: ...


class Synthesizer(Protocol):
    def answer(self, query: str, sources: Sequence[tuple[int, str]], final: bool) -> dict: ...


class HashEmbedder:
    """Equal texts get equal unit vectors; shared words bring vectors closer."""

    def __init__(self, dimensions: int = 64) -> None:
        self.dimensions = dimensions

    def __call__(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dimensions
            for w in t.lower().split():
                h = hashlib.sha256(w.encode()).digest()
                v[h[0] % self.dimensions] += 1 if h[1] & 1 else -1
            norm = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / norm for x in v])
        return out


class RawPlanner:
    def plan(self, query: str) -> RetrievalPlan:
        return raw_rag_plan(query)


class KeepAllJudge:
    def judge(self, query: str, documents: Sequence[tuple[int, str]]) -> list[dict]:
        return [{"document_id": i, "keep": True, "reason": "", "score": 1.0} for i, _ in documents]


class QuotingSynthesizer:
    def answer(self, query: str, sources: Sequence[tuple[int, str]], final: bool) -> dict:
        return {"outcome": "answered", "answer": " ".join(t for _, t in sources[:1]), "citations": [i for i, _ in sources[:1]], "adjustment": None}


def json_object(text: str) -> dict | None:
    """The JSON object in a model's reply, fenced or after other words."""
    for candidate in (text, re.sub(r"\A\s*```\w*\s*|\s*```\s*\Z", "", text or ""), (text or "")[(text or "").find("{") : (text or "").rfind("}") + 1]):
        try:
            found = json.loads(candidate)
        except (ValueError, TypeError):
            continue
        if isinstance(found, dict):
            return found
    return None


def _text(value: Any) -> str | None:
    return value.strip() or None if isinstance(value, str) else None


def parse_plan(reply: str, query: str) -> RetrievalPlan:
    """A planner's reply; one broad semantic search if it can't be used."""
    found = json_object(reply)
    if found is None:
        return broad_plan(query, "fallback")
    specs = []
    for s in found.get("specs") or []:
        if not isinstance(s, dict) or s.get("mode") not in ("semantic", "keyword"):
            continue
        g = s.get("filter_guess") if isinstance(s.get("filter_guess"), dict) else {}
        guess = FilterGuess(_text(g.get("correspondent")), _text(g.get("document_type")), tuple(t for t in map(_text, g.get("tags") or []) if t), _text(g.get("date_from")), _text(g.get("date_to")))
        words = tuple(w for w in map(_text, s.get("keywords") or []) if w)
        if s["mode"] == "semantic" and _text(s.get("semantic")) or s["mode"] == "keyword" and words:
            specs.append(PlannedSpec(s["mode"], _text(s.get("semantic")), words, guess, _text(s.get("rationale")) or ""))
    clarify = _text(found.get("clarify"))
    return RetrievalPlan(tuple(specs[:MAX_SPECS]), clarify) if specs or clarify else broad_plan(query, "fallback")


def parse_score(value: Any) -> float:
    """A number cut to 0..1; anything else, booleans too, is 0."""
    return 0.0 if isinstance(value, bool) or not isinstance(value, (int, float)) else min(1.0, max(0.0, float(value)))


def parse_verdicts(reply: str, asked: Sequence[int]) -> list[dict]:
    """Verdicts on the documents asked about; a reply that can't be read keeps all."""
    found = json_object(reply)
    rows = found.get("verdicts") if found else None
    if not isinstance(rows, list):
        return [{"document_id": i, "keep": True, "reason": "", "score": 0.0} for i in asked]
    by = {r["document_id"]: r for r in rows if isinstance(r, dict) and r.get("document_id") in set(asked)}
    return [{"document_id": i, "keep": bool(by[i].get("keep", True)), "reason": _text(by[i].get("reason")) or "", "score": parse_score(by[i].get("score"))} if i in by else {"document_id": i, "keep": True, "reason": "", "score": 0.0} for i in asked]


def fence(text: str, nonce: str) -> str:
    """Untrusted text between marks that it can't contain."""
    return f"<<<DATA {nonce}>>>\n{text.replace('<<<', '').replace('>>>', '')}\n<<<END {nonce}>>>"


class Unsupported(Exception):
    """A model refused a parameter; `parameter` is its name."""

    def __init__(self, parameter: str) -> None:
        super().__init__(parameter)
        self.parameter = parameter


def with_fallbacks(call: Callable[..., str], models: Sequence[str], tries: int = 3, wait: Callable[[float], None] = time.sleep, **parameters: Any) -> str:
    """The reply of the first model that gives one. A model that refuses a parameter is asked without it; any other error is tried again after 1, 2, 4 ... seconds; then the next model's turn comes."""
    last: Exception | None = None
    for model in models:
        left, asked = dict(parameters), 0
        while asked < tries:
            try:
                return call(model, **left)
            except Unsupported as e:
                last = e
                if left.pop(e.parameter, None) is None:
                    break
            except Exception as e:  # noqa: BLE001  any provider error
                last, asked = e, asked + 1
                if asked < tries:
                    wait(2.0 ** (asked - 1))
    raise RuntimeError("no model gave a reply") from last


def classify(documents: DataFrame, classifier: Callable[[str], str]) -> DataFrame:
    """documents (with text) and `reply`, that of an injected classifier; null where it fails. parse_classification reads replies."""

    def run(frames):
        for pdf in frames:
            out = []
            for text in pdf["text"]:
                try:
                    out.append(classifier(text or ""))
                except Exception:  # noqa: BLE001  one document's failure is its own
                    out.append(None)
            yield pdf.assign(reply=out)

    return documents.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema) + ", reply string")


MOST_QUERY_CHARS = 4000


def normalise_query(query: str) -> str:
    """The question without outer white space, of 1 to MOST_QUERY_CHARS characters."""
    if len(query) > MOST_QUERY_CHARS:
        raise ValueError(f"a question has at most {MOST_QUERY_CHARS} characters")
    if not query.strip():
        raise ValueError("a question must not be blank")
    return query.strip()
