"""Text functions as columns. White space is Unicode's: Java's \\s alone is ASCII, hence (?U)."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"

# fixed values: organisation suffixes
COMPANY_SUFFIXES = ("ab", "as", "bv", "co", "company", "corp", "corporation", "gmbh", "inc", "incorporated", "limited", "llc", "ltd", "oy", "plc", "sa", "sarl", "spa")
# fixed values: phrases of a model that refuses
REFUSAL_PHRASES = (
    "i can't assist",
    "i cannot assist",
    "i can't help with transcrib",
    "i cannot help with transcrib",
    "i'm sorry, i can't assist with that.",
    "chatgpt refused to transcribe",
)
REFUSAL_MARK = "CHATGPT REFUSED TO TRANSCRIBE"
REFUSAL_MOST_CHARS = 200
# fixed values: document types that say nothing
GENERIC_TYPES = ("document", "documents", "general", "misc", "miscellaneous", "n/a", "na", "none", "other", "unknown", "unspecified")
# fixed values: words that hint at a period
TEMPORAL_WORDS = (
    "last", "since", "ago", "year", "years", "month", "months", "week", "weeks", "day", "days", "yesterday", "today", "recent", "past", "before", "after", "during", "between",
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
)

#: Latin letters whose decomposition is a base letter and marks, and those base letters.
_FOLDED = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if len(unicodedata.normalize("NFD", chr(c))) > 1]
ACCENTED, PLAIN = "".join(a for a, _ in _FOLDED), "".join(b for _, b in _FOLDED)


def fold(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def collapse(text: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def normalise_simple(text: Column) -> Column:
    return collapse(F.lower(text))


def normalise_name(text: Column) -> Column:
    """Letters a-z, digits and spaces only, without trailing company suffixes; a name of suffixes alone is empty."""
    plain = collapse(F.regexp_replace(F.lower(text), r"(?U)[^a-z0-9\s]", ""))
    return F.trim(F.regexp_replace(plain, rf"(?:(?:^| )(?:{'|'.join(COMPANY_SUFFIXES)}))+$", ""))


def normalise_language(text: Column) -> Column:
    """A two-letter code, `und`, or null for no value."""
    t = F.lower(F.trim(text))
    prefix = F.regexp_extract(t, r"^(\p{L}{2})(?:[-_].*)?$", 1)
    return F.when(text.isNull() | (text == ""), F.lit(None).cast("string")).when(prefix != "", prefix).otherwise("und")


def snippet(text: Column, most: int = 280, ellipsis: bool = True) -> Column:
    """A one-line preview; the keyword form has no ellipsis and isn't trimmed at the cut."""
    line = collapse(text)
    cut = F.substring(line, 1, most)
    return F.when(F.length(line) <= most, line).otherwise(F.concat(F.rtrim(cut), F.lit("…")) if ellipsis else cut)


def contains_any(text: Column, phrases: Iterable[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(text, F.lit(p.lower()))
    return out


def contains_redacted(text: Column) -> Column:
    return text.rlike(r"(?i)\[[^\]]*redacted[^\]]*\]")


def is_error_content(text: Column, phrases: Sequence[str] = REFUSAL_PHRASES) -> Column:
    return contains_redacted(text) | contains_any(F.lower(text), phrases)


def is_model_refusal(text: Column, phrases: Sequence[str] = REFUSAL_PHRASES, mark: str = REFUSAL_MARK) -> Column:
    """The mark anywhere; a phrase only where the text is short enough to be nothing else."""
    low = F.lower(text)
    return F.contains(low, F.lit(mark.lower())) | ((F.length(text) < REFUSAL_MOST_CHARS) & contains_any(low, phrases))


def is_generic_type(text: Column) -> Column:
    return text.isNull() | (text == "") | normalise_simple(text).isin(*GENERIC_TYPES)


def is_trivial_query(text: Column) -> Column:
    """One to three words without digit, identifier sign, temporal word or a capital after the first word."""
    words = F.filter(F.split(collapse(text), " "), lambda w: w != "")
    later = F.slice(words, 2, 3)
    return (
        F.size(words).between(1, 3)
        & ~text.rlike(r"\p{Nd}")
        & ~text.rlike("[@#/£$€%]")
        & ~F.exists(words, lambda w: F.lower(w).isin(*TEMPORAL_WORDS))
        & ~F.exists(later, lambda w: w.rlike(r"^\p{Lu}"))
    )


def name_key(text: Column) -> Column:
    """Letters a-z and digits only."""
    return F.regexp_replace(fold_compatible(text), "[^a-z0-9]", "")


def name_tokens(text: Column, without: Sequence[str] = ("of", "the", "and", "for", "to")) -> Column:
    """Sorted distinct words of a name without connectives."""
    parts = F.split(fold_compatible(text), "[^a-z0-9]+")
    return F.array_sort(F.array_distinct(F.filter(parts, lambda w: (w != "") & ~w.isin(*without))))


def _all_chars() -> Iterable[str]:
    return (chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000)


def _compatible() -> tuple[dict[str, str], dict[str, str]]:
    """Characters whose compatibility form has an ASCII letter or digit, or begins with a combining mark, and that form: of one character, and of several."""
    one, several = {}, {}
    for c in _all_chars():
        n = unicodedata.normalize("NFKC", c)
        if n != c and (any(x.isascii() and x.isalnum() for x in n) or unicodedata.combining(n[0])):
            (one if len(n) == 1 else several)[c] = n
    several["\u0130"] = "I\u0307"  # its lower case has an i, unless a mark that follows makes the I another letter
    return one, several


def _ranges(chars: Iterable[str]) -> str:
    """The inside of a regex class of these characters."""
    out: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" if a < b else rf"\x{{{a:X}}}" for a, b in out)


def _composing() -> str:
    """A regex of the ASCII letters that marks behind them make letters beyond ASCII.

    A mark composes with the letter unless one of its own class stands between them; marks of other classes
    may. Marks between are looked for in the blocks of marks for all scripts. The dotted capital I keeps its letter in lower case."""
    pairs: dict[int, dict[frozenset[str], list[str]]] = {}
    by_letter: dict[tuple[str, int], set[str]] = {}
    for c in _all_chars():
        d = unicodedata.normalize("NFD", c)
        if len(d) == 2 and d[0].isascii() and d[0].isalpha() and unicodedata.normalize("NFC", d) == c and not any(x.isascii() for x in c.lower()):
            by_letter.setdefault((d[0], unicodedata.combining(d[1])), set()).add(d[1])
    for (letter, kind), found in by_letter.items():
        pairs.setdefault(kind, {}).setdefault(frozenset(found), []).append(letter)
    blocks = [chr(c) for a, b in ((0x300, 0x36F), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x20D0, 0x20FF), (0xFE20, 0xFE2F)) for c in range(a, b + 1)]
    some = []
    for kind, groups in sorted(pairs.items()):
        between = _ranges(m for m in blocks if unicodedata.combining(m) not in (0, kind))
        some += [f"[{''.join(letters)}][{between}]*[{_ranges(found)}]" for found, letters in groups.items()]
    return "|".join(some)


_ONE, _SEVERAL = _compatible()
_COMPOSED = _composing()
#: Code points of a chunk of the table of longer forms, as a power of two.
_CHUNK = 7


def _longer_forms() -> Column:
    """Chunk of code points -> character -> form."""
    chunks: dict[int, dict[str, str]] = {}
    for c, n in _SEVERAL.items():
        chunks.setdefault(ord(c) >> _CHUNK, {})[c] = n
    return F.from_json(F.lit(json.dumps(chunks)), "map<string,map<string,string>>")


def fold_compatible(text: Column) -> Column:
    """Lower case of the compatibility form, as far as letters a-z and digits go: what has another form by NFKC gets it, one or several characters, and
    an ASCII letter that a mark makes another letter becomes a letter beyond ASCII. Other characters may keep their form. Plain ASCII costs two tests."""
    one = F.translate(text, "".join(_ONE), "".join(_ONE.values()))
    forms = _longer_forms()
    char_form = lambda c: F.coalesce(forms[F.call_function("shiftright", F.ascii(c), F.lit(_CHUNK)).cast("string")][c], c)
    several = F.when(one.rlike(f"[{_ranges(_SEVERAL)}]"), F.array_join(F.transform(F.split(one, ""), char_form), "")).otherwise(one)
    composed = F.when(several.rlike(r"\p{Mn}"), F.regexp_replace(several, _COMPOSED, "\u00e9")).otherwise(several)
    return F.lower(F.when(text.rlike(r"[^\x00-\x7F]"), composed).otherwise(text))


#: Lower-case characters that folding changes: to one character, and to several.
_FOLDS = {c: c.casefold() for c in _all_chars() if c.lower() == c != c.casefold()}
_FOLD_ONE, _FOLD_SEVERAL = {c: f for c, f in _FOLDS.items() if len(f) == 1}, {c: f for c, f in _FOLDS.items() if len(f) > 1}


def casefold(text: Column) -> Column:
    """Case folding, as names are compared; a final sigma folds like any other."""
    folded = F.translate(F.lower(text), "".join(_FOLD_ONE), "".join(_FOLD_ONE.values()))
    table = F.from_json(F.lit(json.dumps(_FOLD_SEVERAL)), "map<string,string>")
    several = F.array_join(F.transform(F.split(folded, ""), lambda c: F.coalesce(table[c], c)), "")
    return F.when(folded.rlike(f"[{_ranges(_FOLD_SEVERAL)}]"), several).otherwise(folded)


def page_ranges(pages: Column) -> Column:
    """A sorted array of distinct page numbers as `1-3, 7`."""
    p = F.array_sort(F.array_distinct(pages))
    # a page starts a range if its predecessor isn't listed, and ends one if its successor isn't
    starts = F.filter(p, lambda x: ~F.array_contains(p, x - 1))
    ends = F.filter(p, lambda x: ~F.array_contains(p, x + 1))
    return F.array_join(F.zip_with(starts, ends, lambda a, b: F.when(a == b, a.cast("string")).otherwise(F.concat_ws("-", a.cast("string"), b.cast("string")))), ", ")
