"""Predicates that narrow documents before anything is ranked; plain columns, so they reach the scan."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.dates import next_day
from docloom.functions.text import ascii_lower
from docloom.schemas import SearchFilters


def conjunction(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def document_filter(f: SearchFilters) -> Column:
    """Dates are compared as strings; the upper bound is the start of the next day, and none if date_to isn't a date. Null never matches."""
    parts = []
    if f.date_from is not None:
        parts.append(F.col("created") >= f.date_from)
    if f.date_to is not None and (end := next_day(f.date_to)):
        parts.append(F.col("created") < end)
    if f.correspondent_id is not None:
        parts.append(F.col("correspondent_id") == f.correspondent_id)
    if f.document_type_id is not None:
        parts.append(F.col("document_type_id") == f.document_type_id)
    parts += [F.array_contains("tag_ids", F.lit(t).cast("long")) for t in f.tag_ids]
    return conjunction(parts)


def text_filter(term: str, *columns: str) -> Column:
    """The term, literally, in any of the columns, ASCII case aside."""
    needle = F.lit("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in term))
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(ascii_lower(F.col(c)), needle), F.lit(False)) for c in columns])


def pipeline_filter(pre: int, post: int | None, processing: int | None) -> Column:
    """Waiting for a pipeline step: its tag is there, the tags for done and running aren't."""
    without = [~F.array_contains("tag_ids", F.lit(t).cast("long")) for t in (post, processing) if t is not None]
    return conjunction([F.array_contains("tag_ids", F.lit(pre).cast("long")), *without])


def stale_tags(documents: DataFrame, pre: int, post: int | None, processing: int | None) -> DataFrame:
    """id, tag_ids for documents that are done but still tagged as waiting: without the tags for waiting and running."""
    if post is None:
        return documents.select("id", "tag_ids").limit(0)
    drop = F.array(*[F.lit(t).cast("long") for t in (pre, processing) if t is not None])
    has = lambda t: F.array_contains("tag_ids", F.lit(t).cast("long"))
    return documents.where(has(pre) & has(post)).select("id", F.array_except("tag_ids", drop).alias("tag_ids"))


def indexable(content: Column, error_tag: int | None) -> Column:
    """Some text, and no error tag."""
    some = F.coalesce(content.rlike(r"(?U)\S"), F.lit(False))
    return some if error_tag is None else some & ~F.array_contains("tag_ids", F.lit(error_tag).cast("long"))


def irrelevant(similarity: Column, keyword_hit: Column, least: float = 0.60) -> Column:
    """Too dissimilar at best, and no keyword hit; without a similarity never."""
    return F.coalesce(similarity < least, F.lit(False)) & ~keyword_hit
