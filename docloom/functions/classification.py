"""Classifier replies as columns: JSON text, fenced or after other words, to a struct of cleaned fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the text fields of a reply
FIELDS = ("title", "correspondent", "document_date", "document_type", "language", "person")


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _text_of(value: Column) -> Column:
    """A JSON string without outer white space; anything else, numbers and booleans too, counts as absent."""
    return F.when(F.schema_of_variant(value) == "STRING", _trimmed(F.try_variant_get(value, "$", "string"))).otherwise("")


def parse_classification(reply: Column) -> Column:
    """struct of FIELDS and tags; null if the reply holds no JSON object. One text may stand for a list of tags; blank tags go."""
    found = F.try_parse_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0))
    field = lambda name: F.try_variant_get(found, f"$.{name}", "variant")
    tags = field("tags")
    one = F.array(_text_of(tags))
    many = F.transform(F.coalesce(F.try_variant_get(tags, "$", "array<string>"), F.array().cast("array<string>")), _trimmed)
    cleaned = F.filter(F.when(F.schema_of_variant(tags) == "STRING", one).otherwise(many), lambda t: t != "")
    parsed = F.struct(*[F.coalesce(_text_of(field(n)), F.lit("")).alias(n) for n in FIELDS], cleaned.alias("tags"))
    return F.when(F.coalesce(F.schema_of_variant(found).startswith("OBJECT"), F.lit(False)), parsed)


def is_empty_classification(parsed: Column) -> Column:
    """No text in any field and no tag."""
    blank = lambda c: F.coalesce(_trimmed(c), F.lit("")) == ""
    out = ~F.exists(F.coalesce(parsed["tags"], F.array().cast("array<string>")), lambda t: ~blank(t))
    for name in FIELDS:
        out = out & blank(parsed[name])
    return out
