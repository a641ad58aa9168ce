"""Tag lists: stable case-insensitive distinct, stop lists, required and optional tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import normalise_name, normalise_simple

# fixed values: tags that collide with automation markers
BLACKLISTED = ("ai", "error", "indexed", "new")


def dedupe_tags(tags: Column) -> Column:
    """Trimmed tags without blanks; of those equal in lower case the first stays in its place."""
    trimmed = F.filter(F.transform(tags, lambda t: F.trim(t)), lambda t: t != "")
    return F.aggregate(trimmed, F.array().cast("array<string>"), lambda seen, t: F.when(F.exists(seen, _equals(t)), seen).otherwise(F.concat(seen, F.array(t))))


def _equals(t: Column):
    return lambda s: F.lower(s) == F.lower(t)


def without_blacklisted(tags: Column) -> Column:
    return F.filter(dedupe_tags(tags), lambda t: ~normalise_simple(t).isin(*BLACKLISTED))


def without_redundant(tags: Column, correspondent: Column, document_type: Column, person: Column) -> Column:
    """Tags that don't repeat the correspondent (company suffixes aside), the type or the person."""
    who, what, whom = normalise_name(F.coalesce(correspondent, F.lit(""))), normalise_simple(F.coalesce(document_type, F.lit(""))), normalise_simple(F.coalesce(person, F.lit("")))

    def stays(t: Column) -> Column:
        simple = normalise_simple(t)
        return ~((who != "") & ((simple == who) | (normalise_name(t) == who)) | (what != "") & (simple == what) | (whom != "") & (simple == whom))

    return F.filter(dedupe_tags(tags), stays)


def model_tags(text: Column) -> Column:
    """Models named in `Transcribed by model:` lines."""
    named = F.regexp_extract_all(text, F.lit(r"(?i)transcribed by model:\s*([^\r\n]+)"), F.lit(1))
    return dedupe_tags(F.flatten(F.transform(named, lambda m: F.split(m, ","))))


def enrich_tags(tags: Column, text: Column, year: Column, country: str = "", limit: int = 5) -> Column:
    """Model, year and country tags first, then at most limit others; all in lower case."""
    required = dedupe_tags(F.concat(model_tags(text), F.array(year), F.array(F.lit(country))))
    lower = F.transform(required, lambda t: F.lower(t))
    others = F.filter(dedupe_tags(tags), lambda t: ~F.array_contains(lower, F.lower(t)))
    return F.transform(dedupe_tags(F.concat(required, F.slice(others, 1, max(0, limit)))), lambda t: F.lower(t))


def without_pipeline_tags(tags: Column, pipeline: tuple[int, ...]) -> Column:
    return F.array_except(tags, F.array(*[F.lit(t).cast("long") for t in pipeline]))


def set_custom_field(fields: Column, key: int, value: Column) -> Column:
    """An array of struct(field, value) with that field's value replaced in place, or added at the end."""
    new = F.struct(F.lit(key).cast("long").alias("field"), value.alias("value"))
    there = F.exists(fields, lambda f: f["field"] == key)
    return F.when(there, F.transform(fields, lambda f: F.when(f["field"] == key, new).otherwise(f))).otherwise(F.concat(F.coalesce(fields, F.array().cast("array<struct<field:bigint,value:string>>")), F.array(new)))
