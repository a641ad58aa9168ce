"""Browsing: documents with their names, filters, sorting and paging; facets; statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators.filters import document_filter, text_filter
from docloom.operators.ranked import page
from docloom.schemas import SearchFilters

SORTS = {"created": "created", "title": "title", "indexed_at": "indexed_at", "added": "indexed_at"}


def _dimension(taxonomy: DataFrame, kind: str, key: str, name: str) -> DataFrame:
    """A few thousand names at most: broadcast by Spark's own size check."""
    return taxonomy.where(F.col("kind") == kind).select(F.col("id").alias(key), F.col("name").alias(name))


def with_names(documents: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """documents with correspondent and document_type names, null where there is none."""
    out = documents.join(_dimension(taxonomy, "correspondent", "correspondent_id", "correspondent"), "correspondent_id", "left")
    return out.join(_dimension(taxonomy, "document_type", "document_type_id", "document_type"), "document_type_id", "left")


def tag_names(documents: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """id, tags: names in the order of tag_ids; unknown ids go."""
    at = documents.select("id", F.posexplode("tag_ids").alias("pos", "tag_id"))
    named = at.join(_dimension(taxonomy, "tag", "tag_id", "name"), "tag_id")
    lists = named.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("tags"))
    return documents.select("id").join(lists, "id", "left").select("id", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))


def browse(documents: DataFrame, taxonomy: DataFrame, filters: SearchFilters = SearchFilters(), text: str | None = None) -> DataFrame:  # noqa: B008
    """Documents with names that pass the filters and hold the text in title, correspondent or type."""
    named = with_names(documents.where(document_filter(filters)), taxonomy)
    return named.where(text_filter(text, "title", "correspondent", "document_type")) if text else named


def browse_page(found: DataFrame, sort: str = "created", descending: bool = True, number: int = 1, size: int = 20) -> DataFrame:
    """One page; only the listed sort keys; nulls come first ascending and last descending; the id breaks ties in the same direction."""
    if sort not in SORTS:
        raise ValueError(f"can't sort by {sort}")
    key, tie = F.col(SORTS[sort]), F.col("id")
    order = [key.desc_nulls_last(), tie.desc()] if descending else [key.asc_nulls_first(), tie.asc()]
    return page(found.orderBy(*order), number, size)


def facet_counts(documents: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """kind, id, name, n of every taxonomy entry, unused ones with 0; a tag twice in one list counts twice."""
    used = documents.select(
        F.explode(
            F.concat(
                F.array(F.struct(F.lit("correspondent").alias("kind"), F.col("correspondent_id").alias("id")), F.struct(F.lit("document_type").alias("kind"), F.col("document_type_id").alias("id"))),
                F.transform("tag_ids", lambda t: F.struct(F.lit("tag").alias("kind"), t.alias("id"))),
            )
        ).alias("x")
    ).where("x.id IS NOT NULL")
    counts = used.groupBy("x").agg(F.count(F.lit(1)).alias("n")).select("x.kind", "x.id", "n")
    return taxonomy.join(counts, ["kind", "id"], "left").select("kind", "id", "name", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def date_bounds(documents: DataFrame) -> DataFrame:
    """One row: least and greatest created, null if empty."""
    return documents.agg(F.nullif(F.min("created"), F.lit("")).alias("date_from"), F.nullif(F.max("created"), F.lit("")).alias("date_to"))


def index_stats(documents: DataFrame, chunks: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """One row: counts, newest indexing time, the version string of caches, and meta values."""
    d = documents.agg(F.count(F.lit(1)).alias("documents"), F.max("indexed_at").alias("last_indexed_at"))
    c = chunks.agg(F.count(F.lit(1)).alias("chunks"))
    one = d.join(F.broadcast(c))  # one row each
    one = one.withColumn("version", F.concat_ws(":", F.col("documents").cast("string"), F.col("chunks").cast("string"), F.coalesce("last_indexed_at", F.lit("none"))))
    if meta is not None:
        keys = meta.agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in ("last_reconcile_at", "embedding_model")])
        one = one.join(F.broadcast(keys))
    return one


def integrity(documents: DataFrame, chunks: DataFrame, index: DataFrame) -> DataFrame:
    """problem, n: chunks without a document, wrong chunk counts, postings without a chunk; no row is a sound store."""
    orphans = chunks.join(documents.select(F.col("id").alias("document_id")), "document_id", "left_anti").agg(F.count(F.lit(1)).alias("n")).withColumn("problem", F.lit("orphan chunks"))
    real = chunks.groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias("real"))
    counts = documents.join(real, "id", "left").where(F.coalesce("real", F.lit(0)) != F.coalesce("chunk_count", F.lit(0))).agg(F.count(F.lit(1)).alias("n")).withColumn("problem", F.lit("chunk counts"))
    lost = index.select("chunk_id").distinct().join(chunks, "chunk_id", "left_anti").agg(F.count(F.lit(1)).alias("n")).withColumn("problem", F.lit("orphan postings"))
    return orphans.unionByName(counts).unionByName(lost).where("n > 0").select("problem", "n")
