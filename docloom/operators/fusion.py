"""Reciprocal rank fusion of ranked lists, document selection, caps, relevance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.schemas import Tiers

#: fixed value: the constant of reciprocal rank fusion
RRF = 60


def fuse(ranked: DataFrame) -> DataFrame:
    """chunk_id, document_id, rrf, first: ranked has chunk_id, document_id, list_no, pos. first orders equal scores as first seen."""
    return ranked.groupBy("chunk_id", "document_id").agg(F.sum(1 / (RRF + F.col("pos"))).alias("rrf"), F.min(F.struct("list_no", "pos")).alias("first"))


def _best_first() -> list[Column]:
    return [F.round("rrf", 9).desc(), F.col("first").asc(), F.col("chunk_id").asc()]


def top_documents(fused: DataFrame, k: int) -> DataFrame:
    """document_id, best: the k documents with the best chunk."""
    best = fused.groupBy("document_id").agg(F.max(F.round("rrf", 9)).alias("best"), F.min("first").alias("first"))
    return best.orderBy(F.col("best").desc(), "first", "document_id").limit(max(0, k)).select("document_id", "best")


def capped_chunks(fused: DataFrame, k: int, per_document: int = 3) -> DataFrame:
    """Chunks of the k best documents, at most per_document each: the documents are chosen before the cap."""
    mine = fused.join(top_documents(fused, k).select("document_id"), "document_id", "left_semi")
    n = F.row_number().over(Window.partitionBy("document_id").orderBy(*_best_first()))
    return mine.withColumn("n", n).where(F.col("n") <= per_document).drop("n")


def merge_chunks(previous: DataFrame, more: DataFrame) -> DataFrame:
    """Both sets of chunks once; of a chunk in both the previous row stands."""
    both = previous.withColumn("_from", F.lit(0)).unionByName(more.withColumn("_from", F.lit(1)))
    one = both.groupBy("chunk_id").agg(F.min_by(F.struct(*[c for c in previous.columns if c != "chunk_id"]), "_from").alias("r"))
    return one.select("chunk_id", "r.*")


def relevance_tier(similarity: Column, tiers: Tiers = Tiers()) -> Column:  # noqa: B008
    """No similarity (a keyword hit alone) counts as good."""
    return F.when(similarity.isNull(), "good").when(similarity >= tiers.strong, "strong").when(similarity >= tiers.good, "good").when(similarity >= tiers.partial, "partial").otherwise("weak")


def relevance_signal(hits: DataFrame) -> DataFrame:
    """One row: best similarity and whether any keyword list hit. hits: distance (null in keyword lists), keyword."""
    return hits.agg((1 / (1 + F.min("distance"))).alias("similarity"), F.coalesce(F.bool_or("keyword"), F.lit(False)).alias("keyword_hit"))


def best_sources(chunks: DataFrame, documents: DataFrame, judged: DataFrame | None = None, tiers: Tiers = Tiers()) -> DataFrame:  # noqa: B008
    """A row for each document of chunks (chunk_id, document_id, text, rrf, similarity): best score, that chunk's snippet, best similarity, tier, and metadata if the index has it. By judge score, else rrf."""
    from docloom.functions.text import snippet

    best = chunks.groupBy("document_id").agg(
        F.max(F.round("rrf", 9)).alias("score"),
        F.min_by("text", F.struct((-F.round("rrf", 9)).alias("s"), "chunk_id")).alias("text"),
        F.max("similarity").alias("similarity"),
    )
    meta = documents.select(F.col("id").alias("document_id"), "title", "created")
    out = best.join(meta, "document_id", "left").withColumn("snippet", snippet(F.col("text"))).withColumn("tier", relevance_tier(F.col("similarity"), tiers))
    out = out.withColumn("judge", F.lit(None).cast("double")) if judged is None else out.join(judged.select("document_id", F.col("score").alias("judge")), "document_id", "left")
    return out.select("document_id", "title", "created", "snippet", "score", "tier", "judge").orderBy(F.coalesce("judge", "score").desc(), F.col("score").desc(), "document_id")


def trace_order(chunks: DataFrame) -> DataFrame:
    """By similarity, those without one last."""
    return chunks.orderBy(F.col("similarity").desc_nulls_last(), "chunk_id")


def merge_verdicts(documents: DataFrame, verdicts: DataFrame) -> DataFrame:
    """A verdict for each document: a missing one keeps with score 0; scores are cut to 0..1; verdicts on other documents go. documents: document_id."""
    v = verdicts.groupBy("document_id").agg(F.first(F.struct("keep", "score")).alias("v"))
    return documents.join(v, "document_id", "left").select("document_id", F.coalesce("v.keep", F.lit(True)).alias("keep"), F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("v.score"))), F.lit(0.0)).alias("score"))


def kept_or_all(documents: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen documents; all of them if nothing is chosen (an answer without citations)."""
    none = chosen.join(documents, "document_id", "left_semi").groupBy().agg((F.count(F.lit(1)) == 0).alias("_none"))
    marked = documents.join(chosen.select("document_id").distinct().withColumn("_c", F.lit(True)), "document_id", "left").join(F.broadcast(none))
    return marked.where(F.col("_none") | F.col("_c")).drop("_c", "_none")
