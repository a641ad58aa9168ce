"""Keyword ranking over chunks and documents, with paging."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.filters import document_filter
from docloom.operators.fts import BlockIndex, StoredIndex, scores, top_chunks
from docloom.schemas import SearchFilters


def _allowed(documents: DataFrame, filters: SearchFilters | None) -> DataFrame | None:
    if filters is None or filters.is_empty():
        return None
    return documents.where(document_filter(filters)).select(F.col("id").alias("document_id"))


def keyword_search(source: DataFrame | StoredIndex | BlockIndex, documents: DataFrame, query: str, k: int, filters: SearchFilters | None = None) -> DataFrame:
    """The k best chunks of an index or of chunks with texts: chunk_id, document_id, bm25. A block index skips blocks that can't hold one."""
    if isinstance(source, BlockIndex):
        return top_chunks(source, query, k, _allowed(documents, filters))
    return scores(source, query, _allowed(documents, filters)).orderBy(F.round("bm25", 6), "chunk_id").limit(max(0, k))


def best_chunk_each(scored: DataFrame) -> DataFrame:
    """Each document's best chunk; a sum-like aggregate, so a document of any number of chunks costs one row a task."""
    return scored.groupBy("document_id").agg(F.min(F.struct(F.round("bm25", 6).alias("bm25"), "chunk_id")).alias("b")).select("document_id", F.col("b.chunk_id").alias("chunk_id"), F.col("b.bm25").alias("bm25"))


def keyword_documents(source: DataFrame | StoredIndex | BlockIndex, documents: DataFrame, query: str, limit: int, offset: int = 0, filters: SearchFilters | None = None) -> DataFrame:
    """A page of documents by their best chunk."""
    best = best_chunk_each(scores(source, query, _allowed(documents, filters)))
    return best.orderBy("bm25", "chunk_id").offset(max(0, offset)).limit(max(0, limit))


def keyword_document_count(source: DataFrame | StoredIndex | BlockIndex, documents: DataFrame, query: str, filters: SearchFilters | None = None) -> DataFrame:
    return scores(source, query, _allowed(documents, filters)).agg(F.countDistinct("document_id").alias("total"))


def page(df: DataFrame, number: int, size: int, most: int = 100) -> DataFrame:
    """Page `number` (from 1) of `size` rows (1 to most) of an ordered frame."""
    size = min(max(1, size), most)
    return df.offset((max(1, number) - 1) * size).limit(size)


def rank_in(df: DataFrame, list_no: int, *order) -> DataFrame:
    """chunk_id, document_id, list_no and pos of a short ranked list: its rows are numbered in one task, so it must be limited already."""
    return df.select("chunk_id", "document_id", F.lit(list_no).alias("list_no"), F.row_number().over(Window.orderBy(*order)).alias("pos"))
