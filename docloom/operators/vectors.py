"""Exact vector search. The distance is a column over arrays; top-k is a per-task heap (TakeOrderedAndProject)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """Null for null vectors and those without direction."""
    return 1 - F.try_divide(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))


def vector_literal(values: Sequence[float]) -> Column:
    return F.from_json(F.lit(str([float(v) for v in values])), "array<double>")


def similarity(distance: Column) -> Column:
    """1 / (1 + distance); null stays null."""
    return 1 / (1 + distance)


def vector_search(chunks: DataFrame, documents: DataFrame | None, query: Sequence[float], k: int, where: Column | None = None) -> DataFrame:
    """The k chunks nearest to the query: chunk_id, document_id, distance. A filter on documents applies before the ranking."""
    if k <= 0:
        return chunks.limit(0).select("chunk_id", "document_id", F.lit(0.0).alias("distance"))
    if documents is not None and where is not None:
        chunks = chunks.join(documents.where(where).select(F.col("id").alias("document_id")), "document_id", "left_semi")
    distance = cosine_distance(F.col("embedding"), vector_literal(query))
    return chunks.select("chunk_id", "document_id", distance.alias("distance")).where("distance IS NOT NULL").orderBy(F.round("distance", 6), "chunk_id").limit(k)


#: Bytes of query vectors, as doubles, that one pass over the chunks takes; rows of one product.
QUERY_BYTES, PRODUCT_ROWS = 16 << 20, 1024


class _Nearest:
    """The k nearest chunks so far of each query of a block: distances in millionths, chunk and document ids, nearest first."""

    def __init__(self, queries: np.ndarray, k: int) -> None:
        self.queries, self.k = queries, k
        self.held = [np.zeros((3, 0), dtype=np.int64) for _ in queries]
        self.floor = np.full(len(queries), np.iinfo(np.int64).max)

    def add(self, vectors: np.ndarray, chunk_ids: np.ndarray, document_ids: np.ndarray) -> None:
        size = np.sqrt((vectors * vectors).sum(axis=1))
        there = size > 0
        vectors, chunk_ids, document_ids = vectors[there] / size[there, None], chunk_ids[there], document_ids[there]
        far = np.rint((1 - self.queries @ vectors.T) * 1e6).astype(np.int64)
        for q in np.flatnonzero((far <= self.floor[:, None]).any(axis=1)):
            near = np.flatnonzero(far[q] <= self.floor[q])
            some = np.concatenate([self.held[q], np.stack([far[q][near], chunk_ids[near], document_ids[near]])], axis=1)
            self.held[q] = some[:, np.lexsort((some[1], some[0]))[: self.k]]
            if self.held[q].shape[1] == self.k:
                self.floor[q] = self.held[q][0, -1]


def _pass(chunks: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """query_id, far, chunk_id, document_id: for each task the k nearest of its chunks to each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Nearest(queries, k)
        for b in batches:
            for i in range(0, b.num_rows, PRODUCT_ROWS):
                part = b.slice(i, PRODUCT_ROWS)
                lists = part.column("embedding")
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
                if (sizes != queries.shape[1]).any():
                    raise ValueError(f"queries have {queries.shape[1]} dimensions, a chunk has another number")
                vectors = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, queries.shape[1])
                best.add(vectors, part.column("chunk_id").to_numpy(), part.column("document_id").to_numpy())
        count = [h.shape[1] for h in best.held]
        rows = np.concatenate(best.held, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, count)), *map(pa.array, rows)], names=["query_id", "far", "chunk_id", "document_id"])

    return chunks.mapInArrow(run, "query_id long, far long, chunk_id long, document_id long")


def vector_search_batch(chunks: DataFrame, documents: DataFrame | None, queries: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """The k chunks nearest to each of many queries (query_id, embedding): query_id, chunk_id, document_id, distance (to six places), rank.

    Queries go in blocks of at most QUERY_BYTES, one pass over the chunks each. A task multiplies its
    chunks' vectors, PRODUCT_ROWS at a time, with the block and keeps k rows a query; only those are
    shuffled and merged. Vectors that are null or without direction have no distance. query_id must be unique."""
    spark = chunks.sparkSession
    empty = spark.createDataFrame([], "query_id long, far long, chunk_id long, document_id long")
    if documents is not None and where is not None:
        chunks = chunks.join(documents.where(where).select(F.col("id").alias("document_id")), "document_id", "left_semi")
    rows = chunks.where("embedding IS NOT NULL").select("chunk_id", "document_id", "embedding")
    found, ids, block = [], [], []
    for q in queries.where("embedding IS NOT NULL").select("query_id", "embedding").toLocalIterator() if k > 0 else ():
        v = np.array(q.embedding, dtype=np.float64)
        if not v.any():
            continue
        ids.append(q.query_id)
        block.append(v / np.sqrt(v @ v))
        if len(block) * block[0].nbytes >= QUERY_BYTES:
            found.append(_pass(rows, np.array(ids, dtype=np.int64), np.stack(block), k))
            ids, block = [], []
    if block:
        found.append(_pass(rows, np.array(ids, dtype=np.int64), np.stack(block), k))
    merged = empty
    for f in found:
        merged = merged.unionByName(f)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("far", "chunk_id"))
    return merged.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "chunk_id", "document_id", (F.col("far") / 1e6).alias("distance"), "rank")


class Breaker:
    """Stops calls of a provider that keeps failing: after `failures` in a row a task makes no more, and no further wave starts.

    Tasks report through accumulators, which the driver reads between waves. It stays open until reset."""

    def __init__(self, spark: SparkSession, failures: int = 3) -> None:
        if failures < 1:
            raise ValueError("failures must be at least 1")
        self.failures = failures
        self._spark = spark
        self.reset()

    def reset(self) -> None:
        self.calls, self.tripped = self._spark.sparkContext.accumulator(0), self._spark.sparkContext.accumulator(0)

    def is_open(self) -> bool:
        return self.tripped.value > 0


class BreakerOpen(RuntimeError):
    """Calls were stopped; nothing of the work under way counts."""


def embed(chunks: DataFrame, embedder, batch: int = 96, breaker: Breaker | None = None) -> DataFrame:
    """chunks with embeddings from an injected embedder (texts -> vectors), `batch` texts a call. The texts of a failing batch are tried one by one; those that fail get null vectors, and so do those that an open breaker leaves untried."""
    most, calls, tripped = (breaker.failures, breaker.calls, breaker.tripped) if breaker else (None, None, None)

    def run(frames):
        streak = 0

        def vectors(texts: list[str]) -> list:
            nonlocal streak
            if most is not None and streak >= most:
                return [None] * len(texts)
            try:
                if calls is not None:
                    calls.add(1)
                found = [[float(x) for x in v] for v in embedder(texts)]
                streak = 0
                return found
            except Exception:  # noqa: BLE001  any provider error: keyword search still works
                streak += 1
                if most is not None and streak == most:
                    tripped.add(1)
                return [None] if len(texts) == 1 else [v for t in texts for v in vectors([t])]

        for pdf in frames:
            out = []
            for i in range(0, len(pdf), batch):
                out += vectors(pdf["text"].iloc[i : i + batch].tolist())
            yield pdf.assign(embedding=out)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunks.schema if f.name != "embedding")
    return chunks.drop("embedding").mapInPandas(run, f"{fields}, embedding array<float>")


#: Chunks of the first wave, which one task tries, and the factor by which waves grow.
FIRST_WAVE, WAVE_GROWTH = 384, 8
_BUCKETS = 1 << 20


def embed_in_waves(chunks: DataFrame, embedder, breaker: Breaker, write: Callable[[DataFrame], None], batch: int = 96) -> None:
    """Embeds chunks (chunk_id, text) wave by wave, each written before the next starts, and raises BreakerOpen as soon as the breaker opens.

    The first wave is small and one task's, so a provider that is down costs `failures` calls; later waves grow, and one
    that breaks down within a wave costs at most so many calls a task."""
    chunks = chunks.persist(StorageLevel.DISK_ONLY)
    try:
        bucket, n = F.pmod(F.xxhash64("chunk_id"), F.lit(_BUCKETS)), chunks.count()
        low, size = 0, FIRST_WAVE
        while low < _BUCKETS:
            if breaker.is_open():
                raise BreakerOpen("the embedding provider keeps failing")
            high = min(_BUCKETS, low + max(1, math.ceil(_BUCKETS * size / max(n, 1))))
            wave = chunks.where((bucket >= low) & (bucket < high))
            write(embed(wave.coalesce(1) if low == 0 else wave, embedder, batch, breaker))
            low, size = high, size * WAVE_GROWTH
        if breaker.is_open():
            raise BreakerOpen("the embedding provider keeps failing")
    finally:
        chunks.unpersist()
