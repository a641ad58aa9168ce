"""One cycle of incremental indexing over a store: scan, diff, chunk, embed, upsert, retry, sweep."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom import schemas
from docloom.functions.dates import normalise_timestamp
from docloom.operators.chunking import chunk_documents, chunk_key
from docloom.operators.fts import postings, token_counts
from docloom.operators.sync import content_hash, deletion_candidates, index_outcomes, latest_each, light_diff, next_watermark, retry_documents, scan_since, update_failures
from docloom.operators.vectors import Breaker, embed, embed_in_waves
from docloom.sources.store import IndexStore, merged_metadata


@dataclass(frozen=True)
class Report:
    indexed: int
    metadata_only: int
    skipped: int
    unchanged: int
    deleted: int
    watermark: str | None
    failed: int = 0
    given_up: int = 0


#: Segments of a table at which a cycle compacts the store.
MOST_SEGMENTS = 24


def plain_chunk_rows(source: DataFrame, size: int = 2000, overlap: int = 256) -> DataFrame:
    """Chunk rows, without vectors, of source documents (id, text)."""
    chunks = chunk_documents(source, size, overlap, "id").withColumn("chunk_id", chunk_key(F.col("document_id"), F.col("chunk_index")))
    return chunks.select("chunk_id", "document_id", "chunk_index", "text", "page_hint")


def chunk_rows(source: DataFrame, embedder, size: int = 2000, overlap: int = 256) -> DataFrame:
    """Chunk rows, with vectors, of source documents (id, text)."""
    return embed(plain_chunk_rows(source, size, overlap), embedder)


def document_rows(source: DataFrame, chunks: DataFrame, now: str) -> DataFrame:
    """Document rows of source documents (id, title, ..., modified, text) and their chunks."""
    counts = chunks.groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).cast("int").alias("chunk_count"), F.max("page_hint").alias("page_count"))
    return source.join(counts, "id", "left").select("id", "title", "correspondent_id", "document_type_id", "tag_ids", "created", normalise_timestamp(F.col("modified")).alias("modified"), content_hash(F.col("text")).alias("content_hash"), "page_count", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.lit(now).alias("indexed_at"))


def run_cycle(store: IndexStore, source: DataFrame, embedder, now: str, error_tag: int | None = None, sweep: bool = True, expected: int | None = None, stream: bool = False, most_segments: int = MOST_SEGMENTS, breaker: Breaker | None = None) -> Report:
    """source: id, title, correspondent_id, document_type_id, tag_ids, created, modified, text.

    Rows since the watermark less its overlap are read again; those unchanged are left out, so a
    repeated cycle does nothing. A new store reads all. Documents that failed before are tried again
    until they have failed MOST_FAILURES times in a row. A document whose text can't be embedded
    fails alone: it isn't written, and keeps what the index has of it. All changes of a cycle are one
    generation, which adds the changed rows; the store is compacted at most_segments.

    breaker: if embedding calls keep failing the cycle stops with BreakerOpen and changes nothing, so no document counts as failed.

    A document that the source no longer lists is looked up once more before it is deleted.

    stream: the rows come in any order and are all there is, so no watermark leaves any out, and what is
    older than the index stays out."""
    base, state, failed = store._manifest(), store.index_state(), store.read("failures")
    rows = source if stream else scan_since(source, store.meta("watermark"))
    page = latest_each(rows.select("id", "modified")).cache()  # light: texts are read below, of new and changed documents only
    retried = retry_documents(failed, page, source)
    change = light_diff(page, state, stream).cache()
    todo = latest_each(rows.join(change.where("change <> 'unchanged'").select("id"), "id", "left_semi").unionByName(retried)).cache()
    outcomes = index_outcomes(todo.select("id", "text", "tag_ids"), state, error_tag).cache()
    unchanged = change.where("change = 'unchanged'").count()

    fresh = todo.join(outcomes.where("outcome = 'indexed'").select("id"), "id", "left_semi")
    if breaker is None:
        folder = store.stage("chunks", chunk_rows(fresh, embedder))
    else:
        folder = store.new_folder("chunks")
        embed_in_waves(plain_chunk_rows(fresh), embedder, breaker, lambda wave: store.stage("chunks", wave, folder))
    chunks = store.staged("chunks", folder)
    lost = chunks.where("embedding IS NULL").select(F.col("document_id").alias("id")).distinct().cache()
    if not lost.isEmpty():
        folder = store.stage("chunks", chunks.join(lost, F.col("document_id") == F.col("id"), "left_anti"))
        chunks = store.staged("chunks", folder)
    tried = outcomes.join(lost.withColumn("_lost", F.lit(True)), "id", "left").select("id", F.when(F.col("_lost").isNull(), F.col("outcome")).alias("outcome")).cache()
    by = {r.outcome: r.n for r in tried.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).collect()}

    documents = document_rows(fresh.join(lost, "id", "left_anti"), chunks, now)
    moved = todo.join(tried.where("outcome = 'metadata_only'").select("id"), "id", "left_semi").withColumn("indexed_at", F.lit(now)).withColumn("modified", normalise_timestamp(F.col("modified")))
    gone = tried.where("outcome = 'pruned'").select("id")
    if sweep:
        missed = deletion_candidates(store.document_ids(), source, expected).cache()
        if not missed.isEmpty():  # a second look at the source, for these alone
            there = source.join(missed, "id", "left_semi").select("id")
            gone = gone.unionByName(missed.join(there, "id", "left_anti")).distinct()
    gone = gone.cache()
    deleted = gone.count()
    watermark = next_watermark(page.select("modified"), store.meta("watermark")).first().watermark
    if stream and (known := store.meta("watermark")) and known > watermark:
        watermark = known
    meta = store.read("meta").where("key NOT IN ('watermark', 'last_reconcile_at')").unionByName(store.spark.createDataFrame([("watermark", watermark), ("last_reconcile_at", now)], schemas.META))
    counted = update_failures(failed.join(gone.select(F.col("id").alias("document_id")), "document_id", "left_anti"), tried).cache()
    given_up = counted.where("given_up").count()  # tried again when their content changes, and counted from one
    failures = counted.where("NOT given_up").select("document_id", "failures")
    replaced = {"meta": store.stage("meta", meta), "failures": store.stage("failures", failures)}
    added, dead = {}, {}
    if by.get("indexed") or by.get("metadata_only") or deleted:
        held = store.read("documents").join(moved.select("id"), "id", "left_semi")
        added["documents"] = store.stage("documents", documents.unionByName(merged_metadata(held, moved)))
        written = store.staged("documents", added["documents"])
        keys = documents.select("id").unionByName(gone).select(F.col("id").alias("key"))
        dead = dict.fromkeys(("chunks", "postings", "fts_stats"), keys) | {"documents": written.select(F.col("id").alias("key")).unionByName(gone.select(F.col("id").alias("key")))}
    if by.get("indexed"):
        added |= {"chunks": folder, "postings": store.stage("postings", postings(chunks))}
        added["fts_stats"] = store.stage("fts_stats", token_counts(chunks, store.staged("postings", added["postings"])))
    store.publish(base, replaced, added, dead)
    for held in (page, change, todo, outcomes, lost, tried, gone, counted):
        held.unpersist()
    if store.segments() > most_segments:
        store.compact()
    return Report(by.get("indexed", 0), by.get("metadata_only", 0), by.get("skipped", 0) + by.get("pruned", 0), unchanged, deleted, watermark, by.get(None, 0), given_up)
