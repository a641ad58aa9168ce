"""Incremental indexing as joins: what changed, what to retry, what to delete, where to read on."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.dates import normalise_timestamp, utc_timestamp
from docloom.operators.filters import indexable

OVERLAP_SECONDS = 10
MOST_FAILURES = 5


def scan_since(source: DataFrame, watermark: str | None, columns: list[str] | None = None) -> DataFrame:
    """Rows modified after the watermark, as times whatever their zones, and those whose time can't be read; columns reach the scan, and a filter by days on the text."""
    rows = source
    if watermark is not None:
        time, since = utc_timestamp(F.col("modified")), utc_timestamp(F.lit(watermark))
        day = F.col("modified") >= (dt.date.fromisoformat(watermark[:10]) - dt.timedelta(days=1)).isoformat()  # zones differ by less than a day
        rows = source.where(F.col("modified").isNull() | (day & F.coalesce(time > since, F.lit(True))))
    return rows.select(*columns) if columns else rows


def latest_each(rows: DataFrame) -> DataFrame:
    """Of several rows of one id the last modified, or else the greatest."""
    best = F.max(F.struct(utc_timestamp(F.col("modified")).alias("_time"), *[c for c in rows.columns if c != "id"])).alias("_best")
    return rows.groupBy("id").agg(best).select(*["id" if c == "id" else F.col(f"_best.{c}").alias(c) for c in rows.columns])


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def light_diff(light: DataFrame, state: DataFrame, out_of_order: bool = False) -> DataFrame:
    """id, change of each listed document: new, unchanged (same normalised time), or changed. light: id, modified; state: id, modified of the index.

    out_of_order: rows may come late; one that is older than the index's is unchanged."""
    known = state.select("id", F.col("modified").alias("_old"))
    change = F.when(F.col("_old").isNull(), "new").when(normalise_timestamp(F.col("modified")) == normalise_timestamp(F.col("_old")), "unchanged").otherwise("changed")
    if out_of_order:
        change = F.when(utc_timestamp(F.col("modified")) < utc_timestamp(F.col("_old")), "unchanged").otherwise(change)
    return light.join(known, "id", "left").select("id", change.alias("change"))


def index_outcomes(source: DataFrame, state: DataFrame, error_tag: int | None = None) -> DataFrame:
    """id, outcome: pruned (indexed before, now blank or in error), skipped (blank or in error, never indexed), metadata_only (same text) or indexed.

    source: id, text, tag_ids; state: id, content_hash."""
    known = state.select("id", F.col("content_hash").alias("_hash"))
    usable = indexable(F.col("text"), error_tag)
    outcome = F.when(~usable & F.col("_hash").isNotNull(), "pruned").when(~usable, "skipped").when(F.col("_hash") == content_hash(F.col("text")), "metadata_only").otherwise("indexed")
    return source.join(known, "id", "left").select("id", outcome.alias("outcome"))


def tally(outcomes: DataFrame) -> DataFrame:
    """One row of counts; a pruned document is reported as skipped, a null outcome as failed."""
    is_ = lambda *names: F.count_if(F.col("outcome").isin(*names)).alias(names[0])
    return outcomes.agg(is_("indexed"), is_("metadata_only"), is_("skipped", "pruned"), F.count_if(F.col("outcome").isNull()).alias("failed"))


def next_watermark(page: DataFrame, current: str | None = None) -> DataFrame:
    """One row, watermark: the greatest readable modified less the overlap; the current one if none can be read."""
    latest = F.max(utc_timestamp(F.col("modified"))) - F.expr(f"INTERVAL {OVERLAP_SECONDS} SECONDS")
    shown = F.date_format(F.to_utc_timestamp(latest, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return page.agg(F.coalesce(shown, F.lit(current)).alias("watermark"))


def update_failures(failed: DataFrame, outcomes: DataFrame, most: int = MOST_FAILURES) -> DataFrame:
    """document_id, failures, given_up. Success clears; a failure counts one more and at `most` gives up; documents not tried keep their count."""
    tried = outcomes.select(F.col("id").alias("document_id"), F.col("outcome").isNull().alias("_failed"), F.lit(True).alias("_tried"))
    both = failed.join(tried, "document_id", "full")
    count = F.coalesce("failures", F.lit(0)) + F.when(F.col("_tried"), 1).otherwise(0)
    return both.where(F.col("_tried").isNull() | F.col("_failed")).select("document_id", count.cast("int").alias("failures"), (F.col("_tried").isNotNull() & (count >= most)).alias("given_up"))


def failed_titles(failed: DataFrame, documents: DataFrame) -> DataFrame:
    """document_id, title, failures of failing documents by id; one that was never indexed has no title."""
    titles = documents.select(F.col("id").alias("document_id"), "title")
    return failed.select("document_id", "failures").join(titles, "document_id", "left").select("document_id", "title", "failures").orderBy("document_id")


def retry_documents(failed: DataFrame, page: DataFrame, source: DataFrame) -> DataFrame:
    """Source rows of failed documents that the page didn't bring; those gone from the source don't come back."""
    open_ = failed.join(page.select(F.col("id").alias("document_id")), "document_id", "left_anti")
    return source.join(open_.select(F.col("document_id").alias("id")), "id", "left_semi")


def deletion_candidates(indexed: DataFrame, source: DataFrame, expected: int | None = None) -> DataFrame:
    """Indexed ids that the source doesn't list. expected: the source's own count; a listing of fewer rows is incomplete and nothing is deleted."""
    gone = indexed.select("id").join(source.select("id"), "id", "left_anti")
    if expected is None:
        return gone
    whole = source.agg((F.count(F.lit(1)) >= expected).alias("_whole"))
    return gone.join(F.broadcast(whole)).where("_whole").drop("_whole")


def transition(tags: Column, pre: int, post: int, processing: int, error: int, state: Column) -> Column:
    """Tag ids after a pipeline step: done, error or claimed; any other state leaves them."""
    drop = F.array(*[F.lit(t).cast("long") for t in (pre, processing, error)])
    add = lambda t: F.array_union(F.array_except(tags, drop), F.array(F.lit(t).cast("long")))
    return F.when(state == "done", add(post)).when(state == "error", add(error)).when(state == "claimed", F.array_union(tags, F.array(F.lit(processing).cast("long")))).otherwise(tags)


def longest_streak(events: DataFrame, key: str, order: str, failed: str) -> DataFrame:
    """key, streak: the most failures in a row, by islands of a running count of successes (the breaker opens at 3). A key's events are one window's partition; streaming/failures.py folds a log of any skew as it passes."""
    from pyspark.sql import Window

    island = F.sum(F.when(F.col(failed), 0).otherwise(1)).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    runs = events.withColumn("_i", island).where(failed).groupBy(key, "_i").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy(key).agg(F.max("n").alias("streak"))
