"""Indexing as a stream: each micro-batch is one cycle of plans.indexing."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from docloom.plans.indexing import run_cycle
from docloom.sources.store import IndexStore
from docloom.streaming.activity import ActivityLog


def stream_source(spark: SparkSession, path: str, schema: StructType, files: int = 100) -> DataFrame:
    """New files of a folder, some at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def start_indexing(source: DataFrame, store_path: str, embedder, checkpoint: str, once: bool = True, interval: str = "60 seconds", activity: ActivityLog | None = None) -> StreamingQuery:
    """A row that comes again is unchanged the second time, so a repeated batch does no harm, and rows may come in any order. Deletions need a full listing and aren't done here.

    activity: gets each cycle's report; StreamActivity(activity, cycles=False) as the session's listener adds beats and failures."""

    def cycle(batch: DataFrame, _: int) -> None:
        began = dt.datetime.now(dt.UTC).isoformat(timespec="seconds")
        report = run_cycle(IndexStore(batch.sparkSession, store_path), batch, embedder, began, sweep=False, stream=True)
        if activity:
            activity.record_sync(report, began)

    w = source.writeStream.queryName("indexer").foreachBatch(cycle).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=interval)).start()
