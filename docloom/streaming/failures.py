"""Consecutive failures of documents as keyed state: counted, retried by timers, cleared by success, given up at a limit.

A document's state is one number and a timer, kept by Spark's state store and its checkpoints, so a stream that starts again
goes on counting, and a cycle costs its own documents, not all that ever failed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docloom.operators.sync import MOST_FAILURES

#: failed: one more, is retried; given_up: the limit, forgotten until its content comes again; cleared: indexed after failures; retry: its time has come.
EVENTS = "document_id long, failures int, action string"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


def step(failures: int, failed: bool, most: int = MOST_FAILURES) -> tuple[int, str | None]:
    """The count after one outcome, and what happened, if anything."""
    if not failed:
        return 0, "cleared" if failures else None
    return (0, "given_up") if failures + 1 >= most else (failures + 1, "failed")


class FailureCounter(StatefulProcessor):
    """Rows: document_id, ts, failed. ttl_ms: a document that is never tried again, as when it was deleted, is forgotten."""

    def __init__(self, most: int, retry_ms: int, ttl_ms: int) -> None:
        self.most, self.retry_ms, self.ttl_ms = most, retry_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("failures", "failures int", self.ttl_ms)

    def _held(self) -> int:
        return self.count.get()[0] if self.count.exists() else 0

    def _stop_timers(self) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ANN001
        # one document's rows of one batch, a number and a flag each
        tried = pd.concat([r[["ts", "failed"]] for r in rows]).sort_values("ts", kind="stable")
        failures, out = self._held(), []
        for failed in tried["failed"]:
            before = failures
            failures, action = step(failures, bool(failed), self.most)
            if action:
                out.append((key[0], {"failed": failures, "given_up": self.most, "cleared": before}[action], action))
        self._stop_timers()
        if failures:
            self.count.update((failures,))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.retry_ms)
        elif self.count.exists():
            self.count.clear()
        yield pd.DataFrame(out, columns=["document_id", "failures", "action"]).astype({"document_id": "int64", "failures": "int32", "action": "object"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ANN001
        failures = self._held()
        rows = [(key[0], failures, "retry")] if failures else []
        yield pd.DataFrame(rows, columns=["document_id", "failures", "action"]).astype({"document_id": "int64", "failures": "int32", "action": "object"})

    def close(self) -> None:
        pass


def use_state_store(spark: SparkSession) -> None:
    """Timers and time to live need the state store that keeps its keys on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def failure_events(outcomes: DataFrame, most: int = MOST_FAILURES, retry_seconds: float = 60.0, ttl_days: float = 30.0) -> DataFrame:
    """outcomes, a stream of document_id, ts, outcome (null: failed) -> EVENTS.

    Timers make batches of their own without data, so with the trigger availableNow set spark.sql.streaming.noDataMicroBatches.enabled
    to false: due retries then come with the next batch of rows."""
    use_state_store(outcomes.sparkSession)
    rows = outcomes.selectExpr("document_id", "ts", "outcome IS NULL AS failed")
    return rows.groupBy("document_id").transformWithStateInPandas(FailureCounter(most, int(1000 * retry_seconds), int(DAY_MS * ttl_days)), EVENTS, "Update", "ProcessingTime")


def failure_log(outcomes: DataFrame, most: int = MOST_FAILURES) -> DataFrame:
    """The same events, retries aside, of a finished log: rows are sorted by document and time and folded as they pass, so a document of any number of rows takes one batch's memory."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        document, failures = None, 0
        for pdf in frames:
            out = []
            for k, failed in zip(pdf["document_id"], pdf["failed"], strict=True):
                if k != document:
                    document, failures = k, 0
                before = failures
                failures, action = step(failures, bool(failed), most)
                if action:
                    out.append((k, {"failed": failures, "given_up": most, "cleared": before}[action], action))
            yield pd.DataFrame(out, columns=["document_id", "failures", "action"])

    rows = outcomes.selectExpr("document_id", "ts", "outcome IS NULL AS failed")
    return rows.repartition("document_id").sortWithinPartitions("document_id", "ts").mapInPandas(run, EVENTS)
