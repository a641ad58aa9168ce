"""What streams do, as tables: a row for each cycle and a beat for each sign of life.

Writing is best effort: it must never stop the work it reports. Rows wait in memory and are appended by a thread of
their own, so that Spark's listener bus never waits for a job.
"""

from __future__ import annotations

import datetime as dt
import logging
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from docloom.operators.accounting import capped_activity, latest_heartbeats

ACTIVITY = "id long, kind string, started_at string, finished_at string, ok boolean, summary map<string,long>, detail string"
BEATS = "name string, ts string, detail string, processed long"
#: fixed value: what a daemon without work says
IDLE = "idle"
log = logging.getLogger(__name__)


def utc_now() -> str:
    return dt.datetime.now(dt.UTC).isoformat(timespec="milliseconds")


class ActivityLog:
    """The tables activity and beats below a path; one writer a path, for cycles are numbered one by one."""

    def __init__(self, spark: SparkSession, path: str, every: float = 5.0, clock: Callable[[], str] = utc_now) -> None:
        self.spark, self.path, self.every, self.clock = spark, path.rstrip("/"), every, clock
        self._held: dict[str, list[tuple]] = {"activity": [], "beats": []}
        self._lock, self._wake, self._writing = threading.Lock(), threading.Event(), threading.Lock()
        self._next = (self._read("activity", ACTIVITY).agg(F.max("id")).first()[0] or 0) + 1
        self._closed = False
        self._thread = threading.Thread(target=self._run, daemon=True)
        self._thread.start()

    def _read(self, table: str, schema: str) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{table}")

    def record(self, kind: str, started_at: str, finished_at: str, ok: bool, summary: dict[str, int], detail: str) -> None:
        """One cycle, which is a beat as well."""
        with self._lock:
            self._held["activity"].append((self._next, kind, started_at, finished_at, ok, {k: int(v) for k, v in summary.items()}, detail))
            self._next += 1

    def record_sync(self, report, started_at: str, name: str = "indexer") -> None:  # noqa: ANN001
        """A cycle of the index from its report: documents that fail are counted, the cycle itself is well."""
        summary = {k: getattr(report, k) for k in ("indexed", "metadata_only", "skipped", "failed", "given_up", "deleted")}
        detail = f"indexed {report.indexed}, {report.failed} failed" if report.failed else f"indexed {report.indexed} document(s)"
        self.record("sync", started_at, self.clock(), True, summary, detail)
        self.beat(name, detail, report.indexed)

    def beat(self, name: str, detail: str = IDLE, processed: int = 0) -> None:
        with self._lock:
            self._held["beats"].append((name, self.clock(), detail, int(processed)))

    def flush(self) -> None:
        """Append what is held; on failure it stays held."""
        for table, schema in (("activity", ACTIVITY), ("beats", BEATS)):
            with self._writing:
                with self._lock:
                    rows = list(self._held[table])
                if not rows:
                    continue
                try:
                    self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.path}/{table}")
                except Exception as e:  # noqa: BLE001  reports must not stop the work
                    log.warning("activity isn't written: %s", e)
                    continue
                with self._lock:
                    del self._held[table][: len(rows)]

    def _run(self) -> None:
        while not self._closed:
            self._wake.wait(self.every)
            self.flush()

    def close(self) -> None:
        self._closed = True
        self._wake.set()
        self._thread.join()
        self.flush()

    def activity(self, most: int = 500) -> DataFrame:
        """The newest cycles, newest first."""
        return capped_activity(self._read("activity", ACTIVITY), most).orderBy(F.desc("id"))

    def beats(self) -> DataFrame:
        """name, last_heartbeat, detail, processed_count of every name."""
        return latest_heartbeats(self._read("beats", BEATS))


class StreamActivity(StreamingQueryListener):
    """Beats for every sign of life of named streams, and a cycle row for each batch with rows.

    Counts that a stream observes under the name `outcomes` (DataFrame.observe) are the summary; else the number of rows. A stream that
    ends by an error leaves a cycle that isn't ok. cycles=False leaves cycle rows to the stream itself."""

    def __init__(self, activity: ActivityLog, cycles: bool = True) -> None:
        self.to, self.cycles = activity, cycles
        self._names: dict[str, str] = {}

    def _name(self, run_id: object, name: str | None) -> str:
        return self._names.setdefault(str(run_id), name or "stream")

    def onQueryStarted(self, event) -> None:  # noqa: N802, ANN001
        self.to.beat(self._name(event.runId, event.name), "started")

    def onQueryProgress(self, event) -> None:  # noqa: N802, ANN001
        p = event.progress
        name = self._name(p.runId, p.name)
        if not p.numInputRows:
            self.to.beat(name)
            return
        observed = p.observedMetrics.get("outcomes")
        summary = {k: v for k, v in observed.asDict().items() if v is not None} if observed is not None else {"rows": p.numInputRows}
        detail = ", ".join(f"{k} {v}" for k, v in summary.items())
        if self.cycles:
            begun = dt.datetime.fromisoformat(p.timestamp.replace("Z", "+00:00"))
            ended = begun + dt.timedelta(milliseconds=p.batchDuration)
            self.to.record("sync", begun.isoformat(timespec="milliseconds"), ended.isoformat(timespec="milliseconds"), True, summary, detail)
        self.to.beat(name, detail, p.numInputRows)

    def onQueryIdle(self, event) -> None:  # noqa: N802, ANN001
        self.to.beat(self._name(event.runId, None))

    def onQueryTerminated(self, event) -> None:  # noqa: N802, ANN001
        name, now = self._name(event.runId, None), self.to.clock()
        if event.exception:
            self.to.record("sync", now, now, False, {}, f"{name} failed: {event.exception.splitlines()[0][:200]}")
        self.to.beat(name, "stopped")
