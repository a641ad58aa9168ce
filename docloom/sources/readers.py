"""Reads of a document source and result sinks."""

from __future__ import annotations

import json
import logging
import queue
import threading
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

log = logging.getLogger(__name__)


def read_source(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A document collection as Parquet; a given schema is never inferred."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def by_tag(documents: DataFrame, tag: int) -> DataFrame:
    return documents.where(F.array_contains("tag_ids", F.lit(tag).cast("long")))


def by_id(documents: DataFrame, document_id: int) -> DataFrame:
    return documents.where(F.col("id") == document_id)


def exists(documents: DataFrame, document_id: int) -> bool:
    return not by_id(documents, document_id).isEmpty()


def taxonomy_entries(taxonomy: DataFrame, kind: str | None = None) -> DataFrame:
    """Entries by name, or by kind and name."""
    return taxonomy.orderBy("kind", "name", "id") if kind is None else taxonomy.where(F.col("kind") == kind).orderBy("name", "id")


def originals(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Original files: path, modificationTime, length, content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def ndjson(events: Iterable[dict], result: dict) -> Iterator[str]:
    """Ordered event lines, then the result line."""
    for e in events:
        yield json.dumps({"type": "event", **e}, ensure_ascii=False) + "\n"
    yield json.dumps({"type": "result", **result}, ensure_ascii=False) + "\n"


#: Seconds without an event after which a stream says that it is alive.
KEEP_ALIVE = 15.0


def event_stream(work: Callable[[Callable[[dict], None]], dict], keep_alive: float = KEEP_ALIVE, wait: Callable[[queue.Queue, float], tuple[str, dict]] = lambda q, s: q.get(timeout=s)) -> Iterator[str]:
    """Lines of a piece of work as it goes on: its events in order, the result or an error last, each numbered, and a blank line whenever nothing came for `keep_alive` seconds.

    work(emit) runs in a thread and passes events to emit; what it returns is the result. A reader that stops early waits for the work to end."""
    events: queue.Queue[tuple[str, dict]] = queue.Queue()

    def run() -> None:
        try:
            events.put(("result", work(lambda e: events.put(("event", dict(e))))))
        except Exception as e:  # noqa: BLE001  the reader has begun: a failure is a line
            log.exception("streamed work failed")
            events.put(("error", {"kind": getattr(e, "kind", "internal"), "message": str(e) if hasattr(e, "kind") else "the work failed"}))

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    try:
        seq, kind = 0, ""
        while kind not in ("result", "error"):
            try:
                kind, payload = wait(events, keep_alive)
            except queue.Empty:
                yield "\n"
                continue
            seq += 1
            yield json.dumps({**payload, "type": kind, "seq": seq}, ensure_ascii=False) + "\n"
    finally:
        thread.join()


def write_ndjson(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
