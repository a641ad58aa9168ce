"""Failed documents as keyed state with restarts, and the activity of streams."""

import random
import time

import pytest
from pyspark.sql import functions as F

from docloom.streaming import activity, failures

OUTCOMES = "document_id long, ts double, outcome string"


def plain(rows, most):
    count, events = {}, []
    for document, _, outcome in sorted(rows, key=lambda r: r[1]):
        n = count.get(document, 0)
        if outcome is not None:
            if n:
                events.append((document, n, "cleared"))
            count.pop(document, None)
        elif n + 1 >= most:
            events.append((document, most, "given_up"))
            count.pop(document, None)
        else:
            count[document] = n + 1
            events.append((document, n + 1, "failed"))
    return sorted(events), count


def drain(spark, frame, out, checkpoint):
    def keep(batch, _):
        batch.write.mode("append").parquet(out)

    run = frame.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert not run.isActive


def test_counts_go_on_after_a_restart(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else a stream with timers never runs out of batches
    rng = random.Random(2)
    rows = [(rng.randint(1, 12), float(i), None if rng.random() < 0.75 else "indexed") for i in range(240)]
    out, checkpoint, source = (f"file://{tmp_path}/{x}" for x in ("out", "checkpoint", "in"))
    stream = lambda: failures.failure_events(spark.readStream.schema(OUTCOMES).parquet(source), 5, 3600)
    for i in range(0, 240, 80):  # three runs, each from the checkpoint of the one before
        spark.createDataFrame(rows[i : i + 80], OUTCOMES).repartition(2).write.mode("append").parquet(source)
        drain(spark, stream(), out, checkpoint)
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    want, _ = plain(rows, 5)
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == want
    assert sorted(tuple(r) for r in failures.failure_log(spark.createDataFrame(rows, OUTCOMES).repartition(3)).collect()) == want


def test_failed_documents_come_back_by_timers(spark, tmp_path):
    out, source = f"file://{tmp_path}/out", f"file://{tmp_path}/in"
    spark.createDataFrame([(1, 1.0, None), (2, 2.0, None), (2, 3.0, "indexed"), *[(3, 4.0 + i, None) for i in range(5)]], OUTCOMES).write.parquet(source)

    def keep(batch, _):
        batch.write.mode("append").parquet(out)

    events = failures.failure_events(spark.readStream.schema(OUTCOMES).parquet(source), 5, 1.0)
    run = events.writeStream.foreachBatch(keep).option("checkpointLocation", f"file://{tmp_path}/c").outputMode("update").trigger(processingTime="500 milliseconds").start()
    try:
        until = time.time() + 60
        found = []
        while time.time() < until and not any(r.action == "retry" for r in found):
            time.sleep(1)
            try:
                found = spark.read.schema(failures.EVENTS).parquet(out).collect()
            except Exception:  # noqa: BLE001  nothing is written yet
                continue
    finally:
        run.stop()
    assert {(r.document_id, r.failures) for r in found if r.action == "retry"} == {(1, 1)}
    assert {r.document_id for r in found if r.action == "given_up"} == {3} and {r.document_id for r in found if r.action == "cleared"} == {2}


@pytest.mark.parametrize(("failed", "failures_", "want"), [(True, 0, (1, "failed")), (True, 3, (4, "failed")), (True, 4, (0, "given_up")), (False, 0, (0, None)), (False, 4, (0, "cleared"))])
def test_step(failed, failures_, want):
    assert failures.step(failures_, failed, 5) == want


def test_listener_writes_cycles_and_beats(spark, tmp_path):
    log = activity.ActivityLog(spark, f"file://{tmp_path}/log", every=60)
    listener = activity.StreamActivity(log)
    spark.streams.addListener(listener)
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    try:
        for i, rows in enumerate(([(1, "indexed"), (2, None)], [(3, "indexed")])):
            spark.createDataFrame(rows, "id long, outcome string").coalesce(1).write.mode("append").parquet(source)
            counted = spark.readStream.schema("id long, outcome string").parquet(source).observe("outcomes", F.count_if(F.col("outcome") == "indexed").alias("indexed"), F.count_if(F.col("outcome").isNull()).alias("failed"))
            run = counted.writeStream.queryName("indexer").format("parquet").option("path", out).option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
            run.awaitTermination(60)

        def broken(batch, _):
            raise RuntimeError("no such luck")

        run = spark.readStream.schema("id long, outcome string").parquet(source).writeStream.queryName("unlucky").foreachBatch(broken).option("checkpointLocation", f"file://{tmp_path}/d").trigger(availableNow=True).start()
        with pytest.raises(Exception, match="luck"):
            run.awaitTermination(60)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        time.sleep(1)
    finally:
        spark.streams.removeListener(listener)
        log.close()
    rows = log.activity().collect()
    assert [r.id for r in rows] == list(range(len(rows), 0, -1))
    good = [r for r in rows if r.ok]
    assert sorted((r.summary["indexed"], r.summary["failed"]) for r in good) == [(1, 0), (1, 1)] and all(r.started_at <= r.finished_at for r in good)
    assert [r.detail.split(":")[0] for r in rows if not r.ok] == ["unlucky failed"]
    beats = {r.name: r for r in log.beats().collect()}
    assert beats["indexer"].processed_count == 3 and beats["indexer"].detail == "stopped" and beats["unlucky"].detail == "stopped"
    again = activity.ActivityLog(spark, f"file://{tmp_path}/log", every=60)
    again.record("sweep", "a", "b", True, {"pruned": 2}, "pruned 2 deleted document(s)")
    again.close()
    assert again.activity(2).first().id == len(rows) + 1 and again.activity(2).count() == 2


def test_reports_never_stop_the_work(spark, tmp_path):
    log = activity.ActivityLog(spark, f"file://{tmp_path}/log", every=60)
    log.path = "file:///proc/nowhere"
    log.record("sync", "a", "b", True, {"indexed": 1}, "x")
    log.flush()
    log.path = f"file://{tmp_path}/log"
    log.close()
    assert log.activity().count() == 1
