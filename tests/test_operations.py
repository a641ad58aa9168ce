"""Sweeps in two phases, the schedule of several drivers, the breaker and the event stream."""

import json
import queue
import threading
import time

import pytest
from pyspark.sql import functions as F

from docloom.operators.vectors import Breaker, BreakerOpen, embed_in_waves
from docloom.plans.indexing import run_cycle
from docloom.plans.schedule import Due, Task, _read, claim, finish, request, run_due
from docloom.plans.sweep import run_sweep
from docloom.sources.readers import event_stream
from docloom.sources.store import IndexStore, StaleWriter

SOURCE = "id long, title string, correspondent_id long, document_type_id long, tag_ids array<long>, created string, modified string, text string"


fake = lambda texts: [[float(len(t)), 1.0] for t in texts]  # noqa: E731  a lambda, so that workers get it by value


def rows_of(spark, ids):
    return spark.createDataFrame([(i, f"t{i}", 1, 2, [3], "2024-01-01", f"2024-02-{i % 27 + 1:02d}T00:00:00+00:00", f"text of document {i}") for i in ids], SOURCE)


@pytest.fixture
def store(spark, tmp_path):
    s = IndexStore(spark, f"file://{tmp_path}/store")
    run_cycle(s, rows_of(spark, range(6)), fake, "2024-03-01T00:00:00+00:00", sweep=False)
    return s


def listed(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id long")


def ids(store):
    return sorted(r.id for r in store.document_ids().collect())


def test_document_that_comes_back_between_both_phases_stays(spark, store):
    first = run_sweep(store, listed(spark, [0, 1, 2]), "t1")
    assert (first.candidates, first.pruned, first.aborted) == (3, 0, False) and ids(store) == [0, 1, 2, 3, 4, 5]
    assert sorted(r.id for r in store.read("doomed").collect()) == [3, 4, 5]
    second = run_sweep(store, listed(spark, [0, 2, 4]), "t2")  # 4 is back, 1 is missed for the first time
    assert (second.candidates, second.pruned) == (3, 2) and ids(store) == [0, 1, 2, 4] and store.meta("last_full_sweep_at") == "t2"
    assert [r.id for r in store.read("doomed").collect()] == [1]
    assert store.read("chunks").where("document_id IN (3, 5)").isEmpty() and store.read("postings").where("document_id IN (3, 5)").isEmpty()
    assert run_sweep(store, listed(spark, [0, 1, 2, 4]), "t3").candidates == 0 and store.read("doomed").isEmpty()


def test_short_listing_aborts(spark, store):
    run_sweep(store, listed(spark, [0, 1, 2]), "t1")
    before = store.generation()
    assert run_sweep(store, listed(spark, [0]), "t2", expected=6).aborted and store.generation() == before
    assert store.read("doomed").count() == 3


def test_point_lookups_confirm_at_once(spark, store):
    asked = []

    def still_there(candidates):
        asked.append(sorted(r.id for r in candidates.collect()))
        return candidates.where("id = 5")

    done = run_sweep(store, listed(spark, [0, 1, 2]), "t1", 3, still_there)
    assert (done.candidates, done.pruned) == (3, 2) and asked == [[3, 4, 5]] and ids(store) == [0, 1, 2, 5]


def test_sweep_is_stale_beside_another_writer(spark, store, monkeypatch):
    def meddle(candidates):
        store.write_meta(other="writer")
        return candidates.limit(0)

    with pytest.raises(StaleWriter):
        run_sweep(store, listed(spark, [0]), "t1", None, meddle)
    assert ids(store) == [0, 1, 2, 3, 4, 5]


# --- schedule


def test_two_racing_drivers_run_a_task_once(spark, store):
    ran, ready = [], threading.Barrier(2)

    def driver(name):
        own = IndexStore(spark, store.path)
        ready.wait()
        run_due(own, [Task("sweep", lambda: ran.append(name), 60.0)], lambda: 1000.0)

    threads = [threading.Thread(target=driver, args=(n,)) for n in ("a", "b")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(ran) == 1 and _read(store, "sweep") == Due(due=1060.0)


def test_intervals_requests_failures_and_leases(spark, store):
    now, ran = [0.0], []
    sweep = Task("sweep", lambda: ran.append("sweep"), 100.0)
    rebuild = Task("rebuild", lambda: ran.append("rebuild"))
    step = lambda: run_due(store, [rebuild, sweep], lambda: now[0])
    step()
    assert ran == ["sweep"]
    now[0] = 99.0
    step()
    assert ran == ["sweep"]
    request(store, "rebuild")
    request(store, "rebuild")
    request(store, "sweep")
    step()
    assert ran == ["sweep", "rebuild", "sweep"] and not step()
    bad = Task("sweep", lambda: 1 / 0, 100.0)
    now[0] = 300.0
    assert isinstance(run_due(store, [bad], lambda: now[0])["sweep"], ZeroDivisionError)
    assert "sweep" in step()  # a failed run is due again
    now[0] = 1000.0
    held = claim(store, sweep, now[0])
    assert held and claim(store, sweep, now[0] + 1) is None
    later = claim(store, sweep, now[0] + sweep.lease + 1)  # the first driver died
    assert later and not finish(store, sweep, held, now[0] + 5000, True) and finish(store, sweep, later, now[0] + 5000, True)


# --- breaker


def failing_from(path, good):
    """An embedder that counts its calls in files, as tasks share no memory, and fails after `good` of them."""

    def embedder(texts):
        import os
        import uuid

        n = len(os.listdir(path))
        open(f"{path}/{uuid.uuid4().hex}", "w").close()
        if n >= good:
            raise RuntimeError("down")
        return [[1.0] for _ in texts]

    return embedder


def test_provider_that_is_down_costs_three_calls(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    chunks = spark.range(20_000).selectExpr("id AS chunk_id", "id AS document_id", "cast(id AS string) AS text").repartition(8)
    breaker, written = Breaker(spark), []
    with pytest.raises(BreakerOpen):
        embed_in_waves(chunks, failing_from(str(tmp_path / "calls"), 0), breaker, lambda w: written.append(w.count()))
    assert len(list((tmp_path / "calls").iterdir())) == 3 == breaker.calls.value and len(written) == 1
    with pytest.raises(BreakerOpen):  # stays open
        embed_in_waves(chunks, failing_from(str(tmp_path / "calls"), 0), breaker, lambda w: written.append(w.count()))
    assert len(written) == 1
    breaker.reset()
    assert not breaker.is_open()


def test_waves_cover_all_and_a_late_failure_stops_the_next(spark, tmp_path):
    chunks = spark.range(30_000).selectExpr("id AS chunk_id", "id AS document_id", "cast(id AS string) AS text").repartition(4)
    out = f"file://{tmp_path}/out"
    embed_in_waves(chunks, lambda texts: [[1.0] for _ in texts], Breaker(spark), lambda w: w.write.mode("append").parquet(out))
    assert spark.read.parquet(out).select("chunk_id").distinct().count() == 30_000 == spark.read.parquet(out).where("embedding IS NOT NULL").count()
    (tmp_path / "calls").mkdir()
    breaker = Breaker(spark)
    with pytest.raises(BreakerOpen):
        embed_in_waves(chunks, failing_from(str(tmp_path / "calls"), 10), breaker, lambda w: w.write.format("noop").mode("overwrite").save())
    tasks = 8
    assert breaker.calls.value <= 10 + 3 * tasks + tasks


def test_single_failures_do_not_open_it(spark):
    def picky(texts):
        if any(t.endswith("7") for t in texts):
            raise ValueError("no sevens")
        return [[1.0] for _ in texts]

    chunks = spark.range(200).selectExpr("id AS chunk_id", "id AS document_id", "cast(id AS string) AS text").coalesce(1)
    breaker, found = Breaker(spark), []
    embed_in_waves(chunks, picky, breaker, lambda w: found.append(w.where("embedding IS NULL").count()), batch=5)
    assert sum(found) == 20 and not breaker.is_open()


def test_cycle_with_an_open_breaker_changes_nothing(spark, store):
    def down(texts):
        raise RuntimeError("down")

    before = store.generation()
    more = rows_of(spark, range(20)).withColumn("modified", F.lit("2024-05-01T00:00:00+00:00")).withColumn("text", F.concat("text", F.lit(" new")))
    with pytest.raises(BreakerOpen):
        run_cycle(store, more, down, "2024-06-01T00:00:00+00:00", breaker=Breaker(spark))
    assert store.generation() == before and store.read("failures").isEmpty()
    done = run_cycle(store, more, fake, "2024-06-02T00:00:00+00:00", breaker=Breaker(spark))
    assert done.indexed == 20 and done.failed == 0 and ids(store) == list(range(20)) and store.read("chunks").where("embedding IS NULL").isEmpty()


def test_cycle_looks_again_before_it_deletes(spark, store):
    done = run_cycle(store, rows_of(spark, [0, 1, 2]), fake, "2024-06-01T00:00:00+00:00")
    assert done.deleted == 3 and ids(store) == [0, 1, 2]


# --- event stream


def test_events_in_order_with_signs_of_life():
    """A fake clock: the reader is told that time ran out whenever the queue is empty."""
    go = threading.Semaphore(0)

    def work(emit):
        for i in range(3):
            go.acquire()
            emit({"phase": i, "type": "x"})
        go.acquire()
        return {"answer": "é"}

    def wait(q, seconds):
        assert seconds == 15.0
        try:
            return q.get_nowait()
        except queue.Empty:
            go.release()
            until = time.time() + 5
            while q.empty() and time.time() < until and seen.count("\n") > 3 * sum(x != "\n" for x in seen) + 3:
                time.sleep(0.01)
            raise

    seen: list[str] = []
    for line in event_stream(work, 15.0, wait):
        seen.append(line)
    told = [json.loads(x) for x in seen if x != "\n"]
    assert [(t["type"], t["seq"]) for t in told] == [("event", 1), ("event", 2), ("event", 3), ("result", 4)]
    assert [t.get("phase") for t in told[:3]] == [0, 1, 2] and told[3]["answer"] == "é" and seen.count("\n") >= 1 and seen[-1] != "\n"


def test_real_clock_and_errors():
    def slow(emit):
        emit({"n": 1})
        time.sleep(0.25)
        return {}

    assert [x if x == "\n" else json.loads(x)["type"] for x in event_stream(slow, 0.1)][0] == "event" and "\n" in list(event_stream(slow, 0.1))

    class Budget(RuntimeError):
        kind = "budget"

    def over(emit):
        raise Budget("spent")

    def broken(emit):
        raise KeyError("secret detail")

    assert json.loads(next(event_stream(over))) == {"kind": "budget", "message": "spent", "type": "error", "seq": 1}
    assert json.loads(next(event_stream(broken))) == {"kind": "internal", "message": "the work failed", "type": "error", "seq": 1}
