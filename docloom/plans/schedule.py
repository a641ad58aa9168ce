"""What is due: times and requests in the store's manifest, claimed by compare-and-swap, so that one of several drivers runs each.

A claim is a lease: the driver that holds it runs the task and then sets the next time. If it fails, the lease goes and the
task is due again at once; if it dies, the lease runs out.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, replace

from pyspark.sql import functions as F

from docloom import schemas
from docloom.sources.store import IndexStore, StaleWriter

TRIES = 20


@dataclass(frozen=True)
class Due:
    """due: time of the next run, in seconds; none for tasks that run on request only. requested: also run without being due."""

    due: float | None = None
    requested: bool = False
    holder: str | None = None
    lease_until: float = 0.0


@dataclass(frozen=True)
class Task:
    name: str
    run: Callable[[], object]
    interval: float | None = None
    lease: float = 3600.0


def _read(store: IndexStore, name: str) -> Due:
    text = store.meta(f"due:{name}")
    return Due(**json.loads(text)) if text else Due()


def _swap(store: IndexStore, name: str, change: Callable[[Due], Due | None]) -> Due | None:
    """Replace a task's entry by what change makes of it, in one generation; None if change leaves it. Another writer's commit starts it over."""
    for _ in range(TRIES):
        base = store._manifest()
        new = change(_read(store, name))
        if new is None:
            return None
        key = f"due:{name}"
        meta = store.read("meta").where(F.col("key") != key).unionByName(store.spark.createDataFrame([(key, json.dumps(asdict(new)))], schemas.META))
        try:
            store.publish(base, {"meta": store.stage("meta", meta)})
        except StaleWriter:
            continue
        return new
    raise StaleWriter(f"the entry of {name} kept changing")


def request(store: IndexStore, name: str) -> None:
    """Ask for a run at the next opportunity; asking again before it changes nothing."""
    _swap(store, name, lambda d: None if d.requested else replace(d, requested=True))


def claim(store: IndexStore, task: Task, now: float) -> str | None:
    """A lease on the task if it is due or requested and nobody holds it, else None. A task with an interval that never ran is due."""
    holder = uuid.uuid4().hex

    def take(d: Due) -> Due | None:
        due = d.requested or task.interval is not None and (d.due is None or now >= d.due)
        return replace(d, holder=holder, lease_until=now + task.lease, requested=False) if due and not (d.holder and now < d.lease_until) else None

    return holder if _swap(store, task.name, take) else None


def finish(store: IndexStore, task: Task, holder: str, now: float, ok: bool) -> bool:
    """End a lease: the next run is an interval away, or due at once after a failure. False if the lease was lost meanwhile."""

    def end(d: Due) -> Due | None:
        if d.holder != holder:
            return None
        if ok:
            return replace(d, holder=None, lease_until=0.0, due=None if task.interval is None else now + task.interval)
        return replace(d, holder=None, lease_until=0.0, requested=True)

    return _swap(store, task.name, end) is not None


def run_due(store: IndexStore, tasks: Sequence[Task], clock: Callable[[], float]) -> dict[str, object]:
    """Runs the tasks that are due and free, in order: results, or the error of each that failed. An error of one doesn't stop the others."""
    done: dict[str, object] = {}
    for task in tasks:
        holder = claim(store, task, clock())
        if holder is None:
            continue
        try:
            done[task.name], ok = task.run(), True
        except Exception as e:  # noqa: BLE001  one task's failure is its own; it is due again
            done[task.name], ok = e, False
        finish(store, task, holder, clock(), ok)
    return done
