"""Deletions in two phases: what a full listing misses is held, and deleted once a second, independent look misses it too."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom import schemas
from docloom.operators.sync import deletion_candidates
from docloom.sources.store import KEYS, IndexStore


@dataclass(frozen=True)
class SweepReport:
    candidates: int
    pruned: int
    aborted: bool = False


def run_sweep(store: IndexStore, listing: DataFrame, now: str, expected: int | None = None, still_there: Callable[[DataFrame], DataFrame] | None = None) -> SweepReport:
    """listing: id of all documents of the source. expected: the source's own count; a shorter listing aborts the sweep and changes nothing.

    still_there looks candidates (id) up one by one and returns those that exist: the others are deleted at once. Without it they
    wait in the store's table `doomed` with the generation that missed them, and go when a sweep of a later generation misses them
    again; one that is listed meanwhile leaves the table. All of a sweep is one generation, so a crash between
    both phases changes nothing, and a document indexed meanwhile by another writer makes the sweep fail as stale."""
    base = store._manifest()
    if expected is not None and listing.count() < expected:
        return SweepReport(0, 0, True)
    missed = deletion_candidates(store.document_ids(), listing.select("id")).distinct().cache()
    n = missed.count()
    if still_there is not None:
        gone = missed.join(still_there(missed).select("id"), "id", "left_anti")
        held = store.spark.createDataFrame([], schemas.DOOMED)
    else:
        before = store.read("doomed")
        gone = missed.join(before.where(F.col("generation") <= base["generation"]), "id", "left_semi")
        held = missed.join(before, "id", "left_anti").select("id", F.lit(base["generation"] + 1).cast("long").alias("generation"))
    gone = gone.cache()
    pruned = gone.count()
    meta = store.read("meta").where("key <> 'last_full_sweep_at'").unionByName(store.spark.createDataFrame([("last_full_sweep_at", now)], schemas.META))
    replaced = {"doomed": store.stage("doomed", held), "meta": store.stage("meta", meta)}
    store.publish(base, replaced, dead=dict.fromkeys(KEYS, gone.select(F.col("id").alias("key"))) if pruned else None)
    missed.unpersist()
    gone.unpersist()
    return SweepReport(n, pruned)
