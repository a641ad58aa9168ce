"""Login throttling with locks and resets, as keyed state; the batch form replays the same rules."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WINDOW = LOCK = 900.0
PAIR_LIMIT, USER_LIMIT = 5, 20
OUT = "key string, ts double, allowed boolean, locked_until double"


def replay(times: list[float], locked: float, events: Iterable[tuple[float, bool]], limit: int) -> tuple[list[float], float, list[tuple[float, bool, float]]]:
    """Failure times and lock after the events (time, success), and for each event whether it was allowed and the lock after it.

    While locked nothing counts; a success clears; `limit` failures within WINDOW lock for LOCK."""
    out = []
    for t, success in events:
        allowed = t >= locked
        if allowed:
            if success:
                times, locked = [], 0.0
            else:
                times = [x for x in times if x > t - WINDOW] + [t]
                if len(times) >= limit:
                    locked, times = t + LOCK, []
        out.append((t, allowed, locked))
    return times, locked, out


def throttle_stream(attempts: DataFrame, limit: int = PAIR_LIMIT, output: str = "append") -> DataFrame:
    """attempts: key, ts (seconds), success -> OUT for each attempt. State per key is at most `limit` times and a lock; it expires with them."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times, locked = (list(state.get[0]), state.get[1]) if state.exists else ([], 0.0)
        rows = pd.concat(frames).sort_values("ts")
        times, locked, out = replay(times, locked, zip(rows["ts"], rows["success"], strict=True), limit)
        state.update((times, locked))
        state.setTimeoutDuration(int(1000 * (WINDOW + LOCK)))
        yield pd.DataFrame([(key[0], *r) for r in out], columns=["key", "ts", "allowed", "locked_until"])

    return attempts.groupBy("key").applyInPandasWithState(step, OUT, "times array<double>, locked double", output, GroupStateTimeout.ProcessingTimeTimeout)


def throttle_batch(attempts: DataFrame, limit: int = PAIR_LIMIT) -> DataFrame:
    """The same for a finished log. Keys are sorted by time and replayed as they stream by, so an attacked key of any length takes the memory of one batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, times, locked = None, [], 0.0
        for pdf in frames:
            rows = []
            for k, part in pdf.groupby("key", sort=False):
                if k != key:
                    key, times, locked = k, [], 0.0
                times, locked, out = replay(times, locked, zip(part["ts"], part["success"], strict=True), limit)
                rows += [(k, *r) for r in out]
            yield pd.DataFrame(rows, columns=["key", "ts", "allowed", "locked_until"])

    return attempts.select("key", "ts", "success").repartition("key").sortWithinPartitions("key", "ts").mapInPandas(run, OUT)
