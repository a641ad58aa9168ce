"""Runs of equal keys in sorted Arrow streams, for grouped work without a call a group."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


def trimmed(run: Callable) -> Callable:
    """run for mapInArrow, giving freed memory back to the system after a task: workers are used again, and their peaks would add up."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            return

    return whole


def run_ends(keys: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each run of equal keys."""
    if not len(keys):
        return []
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])).tolist()
    return list(zip(at, [*at[1:], len(keys)], strict=True))


def runs_by(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of equal keys of a sorted stream, each whole; many runs a table."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1])) if keys[0] <= keys[-1] else 0
        if cut:
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = [b.slice(cut)]
        else:
            if held and held[-1].column(key)[-1].as_py() != keys[0]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)
