"""Best-fit-decreasing packing of tokenised documents into sequences of a fixed length.

A document is its token ids and a closing id; only documents longer than a sequence are cut, from
the end, so that the first piece may be shorter. Pieces are dealt by hash into groups of about
PACK_PIECES; each group is packed by itself, longest piece first, into the open sequence with the
least room that still suffices. That sequence comes from a segment tree over the remaining
capacities. Groups of this size leave one sequence or so unfilled each.

Null texts are a closing id only; texts of any length are encoded whole, in passes of 512 kB of
text; pieces of equal length follow doc_id, piece and checksum; repeated rows are packed each; null
doc_ids are packed too; an empty table gives no rows; other columns of the input aren't read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.runs import trimmed
from docloom.llm.scratch import Scratch
from docloom.llm.tokens import default_path, encoder

LENGTH = 2048
CLOSING_ID = 0
#: Pieces that one task packs together.
PACK_PIECES = 40_000
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, length: int) -> Iterator[tuple[int, int]]:
    """Start and length of the pieces of n ids."""
    at = n % length or min(n, length)
    yield 0, at
    while at < n:
        yield at, length
        at += length


def token_pieces(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every document's pieces; docs: doc_id, text."""
    path = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            rows: list[list] = [[], [], [], [], []]
            texts = [t or "" for t in b.column(1).to_pylist()]
            for doc_id, ids in zip(b.column(0).to_pylist(), enc.encode(texts), strict=True):
                raw = np.append(ids, np.uint32(CLOSING_ID)).astype("<u4").tobytes()
                for k, (start, size) in enumerate(cut(len(raw) // 4, length)):
                    for column, x in zip(rows, (doc_id, k, start, size, zlib.crc32(raw[4 * start : 4 * (start + size)])), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(rows)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(trimmed(run), _PIECES)


class BestFit:
    """Open bins by remaining capacity. A node of the tree tells whether any capacity below it has a bin."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.size = 1 << capacity.bit_length()
        self.tree = [False] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(self.size)]
        self.count = 0

    def _least(self, need: int) -> int:
        """The least capacity of need or more that has a bin, or -1."""
        tree, k = self.tree, need + self.size
        if tree[k]:
            return need
        while k > 1:
            if not k & 1 and tree[k + 1]:
                k += 1
                while k < self.size:
                    k = 2 * k if tree[2 * k] else 2 * k + 1
                return k - self.size
            k >>= 1
        return -1

    def _mark(self, capacity: int, value: bool) -> None:
        tree, k = self.tree, capacity + self.size
        tree[k] = value
        while k > 1:
            k >>= 1
            now = tree[2 * k] or tree[2 * k + 1]
            if tree[k] == now:
                break
            tree[k] = now

    def put(self, need: int) -> tuple[int, int]:
        """Bin and offset for an item."""
        room = self._least(need)
        if room < 0:
            which, room = self.count, self.capacity
            self.count += 1
        else:
            which = self.bins[room].pop()
            if not self.bins[room]:
                self._mark(room, False)
        left = room - need
        if left:
            self.bins[left].append(which)
            if len(self.bins[left]) == 1:
                self._mark(left, True)
        return which, self.capacity - room


def pack(pieces: DataFrame, groups: int, length: int = LENGTH) -> DataFrame:
    """pieces with sequence_id and offset. pieces: those of token_pieces, or any with a length."""
    columns = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset", "_group")]
    grouped = pieces.select(*columns, F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int").alias("_group"))
    ordered = grouped.repartition(groups, "_group").sortWithinPartitions("_group", F.col("length").desc(), "doc_id", "piece", "ids_crc32")
    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema}
    names = [*columns, "sequence_id", "offset"]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, fit = None, None
        for b in batches:
            at = b.schema.names.index
            ids, offsets = [], []
            for g, need in zip(b.column(at("_group")).to_pylist(), b.column(at("length")).to_pylist(), strict=True):
                if g != group:
                    group, fit = g, BestFit(length)
                which, offset = fit.put(need)
                ids.append((g << 32) + which)
                offsets.append(offset)
            yield pa.RecordBatch.from_arrays([*(b.column(at(c)) for c in columns), pa.array(ids, pa.int64()), pa.array(offsets, pa.int64())], names)

    return ordered.mapInArrow(trimmed(run), schema)


def pack_documents(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None, per_group: int = PACK_PIECES) -> DataFrame:
    """Pieces of all documents and their places."""
    pieces = Scratch(docs.sparkSession).keep(token_pieces(docs, length, tokenizer))
    return pack(pieces, max(1, math.ceil(pieces.count() / per_group)), length)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = None
