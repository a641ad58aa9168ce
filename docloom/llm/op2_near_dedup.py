"""MinHash near-dedup by a chosen-path set similarity join.

A document is the set of its k-word shingles; those with equal sets are one class and its smallest
doc_id stands for it. Every class has SIZE minwise values. In each of several independent trees the
classes of a node branch by minwise coordinates that the node's path chooses: one for certain and
a second with probability 1 / threshold - 1, so that a pair at the threshold stays together in one
node of each level on average. Nodes of at most LEAF classes are compared exhaustively; equal nodes
of several trees are compared once. `survival` gives the chance that a pair at the threshold is
still together after PLAN_DEPTH levels of one tree; there are as many trees as make it RECALL over
all of them.

Groups of near copies aren't split by coordinates, so they leave the trees before these branch: in
the first PEELS levels each large node gets a pivot, the class most like a bounded sample of it, and
all of the node are compared with the pivot on full sets. Pivots that a class links are one family: what is
linked with one of them leaves all nodes of the family, and what stays is compared with all of them.
What else could be linked with one of those that left has, by the triangle inequality of Jaccard distances, a
similarity of 2 * threshold - 1 or more with its pivot: of these few, those that no other link has brought into the
pivot's component are compared with all that left for the pivot, in blocks and on full sets. Nodes that are still large at MAX_DEPTH are compared in
blocks as well.

In a leaf, classes are joined by estimates of their similarity to groups of candidates; equal groups
of several leaves are taken once, with their full sets, and their pairs are compared in order of
estimates until all are in one component or no pair of different components is left, so copies aren't expanded
into all pairs. Pairs with an estimate more than DEVIATIONS deviations under the threshold aren't compared: besides
the chance of missing a pair in all trees that loses one pair at the threshold in about 30,000, and fewer above it.

Defined results: null or empty texts have 0 shingles and no link; fewer than k words are one
shingle; texts of any length are read whole, in pieces; rows that share a doc_id are one document:
their classes are linked, and if several have that doc_id as the smallest, one of them is compared
with others; rows without doc_id are neither linked nor dropped (component null, kept true); ties
can't arise, for the smallest doc_id decides; empty tables give empty results; extra columns aren't
read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.components import components
from docloom.llm.runs import run_ends, runs_by, trimmed
from docloom.llm.scratch import Scratch, broadcast_if_small
from docloom.llm.words import U, _splitmix, column_bytes, groups, mix, shingles, words

SIZE = 64
LEAF = 256
MAX_DEPTH = 10
PLAN_DEPTH = 6
PEELS = 1
BLOCK = 512
SAMPLE = 256
RECALL = 0.9999
DEVIATIONS = 4
_FACTORS = _splitmix(11, SIZE) | U(1)


def survival(threshold: float, depth: int) -> float:
    """Chance that a pair with this similarity shares a node of that level of one tree."""
    s = 1.0
    for _ in range(depth):
        s = 1 - (1 - threshold * s) * (1 - (1 - threshold) * s)
    return s


def tree_count(threshold: float, recall: float = RECALL) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(threshold, PLAN_DEPTH)))


def _signatures(k: int):
    """doc_id, text -> doc_id, n_shingles, two sums that stand for the set, minwise values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, ids = column_bytes(b.column(1)), b.column(0)
            for i, j in groups(texts):
                s, o = shingles(*words(texts[i:j]), k)
                counts = np.diff(o)
                which = np.repeat(np.arange(j - i), counts)
                order = np.lexsort((s, which))
                s, which = s[order], which[order]
                new = np.ones(len(s), dtype=bool)
                new[1:] = (s[1:] != s[:-1]) | (which[1:] != which[:-1])
                s, which = s[new], which[new]
                n = np.bincount(which, minlength=j - i)
                full = np.flatnonzero(n)
                at = np.concatenate([[0], np.cumsum(n[full])[:-1]]).astype(np.int64) if len(full) else np.zeros(0, np.int64)
                keys, sig = np.zeros((2, j - i), dtype=U), np.zeros((j - i, SIZE), dtype=np.uint32)
                if len(full):
                    keys[0, full], keys[1, full] = np.add.reduceat(mix(s), at), np.bitwise_xor.reduceat(mix(s * U(0x9E3779B97F4A7C15)), at)
                    for c in range(SIZE):
                        sig[full, c] = (np.minimum.reduceat(s * _FACTORS[c], at) >> U(32)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i).cast(pa.int64()), pa.array(n.astype(np.int64)), pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)), pa.array([r.tobytes() for r in sig], pa.binary())],
                    ["doc_id", "n_shingles", "k1", "k2", "sig"],
                )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, ids = column_bytes(b.column(1)), b.column(0)
            for i, j in groups(texts):
                s, o = shingles(*words(texts[i:j]), k)
                rows = [np.unique(s[x:y]).view(np.int64) for x, y in zip(o, o[1:], strict=False)]
                offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else []))], ["doc_id", "shingles"])

    return run


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, SIZE)


def _branch(threshold: float, trees: int | None = None):
    """node, id, sig -> the child nodes of each row; with trees: id, sig -> the roots' children."""
    extra = U(int((1 / threshold - 1) * 2**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig, ids = _matrix(b.column("sig")), b.column("id").to_numpy()
            if not len(ids):
                continue
            nodes, rows = [], []
            for r in mix(np.arange(1, trees + 1, dtype=U)) if trees else [None]:
                node = np.full(len(ids), r, dtype=U) if trees else b.column("node").to_numpy().view(U)
                c1, c2 = mix(node ^ U(0xA5A5)) % U(SIZE), mix(node ^ U(0x5A5A)) % U(SIZE)
                two = (mix(node ^ U(0x1234)) < extra) & (c1 != c2)
                every = np.arange(len(ids))
                for c, rows_of in ((c1, every), (c2[two], every[two])):
                    value = sig[rows_of, c.astype(np.int64)].astype(U)
                    nodes.append(mix(mix(node[rows_of] + c + U(1)) + value))
                    rows.append(rows_of)
            rows = np.concatenate(rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes).view(np.int64)), pa.array(ids[rows])], ["node", "id"])

    return run


def _estimates(x: np.ndarray) -> np.ndarray:
    """How many minwise values each two rows share."""
    like = np.zeros((len(x), len(x)), dtype=np.uint8)
    for column in x.T:
        like += column[:, None] == column[None, :]
    return like


def _root(root: dict | list, v: int) -> int:
    while root[v] != v:
        root[v] = root[root[v]]
        v = root[v]
    return v


def _candidates(cut: float):
    """Rows of nodes -> groups of ids that estimates of `cut` or more join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs_by(batches, "node"):
            nodes, ids, sig = t.column("node").to_numpy(), t.column("id").to_numpy(), _matrix(t.column("sig"))
            out: list[list[int]] = []
            for lo, hi in run_ends(nodes):
                if hi - lo < 2:
                    continue
                i, j = np.nonzero(np.triu(_estimates(sig[lo:hi]) >= cut * SIZE, 1))
                root = list(range(hi - lo))
                for p, q in zip(i.tolist(), j.tolist(), strict=True):
                    root[_root(root, p)] = _root(root, q)
                by: dict[int, list[int]] = {}
                for v in {*i.tolist(), *j.tolist()}:
                    by.setdefault(_root(root, v), []).append(int(ids[lo + v]))
                out += [sorted(x) for x in by.values()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int64()))], ["ids"])

    return run


def _intersections(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, by products of their incidence over some thousand members at a time."""
    which = np.repeat(np.arange(len(at) - 1), np.diff(at))
    _, member, held_by = np.unique(flat, return_inverse=True, return_counts=True)
    shared = held_by[member] > 1
    which, member = which[shared], np.unique(member[shared], return_inverse=True)[1]
    order = np.argsort(member, kind="stable")
    which, member = which[order], member[order]
    out = np.zeros((len(at) - 1, len(at) - 1), dtype=np.float64)
    step = 4096
    for first in range(0, int(member[-1]) + 1 if len(member) else 0, step):
        lo, hi = np.searchsorted(member, (first, first + step))
        x = np.zeros((len(at) - 1, step), dtype=np.float32)
        x[which[lo:hi], member[lo:hi] - first] = 1
        out += x @ x.T
    return out


def _group_links(num: int, den: int, cut: float):
    """Links within each group that join its components, on full sets; pairs of one component aren't compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs_by(batches, "node"):
            key, ids, sig = t.column("node").to_numpy(), t.column("id").to_numpy(), _matrix(t.column("sig"))
            held = t.column("shingles").combine_chunks()
            flat, at = held.values.to_numpy(), held.offsets.to_numpy()
            size = np.diff(at)
            a, b = [], []
            for lo, hi in run_ends(key):
                n, like, together = size[lo:hi], _estimates(sig[lo:hi]), None
                near = (like >= cut * SIZE) & (den * np.minimum(n[:, None], n[None, :]) >= num * np.maximum(n[:, None], n[None, :]))
                i, j = np.nonzero(np.triu(near, 1))
                if len(i) > 4 * (hi - lo):  # one product of all sets is cheaper than so many intersections
                    together = _intersections(flat[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                root = list(range(hi - lo))
                order = np.argsort(-like[i, j].astype(np.int16), kind="stable")
                for p, q in zip(i[order].tolist(), j[order].tolist(), strict=True):
                    u, v = _root(root, p), _root(root, q)
                    if u == v:
                        continue
                    x, y = lo + p, lo + q
                    both = int(together[p, q]) if together is not None else len(np.intersect1d(flat[at[x] : at[x + 1]], flat[at[y] : at[y + 1]], assume_unique=True))
                    if den * both >= num * (size[x] + size[y] - both):
                        root[u] = v
                        a.append(ids[x])
                        b.append(ids[y])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


def _medoids(threshold: float):
    """node, id, sig of a bounded sample -> each node's pivot: the one with most estimates at the threshold or above, and of these the one most like the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs_by(batches, "node"):
            key, ids, sig = t.column("node").to_numpy(), t.column("id").to_numpy(), _matrix(t.column("sig"))
            rows = []
            for lo, hi in run_ends(key):
                like = _estimates(sig[lo:hi])
                best = (like >= threshold * SIZE).sum(axis=1) * (hi - lo) * SIZE + like.sum(axis=1, dtype=np.int64)
                rows.append((key[lo], ids[lo + int(best.argmax())]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["node", "pivot"])

    return run


def _alike(cut: float):
    """id, pivot, sig, pivot_sig -> id, pivot of those whose estimate is `cut` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = (_matrix(b.column(2)) == _matrix(b.column(3))).mean(axis=1) >= cut
                yield b.select([0, 1]).filter(pa.array(near))

    return run


def _block_links(num: int, den: int, cut: float):
    """Links of a block's lone rows with its other rows that join components; pairs of one component aren't compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs_by(batches, "block"):
            key, ids, sig, comp, lone = t.column("block").to_numpy(), t.column("id").to_numpy(), _matrix(t.column("sig")), t.column("component").to_numpy(), t.column("lone").to_numpy(zero_copy_only=False)
            held = t.column("shingles").combine_chunks()
            flat, at = held.values.to_numpy(), held.offsets.to_numpy()
            size = np.diff(at)
            a, b = [], []
            for lo, hi in run_ends(key):
                rows = np.arange(lo, hi)
                rest, ones = rows[~lone[rows]], rows[lone[rows]]
                if not len(rest) or not len(ones):
                    continue
                there = np.unique(np.concatenate([flat[at[r] : at[r + 1]] for r in rest]))
                root = {c: c for c in comp[rows].tolist()}
                for r in ones:
                    mine, own = flat[at[r] : at[r + 1]], int(comp[r])
                    # of a set with a link at least the threshold's share of its own shingles stands in the other
                    held_too = np.searchsorted(there, mine)
                    if den * np.count_nonzero(there[np.minimum(held_too, len(there) - 1)] == mine) < num * len(mine):
                        continue
                    like = (sig[rest] == sig[r]).mean(axis=1)
                    # |A & B| is the smaller size at most, |A | B| the larger at least
                    near = (like >= cut) & (comp[rest] != comp[r]) & (den * np.minimum(size[rest], size[r]) >= num * np.maximum(size[rest], size[r]))
                    for x in rest[near][np.argsort(-like[near], kind="stable")]:
                        u, v = _root(root, own), _root(root, int(comp[x]))
                        if u == v:
                            continue
                        both = len(np.intersect1d(mine, flat[at[x] : at[x + 1]], assume_unique=True))
                        if den * both >= num * (size[r] + size[x] - both):
                            root[u] = v
                            a.append(ids[r])
                            b.append(ids[x])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


def _full_sets(docs: DataFrame, ids: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """doc_id, shingles of the documents with these ids."""
    texts = docs.join(broadcast_if_small(scratch.keep(ids.distinct())), "doc_id", "left_semi").select("doc_id", "text")
    return scratch.keep(texts.mapInArrow(trimmed(_sets(k)), "doc_id long, shingles array<long>").groupBy("doc_id").agg(F.first("shingles").alias("shingles")))


def _compared(docs: DataFrame, pairs: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """Pairs with i, the size of the intersection, and u, that of the union of the full sets."""
    pairs = scratch.keep(pairs.distinct())
    sets = _full_sets(docs, pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))), k, scratch)
    # b first: in stars it is the class that occurs least
    joined = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b").join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
    both = F.size(F.array_intersect("sa", "sb"))
    out = scratch.keep(joined.select("a", "b", both.alias("i"), (F.size("sa") + F.size("sb")).alias("n")))
    scratch.drop(sets)
    return out.select("a", "b", "i", (F.col("n") - F.col("i")).alias("u"))


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


class _Search:
    """Trees, pivots and links of one table's classes. reps: id, sig of each class."""

    def __init__(self, docs: DataFrame, reps: DataFrame, k: int, num: int, den: int, scratch: Scratch) -> None:
        self.docs, self.reps, self.k, self.num, self.den, self.scratch = docs, reps, k, num, den, scratch
        self.threshold = num / den
        self.cut = self._less(self.threshold)
        self.parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    @staticmethod
    def _less(similarity: float) -> float:
        return similarity - DEVIATIONS * math.sqrt(similarity * (1 - similarity) / SIZE)

    def _by(self, d: DataFrame, key: str) -> DataFrame:
        return d.repartition(self.parts, key).sortWithinPartitions(key, "id")

    def _near_pivots(self, pairs: DataFrame) -> DataFrame:
        """Pairs (id, pivot) of classes that may be near, compared on full sets: id, pivot, i, u."""
        keep, join = self.scratch.keep, broadcast_if_small
        of_pivots = keep(self.reps.join(join(pairs.select(F.col("pivot").alias("id")).distinct()), "id", "left_semi").select(F.col("id").alias("pivot"), F.col("sig").alias("pivot_sig")))
        signed = pairs.join(self.reps, "id").join(join(of_pivots), "pivot").select("id", "pivot", "sig", "pivot_sig")
        alike = keep(signed.mapInArrow(trimmed(_alike(max(0.0, self._less(2 * self.threshold - 1)))), "id long, pivot long"))
        return _compared(self.docs, alike.select(F.col("pivot").alias("a"), F.col("id").alias("b")), self.k, self.scratch).select(F.col("b").alias("id"), F.col("a").alias("pivot"), "i", "u")

    def _linked(self) -> Column:
        return self.den * F.col("i") >= self.num * F.col("u")

    def peel(self, large: DataFrame) -> tuple[DataFrame, DataFrame]:
        """large (node, id) without the classes linked with a pivot of their node's family, and all pairs compared: family, id, pivot, i, u.

        Pivots that share a class that is linked with both are one family. What is linked with one of them leaves all nodes of the family, as
        what stays in these is compared with all of them."""
        keep, join = self.scratch.keep, broadcast_if_small
        sample = large.groupBy("node", F.pmod(F.xxhash64("id"), F.lit(SAMPLE)).alias("_s")).agg(F.min(F.struct(F.xxhash64("id").alias("h"), "id")).alias("x")).select("node", "x.id")
        pivots = keep(self._by(sample.join(self.reps, "id"), "node").mapInArrow(trimmed(_medoids(self.threshold)), "node long, pivot long"))
        held = keep(large.join(join(pivots), "node"))
        pairs = keep(held.where("id <> pivot").select("id", "pivot").distinct())
        first = self._near_pivots(pairs)
        every = pivots.select("pivot").distinct()
        star = keep(first.where(self._linked()).select("id", "pivot").unionByName(every.select(F.col("pivot").alias("id"), "pivot")))
        families = keep(star.join(star.groupBy("id").agg(F.min("pivot").alias("least")), "id").groupBy("pivot").agg(F.min("least").alias("family")))
        of = join(families)
        gone = star.join(of, "pivot").select("family", "id").distinct()
        left = keep(held.join(of, "pivot").select("node", "family", "id").join(gone, ["family", "id"], "left_anti"))
        more = self._near_pivots(keep(left.select("family", "id").distinct().join(of, "family").select("id", "pivot").join(pairs, ["id", "pivot"], "left_anti")))
        found = keep(first.unionByName(more).join(of, "pivot").select("family", "id", "pivot", "i", "u"))
        gone = found.where(self._linked()).select("family", "id").distinct()
        return keep(left.join(gone, ["family", "id"], "left_anti").select("node", "id")), found

    def leaf_links(self, small: DataFrame) -> DataFrame:
        """Links within leaves; small: node, id."""
        keep = self.scratch.keep
        sets_of = lambda rows, column: rows.select(F.xxhash64(column).alias("node"), F.explode(column).alias("id"))
        leaves = small.groupBy("node").agg(F.sort_array(F.collect_list("id")).alias("ids")).where(F.size("ids") > 1).select("ids").distinct()
        rows = self._by(sets_of(leaves, "ids").join(self.reps, "id"), "node").select("node", "id", "sig")
        found = keep(rows.mapInArrow(trimmed(_candidates(self.cut)), "ids array<long>").distinct())
        rows = keep(sets_of(found, "ids"))
        sets = _full_sets(self.docs, rows.select(F.col("id").alias("doc_id")), self.k, self.scratch)
        whole = self._by(rows.join(sets.withColumnRenamed("doc_id", "id").join(self.reps, "id"), "id"), "node").select("node", "id", "sig", "shingles")
        out = keep(whole.mapInArrow(trimmed(_group_links(self.num, self.den, self.cut)), "a long, b long"))
        self.scratch.drop(sets)
        return out

    def blocks(self, lone: DataFrame, rest: DataFrame) -> DataFrame:
        """Links of lone rows with others of the same group and of another component; lone, rest: group, id, component.

        Either side is dealt into blocks of about BLOCK rows and each block meets each of the other side."""
        keep = self.scratch.keep
        count = lambda d, n: d.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(n))
        sizes = broadcast_if_small(keep(count(lone, "nu").join(count(rest, "nm"), "group")))
        lone, rest = keep(lone.join(sizes, "group")), keep(rest.join(sizes, "group"))
        sets = _full_sets(self.docs, lone.select(F.col("id").alias("doc_id")).unionByName(rest.select(F.col("id").alias("doc_id"))), self.k, self.scratch)
        mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        key = lambda i, j: F.xxhash64("group", i, j)
        one = lone.select("id", "component", F.lit(True).alias("lone"), F.explode(F.transform(F.sequence(F.lit(0), F.col("nm") - 1), lambda j: key(mine("nu"), j))).alias("block"))
        other = rest.select("id", "component", F.lit(False).alias("lone"), F.explode(F.transform(F.sequence(F.lit(0), F.col("nu") - 1), lambda i: key(i, mine("nm")))).alias("block"))
        whole = self._by(one.unionByName(other).join(sets.withColumnRenamed("doc_id", "id"), "id").join(self.reps, "id"), "block")
        out = keep(whole.select("block", "id", "component", "lone", "sig", "shingles").mapInArrow(trimmed(_block_links(self.num, self.den, self.cut)), "a long, b long"))
        self.scratch.drop(sets)
        return out

    def fringe_links(self, found: DataFrame, known: DataFrame) -> DataFrame:
        """Links of classes near a pivot with those linked with it. found: pairs family, id, pivot, i, u; known: id and component by all other links.

        Of a family's pivots a class stands for the one most like it, and what is in a pivot's component by other links isn't compared again."""
        own = F.min(F.struct((-F.col("i") / F.col("u")).alias("unlike"), "pivot"))["pivot"]
        of_pivot = broadcast_if_small(self.scratch.keep(found.select("pivot").distinct().join(known.withColumnsRenamed({"id": "pivot", "component": "of"}), "pivot", "left").select("pivot", F.coalesce("of", "pivot").alias("of"))))
        star = found.where(self._linked()).groupBy("family", "id").agg(own.alias("pivot")).join(of_pivot, "pivot").select(F.col("pivot").alias("group"), "id", F.col("of").alias("component"))
        close = found.where(~self._linked() & (self.den * F.col("i") >= (2 * self.num - self.den) * F.col("u"))).select("pivot", "id").distinct()
        lone = close.join(known, "id", "left").join(of_pivot, "pivot").select(F.col("pivot").alias("group"), "id", F.coalesce("component", "id").alias("component"), "of")
        return self.blocks(self.scratch.keep(lone.where("component <> of").drop("of")), self.scratch.keep(star.distinct()))

    def run(self, shared: DataFrame) -> DataFrame:
        """id and component of the classes with links. shared: a, b of classes that one doc_id links."""
        keep = self.scratch.keep
        level = self.reps.mapInArrow(trimmed(_branch(self.threshold, tree_count(self.threshold))), "node long, id long")
        small, links, compared = [], [keep(shared)], []
        for depth in range(1, MAX_DEPTH + 1):
            level = keep(level)
            sizes = keep(level.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LEAF).select("node"))
            if sizes.isEmpty():
                small.append(level)
                break
            held = broadcast_if_small(sizes)
            small.append(level.join(held, "node", "left_anti"))
            large = level.join(held, "node", "left_semi")
            if depth <= PEELS:
                large, found = self.peel(keep(large))
                compared.append(found)
            if depth == MAX_DEPTH:
                side = keep(large.select(F.col("node").alias("group"), "id", F.col("id").alias("component")))
                links.append(self.blocks(side, side))
                break
            level = large.join(self.reps, "id").select("node", "id", "sig").mapInArrow(trimmed(_branch(self.threshold)), "node long, id long")
        if compared:
            found = self.scratch.keep(reduce(DataFrame.unionByName, compared).distinct())
            links.append(found.where(self._linked()).select(*_ordered("id", "pivot")))
        links.append(self.leaf_links(reduce(DataFrame.unionByName, small)))
        known = components(reduce(DataFrame.unionByName, links), self.scratch)
        if not compared:
            return known
        more = self.fringe_links(found, known)
        return known if more.isEmpty() else components(known.select(F.col("component").alias("a"), F.col("id").alias("b")).unionByName(more), self.scratch)


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs (doc_id, text). Linked: den * intersection >= num * union."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = scratch.keep(docs.mapInArrow(trimmed(_signatures(k)), "doc_id long, n_shingles long, k1 long, k2 long, sig binary"))
    known = rows.where("doc_id IS NOT NULL AND n_shingles > 0")
    # written, so that the joins deal it anew and large classes can be split
    classes = scratch.keep(known.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("id")))
    members = scratch.keep(known.select("doc_id", "k1", "k2", "n_shingles").join(classes, ["k1", "k2", "n_shingles"]).select("doc_id", "id").distinct())
    reps = scratch.keep(known.join(classes.select("k1", "k2", "n_shingles", "id"), ["k1", "k2", "n_shingles"]).where("doc_id = id").groupBy("id", "k1", "k2").agg(F.first("sig").alias("sig")).groupBy("id").agg(F.first("sig").alias("sig")))
    # a doc_id that occurs with several texts belongs to several classes and links them
    several = members.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("doc_id", "a")
    shared = members.join(several, "doc_id").where("id <> a").select("a", F.col("id").alias("b"))
    labels = _Search(docs, reps, k, num, den, scratch).run(shared)
    final = scratch.keep(members.join(labels, "id", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "id")).alias("component_id")))
    scratch.only(rows, final)
    out = rows.select("doc_id", "n_shingles").join(final, "doc_id", "left")
    own = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def keep_one_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs without those that have a near duplicate of smaller doc_id; of repeated rows of one doc_id one stays. Rows without doc_id stay."""
    scratch = Scratch(docs.sparkSession)
    gone = scratch.keep(near_duplicates(docs, k, num, den).where("NOT kept").select("doc_id").distinct())
    left = docs.join(broadcast_if_small(gone), "doc_id", "left_anti")
    repeated = scratch.keep(docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("doc_id"))
    if repeated.isEmpty():
        return left.select(*docs.columns)
    many = broadcast_if_small(repeated)
    return left.join(many, "doc_id", "left_anti").unionByName(left.join(many, "doc_id", "left_semi").dropDuplicates(["doc_id"])).select(*docs.columns)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, num=85, den=100)


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) IN (1, 2)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 85 * (a.n + b.n - i)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.id WHERE r.c < e.y),
c AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.c AS component_id, d.doc_id = c.c AS kept FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.id = d.doc_id
"""
