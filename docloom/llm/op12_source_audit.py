"""Source divergence audit: how the word use of the sources of a language differs, by systolic rotation.

Terms are runs of ASCII letters and characters beyond ASCII, with A-Z lower-cased; a language keeps
those in at least `min_docs` of its documents. A group is a source within a language; it gives every
kept term p = 1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V)), all in whole numbers.

Counts are summed inside tasks, flushed at TALLY entries, and summed again by Spark. The kept terms of a
language are cut into slices of about SLICE terms by hash, and a group's counts in one slice are one
compressed vector. The groups of a language sit in blocks of BLOCK; a block's vectors stay in their
partition (`resident`), and in each round of a round-robin tournament the vectors of the peer block are
sent there, so that every pair of blocks meets once, slice by slice, and each meeting gives both
directions. The first round also brings the language's own vector past every block; a heap for each
vector keeps the terms that the group favours most. Sums over slices and ranks are plain aggregates.
No pair of groups is formed outside a meeting, a meeting holds 2 * BLOCK vectors of one slice however
many rows a source has, and only rows of one pair and slice leave it.

Defined results: null text, lang and source count as empty; a group without terms takes part with counts
of 0; where a language keeps no term its pairs have value 0; a language of one source has no pair rows;
equal values rank by the item's UTF-8 bytes; repeated rows count each time; texts of any length are read
whole, in pieces; an empty table gives an empty result; other columns of the input aren't read.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from docloom.llm.runs import trimmed
from docloom.llm.scratch import Scratch, broadcast_if_small
from docloom.llm.words import pieces

SCALE = 1_000_000_000
PRIOR = 5
MIN_DOCS = 30
TOP_TERMS = 50
#: Entries of a task's tally before it is sent on.
TALLY = 300_000
#: Terms of a slice, about; groups of a block.
SLICE = 1 << 13
BLOCK = 4
#: Bytes of a text that are split at a time.
PIECE = 1 << 22

_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

TALLIED = "lang string, source string, term string, n long, docs long"


def _emitted(tally: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
    for (lang, source), (n, docs) in tally.items():
        terms = [b"", *n]  # the empty term stands for the group itself
        size = len(terms)
        columns = [pa.repeat(pa.scalar(lang), size), pa.repeat(pa.scalar(source), size), pa.array(terms, pa.binary()).cast(pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(docs.__getitem__, n)], pa.int64())]
        yield from pa.Table.from_arrays(columns, schema=schema).to_batches(max_chunksize=20_000)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by group; what a task holds is bounded by TALLY entries and one document's terms."""
    tally: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
    held = 0
    for b in batches:
        for text, lang, source in zip(b.column("text").cast(pa.large_binary()), b.column("lang").to_pylist(), b.column("source").to_pylist(), strict=True):
            n, docs = tally[lang, source]
            held -= len(n)
            seen: set[bytes] = set()
            for piece in pieces((text.as_py() or b"").translate(_TERMS), PIECE):
                words = piece.split()
                n.update(words)
                seen.update(words)
            docs.update(seen)
            held += len(n)
            if held >= TALLY:
                yield from _emitted(tally)
                tally.clear()
                held = 0
    yield from _emitted(tally)


def group_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n, docs; one row of the empty term for every group there is."""
    plain = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for c, a in ((text, "text"), (lang, "lang"), (source, "source"))))
    return plain.mapInArrow(trimmed(_tally), TALLIED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(counts: np.ndarray, whole: int) -> np.ndarray:
    """1 + floor(SCALE * counts / whole) for 0 <= counts <= whole, by long division in thousands so that nothing overflows."""
    if whole >= 1 << 53:
        counts = counts.astype(object)
    out, rest = counts // whole, counts % whole
    for _ in range(3):
        out, rest = out * 1000 + rest * 1000 // whole, rest * 1000 % whole
    return (out + 1).astype(np.int64)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of (id, n), ordered by id, as compressed gaps and counts."""
    for b in batches:
        lists, blobs = b.column("terms"), []
        flat, at = lists.flatten(), np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
        ids, n = flat.field("id").to_numpy(), flat.field("n").to_numpy()
        for i, j in zip(at, at[1:], strict=False):
            blobs.append(zlib.compress(np.diff(ids[i:j], prepend=0).astype(np.int32).tobytes() + n[i:j].astype(np.int64).tobytes(), 1))
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("lang", "slice", "source", "whole", "m")), pa.array(blobs, pa.binary())], names=["lang", "slice", "source", "whole", "m", "vector"])


def _unpacked(blob: bytes, m: int) -> np.ndarray:
    """Counts of all m terms of the slice."""
    raw = zlib.decompress(blob)
    k = len(raw) // 12
    counts = np.zeros(m, dtype=np.int64)
    counts[np.cumsum(np.frombuffer(raw, np.int32, k))] = np.frombuffer(raw, np.int64, k, 4 * k)
    return counts


def _shares(rows: pa.Table) -> tuple[list[str], list[np.ndarray], list[np.ndarray]]:
    """Names, counts and shares of the vectors of a meeting."""
    names, m = rows.column("source").to_pylist(), rows.column("m").to_pylist()
    counts = [_unpacked(v, k) for v, k in zip(rows.column("vector").to_pylist(), m, strict=True)]
    return names, counts, [share(c + PRIOR, w) if len(c) else c for c, w in zip(counts, rows.column("whole").to_pylist(), strict=True)]


_MET = pa.schema([("lang", pa.string()), ("slice", pa.int32()), ("source", pa.string()), ("peer", pa.string()), ("id", pa.int32()), ("value", pa.int64())])
MET = "lang string, slice int, source string, peer string, id int, value long"


def _met(key: tuple, found: list[tuple]) -> pa.Table:
    lang, part = key[0].as_py(), key[1].as_py()
    columns = list(zip(*found, strict=True)) or [()] * 4
    fixed = [pa.array([lang] * len(found), pa.string()), pa.array([part] * len(found), pa.int32())]
    return pa.Table.from_arrays(fixed + [pa.array(c, f.type) for c, f in zip(columns, list(_MET)[2:], strict=True)], schema=_MET)


def _home_round(top: int):  # noqa: ANN202
    def meet(key: tuple, resident: pa.Table, visitor: pa.Table) -> pa.Table:
        """A block's vectors among themselves, and each with its language's vector: peer and value, or term id and value."""
        names, counts, p = _shares(resident)
        _, _, whole = _shares(visitor)
        found = [(a, b, None, int(np.abs(p[i] - p[j]).sum())) for i, a in enumerate(names) for j, b in enumerate(names) if i != j]
        for name, n, own in zip(names, counts, p, strict=True):
            more = own - whole[0]
            ids = np.flatnonzero((n > 0) & (more > 0))
            found += [(name, None, i, -f) for f, i in heapq.nsmallest(top, zip((-more[ids]).tolist(), ids.tolist(), strict=True))]
        return _met(key, found)

    return meet


def _peer_round(key: tuple, resident: pa.Table, visitor: pa.Table) -> pa.Table:
    """All vectors of a block with all of the visiting block, in both directions."""
    if not resident.num_rows or not visitor.num_rows:
        return _met(key, [])
    names, _, p = _shares(resident)
    peers, _, q = _shares(visitor)
    met = [(a, b, int(np.abs(x - y).sum())) for a, x in zip(names, p, strict=True) for b, y in zip(peers, q, strict=True)]
    return _met(key, [row for a, b, v in met for row in ((a, b, None, v), (b, a, None, v))])


def opponent(block: Column, blocks: Column, round_no: int) -> Column:
    """The block that `block` meets in a round of the circle method; one of no such number is a bye, and so are rounds beyond the last."""
    ring = blocks + blocks % 2 - 1
    other = F.pmod(F.lit(round_no) - block, ring)
    last = F.pmod(F.lit(round_no) * ((ring + 1) / 2).cast("int"), ring)
    return F.when(F.lit(round_no) >= ring, blocks).when(block == ring, last).when(other == block, ring).otherwise(other)


def _vectors(counts: DataFrame, min_docs: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vectors of the groups and languages (source null) by slice, the groups with their blocks, and the kept terms with their places."""
    kept = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    kept = scratch.keep(kept.select("lang", "term", "n"))
    seen = counts.where("term = ''").select("lang", "source")
    langs = seen.select("lang").distinct().join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("whole")), "lang", "left")
    langs = langs.select("lang", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("whole", F.lit(0)).alias("whole"))
    langs = broadcast_if_small(scratch.keep(langs.withColumn("slices", F.greatest(F.lit(1), F.ceil(F.col("v") / SLICE)).cast("int"))))
    place = Window.partitionBy("lang", "slice").orderBy("term")
    terms = kept.join(langs.select("lang", "slices"), "lang").withColumn("slice", F.pmod(F.xxhash64("term"), "slices").cast("int"))
    terms = scratch.keep(terms.select("lang", "slice", "term", "n", (F.row_number().over(place) - 1).alias("id")))
    held = counts.where("term <> ''").select("lang", "source", "term", "n").join(terms.drop("n"), ["lang", "term"])
    rows = held.unionByName(terms.withColumn("source", F.lit(None).cast("string")))
    parts = scratch.keep(rows.groupBy("lang", "source", "slice").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("terms"), F.sum("n").alias("sum")))
    sizes = parts.groupBy("lang", "source").agg(F.sum("sum").alias("n"))
    groups = seen.unionByName(langs.select("lang", F.lit(None).cast("string").alias("source")))
    groups = groups.join(sizes, groups.lang.eqNullSafe(sizes.lang) & groups.source.eqNullSafe(sizes.source), "left").select(groups.lang, groups.source, F.coalesce("n", F.lit(0)).alias("n"))
    groups = groups.withColumn("at", F.row_number().over(Window.partitionBy("lang", F.col("source").isNull()).orderBy("source")) - 1)
    groups = groups.join(langs, "lang").withColumn("blocks", F.ceil(F.sum(F.when(F.col("source").isNotNull(), 1)).over(Window.partitionBy("lang")) / BLOCK).cast("int"))
    groups = scratch.keep(groups.select("lang", "source", (F.col("n") + PRIOR * F.col("v")).alias("whole"), "slices", "blocks", F.floor(F.col("at") / BLOCK).cast("int").alias("block")))
    grid = groups.select("lang", "source", "whole", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    width = terms.groupBy("lang", "slice").agg(F.count(F.lit(1)).cast("int").alias("m"))
    cells = grid.join(parts, grid.lang.eqNullSafe(parts.lang) & grid.source.eqNullSafe(parts.source) & (grid.slice == parts.slice), "left").select(grid.lang, grid.slice, grid.source, "whole", "terms")
    cells = cells.join(width, ["lang", "slice"], "left").select("lang", "slice", "source", "whole", F.coalesce("m", F.lit(0)).alias("m"), "terms")
    packed = scratch.keep(cells.mapInArrow(trimmed(_packed), "lang string, slice int, source string, whole long, m int, vector binary"))
    scratch.drop(parts)
    return packed, groups, terms


def audit_sources(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: every other source of the language by its distance (part pair), and the terms that a source favours most (part term, up to rank `top`)."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    counts = scratch.keep(group_counts(docs, text, lang, source))
    packed, groups, terms = _vectors(counts, min_docs, scratch)
    scratch.drop(counts)
    where = groups.where("source IS NOT NULL").select("lang", "source", "block", "blocks")
    home = ["lang", "slice", "block"]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    resident = packed.join(where, ["lang", "source"]).repartition(n, *home).persist(StorageLevel.DISK_ONLY)
    blocks = where.select("lang", "block").distinct()
    own = scratch.keep(packed.where("source IS NULL").join(blocks, "lang"))
    met = [scratch.keep(resident.groupBy(*home).cogroup(own.groupBy(*home)).applyInArrow(_home_round(top), MET))]
    most = where.agg(F.max("blocks")).first()[0] or 0
    for r in range(most + most % 2 - 1):
        other = opponent(F.col("block"), F.col("blocks"), r)
        plays = resident.withColumn("other", other).where("other < blocks")
        stays, goes = plays.where("block < other").drop("other"), plays.where("block > other").withColumn("block", F.col("other")).drop("other")
        goes = goes.toDF(*goes.columns)  # columns of its own: it comes from the table that it visits
        met.append(scratch.keep(stays.groupBy(*home).cogroup(goes.groupBy(*home)).applyInArrow(_peer_round, MET)))
    pairs = met[0].where("peer IS NOT NULL")
    for later in met[1:]:
        pairs = pairs.unionByName(later)
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.groupBy("lang", "source", F.col("peer").alias("item")).agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))
    favoured = met[0].where("peer IS NULL").join(terms.select("lang", "slice", "id", F.col("term").alias("item")), ["lang", "slice", "id"])
    favoured = favoured.select("lang", "source", F.lit("term").alias("part"), "item", "value", F.row_number().over(by_value).alias("rank")).where(F.col("rank") <= top)
    result = scratch.keep(pairs.unionByName(favoured))
    resident.unpersist()
    scratch.only(result)
    return result


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
langs AS (SELECT lang, sum(n)::HUGEINT AS n, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (coalesce(s.n, 0) + 5 * l.v) AS p
  FROM g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN s USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pair AS (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
dist AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value FROM pair LEFT JOIN dist USING (lang, source, item)),
q AS (SELECT k.lang, k.term, 1 + (1000000000 * (k.n::HUGEINT + 5)) // (l.n + 5 * l.v) AS q FROM kept k JOIN langs l USING (lang)),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p.p - q.q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
