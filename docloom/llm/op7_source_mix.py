"""Mixing sources to target weights by Pareto order sampling.

Sources in code-point order, null last, get the weights in turn and share the corpus's words by
them; no source gets more than `cap` times its own words, and the excess is shared anew by weight.

Within a source documents have unequal inclusion weights: by default the binary digits of their
size, a mild preference for long documents. A document is expected `c * weight` times, `cap` at
most, with the c that makes the source's expected words its target. The whole part of that number
is certain, and the fraction is the inclusion probability of one copy more: each document draws u
from a hash of the seed and its doc_id, documents are ranked by their odds u / (1 - u) divided by
the odds of their inclusion probability, and the ranked prefix whose words come nearest to what is
left of the target is taken once more.

No source is ever gathered in one task: the cut in the ranking is found by sums over 4096 ranges
of ranks, then over 4096 ranges within the one that holds the cut, then over the few rows left.
Only the table of sources, one row each, is ordered as a whole.

Null texts have size 0 and are never taken; texts of any length are counted whole; a null doc_id
draws like the text 'null'; rows of one source that share a doc_id and a weight are taken or left
together, and documents of equal rank follow doc_id; empty tables give empty results; columns of the
input pass through, unless the output has a column of that name. Reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.scratch import Scratch, broadcast_if_small

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = 20240229
_RANGES = 4096
ADDED = ("size", "source_size", "target", "taken")


def size_of(text: Column) -> Column:
    """Number of words."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")


def inclusion_weight_of(size: Column) -> Column:
    """The default weight: binary digits of the size."""
    return F.length(F.bin(size)).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, target.

    In order of cap * source_size / weight the capped sources come first, so the level that the
    others share follows from running sums over one row a source."""
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    by = by.withColumn("_w", F.get(F.array(*[F.lit(w) for w in weights]), n % len(weights)).cast("long"))
    by = by.withColumn("_ratio", F.lit(cap) * F.col("source_size") / F.col("_w"))
    order = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    by = by.withColumn("_level", (F.sum("source_size").over(Window.partitionBy()) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("_w").over(rest))
    open_level = F.min(F.when(F.col("_ratio") >= F.col("_level"), F.struct("_ratio", F.col("source").isNull().alias("_null"), "source", "_level"))).over(Window.partitionBy())["_level"]
    by = by.withColumn("_open", open_level)
    by = by.withColumn("target", F.when(F.col("_ratio") >= F.col("_level"), F.col("_open") * F.col("_w")).otherwise((F.lit(cap) * F.col("source_size")).cast("double")))
    return by.select("source", "source_size", "target")


def inclusions(sized: DataFrame, targets: DataFrame, cap: int = CAP) -> DataFrame:
    """For each source and inclusion weight iw: source, source_size, target, iw, whole (certain copies), p (of one more) and rest (words of the target beyond the source's certain copies).

    The heaviest weights reach the cap first, so c follows from running sums over one row a weight."""
    by = sized.groupBy("source", "iw").agg(F.sum("size").alias("_size")).join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    source = Window.partitionBy("source")
    order = source.orderBy(F.col("iw").desc())
    before, left = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    over = F.sum(F.col("iw") * F.col("_size")).over(left)
    by = by.withColumn("_c", F.when(over > 0, (F.col("target") - cap * F.coalesce(F.sum("_size").over(before), F.lit(0))) / over))
    by = by.withColumn("_c", F.max(F.when(F.col("_c") * F.col("iw") <= cap, F.struct("iw", "_c"))).over(source)["_c"])
    by = by.withColumn("_e", F.coalesce(F.least(F.lit(float(cap)), F.col("_c") * F.col("iw")), F.lit(float(cap))))
    by = by.withColumn("whole", F.floor("_e").cast("long")).withColumn("p", F.col("_e") - F.floor("_e").cast("double"))
    by = by.withColumn("rest", F.col("target") - F.sum(F.col("whole") * F.col("_size")).over(source).cast("double"))
    return by.select("source", "source_size", "target", "iw", "whole", "p", "rest")


def _odds_rank(doc_id: Column, p: Column) -> Column:
    """u / (1 - u) / (p / (1 - p)) for a u in (0, 1) that only seed and doc_id decide."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("long")
    u = (bits.cast("double") + 0.5) / F.lit(float(1 << 48))
    return (u / (1 - u)) / (p / (1 - p))


def mix_sources(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: Sequence[int] = WEIGHTS, cap: int = CAP, inclusion_weight: Column | None = None) -> DataFrame:
    """docs with size, source_size, target and taken (words, repeats counted).

    inclusion_weight: whole numbers from 1 on, few distinct ones; by default inclusion_weight_of the size."""
    scratch = Scratch(docs.sparkSession)
    weight = lambda size: inclusion_weight_of(size) if inclusion_weight is None else inclusion_weight.cast("long")
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size_of(F.col(text)).alias("size"), *([] if inclusion_weight is None else [inclusion_weight.cast("long").alias("iw")]))
    sized = scratch.keep(sized.withColumn("iw", inclusion_weight_of(F.col("size"))) if inclusion_weight is None else sized)
    kinds = scratch.keep(inclusions(sized, source_targets(sized, weights, cap), cap))
    held = broadcast_if_small(kinds.where("p > 0 AND rest > 0").select(F.col("source").alias("_src"), F.col("iw").alias("_iw"), "p", "rest"), 100_000)
    clamped = lambda p: F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p))
    same_kind = F.col("source").eqNullSafe(F.col("_src")) & (F.col("iw") == F.col("_iw"))

    def cut_range(d: DataFrame, cell: Column) -> DataFrame:
        """Per source the range of ranks that holds the cut, and the words before it."""
        sums = d.groupBy("_src", cell.alias("_cell")).agg(F.sum("size").alias("_size"), F.first("rest").alias("rest"), F.first("before").alias("before"))
        upto = F.col("before") + F.sum("_size").over(Window.partitionBy("_src").orderBy("_cell"))
        return sums.withColumn("_upto", upto).where(F.col("_upto") >= F.col("rest")).groupBy("_src").agg(F.min(F.struct("_cell", (F.col("_upto") - F.col("_size")).alias("b"))).alias("_c")).select(F.col("_src").alias("_at"), F.col("_c._cell").alias("_cut"), F.col("_c.b").alias("before"))

    z = F.col("q") / (1 + F.col("q"))
    rows = sized.join(held, same_kind).withColumn("q", _odds_rank(F.col("doc_id"), clamped(F.col("p")))).withColumn("before", F.lit(0).cast("long"))
    # _cell of level 1: 1 / 4096 of the ranks; of level 2: 1 / 4096 of that
    for scale in (_RANGES, _RANGES * _RANGES):
        cell = F.floor(z * scale).cast("long")
        cut = scratch.keep(cut_range(rows, cell))
        small = broadcast_if_small(cut, 100_000)
        rows = rows.drop("before").join(small, F.col("_src").eqNullSafe(F.col("_at")) & (cell == F.col("_cut"))).drop("_at", "_cut")
    items = rows.groupBy("_src", "q", "doc_id").agg(F.sum("size").alias("size"), F.first("rest").alias("rest"), F.first("before").alias("before"))
    upto = F.col("before") + F.sum("size").over(Window.partitionBy("_src").orderBy("q", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = items.withColumn("_upto", upto).where(F.col("_upto") + F.col("_upto") - F.col("size") < 2 * F.col("rest"))
    last = last.groupBy("_src").agg(F.max(F.struct("q", F.col("doc_id").isNotNull().alias("_known"), "doc_id")).alias("_last"))
    # a source whose cut range takes nothing from that range still takes all ranks before it; where the sums never reach the rest, all are taken
    final = cut.select(F.col("_at").alias("_src"), (F.col("_cut").cast("double") / float(_RANGES * _RANGES)).alias("_floor")).join(last.withColumnRenamed("_src", "_of"), F.col("_src").eqNullSafe(F.col("_of")), "left").drop("_of")
    final = scratch.keep(kinds.withColumnRenamed("source", "_s").join(final, F.col("_s").eqNullSafe(F.col("_src")), "left").drop("_src"))
    scratch.only(final)

    # what the decision needs travels in two structs, so that no column of docs can clash with it
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ADDED]
    size = size_of(F.col(text))
    row = F.struct(size.alias("size"), F.col(doc_id).alias("id"), F.col(source).alias("source"), weight(size).alias("iw")).alias("__row")
    mixed = final.select(F.struct(*final.columns).alias("__mix"))
    out = docs.select(*kept, row).join(broadcast_if_small(mixed, 100_000), F.col("__row.source").eqNullSafe(F.col("__mix._s")) & (F.col("__row.iw") == F.col("__mix.iw")))
    drawn = (F.col("__mix.rest") > 0) & (F.col("__mix.p") > 0)
    q = _odds_rank(F.col("__row.id"), clamped(F.col("__mix.p")))
    cells = float(_RANGES * _RANGES)
    before_cut = F.coalesce(F.floor(q / (1 + q) * cells) < F.col("__mix._floor") * cells, F.lit(True))
    in_cut = F.coalesce(F.struct(q.alias("q"), F.col("__row.id").isNotNull().alias("_known"), F.col("__row.id").alias("doc_id")) <= F.col("__mix._last"), F.lit(False))
    more = F.when(drawn & (before_cut | in_cut), 1).otherwise(0)
    return out.select(*kept, F.col("__row.size").alias("size"), F.col("__mix.source_size").alias("source_size"), F.col("__mix.target").alias("target"), (F.col("__row.size") * (F.col("__mix.whole") + more)).cast("long").alias("taken"))


def copies(mixed: DataFrame) -> DataFrame:
    """One row for each time that a document is taken; the columns of mix_sources go."""
    n = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(0)
    return mixed.where(n > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1), n))).drop("__copy", *ADDED)


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([5, 2, 1])[1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INTEGER] AS w FROM s),
r AS (SELECT *, 3 * source_size / w AS ratio FROM w),
l AS (
  SELECT *, ((sum(source_size) OVER ())::BIGINT - 3 * coalesce(sum(source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
    / (sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level, row_number() OVER (ORDER BY ratio, source NULLS LAST) AS n FROM r),
o AS (SELECT *, arg_min(level, n) FILTER (WHERE ratio >= level) OVER () AS open FROM l),
t AS (SELECT source, source_size, CASE WHEN ratio >= level THEN open * w ELSE (3 * source_size)::DOUBLE END AS target FROM o),
g AS (SELECT source, length(bin(size))::BIGINT AS iw, sum(size)::BIGINT AS gs FROM d GROUP BY ALL),
h AS (SELECT g.*, t.source_size, t.target FROM g JOIN t ON g.source IS NOT DISTINCT FROM t.source),
i AS (
  SELECT *, (target - 3 * coalesce(sum(gs) OVER (PARTITION BY source ORDER BY iw DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
    / nullif((sum(iw * gs) OVER (PARTITION BY source ORDER BY iw DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT, 0) AS c FROM h),
j AS (SELECT *, arg_max(c, iw) FILTER (WHERE c * iw <= 3) OVER (PARTITION BY source) AS open_c FROM i),
e AS (SELECT *, coalesce(least(3.0::DOUBLE, open_c * iw), 3.0::DOUBLE) AS copies FROM j),
f AS (SELECT *, floor(copies)::BIGINT AS whole, copies - floor(copies) AS p FROM e),
x AS (SELECT *, target - (sum(whole * gs) OVER (PARTITION BY source))::DOUBLE AS rest FROM f),
y AS (
  SELECT d.doc_id, d.size, x.*, greatest(1e-9, least(1 - 1e-9, x.p)) AS clamped,
    (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u
  FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source AND length(bin(d.size)) = x.iw),
q AS (SELECT *, p > 0 AND rest > 0 AS drawn, (u / (1 - u)) / (clamped / (1 - clamped)) AS q FROM y),
k AS (SELECT *, sum(CASE WHEN drawn THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY drawn DESC, q, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM q)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN drawn AND upto + upto - size < 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM k
"""
