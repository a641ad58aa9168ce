"""Quality rules: a bitmask ledger. Every rule is evaluated once over whole texts; a row stores the
measurements and one bit per failed rule, and versioned policies and ablations are bit operations
on the stored ledger, so the texts are never read again.

Words are runs of characters outside space and 0x09-0x0D. Null and empty texts have no words and
no symbols and fail `few_words`; a text of any length is measured whole, as one row of arrays of its
words; ties can't arise; repeated rows are judged alike, each on its own; an empty table gives an
empty ledger; other columns of the input never enter the expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = r"[ \t-\r]+"
SYMBOLS = "#*$%&|<>"

#: Rule names by bit.
RULES = ("few_words", "repeated_windows", "symbols", "duplicate_lines", "long_words")
#: Rules that a policy version enforces.
POLICIES = {1: ("few_words", "repeated_windows"), 2: ("few_words", "repeated_windows", "symbols", "duplicate_lines", "long_words")}


def policy_mask(version: int) -> int:
    return sum(1 << RULES.index(name) for name in POLICIES[version])


def _measured(docs: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Keys and measurements. The word array and the sorted window array are columns of their own
    projections, each used more than once, so the optimizer doesn't copy them into the lambdas."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.select(*keys, t.alias("_t"))
    d = d.withColumn("_w", F.array_remove(F.split("_t", SPACES), "")).withColumn("_n", F.size("_w"))
    d = d.withColumn("_bits", F.length(F.bin("_n")))
    window = lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))
    # window hash in the high bits, position in the low ones: a plain sort of longs brings equal windows together
    packed = F.transform(
        F.sequence(F.lit(0), F.col("_n") - 3),
        lambda i: F.coalesce(F.call_function("shiftleft", F.call_function("shiftright", window(i), F.col("_bits")), F.col("_bits")).bitwiseOR(i.cast("long")), F.lit(0).cast("long")),
    )
    d = d.withColumn("_s", F.when(F.col("_n") >= 3, F.sort_array(packed)))
    high = lambda x: F.call_function("shiftright", x, F.col("_bits"))
    low = lambda x: (x - F.call_function("shiftleft", high(x), F.col("_bits"))).cast("int")

    def same(x: Column, y: Column) -> Column:
        """Equal hashes, confirmed on the words themselves."""
        words = [F.get("_w", low(x) + j) == F.get("_w", low(y) + j) for j in range(3)]
        return F.coalesce((high(x) == high(y)) & words[0] & words[1] & words[2], F.lit(False))

    again = F.filter("_s", lambda x, i: same(x, F.get("_s", i - 1)) | same(x, F.get("_s", i + 1)))
    d = d.withColumn("_r", F.transform(again, low))
    covered = F.array_distinct(F.flatten(F.transform("_r", lambda p: F.array(p, p + 1, p + 2))))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    d = d.withColumn("_lines", lines)
    return d.select(
        *keys,
        F.col("_n").cast("long").alias("n_words"),
        F.length(F.translate("_t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.coalesce(F.size("_r"), F.lit(0)) > 0, F.size(covered)).otherwise(0).cast("long").alias("n_repeat_words"),
    )


def quality_ledger(docs: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """keys, the measurements, and failed: bit i is set if RULES[i] failed. One pass, no shuffle."""
    failed = (
        F.col("n_words") < 50,
        100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
        10 * F.col("n_symbols") > F.col("word_chars"),
        2 * F.col("n_dup_lines") > F.col("n_lines"),
        F.col("word_chars") > 40 * F.col("n_words"),
    )
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failed)]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return _measured(docs, keys, text).withColumn("failed", mask.cast("int"))


def apply_policy(ledger: DataFrame, version: int) -> DataFrame:
    """The ledger with kept: none of the rules of that policy failed."""
    return ledger.withColumn("kept", F.col("failed").bitwiseAND(policy_mask(version)) == 0)


def ablations(ledger: DataFrame, version: int) -> DataFrame:
    """For each rule of the policy: rule, n_failed, and n_only_this: rows that would be kept without it.

    Rows are counted by their bits under the policy first, which leaves one row for each pattern."""
    names = POLICIES[version]
    patterns = ledger.groupBy(F.col("failed").bitwiseAND(policy_mask(version)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    has = [F.struct(F.lit(r).alias("rule"), (F.col("bits").bitwiseAND(1 << RULES.index(r)) != 0).alias("fails")) for r in names]
    rules = ledger.sparkSession.createDataFrame([(r,) for r in names], "rule string")
    counted = patterns.select("n", F.bit_count("bits").alias("rules"), F.explode(F.array(*has)).alias("x")).where("x.fails").groupBy("x.rule").agg(F.sum("n").alias("n_failed"), F.sum(F.when(F.col("rules") == 1, F.col("n"))).alias("n_only_this"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rules.join(counted, "rule", "left").select("rule", zero("n_failed"), zero("n_only_this"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ledger = apply_policy(quality_ledger(docs), 2)
    base = F.col("failed").bitwiseAND(policy_mask(1)) != 0
    return ledger.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "failed", base.alias("base_failed"), "kept")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
win AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
rep AS (SELECT rid, i FROM win WHERE (rid, x) IN (SELECT (rid, x) FROM win GROUP BY rid, x HAVING count(*) > 1)),
cov AS (SELECT rid, count(DISTINCT i + j) AS n FROM rep, (VALUES (0), (1), (2)) AS o(j) GROUP BY rid),
ln AS (SELECT rid, count(*) AS n, count(DISTINCT x) AS u FROM (SELECT rid, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (
  SELECT w.doc_id, len(w.w)::BIGINT AS n_words, length(regexp_replace(w.t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(w.t) - length(regexp_replace(w.t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(ln.n - ln.u, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(ln.n, 0)::BIGINT AS n_lines
  FROM w LEFT JOIN ln USING (rid) LEFT JOIN cov USING (rid)),
f AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END + CASE WHEN 10 * n_symbols > word_chars THEN 4 ELSE 0 END
    + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END + CASE WHEN word_chars > 40 * n_words THEN 16 ELSE 0 END)::INTEGER AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, failed, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept FROM f
"""
