"""License scans: ordered signature rules over whole texts, without Python workers.

A text's words are runs of a-z, 0-9 and characters beyond ASCII, with A-Z lower-cased. The signatures
(`license_rules`) are regexes over the words with one space between; each names words that must be
there. A text's words are intersected with all these words once (the prefilter), and only rules whose
words are all there run, so a text without them costs no regex. A rule's detections are its leftmost matches from
left to right, as ranges of words.

Detections that overlap are resolved by containment: one is suppressed if another of the same or a higher tier
covers its whole range and is longer, of a higher tier, or earlier in the rules. Partial overlaps both stay. As only (row, range, rule)
remain of the text, they are resolved by a running maximum of ends per tier in windows of one document.
The base phrases are rules as well; their places and labels stay, suppressed or not. The score is the confidence
of the best detection that stays, by its tier; 0 without any.

Defined results: null and empty texts have no words, empty labels, score 0 and null positions; texts of
any length are read whole, as one row of an array of words; ties go to the earlier rule; repeated rows are
scanned each by itself; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.license_rules import CONFIDENCE, Rule, rules
from docloom.llm.scratch import Scratch

NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MARK = "\x01"
RULE = "array<struct<no:int,needs:array<string>,regex:string>>"


def lowered(text: Column) -> Column:
    """A-Z lower-cased for matching ASCII: the two letters beyond ASCII whose lower case has one of a-z are put aside."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "[\u212A\u0130]", "\u0138"))


def _starts(norm: Column, regex: Column) -> Column:
    """Numbers of the words at which matches begin: every word stands between two spaces, so a mark before a match is alone between the spaces of two words."""
    parts = F.split(F.regexp_replace(norm, regex, F.lit(f"{MARK}$0")), F.lit(" "))
    return F.transform(F.filter(F.transform(parts, lambda x, i: F.when(x == MARK, i)), lambda i: i.isNotNull()), lambda i: (i / 2).cast("int"))


def detections(docs: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text", with_rules: Sequence[Rule] | None = None) -> DataFrame:
    """keys, n_words, and found: every match as (start, end, no) with words start to end - 1 and the rule's number. One pass, no shuffle."""
    found_by = rules() if with_rules is None else with_rules
    needed = sorted({w for r in found_by for w in r.needs})
    table = F.from_json(F.lit(json.dumps([{"no": r.no, "needs": r.needs, "regex": r.regex} for r in found_by])), RULE)
    d = docs.select(*keys, F.array_remove(F.split(lowered(F.col(text)), NO_WORD), "").alias("_w"))
    d = d.select(*keys, "_w", F.size("_w").cast("long").alias("n_words"), F.array_intersect("_w", F.array(*map(F.lit, needed))).alias("_there"))
    run = F.filter(table, lambda r: F.forall(r["needs"], lambda w: F.array_contains("_there", w)))
    d = d.select(*keys, "_w", "n_words", F.when(F.size("_there") > 0, run).alias("_run"))
    d = d.select(*keys, "n_words", "_run", F.when(F.size("_run") > 0, F.concat(F.lit(" "), F.array_join("_w", "  "), F.lit(" "))).alias("_norm"))
    matched = F.filter(F.transform("_run", lambda r: F.struct(r["no"].alias("no"), r["regex"].alias("regex"), F.regexp_extract_all("_norm", r["regex"], F.lit(0)).alias("all"))), lambda m: F.size(m["all"]) > 0)
    d = d.select(*keys, "n_words", "_norm", F.when(F.size("_run") > 0, matched).alias("_m"))

    def ranges(m: Column) -> Column:
        words = lambda x: ((F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))) / 2).cast("int")
        return F.transform(
            F.arrays_zip(_starts(F.col("_norm"), m["regex"]).alias("start"), F.transform(m["all"], words).alias("size")),
            lambda z: F.struct(z["start"].alias("start"), (z["start"] + z["size"]).alias("end"), m["no"].alias("no")),
        )

    return d.select(*keys, "n_words", F.when(F.size("_m") > 0, F.flatten(F.transform("_m", ranges))).alias("found"))


def resolve(found: DataFrame) -> DataFrame:
    """found (row, start, end, no, tier) with suppressed: whether a range of its tier or a higher one covers it."""
    before = Window.partitionBy("row").orderBy("start", F.desc("end"), F.desc("tier"), "no").rowsBetween(Window.unboundedPreceding, -1)
    covered = [(F.col("tier") == t) & (F.max(F.when(F.col("tier") >= t, F.col("end"))).over(before) >= F.col("end")) for t in CONFIDENCE]
    hidden = covered[0]
    for c in covered[1:]:
        hidden = hidden | c
    return found.withColumn("suppressed", F.coalesce(hidden, F.lit(False)))


def scan_licenses(docs: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text", with_rules: Sequence[Rule] | None = None) -> DataFrame:
    """keys, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    found_by = list(rules() if with_rules is None else with_rules)
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    scanned = scratch.keep(detections(docs, keys, text, found_by).withColumn("row", F.monotonically_increasing_id()))
    about = F.from_json(F.lit(json.dumps([{"label": r.label, "tier": r.tier, "base": r.base} for r in found_by])), "array<struct<label:string,tier:int,base:boolean>>")
    at = {r.no: i for i, r in enumerate(found_by)}
    position = F.col("no") if all(no == i for no, i in at.items()) else F.element_at(F.from_json(F.lit(json.dumps(at)), "map<int,int>"), F.col("no"))
    one = scanned.where("found IS NOT NULL").select("row", *keys, "n_words", F.inline("found"))
    one = one.select("*", F.get(about, position).alias("rule")).select("*", "rule.label", "rule.tier", "rule.base")
    stays, base = ~F.col("suppressed"), F.col("base")
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    confidence = F.lit(0.0)
    for tier, value in CONFIDENCE.items():
        confidence = F.when(F.col("tier") == tier, value).otherwise(confidence)
    start = F.when(base, F.col("start").cast("long"))
    with_any = resolve(one).groupBy("row", "n_words", *keys).agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(start).alias("first_word"), F.max(start).alias("last_word"),
        listed(base).alias("base_labels"), listed(base | stays).alias("labels"), F.max(F.when(stays, confidence)).alias("score"),
    )
    nothing = scanned.where("found IS NULL").select(*keys, "n_words", F.lit(0).cast("long").alias("n_base"), F.lit(None).cast("long").alias("first_word"), F.lit(None).cast("long").alias("last_word"), F.lit("").alias("base_labels"), F.lit("").alias("labels"), F.lit(0.0).alias("score"))
    return nothing.unionByName(with_any.drop("row"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _values(found_by: Sequence[Rule]) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return ",\n  ".join(f"({r.no}, {quote(r.label)}, {r.tier}, [{', '.join(map(quote, r.needs))}], {quote(r.regex)}, {str(r.base).lower()})" for r in found_by)


SQL = rf"""
WITH rules(no, label, tier, needs, regex, base) AS (VALUES
  {_values(rules())}),
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
n AS (SELECT row, ' ' || array_to_string(w, '  ') || ' ' AS norm, w FROM d WHERE list_has_any(w, (SELECT list(DISTINCT x) FROM (SELECT unnest(needs) AS x FROM rules)))),
m AS (SELECT row, no, label, tier, base, regex, norm, regexp_extract_all(norm, regex) AS hits FROM n JOIN rules ON list_has_all(w, needs)),
h AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(norm, regex, chr(1) || '\0', 'g'), ' '), lambda x, i: CASE WHEN x = chr(1) THEN (i - 1) // 2 ELSE -1 END), lambda x: x >= 0) AS starts FROM m WHERE len(hits) > 0),
f AS (SELECT row, no, label, tier, base, unnest(starts) AS b, unnest(list_transform(hits, lambda x: (length(x) - length(replace(x, ' ', ''))) // 2)) AS size FROM h),
r AS (SELECT *, b + size AS e FROM f),
s AS (SELECT *, CASE tier
    WHEN 1 THEN max(e) OVER o WHEN 2 THEN max(CASE WHEN tier >= 2 THEN e END) OVER o
    WHEN 3 THEN max(CASE WHEN tier >= 3 THEN e END) OVER o ELSE max(CASE WHEN tier >= 4 THEN e END) OVER o END AS before
  FROM r WINDOW o AS (PARTITION BY row ORDER BY b, e DESC, tier DESC, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, coalesce(before >= e, false) AS hidden FROM s),
g AS (SELECT row, count(*) FILTER (base) AS n_base, min(b) FILTER (base) AS first_word, max(b) FILTER (base) AS last_word,
    list_sort(list(DISTINCT label) FILTER (base)) AS base_labels, list_sort(list(DISTINCT label) FILTER (base OR NOT hidden)) AS labels,
    max(CASE tier WHEN 1 THEN 0.25 WHEN 2 THEN 0.5 WHEN 3 THEN 0.8 ELSE 1.0 END) FILTER (NOT hidden) AS score FROM t GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(base_labels, ','), '') AS base_labels, coalesce(array_to_string(labels, ','), '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN g USING (row)
"""
