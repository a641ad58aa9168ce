"""URL filters: a Bloom filter cascade over host-and-path keys.

Level 1 encodes the listed keys; level 2 encodes the keys of the corpus that level 1 passes though
they aren't listed; level 3 the listed keys that level 2 passes, and so on until a level passes
nothing wrong. Membership is then exact for every key of the corpus, and testing a row takes bit
tests on constant arrays only: no shuffle, no Python. Lists of millions of keys are cut into shards by a hash, with filters that are
broadcast as single rows of a bounded size; only a list beyond all of them (about 100 million keys) meets the keys of the pages by a join.

A url's keys are all suffixes of its host at dots, each followed by the prefixes of its path of the
lengths that occur among the listed paths. Null urls and urls without `://` have the empty host and
path, match no rule and get the default verdict. Repeated rows are judged alike; of rules of equal
length that fit one url, a block wins, then the smaller string; an empty table or rule list is fine;
urls of any length are judged whole; the input's other columns pass through, unless the output has a column of that name: then its own
value stands.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.scratch import Scratch, broadcast_if_small

#: Fixed by contract: action, host and path.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS_PER_KEY, HASHES = 10, 5
#: A filter of up to so many bytes travels in the plan as a constant, a larger one as a broadcast row; none has more than MAX_LEVEL_BYTES, about 3 million
#: listed keys, and a list no more than MAX_SHARDS parts, 128 MB of first levels.
PLAN_BYTES, MAX_LEVEL_BYTES, MAX_SHARDS = 1 << 16, 4 << 20, 32


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, lower-cased, and path."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def keys_of(host: Column, path: Column, lengths: Sequence[int]) -> Column:
    """Every host suffix with every path prefix of the given lengths, and those only that the path is long enough for."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.array_compact(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sorted(set(lengths))])) if lengths else F.array().cast("array<string>")
    return F.array_distinct(F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p)))))


def _positions(key: Column, level: int, bits: int) -> list[Column]:
    a, b = F.xxhash64(key, F.lit(2 * level)), F.xxhash64(key, F.lit(2 * level + 1))
    return [F.pmod(F.call_function("shiftright", a, F.lit(8)) + F.lit(j).cast("long") * F.call_function("shiftright", b, F.lit(8)), F.lit(bits).cast("long")) for j in range(HASHES)]


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(shards))


class Cascade:
    """Filters by shard and level; test(key) is exact for all keys it was built over, on frames that attach() gave.

    A filter is a list of 64-bit words, which travels in the plan as a constant, or, if it is larger, the name of an array column of
    `rows`, tables of one row each of at most MAX_LEVEL_BYTES, which attach() broadcasts."""

    def __init__(self, shards: list[list[list[int] | str]], rows: list[DataFrame]) -> None:
        self.shards, self.rows = shards, rows

    @property
    def levels(self) -> list[list[int] | str]:
        return self.shards[0]

    def attach(self, df: DataFrame) -> DataFrame:
        for row in self.rows:
            df = df.join(F.broadcast(row))
        return df

    def passes(self, key: Column, shard: int, level: int, words: int) -> Column:
        held = self.shards[shard][level]
        column = F.col(held) if isinstance(held, str) else F.from_json(F.lit(str(held)), "array<bigint>")
        out = F.lit(True)
        for p in _positions(key, level, 64 * words):
            out = out & (F.call_function("shiftrightunsigned", F.get(column, F.floor(p / 64).cast("int")), F.pmod(p, F.lit(64)).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)
        return out

    def _test(self, key: Column, shard: int) -> Column:
        """The first level that rejects the key decides; odd levels hold listed keys."""
        levels = self.shards[shard]
        out = F.lit(len(levels) % 2 == 1)
        for level in reversed(range(len(levels))):
            words = F.size(F.col(levels[level])) if isinstance(levels[level], str) else len(levels[level])
            out = F.when(self.passes(key, shard, level, words), out).otherwise(F.lit(level % 2 == 1))
        return out

    def test(self, key: Column) -> Column:
        """Whether the key is in the list."""
        out = self._test(key, 0)
        for shard in range(1, len(self.shards)):
            out = F.when(shard_of(key, len(self.shards)) == shard, self._test(key, shard)).otherwise(out)
        return F.coalesce(out, F.lit(False))


def _words(keys: DataFrame, count: int, level: int) -> tuple[DataFrame, int]:
    """w, bits of a filter's words that aren't zero, put together by an aggregate of bounded size, and the number of all words."""
    n = max(1, math.ceil(count * BITS_PER_KEY / 64))
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), level, 64 * n))).alias("p"))
    return at.groupBy(F.floor(F.col("p") / 64).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("p", F.lit(64)).cast("int"))).alias("bits")), n


def _add_filter(cascade: Cascade, shard: int, keys: DataFrame, count: int, scratch: Scratch) -> int:
    """The filter of the shard's next level; returns its words."""
    level = len(cascade.shards[shard])
    words, n = _words(keys, count, level)
    if 8 * n <= PLAN_BYTES:
        out = [0] * n
        for r in words.collect():  # at most PLAN_BYTES / 8 rows
            out[r.w] = r.bits
        cascade.shards[shard].append(out)
    else:
        name = f"_cascade_{uuid.uuid4().hex[:12]}"
        every = keys.sparkSession.range(n).join(words, F.col("id") == F.col("w"), "left").agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))).alias("x"))
        cascade.rows.append(scratch.keep(every.select(F.transform("x", lambda x: x["bits"]).alias(name))))
        cascade.shards[shard].append(name)
    return n


def build_cascade(listed: DataFrame, universe: DataFrame, max_levels: int = 40) -> Cascade | None:
    """listed, universe: column key. Lists that need larger filters than MAX_LEVEL_BYTES are cut into shards by a hash of the key, each with filters of its own; beyond MAX_SHARDS it is None.

    The universe is read once a shard; each level's wrong passes are written, and later levels read these small sets."""
    scratch = Scratch(listed.sparkSession)
    inside = scratch.keep(listed.select("key").where(F.col("key").isNotNull()).distinct())
    shards = max(1, math.ceil(inside.count() * BITS_PER_KEY / 8 / MAX_LEVEL_BYTES))
    if shards > MAX_SHARDS:
        return None
    cascade = Cascade([[] for _ in range(shards)], [])
    for shard in range(shards):
        mine = lambda df: df.where(shard_of(F.col("key"), shards) == shard) if shards > 1 else df  # noqa: B023, E731
        own = mine(inside)
        encode, other = own, mine(universe.select("key").where(F.col("key").isNotNull()))
        for level in range(max_levels):
            n = _add_filter(cascade, shard, encode, encode.count(), scratch)
            wrong = cascade.attach(other).where(cascade.passes(F.col("key"), shard, level, n)).select("key").distinct()
            if level == 0:
                wrong = wrong.join(broadcast_if_small(own), "key", "left_anti")
            wrong = scratch.keep(wrong)
            if wrong.isEmpty():
                break
            encode, other = wrong, encode
        else:
            raise RuntimeError("the cascade doesn't end")
    scratch.only(*cascade.rows)
    return cascade


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict. A rule fits its host and all subdomains of it if the url's path starts with the rule's; the longest wins."""
    spark = pages.sparkSession
    host, path = split_url(F.col(url))
    lengths = [len(p) for _, _, p in rules]
    found = keys_of(host, path, lengths)
    scratch = Scratch(spark)
    universe = scratch.keep(pages.select(F.explode(found).alias("key")).distinct())  # of all lists; hot keys are met in their own tasks first
    matched = F.array().cast("array<struct<n:int,w:int,rule:string,action:string>>")
    whole = list(pages.columns)
    for weight, action in enumerate(("block", "allow")):
        listed = [(h + p,) for a, h, p in rules if a == action]
        if not listed:
            continue
        keys = spark.createDataFrame(listed, "key string")
        cascade = build_cascade(keys, universe)
        if cascade is None:  # a list beyond all filters: the keys of the pages that it has, by a join
            pages = _with_hits(pages, found, keys, f"_hits{weight}")
            hits = F.col(f"_hits{weight}")
        else:
            pages = cascade.attach(pages)
            hits = F.filter(found, cascade.test)
        matched = F.concat(matched, _tagged(hits, action, weight))
    scratch.only()
    best = F.get(F.sort_array(matched), 0)
    kept = [c for c in whole if c.lower() not in ("host", "path", "rule", "verdict")]
    return pages.select(*kept, host.alias("host"), path.alias("path"), best.alias("_best")).select(*kept, "host", "path", F.col("_best.rule").alias("rule"), F.coalesce(F.col("_best.action"), F.lit(default)).alias("verdict"))


def _with_hits(pages: DataFrame, found: Column, listed: DataFrame, name: str) -> DataFrame:
    """pages with an array of their keys that are listed. Keys of pages are made distinct before they meet the list, and rows with the same keys share a result."""
    keyed = pages.withColumn("_keys", found).withColumn("_of", F.sha2(F.array_join("_keys", "\n"), 256))
    sets = keyed.groupBy("_of").agg(F.first("_keys").alias("_keys")).select("_of", F.explode("_keys").alias("key"))
    hits = sets.join(listed.distinct(), "key").groupBy("_of").agg(F.collect_list("key").alias(name))
    return keyed.join(hits, "_of", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>"))).drop("_of", "_keys")


def _tagged(hits: Column, action: str, weight: int) -> Column:
    return F.transform(hits, lambda k: F.struct((-F.length(k)).alias("n"), F.lit(weight).alias("w"), k.alias("rule"), F.lit(action).alias("action")))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH r(action, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
u AS (SELECT row_number() OVER () AS rid, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT rid, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (
  SELECT s.*, r.action, r.h || r.p AS rule, row_number() OVER (PARTITION BY rid ORDER BY length(r.h || r.p) DESC NULLS LAST, r.action DESC, r.h || r.p) AS k
  FROM s LEFT JOIN r ON (s.host = r.h OR ends_with(s.host, '.' || r.h)) AND starts_with(s.path, r.p))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM m WHERE k = 1
"""
