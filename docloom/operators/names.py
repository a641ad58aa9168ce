"""Names of correspondents, types and tags: matching guesses, ranking by use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import name_key, name_tokens


def match_names(guesses: DataFrame, entries: DataFrame) -> DataFrame:
    """guess, id, method, candidates. guesses: guess; entries: id, name (a dimension, in id order).

    Equal names win, then equal keys, then equal word sets if one entry alone has them; several are
    ambiguous; else up to five names that share words are a near miss. Equi-joins on derived keys."""
    g = guesses.select("guess").distinct().select("guess", name_key(F.col("guess")).alias("key"), name_tokens(F.col("guess")).alias("tokens"))
    e = entries.select("id", "name", name_key(F.col("name")).alias("key"), name_tokens(F.col("name")).alias("tokens"))
    exact = g.join(e, F.col("guess") == F.col("name")).groupBy("guess").agg(F.min(e["id"]).alias("exact"))
    by_key = g.select("guess", "key").join(e.select("id", "key"), "key").groupBy("guess").agg(F.min("id").alias("normalised"))
    some = g.where(F.size("tokens") > 0)
    loose = some.select("guess", "tokens").join(e.select("id", "name", "tokens"), "tokens").groupBy("guess").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("loose"), F.transform(F.sort_array(F.collect_list(F.struct("id", "name"))), lambda x: x["name"]).alias("equal"))
    shared = some.select("guess", F.explode("tokens").alias("t")).join(e.select("id", "name", F.explode("tokens").alias("t")), "t").groupBy("guess", "id", "name").agg(F.count(F.lit(1)).alias("n"))
    near = shared.groupBy("guess").agg(F.slice(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "id", "name"))), lambda x: x["name"]), 1, 5).alias("near"))
    all_ = g.select("guess").join(exact, "guess", "left").join(by_key, "guess", "left").join(loose, "guess", "left").join(near, "guess", "left")
    found = F.coalesce("exact", "normalised", F.when(F.col("n") == 1, F.col("loose")))
    method = F.when(F.col("exact").isNotNull(), "exact").when(F.col("normalised").isNotNull(), "normalised").when(F.col("n") == 1, "loose").when(F.col("n") > 1, "ambiguous").when(F.col("near").isNotNull(), "near_miss").otherwise("none")
    return all_.withColumn("method", method).select("guess", found.alias("id"), "method", F.when(F.col("method") == "ambiguous", F.col("equal")).when(F.col("method") == "near_miss", F.col("near")).otherwise(F.array().cast("array<string>")).alias("candidates"))


#: Characters by which names that may hold each other are brought together.
ANCHOR = 3


def _anchor(key: Column) -> Column:
    return F.substring(key, 1, ANCHOR)


def _substrings(key: Column) -> Column:
    """Distinct substrings of 1 to ANCHOR characters."""
    of = lambda n: F.when(F.length(key) >= n, F.transform(F.sequence(F.lit(1), F.length(key) - n + 1), lambda i: key.substr(i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.array(*[of(n) for n in range(1, ANCHOR + 1)])))


def match_items(guesses: DataFrame, items: DataFrame, key) -> DataFrame:
    """guess, id: equal after `key` (a column function), else the first item whose key holds the guess's or lies in it.

    Of two keys the one that lies in the other shares its first ANCHOR characters with it, so candidates
    come by an equi-join of these with all substrings of that length."""
    g = guesses.select("guess", key(F.col("guess")).alias("k")).where("k <> ''")
    i = items.select("id", key(F.col("name")).alias("k")).where("k <> ''")
    equal = g.join(i, "k").groupBy("guess").agg(F.min("id").alias("id"))
    rest = g.join(equal, "guess", "left_anti").withColumnRenamed("k", "gk")
    inside = rest.withColumn("a", _anchor(F.col("gk"))).join(i.withColumn("a", F.explode(_substrings(F.col("k")))), "a").where(F.contains(F.col("k"), F.col("gk"))).select("guess", "id")
    around = i.withColumn("a", _anchor(F.col("k"))).join(rest.withColumn("a", F.explode(_substrings(F.col("gk")))), "a").where(F.contains(F.col("gk"), F.col("k"))).select("guess", "id")
    part = inside.unionByName(around).groupBy("guess").agg(F.min("id").alias("id"))
    return guesses.select("guess").distinct().join(equal.unionByName(part), "guess", "left")


def usage_count(value):
    """A count that is a number, a numeral, or a list of documents."""
    v = F.try_parse_json(value)
    size = F.size(F.try_variant_get(v, "$", "array<variant>"))
    return F.coalesce(F.try_variant_get(v, "$", "bigint"), F.when(size >= 0, size.cast("long")), F.lit(0).cast("long"))


def top_names(items: DataFrame, limit: int = 0) -> DataFrame:
    """name, usage: of names equal in lower case the most used (the first of equals, by id); most used first; limit 0 is all. items: id, name, usage."""
    named = items.withColumn("name", F.trim("name")).where("name <> ''")
    best = named.groupBy(F.lower("name").alias("key")).agg(F.min(F.struct((-F.col("usage")).alias("u"), "id", "name")).alias("b"))
    ranked = best.select("key", F.col("b.name").alias("name"), (-F.col("b.u")).alias("usage")).orderBy(F.col("usage").desc(), "key")
    return (ranked.limit(limit) if limit > 0 else ranked).select("name", "usage")
