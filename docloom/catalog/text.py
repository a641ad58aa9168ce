"""Text, date, name and tag functions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from docloom.catalog import query
from docloom.functions import dates, tags, text
from docloom.operators import names
from docloom.sources.driver_tables import MODEL_SQL, table, taxonomy

TODAY = dt.date(2026, 6, 10)
_SUFFIXES = "|".join(text.COMPANY_SUFFIXES)
_NAME = "trim(regexp_replace(trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')), '((^| )(" + _SUFFIXES + "))+$', ''))"


@query(f"SELECT c_custkey, {_NAME.format('raw')} AS name FROM (SELECT c_custkey, c_name || CASE c_custkey % 4 WHEN 0 THEN ' Ltd.' WHEN 1 THEN ', Inc. GmbH' WHEN 2 THEN '  Co Partners' ELSE '' END AS raw FROM customer)")
def normalise_name(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    ending = F.when(F.col("c_custkey") % 4 == 0, " Ltd.").when(F.col("c_custkey") % 4 == 1, ", Inc. GmbH").when(F.col("c_custkey") % 4 == 2, "  Co Partners").otherwise("")
    return c.select("c_custkey", text.normalise_name(F.concat("c_name", ending)).alias("name"))


@query("""SELECT doc_id, regexp_replace(lower(t), '[^a-z0-9]', '', 'g') AS key,
  array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower(t), '[^a-z0-9]+'), lambda x: x NOT IN ('', 'of', 'the', 'and', 'for', 'to')))), ' ') AS tokens
FROM (SELECT doc_id, substr(text, 1, 200) || ' ' || source || ' kg 7 IV' AS t FROM documents)""")
def name_keys(spark, sf_dir):
    """Keys of titles in which letters, digits and groups of them are written in their compatibility forms; the SQL has the plain ones."""
    t = F.translate(F.concat(F.substring("text", 1, 200), F.lit(" "), "source"), "aeost0123456789", "ａⅇº𝐬ｔ⁰①₂³４𝟓⑥₇８⁹")
    for plain, form in (("fi", "ﬁ"), ("ii", "ⅱ"), ("dz", "ǳ"), ("vi", "ⅵ")):
        t = F.replace(t, F.lit(plain), F.lit(form))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(t, F.lit(" ㎏ 𝟟 Ⅳ")).alias("t")).select("doc_id", text.name_key(F.col("t")).alias("key"), F.array_join(text.name_tokens(F.col("t")), " ").alias("tokens"))


_GUESSES = ("English", "ENGLISH", "english-", "Unused Ltd", "ltd unused", "The Unused of Ltd", "src1", "SRC-1", "Frenchish", "src1 src2", "the", "toxic good", "Good")


@query(f"""WITH {MODEL_SQL}, g AS (SELECT * FROM (VALUES {', '.join(f"('{g}')" for g in _GUESSES)}) v(guess)
  UNION SELECT CASE doc_id % 5 WHEN 0 THEN upper(source) WHEN 1 THEN 'The ' || source WHEN 2 THEN replace(source, 'src', 'src-') WHEN 3 THEN source || ' ' || lang ELSE substr(text, 1, 12) END FROM documents),
k AS (SELECT guess, regexp_replace(lower(guess), '[^a-z0-9]', '', 'g') AS key, list_sort(list_distinct(list_filter(string_split_regex(lower(guess), '[^a-z0-9]+'), lambda x: x NOT IN ('', 'of', 'the', 'and', 'for', 'to')))) AS tok FROM g),
e AS (SELECT id, name, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS key, list_sort(list_distinct(list_filter(string_split_regex(lower(name), '[^a-z0-9]+'), lambda x: x NOT IN ('', 'of', 'the', 'and', 'for', 'to')))) AS tok FROM taxonomy),
j AS (SELECT k.guess, min(CASE WHEN e.name = k.guess THEN e.id END) AS exact, min(CASE WHEN e.key = k.key THEN e.id END) AS norm, count(*) FILTER (WHERE len(k.tok) > 0 AND e.tok = k.tok) AS n, min(CASE WHEN len(k.tok) > 0 AND e.tok = k.tok THEN e.id END) AS loose,
  string_agg(e.name, '|' ORDER BY e.id) FILTER (WHERE len(k.tok) > 0 AND e.tok = k.tok) AS equal FROM k, e GROUP BY k.guess),
s AS (SELECT k.guess, e.name, e.id, len(list_intersect(k.tok, e.tok)) AS n FROM k, e WHERE len(list_intersect(k.tok, e.tok)) > 0),
near AS (SELECT guess, string_agg(name, '|' ORDER BY n DESC, id) AS near FROM (SELECT *, row_number() OVER (PARTITION BY guess ORDER BY n DESC, id) AS r FROM s) WHERE r <= 5 GROUP BY guess),
m AS (SELECT j.*, near.near, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN norm IS NOT NULL THEN 'normalised' WHEN n = 1 THEN 'loose' WHEN n > 1 THEN 'ambiguous' WHEN near.near IS NOT NULL THEN 'near_miss' ELSE 'none' END AS method FROM j LEFT JOIN near USING (guess))
SELECT guess, coalesce(exact, norm, CASE WHEN n = 1 THEN loose END) AS id, method, CASE method WHEN 'ambiguous' THEN equal WHEN 'near_miss' THEN near ELSE '' END AS candidates FROM m""")
def name_match(spark, sf_dir):
    """Fixed guesses, and guesses made of the documents' sources and texts."""
    k = F.col("doc_id") % 5
    said = F.when(k == 0, F.upper("source")).when(k == 1, F.concat(F.lit("The "), "source")).when(k == 2, F.replace("source", F.lit("src"), F.lit("src-"))).when(k == 3, F.concat_ws(" ", "source", "lang")).otherwise(F.substring("text", 1, 12))
    g = table(spark, sf_dir, "documents").select(said.alias("guess")).unionByName(spark.createDataFrame([(x,) for x in _GUESSES], "guess string"))
    return names.match_names(g, taxonomy(spark, sf_dir)).select("guess", "id", "method", F.array_join("candidates", "|").alias("candidates"))


@query("""WITH q AS (SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN 'Q' || (o_orderkey % 4 + 1) || ' ' || year(o_orderdate) || ' invoices' WHEN 1 THEN 'salary in ' || monthname(o_orderdate) || ' ' || year(o_orderdate)
    WHEN 2 THEN 'documents from ' || year(o_orderdate) WHEN 3 THEN 'on ' || strftime(o_orderdate, '%Y-%m-%d') || ' please' ELSE 'last month' END AS text, o_orderdate AS d FROM orders)
SELECT k, text, CASE k % 5 WHEN 0 THEN strftime(make_date(year(d), 3 * (k % 4)::INTEGER + 1, 1), '%Y-%m-%d') WHEN 1 THEN strftime(date_trunc('month', d), '%Y-%m-%d') WHEN 2 THEN strftime(date_trunc('year', d), '%Y-%m-%d') WHEN 3 THEN strftime(d, '%Y-%m-%d') ELSE '2026-05-01' END AS date_from,
  CASE k % 5 WHEN 0 THEN strftime(last_day(make_date(year(d), 3 * (k % 4)::INTEGER + 3, 1)), '%Y-%m-%d') WHEN 1 THEN strftime(last_day(d), '%Y-%m-%d') WHEN 2 THEN year(d) || '-12-31' WHEN 3 THEN strftime(d, '%Y-%m-%d') ELSE '2026-05-31' END AS date_to FROM q""")
def date_extract(spark, sf_dir):
    d, k = F.col("o_orderdate"), F.col("o_orderkey")
    said = (
        F.when(k % 5 == 0, F.concat(F.lit("Q"), (k % 4 + 1).cast("string"), F.lit(" "), F.year(d).cast("string"), F.lit(" invoices")))
        .when(k % 5 == 1, F.concat(F.lit("salary in "), F.date_format(d, "MMMM"), F.lit(" "), F.year(d).cast("string")))
        .when(k % 5 == 2, F.concat(F.lit("documents from "), F.year(d).cast("string")))
        .when(k % 5 == 3, F.concat(F.lit("on "), F.date_format(d, "yyyy-MM-dd"), F.lit(" please")))
        .otherwise("last month")
    )
    q = table(spark, sf_dir, "orders").select(k.alias("k"), said.alias("text"))
    return q.withColumn("r", dates.date_range(F.col("text"), TODAY)).select("k", "text", "r.date_from", "r.date_to")


@query("""SELECT doc_id, CASE WHEN raw = '' THEN NULL WHEN regexp_matches(lower(trim(raw)), '^[a-z]{2}([-_].*)?$') THEN substr(lower(trim(raw)), 1, 2) ELSE 'und' END AS language
FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN upper(lang) WHEN 1 THEN lang || '-XX' WHEN 2 THEN ' ' || lang || '_yy ' WHEN 3 THEN lang || 'lish' ELSE '' END AS raw FROM documents)""")
def language_normalise(spark, sf_dir):
    k, lang = F.col("doc_id") % 5, F.col("lang")
    raw = F.when(k == 0, F.upper(lang)).when(k == 1, F.concat(lang, F.lit("-XX"))).when(k == 2, F.concat(F.lit(" "), lang, F.lit("_yy "))).when(k == 3, F.concat(lang, F.lit("lish"))).otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", text.normalise_language(raw).alias("language"))


@query("""WITH d AS (SELECT doc_id, 'tag' || (doc_id % 3) AS a, source, lang FROM documents)
SELECT doc_id, 'gpt-5.4,o4-mini,2021,' || CASE WHEN lang = 'de' THEN '' ELSE 'de,' END || CASE WHEN lang = 'de' THEN 'de,' ELSE '' END || a || ',' || source || CASE WHEN lang = 'de' THEN '' ELSE ',' || lang END AS tags FROM d""")
def tag_enrich(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.array(F.concat(F.lit("tag"), (F.col("doc_id") % 3).cast("string")), F.lit(" "), F.lit("GPT-5.4"), F.upper("source"), "source", "lang").alias("t"))
    body = F.lit("page text\n\nTranscribed by model: gpt-5.4, o4-mini")
    return d.select("doc_id", F.array_join(tags.enrich_tags(F.col("t"), body, F.lit("2021"), "DE", 5), ",").alias("tags"))


@query("SELECT doc_id, source || ',keep' AS tags FROM documents")
def tag_filters(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.array(F.lit("New"), F.lit(" AI "), "source", F.lit("Keep Ltd"), F.lit("keep"), F.lit("Invoice"), F.upper("source")).alias("t"))
    clean = tags.without_redundant(tags.without_blacklisted(F.col("t")), F.lit("nobody"), F.lit("invoice"), F.lit("keep ltd"))
    return d.select("doc_id", F.array_join(clean, ",").alias("tags"))


@query("""WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'I''m sorry, I can''t assist with that. ' || text WHEN 1 THEN text || ' [name Redacted here]' WHEN 2 THEN 'CHATGPT REFUSED TO TRANSCRIBE' ELSE text END AS t FROM documents)
SELECT doc_id, regexp_matches(lower(t), '\\[[^\\]]*redacted[^\\]]*\\]') AS redacted, contains(lower(t), 'chatgpt refused to transcribe') OR (length(t) < 200 AND says) AS refusal, regexp_matches(lower(t), '\\[[^\\]]*redacted[^\\]]*\\]') OR says AS error
FROM (SELECT *, contains(lower(t), 'assist with that') OR contains(lower(t), 'i cannot assist') OR contains(lower(t), 'help with transcrib') OR contains(lower(t), 'chatgpt refused to transcribe') AS says FROM d)""")
def quality_gate(spark, sf_dir):
    k = F.col("doc_id") % 4
    t = F.when(k == 0, F.concat(F.lit("I'm sorry, I can't assist with that. "), "text")).when(k == 1, F.concat("text", F.lit(" [name Redacted here]"))).when(k == 2, "CHATGPT REFUSED TO TRANSCRIBE").otherwise(F.col("text"))
    d = table(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    return d.select("doc_id", text.contains_redacted(F.col("t")).alias("redacted"), text.is_model_refusal(F.col("t")).alias("refusal"), text.is_error_content(F.col("t")).alias("error"))


@query("""SELECT p_partkey, t IS NULL OR trim(lower(t)) IN ('', 'document', 'documents', 'general', 'misc', 'miscellaneous', 'n/a', 'na', 'none', 'other', 'unknown', 'unspecified') AS generic
FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN ' Document ' WHEN 1 THEN '' WHEN 2 THEN 'OTHER' ELSE p_type END AS t FROM part)""")
def generic_types(spark, sf_dir):
    k = F.col("p_partkey") % 4
    kind = F.when(k == 0, " Document ").when(k == 1, "").when(k == 2, "OTHER").otherwise(F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", text.is_generic_type(kind).alias("generic"))


@query("""SELECT name, usage FROM (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY usage DESC, id) AS r FROM (
  SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE lower(p_brand) END AS name, p_size::BIGINT AS usage FROM part)) WHERE r = 1 ORDER BY usage DESC, lower(name) LIMIT 10""")
def top_names(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).otherwise(F.lower("p_brand")).alias("name"), F.col("p_size").cast("long").alias("usage"))
    return names.top_names(p, 10)


@query("""WITH q AS (SELECT doc_id AS k, CASE doc_id % 4 WHEN 0 THEN source WHEN 1 THEN monthname(DATE '2020-01-01' + doc_id::INTEGER % 1461) || ' ' || lang ELSE array_to_string(string_split(replace(text, chr(10), ' '), ' ')[1:doc_id % 5 + 1], ' ') END AS q FROM documents),
w AS (SELECT k, q, list_filter(string_split_regex(q, '\\s+'), lambda x: x <> '') AS w FROM q)
SELECT k, len(w) BETWEEN 1 AND 3 AND NOT regexp_matches(q, '[\\p{Nd}@#/£$€%]') AND len(list_filter(w[2:], lambda x: regexp_matches(x, '^\\p{Lu}'))) = 0
  AND len(list_intersect(list_transform(w, lambda x: lower(x)), ['last', 'since', 'ago', 'year', 'years', 'month', 'months', 'week', 'weeks', 'day', 'days', 'yesterday', 'today', 'recent', 'past', 'before', 'after', 'during', 'between',
    'january', 'february', 'march', 'april', 'may', 'june', 'july', 'august', 'september', 'october', 'november', 'december'])) = 0 AS trivial FROM w""")
def trivial_query(spark, sf_dir):
    k = F.col("doc_id")
    words = F.array_join(F.slice(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " "), F.lit(1), (k % 5 + 1).cast("int")), " ")
    month = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), k.cast("int") % 1461), "MMMM")
    said = F.when(k % 4 == 0, F.col("source")).when(k % 4 == 1, F.concat_ws(" ", month, "lang")).otherwise(words)
    return table(spark, sf_dir, "documents").select(k.alias("k"), text.is_trivial_query(said).alias("trivial"))


@query("""WITH l AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS line FROM documents)
SELECT doc_id, CASE WHEN length(line) <= 280 THEN line ELSE rtrim(substr(line, 1, 280)) || '…' END AS snippet, substr(line, 1, 280) AS keyword_snippet FROM l""")
def snippets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.snippet(F.col("text")).alias("snippet"), text.snippet(F.col("text"), ellipsis=False).alias("keyword_snippet"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, CASE WHEN o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y') ELSE '2026' END AS year FROM orders")
def document_dates(spark, sf_dir):
    iso = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00+00:00"))
    wrong = F.when((F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz")) & (F.col("o_orderkey") % 2 == 0), iso).otherwise("2025-13-99")
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.iso_date(iso).alias("iso"), F.substring(dates.date_for_tags(dates.document_date(wrong, TODAY), F.lit(None), TODAY), 1, 4).alias("year"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size::BIGINT WHEN 1 THEN p_size::BIGINT WHEN 2 THEN 3 ELSE 0 END AS usage FROM part")
def usage_counts(spark, sf_dir):
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, F.col("p_size").cast("string")).when(k == 1, F.concat(F.lit('"'), F.col("p_size").cast("string"), F.lit('"'))).when(k == 2, "[4, 5, 6]").otherwise("null")
    return table(spark, sf_dir, "part").select("p_partkey", names.usage_count(raw).alias("usage"))
