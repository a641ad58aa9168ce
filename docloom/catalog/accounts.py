"""Usage, prices, quotas, history, throttling, health over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.catalog import query
from docloom.functions import identity
from docloom.operators import accounting as a
from docloom.schemas import PRICES
from docloom.sources.driver_tables import table

_MODELS = ("gpt-5.4", "gpt-5.4-mini", "o4-mini", "unknown")
_CALLS = "calls AS (SELECT user_id, ts, ['gpt-5.4', 'gpt-5.4-mini', 'o4-mini', 'unknown'][1 + (event_id % 4)::INTEGER] AS model, CASE WHEN user_id % 3 = 0 THEN 'ollama' ELSE 'openai' END AS provider, event_id % 1000 AS prompt, event_id % 77 AS completion FROM events)"


def calls(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(
        "user_id", "ts", F.element_at(F.array(*[F.lit(m) for m in _MODELS]), (F.col("event_id") % 4 + 1).cast("int")).alias("model"), F.when(F.col("user_id") % 3 == 0, "ollama").otherwise("openai").alias("provider"),
        (F.col("event_id") % 1000).alias("prompt"), (F.col("event_id") % 77).alias("completion"),
    )


@query(f"""WITH {_CALLS}, p(model, i, o) AS (VALUES {', '.join(f"('{m}', {i}::DOUBLE, {o}::DOUBLE)" for m, i, o in a.MODEL_PRICES)}),
c AS (SELECT user_id, prompt, completion, provider = 'ollama' AS local, CASE WHEN provider = 'ollama' THEN 0.0 ELSE prompt / 1e6 * i + completion / 1e6 * o END AS usd FROM calls LEFT JOIN p USING (model))
SELECT user_id, count(*) AS calls, sum(prompt)::BIGINT AS prompt, sum(completion)::BIGINT AS completion, CASE WHEN bool_or(usd IS NULL) THEN NULL ELSE round(sum(usd), 6) END AS usd, bool_and(local) AS local FROM c GROUP BY user_id""")
def price_rollup(spark, sf_dir):
    prices = spark.createDataFrame(list(a.MODEL_PRICES), PRICES)
    return a.roll_up_costs(a.price_calls(calls(spark, sf_dir), prices), "user_id").withColumn("usd", F.round("usd", 6))


@query(f"WITH {_CALLS} SELECT user_id, CAST(ts AS DATE) AS day, sum(prompt + completion)::BIGINT AS tokens, count(*) AS calls FROM calls GROUP BY ALL")
def daily_usage(spark, sf_dir):
    return a.daily_usage(calls(spark, sf_dir), "user_id", "ts", F.col("prompt") + F.col("completion"))


@query(f"""WITH {_CALLS}, u AS (SELECT user_id, CAST(ts AS DATE) AS day, sum(prompt + completion) AS t FROM calls GROUP BY ALL), d AS (SELECT min(day) AS day FROM u)
SELECT k.user_id, k.quota, coalesce(u.t, 0)::BIGINT AS tokens FROM (SELECT DISTINCT user_id, (user_id % 5) * 300 AS quota FROM events) k LEFT JOIN (SELECT u.* FROM u JOIN d USING (day)) u USING (user_id) WHERE quota > 0 AND coalesce(u.t, 0) >= quota""")
def quota_exceeded(spark, sf_dir):
    c = calls(spark, sf_dir)
    day = c.agg(F.min(F.to_date("ts")).cast("string").alias("d")).first().d
    usage = a.daily_usage(c, "user_id", "ts", F.col("prompt") + F.col("completion"))
    keys = c.select("user_id").distinct().withColumn("quota", (F.col("user_id") % 5) * 300)
    return a.over_quota(keys, usage, "user_id", day)


@query("""WITH s AS (SELECT user_id, event_type || (event_id % 40) AS query, event_id AS id, ts AS created FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, query ORDER BY created DESC, id DESC) AS r FROM s), m AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created DESC, id DESC) AS k FROM n WHERE r = 1)
SELECT user_id, query, id, created FROM m WHERE k <= 20""")
def recent_searches(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return a.recent_searches(e.select("user_id", F.concat("event_type", (F.col("event_id") % 40).cast("string")).alias("query"), F.col("event_id").alias("id"), F.col("ts").alias("created")))


@query("""WITH f AS (SELECT user_id, event_id, epoch(date_trunc('second', ts))::BIGINT AS t FROM events)
SELECT user_id, event_id, in_window FROM (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS in_window FROM f) WHERE in_window >= 3""")
def throttle_lockouts(spark, sf_dir):
    """Three events of a user within a day."""
    return a.lockouts(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), ["user_id"], 3, 86_400).select("user_id", "event_id", "in_window")


_NOW = "(SELECT max(ts) FROM events)"


@query(f"""WITH k(name) AS (VALUES {', '.join(f"('{d}')" for d in a.DAEMONS)}), b AS (SELECT ['ocr', 'classifier', 'indexer'][1 + (event_id % 3)::INTEGER] AS name, ts - INTERVAL 1 DAY * CASE WHEN event_id % 3 = 2 THEN 1 ELSE 0 END AS ts, event_id, CASE WHEN event_id % 2 = 0 THEN 'idle' ELSE 'working' END AS detail FROM events),
l AS (SELECT name, max(ts) AS last, arg_max(detail, ts) AS detail, count(*) AS n FROM b GROUP BY name)
SELECT k.name, CASE WHEN last IS NULL OR epoch(date_trunc('second', {_NOW}))::BIGINT - epoch(date_trunc('second', last))::BIGINT > 90 THEN 'stopped' WHEN detail = 'idle' THEN 'idle' ELSE 'running' END AS state, coalesce(detail, 'no heartbeat recorded') AS detail, coalesce(n, 0)::BIGINT AS processed_count FROM k LEFT JOIN l USING (name)""")
def heartbeat_states(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts").alias("now")).first().now
    beats = e.withColumn("ts", F.when(F.col("event_id") % 3 == 2, F.col("ts") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("ts")))
    beats = beats.select(F.element_at(F.array(*[F.lit(d) for d in a.DAEMONS[:3]]), (F.col("event_id") % 3 + 1).cast("int")).alias("name"), "ts", F.when(F.col("event_id") % 2 == 0, "idle").otherwise("working").alias("detail"), F.lit(1).alias("processed"))
    known = spark.createDataFrame([(d,) for d in a.DAEMONS], "name string")
    return a.daemon_states(known, beats, F.lit(now).cast("timestamp_ntz"))


@query("SELECT CASE WHEN count(*) FILTER (WHERE user_id % 4 = 3) = 0 THEN 'ok' WHEN count(*) FILTER (WHERE user_id % 4 = 3) = count(*) THEN 'down' ELSE 'degraded' END AS health FROM events")
def heartbeat_health(spark, sf_dir):
    return a.overall_health(table(spark, sf_dir, "events").select(F.when(F.col("user_id") % 4 == 3, "stopped").otherwise("running").alias("state")))


@query("SELECT event_id AS id, event_type FROM events WHERE event_id > (SELECT max(event_id) FROM events) - 500")
def activity_cap(spark, sf_dir):
    return a.capped_activity(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "event_type"), 500)


@query("SELECT c_custkey AS id, sha256('sk-doc-' || c_name) AS hash, substr('sk-doc-' || c_name, 1, 12) AS prefix, CASE c_custkey % 3 WHEN 0 THEN 'api,admin' WHEN 1 THEN 'mcp' ELSE '' END AS scopes FROM customer")
def api_keys(spark, sf_dir):
    key = F.concat(F.lit("sk-doc-"), "c_name")
    said = F.when(F.col("c_custkey") % 3 == 0, "admin, api,root").when(F.col("c_custkey") % 3 == 1, "mcp").otherwise("none")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), identity.hash_key(key).alias("hash"), identity.display_prefix(key).alias("prefix"), identity.write_scopes(identity.parse_scopes(said)).alias("scopes"))


@query("SELECT c_custkey AS id, prefix FROM (SELECT c_custkey, substr('sk-doc-' || c_name, 1, 12) AS prefix, c_name FROM customer) WHERE c_name IN ('Customer#000000007', 'Customer#000000011')")
def api_key_by_hash(spark, sf_dir):
    key = F.concat(F.lit("sk-doc-"), "c_name")
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), identity.hash_key(key).alias("hash"), identity.display_prefix(key).alias("prefix"))
    found = [a.key_by_hash(keys, f"sk-doc-{n}") for n in ("Customer#000000007", "Customer#000000011", "customer#000000011", "")]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3]).select("id", "prefix")


@query("SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 4 = 0 AND s_suppkey % 5 <> 0 AND s_nationkey % 2 = 0")
def live_keys(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    expires = F.when(F.col("s_suppkey") % 4 == 1, "2020-01-01T00:00:00+00:00").when(F.col("s_suppkey") % 4 == 2, "soon").when(F.col("s_suppkey") % 4 == 3, "2024-01-01T00:00:00+00:00")
    keys = s.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("owner_id"), (F.col("s_suppkey") % 5 == 0).alias("revoked"), expires.alias("expires_at"))
    users = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), (F.col("n_nationkey") % 2 == 0).alias("active"))
    return a.live_keys(keys, users, F.lit("2026-06-10 00:00:00").cast("timestamp")).select("id")


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, max(json_extract(props, '$.k')::BIGINT) AS most FROM events GROUP BY event_type")
def event_types(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.max("k").alias("most"))


_USERS_SQL = """users AS (SELECT c_custkey AS id, c_name AS username, CASE WHEN c_custkey % 10 = 0 THEN 'admin' ELSE 'member' END AS role, CASE WHEN c_acctbal < 0 THEN 'suspended' ELSE 'active' END AS status FROM customer)"""


def users(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), F.when(F.col("c_custkey") % 10 == 0, "admin").otherwise("member").alias("role"), F.when(F.col("c_acctbal") < 0, "suspended").otherwise("active").alias("status"))


@query(f"WITH {_USERS_SQL} SELECT count(*) AS users, count(*) FILTER (WHERE role = 'admin' AND status = 'active') AS admins FROM users")
def user_counts(spark, sf_dir):
    return a.user_counts(users(spark, sf_dir))


@query(f"WITH {_USERS_SQL} SELECT id, username, role, status FROM users WHERE lower(username) = 'customer#000000012' OR lower(username) = 'customer#12'")
def user_by_name(spark, sf_dir):
    u = users(spark, sf_dir)
    return a.by_username(u, "CUSTOMER#000000012").unionByName(a.by_username(u, "Customer#12"))


_REPLIES_SQL = """r AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Sure: ```json {"title": " T' || doc_id || ' ", "tags": ["a ", "", "b"], "language": "en", "person": null}```' WHEN 1 THEN '{"title": false, "tags": " one ", "document_date": "2024-01-01"}'
  WHEN 2 THEN '{"tags": ["  "], "title": "  "}' WHEN 3 THEN 'no object' WHEN 4 THEN NULL ELSE '[1, 2]' END AS reply FROM documents)"""


@query(f"""WITH {_REPLIES_SQL} SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'T' || doc_id WHEN 1 THEN '' WHEN 2 THEN '' END AS title, CASE doc_id % 6 WHEN 0 THEN 'a|b' WHEN 1 THEN 'one' WHEN 2 THEN '' END AS tags,
  CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN '2024-01-01' WHEN 2 THEN '' END AS document_date, CASE WHEN doc_id % 6 < 3 THEN doc_id % 6 = 2 END AS empty FROM r""")
def classification_replies(spark, sf_dir):
    from docloom.functions.classification import is_empty_classification, parse_classification

    n, d = F.col("doc_id") % 6, table(spark, sf_dir, "documents")
    reply = F.when(n == 0, F.concat(F.lit('Sure: ```json {"title": " T'), F.col("doc_id").cast("string"), F.lit(' ", "tags": ["a ", "", "b"], "language": "en", "person": null}```')))
    reply = reply.when(n == 1, '{"title": false, "tags": " one ", "document_date": "2024-01-01"}').when(n == 2, '{"tags": ["  "], "title": "  "}').when(n == 3, "no object").when(n == 4, None).otherwise("[1, 2]")
    p = d.select("doc_id", parse_classification(reply).alias("p"))
    return p.select("doc_id", "p.title", F.array_join("p.tags", "|").alias("tags"), "p.document_date", F.when(F.col("p").isNotNull(), is_empty_classification(F.col("p"))).alias("empty"))
