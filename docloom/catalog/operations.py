"""Keeping an index: stores, embedding, sweeps, windows, states of documents and accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.catalog import query
from docloom.functions import dates, identity, tags
from docloom.operators import accounting, sync, vectors
from docloom.operators.classify import PipelineTags, screen, settle
from docloom.plans.sweep import run_sweep
from docloom.sources import readers
from docloom.sources.driver_tables import MODEL_SQL, chunks, documents, table, taxonomy
from docloom.sources.store import IndexStore
from docloom.sources.workspace import new_dir
from docloom.streaming import failures, quota


@query(f"WITH {MODEL_SQL} SELECT id, title FROM docs WHERE list_contains(tag_ids, 2)")
def documents_by_tag(spark, sf_dir):
    return readers.by_tag(documents(spark, sf_dir), 2).select("id", "title")


def _stored(spark, sf_dir, name: str) -> IndexStore:
    """A store of all documents and their chunks."""
    store, d = IndexStore(spark, new_dir(spark, name)), documents(spark, sf_dir)
    cut = chunks(spark, sf_dir).select("*", F.lit(None).cast("int").alias("page_hint"), F.lit(None).cast("array<float>").alias("embedding"))
    meta = d.select("id", "title", "correspondent_id", "document_type_id", "tag_ids", "created", "modified", sync.content_hash(F.col("text")).alias("content_hash"), "page_count", F.lit(None).cast("int").alias("chunk_count"), "indexed_at")
    store.upsert(meta, cut)
    return store


@query(f"""WITH {MODEL_SQL}, k AS (SELECT * FROM docs WHERE id % 4 <> 0)
SELECT 'documents' AS what, count(*) AS n FROM k UNION ALL SELECT 'chunks', count(*) FROM chunks WHERE document_id % 4 <> 0 UNION ALL SELECT 'scope documents', count(*) FROM k
UNION ALL SELECT 'scope chunks', count(*) FROM chunks WHERE document_id % 4 <> 0 UNION ALL SELECT 'terms', count(DISTINCT t) FROM (SELECT unnest(regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}\\p{{M}}]+')) AS t FROM chunks WHERE document_id % 4 <> 0)
UNION ALL SELECT 'taxonomy', count(*) FROM taxonomy UNION ALL SELECT 'emptied documents', 0 UNION ALL SELECT 'emptied postings', 0 UNION ALL SELECT 'changed models', 1""")
def store_lifecycle(spark, sf_dir):
    """Documents come, some go, the taxonomy is replaced, values are kept, and another embedding model empties all."""
    store = _stored(spark, sf_dir, "lifecycle")
    store.delete(documents(spark, sf_dir).where("id % 4 = 0"))
    store.refresh_taxonomy(taxonomy(spark, sf_dir))
    store.write_meta(embedding_model="one", note="x")
    changed = int(store.check_model("one"))
    scope = store.reembed_scope()
    found = {"documents": store.read("documents").count(), "chunks": store.read("chunks").count(), "scope documents": scope[0], "scope chunks": scope[1], "terms": store.read("postings").select("term").distinct().count(), "taxonomy": store.read("taxonomy").count()}
    changed += int(store.check_model("two"))
    assert store.meta("note") == "x" and store.meta("embedding_model") == "two"
    found |= {"emptied documents": store.read("documents").count(), "emptied postings": store.read("postings").count(), "changed models": changed}
    return spark.createDataFrame(list(found.items()), "what string, n long")


@query(f"WITH {MODEL_SQL} SELECT id FROM docs WHERE id % 6 <> 0 OR id % 4 = 0")
def two_phase_sweep(spark, sf_dir):
    """Two listings miss a sixth of the documents each, the second lists some of these again: only what both miss goes."""
    store, d = _stored(spark, sf_dir, "sweeps"), documents(spark, sf_dir).select("id")
    run_sweep(store, d.where("id % 6 <> 0"), "2026-01-01T00:00:00+00:00")
    run_sweep(store, d.where("id % 6 <> 0 OR id % 4 = 0"), "2026-01-02T00:00:00+00:00")
    return store.document_ids()


@query(f"WITH {MODEL_SQL} SELECT chunk_id, CASE WHEN contains(text, 'stion') THEN NULL ELSE length(text)::DOUBLE END AS x, CASE WHEN contains(text, 'stion') THEN NULL ELSE (length(text) - length(replace(text, 'e', '')))::DOUBLE END AS y FROM chunks")
def embedded_chunks(spark, sf_dir):
    """A provider that refuses some texts, and with them every call that holds one: these chunks alone get no vector."""

    def provider(texts):
        if any("stion" in t for t in texts):
            raise ValueError("refused")
        return [[len(t), t.count("e")] for t in texts]

    made = vectors.embed(chunks(spark, sf_dir).select("chunk_id", "document_id", "text"), provider)
    return made.select("chunk_id", F.get("embedding", 0).cast("double").alias("x"), F.get("embedding", 1).cast("double").alias("y"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '1=' || lang || ';7=' || source WHEN doc_id % 3 = 1 THEN '7=' || source ELSE '7=' || source || ';2=x' END AS fields FROM documents""")
def custom_fields(spark, sf_dir):
    one = lambda k, v: F.struct(F.lit(k).cast("long").alias("field"), v.alias("value"))
    n = F.col("doc_id") % 3
    held = F.when(n == 0, F.array(one(1, F.col("lang")))).when(n == 2, F.array(one(7, F.lit("old")), one(2, F.lit("x"))))
    d = table(spark, sf_dir, "documents").select("doc_id", "source", held.alias("held"))
    new = tags.set_custom_field(F.col("held"), 7, F.col("source"))
    return d.select("doc_id", F.array_join(F.transform(new, lambda f: F.concat_ws("=", f["field"].cast("string"), f["value"])), ";").alias("fields"))


@query("""WITH t AS (SELECT doc_id, doc_id % 4 AS k, list_filter([CASE WHEN doc_id % 2 = 0 THEN 1 END, 9, CASE WHEN doc_id % 3 = 0 THEN 3 END, CASE WHEN doc_id % 5 = 0 THEN 4 END], lambda x: x IS NOT NULL) AS tags FROM documents)
SELECT doc_id, array_to_string(CASE k WHEN 0 THEN list_append(list_filter(tags, lambda x: x NOT IN (1, 3, 4)), 2) WHEN 1 THEN list_append(list_filter(tags, lambda x: x NOT IN (1, 3, 4)), 4)
  WHEN 2 THEN CASE WHEN list_contains(tags, 3) THEN tags ELSE list_append(tags, 3) END ELSE tags END, ',') AS tags FROM t""")
def pipeline_transitions(spark, sf_dir):
    """done, error, claimed and a state that changes nothing; tags 1 waiting, 2 done, 3 running, 4 error."""
    k = F.col("doc_id")
    some = F.array_compact(F.array(F.when(k % 2 == 0, 1), F.lit(9), F.when(k % 3 == 0, 3), F.when(k % 5 == 0, 4)).cast("array<bigint>"))
    state = F.element_at(F.array(*map(F.lit, ("done", "error", "claimed", "idle"))), (k % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(sync.transition(some, 1, 2, 3, 4, state).cast("array<string>"), ",").alias("tags"))


@query(r"""WITH a AS (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN replace(c_name, '#', '_') ELSE left(c_name, 2) END AS username, CASE c_custkey % 4 WHEN 0 THEN c_name || '@x.org' WHEN 1 THEN c_name || '@x' WHEN 2 THEN NULL ELSE c_mktsegment || ' @x.org' END AS email,
  repeat(c_mktsegment || ' ', (c_custkey % 20)::INTEGER) AS name FROM customer)
SELECT id, regexp_full_match(username, '[A-Za-z0-9._-]{3,64}') AS username_ok, email IS NULL OR (len(string_split(email, '@')) = 2 AND NOT contains(email, ' ') AND regexp_matches(split_part(email, '@', 2), '^.+\..+$')) AS email_ok, length(name) <= 120 AS name_ok,
  nullif(rtrim(left(rtrim(name), 80)), '') AS shown FROM a""")
def account_rules(spark, sf_dir):
    k, name = F.col("c_custkey"), F.col("c_name")
    c = table(spark, sf_dir, "customer").select(
        k.alias("id"), F.when(k % 3 == 0, name).when(k % 3 == 1, F.replace(name, F.lit("#"), F.lit("_"))).otherwise(F.left(name, F.lit(2))).alias("u"),
        F.when(k % 4 == 0, F.concat(name, F.lit("@x.org"))).when(k % 4 == 1, F.concat(name, F.lit("@x"))).when(k % 4 == 3, F.concat("c_mktsegment", F.lit(" @x.org"))).alias("e"),
        F.repeat(F.concat("c_mktsegment", F.lit(" ")), (k % 20).cast("int")).alias("n"),
    )
    return c.select("id", identity.valid_username(F.col("u")).alias("username_ok"), identity.valid_email(F.col("e")).alias("email_ok"), identity.valid_display_name(F.col("n")).alias("name_ok"), identity.asker_name(F.col("n")).alias("shown"))


@query("SELECT event_id, 86400 - epoch(date_trunc('second', ts))::BIGINT % 86400 AS seconds, 'https://x/documents/' || event_id || '/' AS url FROM events")
def quota_reset(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", dates.seconds_to_midnight(F.col("ts").cast("timestamp")).alias("seconds"), identity.document_url("https://x", F.col("event_id")).alias("url"))


@query("SELECT event_id AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS expires_at FROM events WHERE strftime(ts, '%Y-%m-%dT%H:%M:%S') > '2024-01-15T00:00:00'")
def live_sessions(spark, sf_dir):
    s = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("expires_at"))
    return accounting.unexpired(s, "2024-01-15T00:00:00")


def _timed(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT user_id, ts::DATE AS day, sum(event_id % 1000) AS tokens, count(*) AS calls FROM events GROUP BY ALL")
def usage_windows(spark, sf_dir):
    """The stream's tumbling days over a finished log."""
    return quota.daily_usage_stream(_timed(spark, sf_dir).withColumn("n", F.col("event_id") % 1000), "user_id", "n")


@query("""WITH w AS (SELECT event_type, epoch(date_trunc('second', ts))::BIGINT // 3600 * 3600 - 3600 * i AS start, epoch(date_trunc('second', ts))::BIGINT AS t FROM events, range(6) r(i))
SELECT event_type, make_timestamp(start * 1000000) AS start, count(*) AS n FROM w WHERE start + 21600 > t GROUP BY ALL HAVING count(*) >= 3""")
def failures_by_window(spark, sf_dir):
    """The stream's sliding windows of six hours, an hour apart."""
    return quota.failure_windows(_timed(spark, sf_dir), ["event_type"], 3, 21_600, 3_600).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH e AS (SELECT user_id AS document_id, event_id, event_type <> 'purchase' AS failed FROM events),
i AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY document_id ORDER BY event_id) AS island FROM e),
p AS (SELECT *, row_number() OVER (PARTITION BY document_id, island, failed ORDER BY event_id) AS k FROM i),
s AS (SELECT document_id, island, count(*) % 5 AS held FROM p WHERE failed GROUP BY ALL)
SELECT document_id, (CASE WHEN k % 5 = 0 THEN 5 ELSE k % 5 END)::INTEGER AS failures, CASE WHEN k % 5 = 0 THEN 'given_up' ELSE 'failed' END AS action FROM p WHERE failed
UNION ALL SELECT p.document_id, s.held::INTEGER, 'cleared' FROM p JOIN s ON s.document_id = p.document_id AND s.island = p.island - 1 WHERE NOT p.failed AND s.held > 0""")
def failure_events(spark, sf_dir):
    """Every event is a try at its user's document, which succeeds for purchases: the keyed state's events, replayed."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), F.col("event_id").cast("double").alias("ts"), F.when(F.col("event_type") == "purchase", "indexed").alias("outcome"))
    return failures.failure_log(e)


@query("""WITH d AS (SELECT doc_id AS id, CASE doc_id % 11 WHEN 0 THEN '  ' WHEN 1 THEN 'I''m sorry, I can''t assist with that.' ELSE text END AS text,
    list_filter([1, 50, CASE WHEN doc_id % 3 = 0 THEN 2 END, CASE WHEN doc_id % 7 = 0 THEN 3 END, CASE WHEN doc_id % 13 = 0 THEN 9 END], lambda x: x IS NOT NULL) AS tags, doc_id % 5 AS k FROM documents),
s AS (SELECT *, CASE WHEN list_contains(tags, 9) THEN 'errored' WHEN list_contains(tags, 3) THEN 'claimed' WHEN trim(text) = '' THEN 'requeued' WHEN contains(text, 'can''t assist') THEN 'refused'
    WHEN k = 0 THEN 'empty' WHEN k = 1 THEN 'empty' WHEN k = 2 THEN 'generic' WHEN k = 3 THEN 'generic' ELSE 'classified' END AS state FROM d)
SELECT id, state, array_to_string(CASE state WHEN 'claimed' THEN tags WHEN 'requeued' THEN [50, 5] WHEN 'classified' THEN [50, 4, 60 + id % 3] ELSE [50, 9] END, ',') AS tags FROM s""")
def classification_states(spark, sf_dir):
    """Documents in every state, with replies that are missing, empty, vague and good. Tags: 1 waiting, 3 running, 4 done, 5 and 2 waiting for and done with transcription, 9 error."""
    n, t = F.col("doc_id"), PipelineTags(ocr_waiting=5, waiting=1, done=4, running=3, ocr_done=2, error=9)
    held = F.array_compact(F.array(F.lit(1), F.lit(50), F.when(n % 3 == 0, 2), F.when(n % 7 == 0, 3), F.when(n % 13 == 0, 9)).cast("array<bigint>"))
    text = F.when(n % 11 == 0, "  ").when(n % 11 == 1, "I'm sorry, I can't assist with that.").otherwise(F.col("text"))
    d = table(spark, sf_dir, "documents")
    said = F.when(n % 5 == 1, '{"title": " ", "tags": []}').when(n % 5 == 2, '{"title": "x", "document_type": "Document"}').when(n % 5 == 3, '{"title": "x"}').when(n % 5 == 4, 'Here: {"title": "x", "document_type": "Invoice"}')
    replies = d.where("doc_id % 5 > 0").select(n.alias("id"), said.alias("reply"), F.array((60 + n % 3).cast("long")).alias("tag_ids"))
    done = settle(screen(d.select(n.alias("id"), text.alias("text"), held.alias("tag_ids")), t), replies, t)
    return done.select("id", "state", F.array_join(F.col("tag_ids").cast("array<string>"), ",").alias("tags"))
