"""Browsing, facets, lookups and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.catalog import query
from docloom.operators import browse as b
from docloom.operators import pages
from docloom.operators.filters import document_filter, pipeline_filter, stale_tags
from docloom.schemas import SearchFilters
from docloom.sources import readers
from docloom.sources.driver_tables import MODEL_SQL, chunks, documents, served_index, table, taxonomy

_NAMED = """named AS (
  SELECT d.*, c.name AS correspondent, t.name AS document_type FROM docs d LEFT JOIN (SELECT id AS cid, name FROM taxonomy WHERE kind = 'correspondent') c ON cid = correspondent_id
  LEFT JOIN (SELECT id AS tid, name FROM taxonomy WHERE kind = 'document_type') t ON tid = document_type_id)"""
_FIELDS = ("id", "title", "correspondent", "document_type", "created")
_LIST = ", ".join(_FIELDS)


@query(f"WITH {MODEL_SQL}, {_NAMED} SELECT {_LIST} FROM named ORDER BY named.created DESC NULLS LAST, id DESC LIMIT 20 OFFSET 40")
def browse_page(spark, sf_dir):
    return b.browse_page(b.browse(documents(spark, sf_dir), taxonomy(spark, sf_dir)), "created", True, 3, 20).select(*_FIELDS)


@query(f"WITH {MODEL_SQL}, {_NAMED} SELECT {_LIST} FROM named ORDER BY named.created ASC NULLS FIRST, id LIMIT 50")
def browse_nulls_first(spark, sf_dir):
    return b.browse_page(b.browse(documents(spark, sf_dir), taxonomy(spark, sf_dir)), "created", False, 1, 50).select(*_FIELDS)


@query(f"WITH {MODEL_SQL}, {_NAMED} SELECT {_LIST} FROM named WHERE contains(lower(title), 'th') OR contains(lower(correspondent), 'th') OR contains(lower(document_type), 'th')")
def browse_text_filter(spark, sf_dir):
    return b.browse(documents(spark, sf_dir), taxonomy(spark, sf_dir), text="TH").select(*_FIELDS)


@query(f"WITH {MODEL_SQL} SELECT id, created FROM docs WHERE created >= '2020-03-01' AND created < '2020-04-16'")
def date_half_open(spark, sf_dir):
    return documents(spark, sf_dir).where(document_filter(SearchFilters("2020-03-01", "2020-04-15T09:30:00+00:00"))).select("id", "created")


@query(f"WITH {MODEL_SQL} SELECT id FROM docs WHERE created >= '2020-03-01'")
def date_bad_bound(spark, sf_dir):
    return documents(spark, sf_dir).where(document_filter(SearchFilters("2020-03-01", "next spring"))).select("id")


@query(f"WITH {MODEL_SQL} SELECT id FROM docs WHERE list_contains(tag_ids, 1) AND list_contains(tag_ids, 2)")
def tag_all_filter(spark, sf_dir):
    return documents(spark, sf_dir).where(document_filter(SearchFilters(tag_ids=(1, 2)))).select("id")


@query(f"WITH {MODEL_SQL} SELECT id FROM docs WHERE list_contains(tag_ids, 1) AND NOT list_contains(tag_ids, 2)")
def pipeline_waiting(spark, sf_dir):
    return documents(spark, sf_dir).where(pipeline_filter(1, 2, 3)).select("id")


@query(f"""WITH {MODEL_SQL}, used AS (
  SELECT 'correspondent' AS kind, correspondent_id AS id FROM docs UNION ALL SELECT 'document_type', document_type_id FROM docs UNION ALL SELECT 'tag', unnest(tag_ids) FROM docs),
n AS (SELECT kind, id, count(*) AS n FROM used GROUP BY ALL) SELECT t.kind, t.id, t.name, coalesce(n.n, 0) AS n FROM taxonomy t LEFT JOIN n ON n.kind = t.kind AND n.id = t.id""")
def facet_counts_zero_fill(spark, sf_dir):
    return b.facet_counts(documents(spark, sf_dir), taxonomy(spark, sf_dir))


@query(f"WITH {MODEL_SQL} SELECT kind, id, name FROM taxonomy")
def taxonomy_scan(spark, sf_dir):
    return readers.taxonomy_entries(taxonomy(spark, sf_dir))


@query(f"WITH {MODEL_SQL} SELECT min(created) AS date_from, max(created) AS date_to FROM docs")
def date_range(spark, sf_dir):
    return b.date_bounds(documents(spark, sf_dir))


@query(f"""WITH {MODEL_SQL}, s AS (SELECT (SELECT count(*) FROM docs) AS documents, (SELECT max(indexed_at) FROM docs) AS last_indexed_at, (SELECT count(*) FROM chunks) AS chunks)
SELECT *, documents || ':' || chunks || ':' || coalesce(last_indexed_at, 'none') AS version FROM s""")
def index_stats(spark, sf_dir):
    return b.index_stats(documents(spark, sf_dir), chunks(spark, sf_dir))


@query(f"""WITH {MODEL_SQL}, x AS (SELECT id, unnest(tag_ids) AS tag, generate_subscripts(tag_ids, 1) AS pos FROM docs)
SELECT d.id, coalesce(n.tags, '') AS tags FROM docs d LEFT JOIN (SELECT x.id, string_agg(t.name, ',' ORDER BY pos) AS tags FROM x JOIN taxonomy t ON t.kind = 'tag' AND t.id = x.tag GROUP BY x.id) n ON n.id = d.id""")
def tag_names(spark, sf_dir):
    return b.tag_names(documents(spark, sf_dir), taxonomy(spark, sf_dir)).select("id", F.array_join("tags", ",").alias("tags"))


@query(f"WITH {MODEL_SQL}, {_NAMED} SELECT id, title, correspondent, document_type FROM named WHERE id IN (3, 5, 8, 999999999)")
def document_summary_lookup(spark, sf_dir):
    ids = spark.createDataFrame([(3,), (5,), (8,), (999999999,)], "id long")
    return b.with_names(documents(spark, sf_dir).join(F.broadcast(ids), "id", "left_semi"), taxonomy(spark, sf_dir)).select("id", "title", "correspondent", "document_type")


@query(f"""WITH {MODEL_SQL}, ids(document_id) AS (VALUES (1::BIGINT), (2), (999999999))
SELECT i.document_id, substr(d.text, 1, 500) AS text, coalesce(length(d.text) > 500, false) AS truncated, CASE WHEN d.text IS NULL THEN 'not found' END AS error FROM ids i LEFT JOIN docs d ON d.id = i.document_id""")
def fetch_truncate(spark, sf_dir):
    ids = spark.createDataFrame([(1,), (2,), (999999999,)], "document_id long")
    return pages.fetch_documents(ids, documents(spark, sf_dir), 500)


@query(f"""WITH {MODEL_SQL}, c AS (SELECT * FROM chunks WHERE NOT (document_id % 19 = 4 AND chunk_index = 0)),
d AS (SELECT id, ceil(length(text) / 2000.0)::BIGINT + CASE WHEN id % 13 = 5 THEN 1 ELSE 0 END AS chunk_count FROM docs WHERE id % 17 <> 3),
n AS (SELECT document_id, count(*) AS n FROM c GROUP BY document_id),
w AS (SELECT DISTINCT chunk_id FROM chunks WHERE regexp_matches(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}\\p{{M}}]')),
p AS (SELECT 'orphan chunks' AS problem, count(*) AS n FROM c WHERE document_id NOT IN (SELECT id FROM d)
  UNION ALL SELECT 'chunk counts', count(*) FROM d LEFT JOIN n ON n.document_id = d.id WHERE coalesce(n.n, 0) <> coalesce(chunk_count, 0)
  UNION ALL SELECT 'orphan postings', count(*) FROM w WHERE chunk_id NOT IN (SELECT chunk_id FROM c))
SELECT problem, n FROM p WHERE n > 0""")
def integrity_check(spark, sf_dir):
    """Planted faults: documents that are gone, counts that are wrong, chunks that the index still has."""
    c = chunks(spark, sf_dir).where("NOT (document_id % 19 = 4 AND chunk_index = 0)")
    count = F.ceil(F.length("text") / 2000) + F.when(F.col("id") % 13 == 5, 1).otherwise(0)
    d = documents(spark, sf_dir).where("id % 17 <> 3").withColumn("chunk_count", count)
    return b.integrity(d, c, served_index(spark, sf_dir).postings())


@query(f"WITH {MODEL_SQL} SELECT id, array_to_string(list_filter(tag_ids, lambda x: x <> 1), ',') AS tags FROM docs WHERE list_contains(tag_ids, 1) AND list_contains(tag_ids, 2)")
def stale_tag_repair(spark, sf_dir):
    s = stale_tags(documents(spark, sf_dir), 1, 2, 3)
    return s.select("id", F.array_join(F.transform("tag_ids", lambda x: x.cast("string")), ",").alias("tags"))


@query(rf"""WITH {MODEL_SQL}, t AS (SELECT chunk_id, unnest(regexp_extract_all(strip_accents(lower(text)), '[\p{{L}}\p{{N}}\p{{M}}]+')) AS term FROM chunks)
SELECT term, count(DISTINCT chunk_id) AS chunks, count(*) AS tf FROM t GROUP BY term""")
def postings_terms(spark, sf_dir):
    p = served_index(spark, sf_dir).postings()
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("chunks"), F.sum("tf").alias("tf"))


@query("SELECT o_orderstatus, c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def dimension_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    j = o.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("o_orderstatus", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
