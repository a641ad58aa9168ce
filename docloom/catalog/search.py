"""Vector, keyword and hybrid search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.catalog import query
from docloom.operators import filters, fts, fusion, ranked, vectors
from docloom.operators.chunking import chunk_key
from docloom.schemas import SearchFilters
from docloom.sources.driver_tables import MODEL_SQL, chunks, documents, fts_sql, query_vector, served_index
from docloom.sources.driver_tables import vectors as vector_table

WORDS, PHRASE = "ereer thion", "the of"
ON_TYPE = SearchFilters(date_from="2020-02-01", date_to="2022-06-30", document_type_id=200)
_ON_TYPE_SQL = "created >= '2020-02-01' AND created < '2022-07-01' AND document_type_id = 200"


def _distance(df: DataFrame, name: str = "distance") -> DataFrame:
    return df.withColumn(name, F.round(F.greatest(F.col(name), F.lit(0.0)), 6) + 0.0)


@query(f"WITH {MODEL_SQL} SELECT chunk_id, document_id, greatest(distance, 0.0) AS distance FROM vec ORDER BY vec.distance, chunk_id LIMIT 10")
def vector_topk(spark, sf_dir):
    return _distance(vectors.vector_search(vector_table(spark, sf_dir), None, query_vector(spark, sf_dir), 10))


@query(f"WITH {MODEL_SQL} SELECT chunk_id, document_id, greatest(distance, 0.0) AS distance FROM vec WHERE document_id IN (SELECT id FROM docs WHERE {_ON_TYPE_SQL}) ORDER BY vec.distance, chunk_id LIMIT 10")
def vector_topk_filtered(spark, sf_dir):
    return _distance(vectors.vector_search(vector_table(spark, sf_dir), documents(spark, sf_dir), query_vector(spark, sf_dir), 10, filters.document_filter(ON_TYPE)))


_BATCH_SQL = """
, qs AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 50 = 0),
pairs AS (SELECT query_id, e.vec_id AS chunk_id, e.vec_id // 2 AS document_id,
    round(1 - list_dot_product(e.embedding::DOUBLE[], qv) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(qv, qv))), 6) AS distance FROM embeddings e, qs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id)::INTEGER AS rank FROM pairs{where})
SELECT query_id, chunk_id, document_id, distance + 0.0 AS distance, rank FROM ranked WHERE rank <= 10"""


def _batch(spark, sf_dir, where=None):
    queries = vector_table(spark, sf_dir).where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    found = vectors.vector_search_batch(vector_table(spark, sf_dir), documents(spark, sf_dir), queries, 10, where)
    return found.withColumn("distance", F.col("distance") + 0.0)


@query(f"WITH {MODEL_SQL}{_BATCH_SQL.format(where='')}")
def vector_topk_batch(spark, sf_dir):
    """Every fiftieth vector asks for its ten nearest of all."""
    return _batch(spark, sf_dir)


@query(f"WITH {MODEL_SQL}{_BATCH_SQL.format(where=f' WHERE document_id IN (SELECT id FROM docs WHERE {_ON_TYPE_SQL})')}")
def vector_topk_batch_filtered(spark, sf_dir):
    return _batch(spark, sf_dir, filters.document_filter(ON_TYPE))


def _keyword(spark, sf_dir, text, k=20, f=None):
    return ranked.keyword_search(served_index(spark, sf_dir), documents(spark, sf_dir), text, k, f).select("chunk_id", "document_id", F.round("bm25", 6).alias("bm25"))


@query(f"WITH {MODEL_SQL}, {fts_sql(['the'])} SELECT * FROM kw ORDER BY bm25, chunk_id LIMIT 20")
def bm25_topk(spark, sf_dir):
    return _keyword(spark, sf_dir, "the")


@query(f"WITH {MODEL_SQL}, {fts_sql(['the', 'that'])} SELECT * FROM kw ORDER BY bm25, chunk_id LIMIT 20")
def bm25_all_terms(spark, sf_dir):
    return _keyword(spark, sf_dir, "the That")


@query(f"WITH {MODEL_SQL}, {fts_sql(['of the'])} SELECT * FROM kw ORDER BY bm25, chunk_id LIMIT 20")
def bm25_phrase(spark, sf_dir):
    return _keyword(spark, sf_dir, "of-the")


@query(f"WITH {MODEL_SQL}, {fts_sql(['the'])} SELECT * FROM kw WHERE document_id IN (SELECT id FROM docs WHERE {_ON_TYPE_SQL}) ORDER BY bm25, chunk_id LIMIT 20")
def bm25_filtered(spark, sf_dir):
    return _keyword(spark, sf_dir, "the", f=ON_TYPE)


@query(f"WITH {MODEL_SQL}, {fts_sql(['that', 'for'])} SELECT * FROM kw ORDER BY bm25, chunk_id LIMIT 15")
def bm25_unindexed(spark, sf_dir):
    """The same without a stored index: texts are tokenised as they are read."""
    return fts.keyword_scores(chunks(spark, sf_dir), "that for").select("chunk_id", "document_id", F.round("bm25", 6).alias("bm25")).orderBy("bm25", "chunk_id").limit(15)


_BEST = "best AS (SELECT document_id, chunk_id, bm25 FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY bm25, chunk_id) AS n FROM kw) WHERE n = 1)"


@query(f"WITH {MODEL_SQL}, {fts_sql(['the'])}, {_BEST} SELECT * FROM best ORDER BY bm25, chunk_id LIMIT 10 OFFSET 10")
def keyword_document_page(spark, sf_dir):
    return ranked.keyword_documents(served_index(spark, sf_dir), documents(spark, sf_dir), "the", 10, 10)


@query(f"WITH {MODEL_SQL}, {fts_sql(['the'])} SELECT count(DISTINCT document_id) AS total FROM kw WHERE document_id IN (SELECT id FROM docs WHERE {_ON_TYPE_SQL})")
def keyword_document_total(spark, sf_dir):
    return ranked.keyword_document_count(served_index(spark, sf_dir), documents(spark, sf_dir), "the", ON_TYPE)


# chunk ids of the vector table count pairs per document; for fusion both lists speak of chunk 0 of a document
_LISTS_SQL = f"""WITH {MODEL_SQL}, {fts_sql(['the'])},
v AS (SELECT document_id * 1048576 AS chunk_id, document_id, min(distance) AS distance FROM vec GROUP BY document_id),
lists AS (
  SELECT chunk_id, document_id, 0 AS list_no, row_number() OVER (ORDER BY distance, chunk_id) AS pos, distance FROM (SELECT * FROM v ORDER BY v.distance, chunk_id LIMIT 25)
  UNION ALL SELECT chunk_id, document_id, 1, row_number() OVER (ORDER BY bm25, chunk_id), NULL FROM (SELECT * FROM kw ORDER BY bm25, chunk_id LIMIT 25)),
fused AS (
  SELECT chunk_id, document_id, round(sum(1.0::DOUBLE / (60 + pos)), 9) AS rrf, min(list_no * 1000 + pos) AS first, 1 / (1 + min(distance)) AS similarity, bool_or(list_no = 1) AS hit FROM lists GROUP BY ALL),
top AS (SELECT document_id, max(rrf) AS best FROM fused GROUP BY document_id ORDER BY best DESC, min(first), document_id LIMIT 10)"""


def ranked_lists(spark, sf_dir) -> DataFrame:
    """The 25 nearest and the 25 best by keyword: chunk_id, document_id, list_no, pos, distance."""
    v = vector_table(spark, sf_dir).select(chunk_key(F.col("document_id"), F.lit(0)).alias("chunk_id"), "document_id", F.round(vectors.cosine_distance(F.col("embedding"), vectors.vector_literal(query_vector(spark, sf_dir))), 6).alias("distance"))
    v = v.groupBy("chunk_id", "document_id").agg(F.min("distance").alias("distance")).orderBy("distance", "chunk_id").limit(25)
    near = ranked.rank_in(v, 0, "distance", "chunk_id").join(v.select("chunk_id", "distance"), "chunk_id")
    by_word = ranked.rank_in(_keyword(spark, sf_dir, "the", 25), 1, "bm25", "chunk_id").withColumn("distance", F.lit(None).cast("double"))
    return reduce(DataFrame.unionByName, [near, by_word])


def fused_chunks(spark, sf_dir) -> DataFrame:
    return fusion.fuse(ranked_lists(spark, sf_dir))


@query(f"{_LISTS_SQL} SELECT chunk_id, document_id, rrf FROM fused ORDER BY rrf DESC, fused.first, chunk_id LIMIT 20")
def rrf_hybrid(spark, sf_dir):
    f = fused_chunks(spark, sf_dir)
    return f.orderBy(F.round("rrf", 9).desc(), "first", "chunk_id").limit(20).select("chunk_id", "document_id", F.round("rrf", 9).alias("rrf"))


@query(f"{_LISTS_SQL} SELECT document_id, best FROM top")
def rrf_top_docs(spark, sf_dir):
    return fusion.top_documents(fused_chunks(spark, sf_dir), 10)


@query(f"""{_LISTS_SQL} SELECT chunk_id, document_id, rrf FROM (
  SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY rrf DESC, fused.first, chunk_id) AS n FROM fused WHERE document_id IN (SELECT document_id FROM top)) WHERE n <= 1""")
def rrf_capped_chunks(spark, sf_dir):
    return fusion.capped_chunks(fused_chunks(spark, sf_dir), 10, 1).select("chunk_id", "document_id", F.round("rrf", 9).alias("rrf"))


_TIER = "CASE WHEN {0} IS NULL THEN 'good' WHEN {0} >= 0.70 THEN 'strong' WHEN {0} >= 0.66 THEN 'good' WHEN {0} >= 0.60 THEN 'partial' ELSE 'weak' END"


@query(f"WITH {MODEL_SQL} SELECT tier, count(*) AS n FROM (SELECT {_TIER.format('1 / (1 + distance)')} AS tier FROM vec) GROUP BY tier")
def similarity_tier(spark, sf_dir):
    d = F.round(vectors.cosine_distance(F.col("embedding"), vectors.vector_literal(query_vector(spark, sf_dir))), 6)
    return vector_table(spark, sf_dir).select(fusion.relevance_tier(vectors.similarity(d)).alias("tier")).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_LISTS_SQL} SELECT round(1 / (1 + min(distance)), 6) AS similarity, bool_or(list_no = 1) AS keyword_hit, coalesce(1 / (1 + min(distance)) < 0.6, false) AND NOT bool_or(list_no = 1) AS irrelevant FROM lists")
def relevance_gate(spark, sf_dir):
    s = fusion.relevance_signal(ranked_lists(spark, sf_dir).withColumn("keyword", F.col("list_no") == 1))
    return s.select(F.round("similarity", 6).alias("similarity"), "keyword_hit", filters.irrelevant(F.col("similarity"), F.col("keyword_hit")).alias("irrelevant"))


@query(f"""{_LISTS_SQL}, c AS (SELECT f.*, k.text FROM fused f JOIN chunks k USING (chunk_id) WHERE f.document_id IN (SELECT document_id FROM top)),
b AS (SELECT document_id, max(rrf) AS score, max(similarity) AS similarity, first(text ORDER BY rrf DESC, chunk_id) AS text FROM c GROUP BY document_id),
s AS (SELECT b.*, d.title, d.created, trim(regexp_replace(b.text, '\\s+', ' ', 'g')) AS line FROM b LEFT JOIN docs d ON d.id = b.document_id)
SELECT document_id, title, created, CASE WHEN length(line) <= 280 THEN line ELSE rtrim(substr(line, 1, 280)) || '…' END AS snippet, score, {_TIER.format('similarity')} AS tier FROM s""")
def best_chunk_sources(spark, sf_dir):
    lists = ranked_lists(spark, sf_dir)
    sims = lists.groupBy("chunk_id").agg((1 / (1 + F.min("distance"))).alias("similarity"))
    f = fusion.fuse(lists)
    top = fusion.top_documents(f, 10).select("document_id")
    c = f.join(top, "document_id", "left_semi").join(sims, "chunk_id").join(chunks(spark, sf_dir, top).select("chunk_id", "text"), "chunk_id")
    return fusion.best_sources(c, documents(spark, sf_dir)).drop("judge")


@query(f"""{_LISTS_SQL}, a AS (SELECT chunk_id, rrf, 'first' AS origin FROM fused WHERE document_id % 3 <> 0), b AS (SELECT chunk_id, rrf / 2 AS rrf, 'second' AS origin FROM fused WHERE document_id % 2 = 0)
SELECT chunk_id, round(rrf, 9) AS rrf, origin FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY origin) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b)) WHERE n = 1""")
def merge_chunks(spark, sf_dir):
    f = fused_chunks(spark, sf_dir).select("chunk_id", "document_id", F.round("rrf", 9).alias("rrf"))
    a, b = f.where("document_id % 3 <> 0").withColumn("origin", F.lit("first")), f.where("document_id % 2 = 0").withColumn("rrf", F.col("rrf") / 2).withColumn("origin", F.lit("second"))
    return fusion.merge_chunks(a, b).select("chunk_id", F.round("rrf", 9).alias("rrf"), "origin")


@query(f"""{_LISTS_SQL}, said AS (SELECT document_id, CASE WHEN document_id % 4 = 0 THEN false WHEN document_id % 4 = 1 THEN true END AS keep, (document_id % 7) / 4.0 - 0.2 AS score FROM top WHERE document_id % 4 < 2)
SELECT top.document_id, coalesce(said.keep, true) AS keep, round(coalesce(greatest(0.0, least(1.0, said.score)), 0.0)::DOUBLE, 6) AS score FROM top LEFT JOIN said USING (document_id)""")
def judge_verdict_merge(spark, sf_dir):
    top = fusion.top_documents(fused_chunks(spark, sf_dir), 10).select("document_id")
    said = top.where("document_id % 4 < 2").select("document_id", (F.col("document_id") % 4 == 1).alias("keep"), ((F.col("document_id") % 7) / 4.0 - 0.2).alias("score"))
    return fusion.merge_verdicts(top, said).select("document_id", "keep", F.round("score", 6).alias("score"))


@query(f"{_LISTS_SQL} SELECT chunk_id, round(similarity, 6) AS similarity, row_number() OVER (ORDER BY similarity DESC NULLS LAST, chunk_id) AS pos FROM fused")
def trace_order(spark, sf_dir):
    f = ranked_lists(spark, sf_dir).groupBy("chunk_id").agg((1 / (1 + F.min("distance"))).alias("similarity"))
    shown = fusion.trace_order(f).collect()  # two short lists
    return spark.createDataFrame([(r.chunk_id, None if r.similarity is None else round(r.similarity, 6), i + 1) for i, r in enumerate(shown)], "chunk_id long, similarity double, pos long")


_CITED = "SELECT '{0}' AS reply, document_id FROM top WHERE document_id IN (SELECT document_id FROM {0}) OR NOT EXISTS (SELECT 1 FROM {0} JOIN top USING (document_id))"


@query(f"""{_LISTS_SQL}, nothing AS (SELECT document_id FROM top WHERE document_id < 0), strangers AS (SELECT document_id - 1000000 AS document_id FROM top), even AS (SELECT document_id FROM top WHERE document_id % 2 = 0),
best AS (SELECT document_id FROM top WHERE best = (SELECT max(best) FROM top)) {' UNION ALL '.join(_CITED.format(x) for x in ('nothing', 'strangers', 'even', 'best'))}""")
def cited_or_all(spark, sf_dir):
    """Replies that cite nothing, only documents that weren't asked about, some, and the best."""
    held = fusion.top_documents(fused_chunks(spark, sf_dir), 10)
    top, most = held.select("document_id"), held.agg(F.max("best").alias("best"))
    cited = {"nothing": top.where("document_id < 0"), "strangers": top.select((F.col("document_id") - 1_000_000).alias("document_id")), "even": top.where("document_id % 2 = 0"), "best": held.join(F.broadcast(most), "best").select("document_id")}
    return reduce(DataFrame.unionByName, [fusion.kept_or_all(top, c).select(F.lit(k).alias("reply"), "document_id") for k, c in cited.items()])
