"""The index model over the benchmark tables: documents, taxonomy, chunks with vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.chunking import chunk_key, hard_cap
from docloom.operators.fts import BlockIndex, build_blocks
from docloom.sources.workspace import SHUFFLES_DROPPED, dealt, delete, file_state, new_dir, settings

CHUNK_CHARS = 2000
TYPES = (("en", 200, "English"), ("de", 201, "German"), ("fr", 202, "French"), ("es", 203, "Spanish"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, title, correspondent_id, document_type_id, tag_ids, created, modified, indexed_at, page_count, text."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    kind = F.lit(None).cast("long")
    for lang, number, _ in TYPES:
        kind = F.when(F.col("lang") == lang, F.lit(number).cast("long")).otherwise(kind)
    tags = F.array_compact(F.array(F.when(F.col("quality") == 1, F.lit(1).cast("long")), F.when(F.col("toxic") == 1, F.lit(2).cast("long"))))
    day = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), F.col("doc_id").cast("int") % 1461), "yyyy-MM-dd")
    return d.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.substring("text", 1, 40).alias("title"),
        (F.regexp_extract("source", r"(\d+)$", 1).cast("long") + 10).alias("correspondent_id"),
        kind.alias("document_type_id"),
        tags.alias("tag_ids"),
        F.when(F.col("doc_id") % 50 != 7, day).alias("created"),
        F.concat(day, F.lit("T12:00:00+00:00")).alias("modified"),
        F.concat(day, F.lit("T13:00:00+00:00")).alias("indexed_at"),
        F.ceil(F.col("n_chars") / CHUNK_CHARS).cast("int").alias("page_count"),
        "text",
    )


def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "documents").select("source").distinct()
    people = sources.select(F.lit("correspondent").alias("kind"), (F.regexp_extract("source", r"(\d+)$", 1).cast("long") + 10).alias("id"), F.col("source").alias("name"))
    fixed = [("document_type", n, name) for _, n, name in TYPES] + [("tag", 1, "good"), ("tag", 2, "toxic"), ("tag", 3, "unused"), ("correspondent", 999, "Unused Ltd")]
    return people.unionByName(spark.createDataFrame(fixed, "kind string, id long, name string"))


def chunks(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """chunk_id, document_id, chunk_index, text. of: document_id of the few documents that are wanted; other texts aren't shuffled then."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    if of is None:
        rows = dealt(rows, f"{sf_dir}/documents.parquet", "doc_id")
    else:
        rows = rows.join(F.broadcast(of.select(F.col("document_id").alias("doc_id"))), "doc_id", "left_semi")
    cut = hard_cap(rows, CHUNK_CHARS, "doc_id")
    return cut.select(chunk_key(F.col("document_id"), F.col("chunk_index")).alias("chunk_id"), "document_id", "chunk_index", "text")


_served: dict[tuple, BlockIndex] = {}


def served_index(spark: SparkSession, sf_dir: str) -> BlockIndex:
    """The full-text index of the chunks: written once a session and state of the files, as an index server keeps it, and read by every query from then on."""
    key = (spark.sparkContext.applicationId, sf_dir, file_state(spark, f"{sf_dir}/documents.parquet"))
    if key not in _served:
        # the texts' shuffle is gone when that of the blocks begins
        cut, path = new_dir(spark, "fts-chunks"), new_dir(spark, "fts")
        with settings(spark, SHUFFLES_DROPPED):
            chunks(spark, sf_dir).drop("chunk_index").write.option("compression", "zstd").parquet(cut)
        _served[key] = build_blocks(spark.read.schema("chunk_id long, document_id long, text string").parquet(cut), path)
        delete(spark, cut)
    return _served[key]


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, document_id, embedding."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.floor(F.col("vec_id") / 2).alias("document_id"), "embedding")


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").where("vec_id = 0").first().embedding)


#: The same model in DuckDB's SQL, as common table expressions.
MODEL_SQL = f"""docs AS (
  SELECT d.doc_id AS id, substr(d.text, 1, 40) AS title, CAST(regexp_extract(d.source, '([0-9]+)$', 1) AS BIGINT) + 10 AS correspondent_id,
    CAST(CASE d.lang WHEN 'en' THEN 200 WHEN 'de' THEN 201 WHEN 'fr' THEN 202 WHEN 'es' THEN 203 END AS BIGINT) AS document_type_id,
    list_filter([CASE WHEN l.quality = 1 THEN 1 END, CASE WHEN l.toxic = 1 THEN 2 END], lambda x: x IS NOT NULL) AS tag_ids,
    CASE WHEN d.doc_id % 50 <> 7 THEN strftime(DATE '2020-01-01' + CAST(d.doc_id % 1461 AS INTEGER), '%Y-%m-%d') END AS created,
    strftime(DATE '2020-01-01' + CAST(d.doc_id % 1461 AS INTEGER), '%Y-%m-%d') || 'T12:00:00+00:00' AS modified,
    strftime(DATE '2020-01-01' + CAST(d.doc_id % 1461 AS INTEGER), '%Y-%m-%d') || 'T13:00:00+00:00' AS indexed_at,
    CAST(ceil(d.n_chars / {CHUNK_CHARS}.0) AS INTEGER) AS page_count, d.text
  FROM documents d LEFT JOIN labels l USING (doc_id)),
taxonomy AS (
  SELECT DISTINCT 'correspondent' AS kind, CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) + 10 AS id, source AS name FROM documents
  UNION ALL VALUES ('document_type', 200, 'English'), ('document_type', 201, 'German'), ('document_type', 202, 'French'), ('document_type', 203, 'Spanish'),
    ('tag', 1, 'good'), ('tag', 2, 'toxic'), ('tag', 3, 'unused'), ('correspondent', 999, 'Unused Ltd')),
chunks AS (
  SELECT doc_id * 1048576 + i AS chunk_id, doc_id AS document_id, CAST(i AS INTEGER) AS chunk_index, substr(text, CAST(i * {CHUNK_CHARS} + 1 AS BIGINT), {CHUNK_CHARS}) AS text
  FROM (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / {CHUNK_CHARS}.0) AS BIGINT))) AS i FROM documents WHERE length(text) > 0)),
q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = 0),
vec AS (
  SELECT e.vec_id AS chunk_id, e.vec_id // 2 AS document_id,
    round(1 - list_dot_product(e.embedding::DOUBLE[], q.qv) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.qv, q.qv))), 6) + 0.0 AS distance
  FROM embeddings e, q)"""


def fts_sql(query_phrases: list[str], chunks_name: str = "chunks") -> str:
    """CTEs tok, cnt, tot and kw(chunk_id, document_id, bm25) for phrases of folded tokens."""
    counts = ", ".join(f"CAST((length(line) - length(replace(line, ' {p.replace(' ', '  ')} ', ''))) / {len(p.replace(' ', '  ')) + 2} AS BIGINT) AS f{i}" for i, p in enumerate(query_phrases))
    having = ", ".join(f"count(*) FILTER (WHERE f{i} > 0) AS n{i}" for i in range(len(query_phrases)))
    part = lambda i: f"(CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n{i} + 0.5) / (n{i} + 0.5)) END) * f{i} * 2.2::DOUBLE / (f{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))"
    score = " + ".join(part(i) for i in range(len(query_phrases)))
    return rf"""tok AS (SELECT chunk_id, document_id, regexp_extract_all(strip_accents(lower(text)), '[\p{{L}}\p{{N}}\p{{M}}]+') AS w FROM {chunks_name}),
cnt AS (SELECT chunk_id, document_id, len(w) AS dl, {counts} FROM (SELECT *, ' ' || array_to_string(w, '  ') || ' ' AS line FROM tok)),
tot AS (SELECT count(*) AS n, avg(dl) AS avgdl, {having} FROM cnt),
kw AS (SELECT chunk_id, document_id, round(-({score}), 6) AS bm25 FROM cnt, tot WHERE {' AND '.join(f'f{i} > 0' for i in range(len(query_phrases)))})"""
