"""Block index with pruning, and many vector queries at once."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import filters, fts, ranked, vectors
from docloom.schemas import SearchFilters


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """20,000 short chunks of words of very unequal frequency; a few hold a frequent word many times."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    rows = []
    for i in range(20_000):
        text = " ".join(rng.choices(words, weights, k=rng.randint(3, 60)))
        if i % 701 == 0:
            text += " w0" * (5 + i % 13) + " w1 w2" * (i % 5)
        rows.append((i * 7, i // 3, text))
    chunks = spark.createDataFrame(rows + [(10**9, 10**6, ""), (10**9 + 1, 10**6, None)], "chunk_id long, document_id long, text string").repartition(6)
    path = f"file://{tmp_path_factory.mktemp('fts')}"
    return chunks, fts.build_blocks(chunks, path)


def best(frame, k):
    return [(r.chunk_id, round(r.bm25, 6)) for r in frame.orderBy(F.round("bm25", 6), "chunk_id").limit(k).collect()]


@pytest.mark.parametrize("query", ["w0", "w0 w1", "w399", "w0 w0", "w5 w7 w11", "w1-w2", "nowhere", "w0 nowhere", "", "...", "W0"])
@pytest.mark.parametrize("k", [1, 50])
def test_pruned_top_is_the_whole_ranking_cut(corpus, query, k):
    chunks, index = corpus
    want = best(fts.keyword_scores(chunks.fillna("", "text"), query), k)
    assert best(fts.block_scores(index, query), k) == want
    assert [(r.chunk_id, round(r.bm25, 6)) for r in fts.top_chunks(index, query, k).collect()] == want


def test_blocks_that_cannot_win_are_not_read(corpus):
    _, index = corpus
    for query, k, part in (("w20", 10, 0.3), ("w60", 10, 0.3), ("w100", 5, 0.3), ("w20 w60", 1, 0.8)):
        read = fts.candidate_blocks(index, query, k)[0].agg(F.sum("n")).first()[0]
        every = index.blocks.where(F.col("term").isin(*query.split())).agg(F.sum("n")).first()[0]
        assert read < part * every, (query, read, every)


def test_filters_hold_before_the_threshold(spark, corpus):
    chunks, index = corpus
    allowed = spark.range(0, 7000, 13).select(F.col("id").alias("document_id"))
    assert best(fts.top_chunks(index, "w0 w2", 7, allowed), 7) == best(fts.keyword_scores(chunks.fillna("", "text"), "w0 w2", allowed), 7)


def test_many_ranges_are_joined(corpus, monkeypatch):
    chunks, index = corpus
    monkeypatch.setattr(fts, "MANY", 3)
    monkeypatch.setattr(fts, "FIRST_RANGES", 1)
    assert best(fts.top_chunks(index, "w0 w1", 25), 25) == best(fts.keyword_scores(chunks.fillna("", "text"), "w0 w1"), 25)


def test_totals_and_postings(corpus):
    chunks, index = corpus
    lengths = chunks.select(F.size(fts.tokens(F.coalesce("text", F.lit("")))).alias("dl"))
    assert tuple(index.totals.first()) == tuple(lengths.agg(F.count("dl"), F.sum("dl")).first())
    plain = fts.postings(chunks).select("term", "chunk_id", "document_id", "tf", "dl")
    assert plain.exceptAll(index.postings()).isEmpty() and index.postings().exceptAll(plain).isEmpty()


def test_empty_index(spark, tmp_path):
    index = fts.build_blocks(spark.createDataFrame([], "chunk_id long, document_id long, text string"), f"file://{tmp_path}/i")
    assert fts.top_chunks(index, "the", 5).collect() == [] and fts.block_scores(index, "the").collect() == []


def test_keyword_search_takes_blocks(spark, corpus):
    chunks, index = corpus
    documents = chunks.select(F.col("document_id").alias("id"), (F.col("document_id") % 3).alias("document_type_id")).distinct()
    f = SearchFilters(document_type_id=1)
    for source in (index, chunks.fillna("", "text")):
        got = [(r.chunk_id, round(r.bm25, 6)) for r in ranked.keyword_search(source, documents, "w3 w4", 5, f).collect()]
        want = got if source is index else want
        assert got == want and len(got) == 5


# --- many queries at once


def plain_nearest(chunks, queries, k):
    out = []
    for q, v in queries:
        if v is None or not any(v):
            continue
        far = []
        for c, d, e in chunks:
            if e is not None and any(e):
                cos = sum(a * b for a, b in zip(v, e)) / math.sqrt(sum(a * a for a in v) * sum(b * b for b in e))
                far.append((round(1 - cos, 6) + 0.0, c, d))
        out += [(q, c, d, x, i + 1) for i, (x, c, d) in enumerate(sorted(far)[:k])]
    return sorted(out)


@pytest.mark.parametrize("k", [0, 1, 5, 1000])
def test_batch_is_numpy(spark, monkeypatch, k):
    rng = np.random.default_rng(3)
    chunks = [(i, i // 2, [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(300)] + [(300 + i, 9, [1.0, 0.0, 0.0, 0.0]) for i in range(20)] + [(400, 9, None), (401, 9, [0.0] * 4)]
    queries = [(i, [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(20)] + [(50, [2.0, 0.0, 0.0, 0.0]), (51, None), (52, [0.0] * 4)]
    table = spark.createDataFrame(chunks, "chunk_id long, document_id long, embedding array<float>").repartition(5)
    asked = spark.createDataFrame(queries, "query_id long, embedding array<float>")
    monkeypatch.setattr(vectors, "QUERY_BYTES", 200)  # several passes
    monkeypatch.setattr(vectors, "PRODUCT_ROWS", 7)
    got = sorted((r.query_id, r.chunk_id, r.document_id, round(r.distance, 6) + 0.0, r.rank) for r in vectors.vector_search_batch(table, None, asked, k).collect())
    assert got == plain_nearest(chunks, queries, k)


def test_batch_filters_and_agrees_with_single_search(spark):
    rows = [(i, i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)]
    chunks = spark.createDataFrame(rows, "chunk_id long, document_id long, embedding array<float>")
    docs = spark.createDataFrame([(i, f"2024-01-{1 + i % 28:02d}") for i in range(60)], "id long, created string")
    where = filters.document_filter(SearchFilters("2024-01-05", "2024-01-20"))
    asked = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [3.0, 0.0, 1.0])], "query_id long, embedding array<double>")
    got = vectors.vector_search_batch(chunks, docs, asked, 8, where).orderBy("query_id", "rank").collect()
    for q, v in ((1, [1, 2, 3]), (2, [3, 0, 1])):
        assert [r.chunk_id for r in got if r.query_id == q] == [r.chunk_id for r in vectors.vector_search(chunks, docs, v, 8, where).collect()]


def test_batch_never_crosses_tables(spark):
    chunks = spark.createDataFrame([(i, i, [1.0, float(i)]) for i in range(100)], "chunk_id long, document_id long, embedding array<float>")
    asked = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "query_id long, embedding array<float>")
    plan = vectors.vector_search_batch(chunks, None, asked, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    with pytest.raises(Exception, match="dimensions"):
        vectors.vector_search_batch(chunks, None, spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<float>"), 3).collect()


def test_store_builds_its_block_index_once_a_state(spark, tmp_path):
    from docloom.plans.indexing import run_cycle
    from docloom.sources.store import IndexStore

    source = "id long, title string, correspondent_id long, document_type_id long, tag_ids array<long>, created string, modified string, text string"
    rows = [(i, f"t{i}", 1, 2, [3], "2024-01-01", f"2024-02-{i + 1:02d}T00:00:00+00:00", f"alpha word{i} " + "beta " * i) for i in range(9)]
    vectors_of = lambda texts: [[1.0] for _ in texts]
    store = IndexStore(spark, f"file://{tmp_path}/store")
    run_cycle(store, spark.createDataFrame(rows[:6], source), vectors_of, "now", sweep=False)
    folders = lambda: sorted(p.name for p in (tmp_path / "store" / "blocks").iterdir())
    assert best(fts.top_chunks(store.search_index(), "beta", 3), 3) == best(fts.posting_scores(store.index().postings, store.index().lengths, "beta"), 3)
    first = folders()
    store.write_meta(other="value")
    store.search_index()
    assert folders() == first and len(first) == 1
    run_cycle(store, spark.createDataFrame(rows, source), vectors_of, "now", sweep=False)
    store.delete(spark.createDataFrame([(8,)], "id long"))
    got = best(fts.top_chunks(store.search_index(), "beta", 20), 20)
    assert got == best(fts.scores(store.index(), "beta"), 20) and len(got) == 7
    assert len(folders()) == 2
    store.vacuum(older_than=0)
    assert len(folders()) == 1 and best(fts.top_chunks(store.search_index(), "beta", 20), 20) == got


def test_postings_of_token_lists_by_a_plain_count():
    """Terms in order of their first place, chunks and places in order; the best of a block by brute force."""
    import numpy as np
    import pyarrow as pa

    lists = [["a", "b", "a"], [], ["b", "c", "b", "b"]]
    terms, code, chunk, tf, at = fts._occurrences(pa.array(lists, pa.list_(pa.string())))
    ends = np.cumsum(tf)
    got = [(terms[c].as_py(), int(k), at[e - n : e].tolist()) for c, k, n, e in zip(code.tolist(), chunk, tf, ends, strict=True)]
    assert got == [("a", 0, [0, 2]), ("b", 0, [1]), ("b", 2, [0, 2, 3]), ("c", 2, [1])]
    group, f, d = (np.array(x) for x in ([0, 0, 0, 1, 1], [3, 2, 2, 1, 1], [9, 5, 9, 4, 4]))
    best = fts._skyline(group, f, d)
    assert [(int(group[i]), int(f[i]), int(d[i])) for i in best] == [(0, 3, 9), (0, 2, 5), (1, 1, 4)]


def test_a_table_of_one_row_group_is_dealt_out(spark, tmp_path):
    from docloom.sources.driver_tables import chunks

    spark.createDataFrame([(i, "x " * 50) for i in range(64)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    cut = chunks(spark, f"file://{tmp_path}")
    assert cut.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and cut.count() == 64


def test_tokens_of_blocks_are_those_of_spark_and_places_lie_flat(spark, tmp_path):
    """Texts that begin and end with separators, marks, other scripts, repeats; lengths follow from the postings, 0 included."""
    texts = ["--Über  den ẞ, Ça va?", "", "  ... ", "a", "Σίσυφος №5 x² été İstanbul 𝒳y", "of the of the, the of", None, "日本語 テスト　ok\x00z", "'t Is"]
    chunks = spark.createDataFrame([(i * 3, i, t) for i, t in enumerate(texts)], "chunk_id long, document_id long, text string").repartition(2)
    want = {r.chunk_id: r.w for r in chunks.fillna("", "text").select("chunk_id", fts.tokens(F.col("text")).alias("w")).collect()}
    index = fts.build_blocks(chunks, f"file://{tmp_path}/i")
    assert dict(index.blocks.dtypes)["positions"] == "array<int>"
    got = {i: [None] * len(w) for i, w in want.items()}
    for r in fts._block_rows(index.blocks.where("term <> ''"), False).collect():
        for at in r.held:
            got[r.chunk_id][at] = r.term
    assert got == want
    held = fts.postings(chunks)
    assert {r.chunk_id: r.dl for r in fts.token_counts(chunks, held).collect()} == {i: len(w) for i, w in want.items()}
    assert sorted(fts.token_counts(chunks, held).columns) == sorted(fts.token_counts(chunks).columns)
    assert [r.chunk_id for r in fts.block_scores(index, "of-the").collect()] == [15]


def test_the_sorted_index_has_more_partitions_for_more_rows(spark, tmp_path):
    """A task's share stays at the advisory size, also if every chunk has the same terms."""
    chunks = spark.range(0, 6000, 1, 6).select(F.col("id").alias("chunk_id"), F.col("id").alias("document_id"), F.lit("same words again and again").alias("text"))
    saved = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16k")
    try:
        fts.by_term(fts.postings(chunks)).write.parquet(f"{tmp_path}/p")
        found = spark.read.parquet(f"{tmp_path}/p")
        files = found.where("term = 'again'").select(F.input_file_name().alias("f"), "term", "chunk_id").groupBy("f").agg(F.count(F.lit(1)).alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", saved)
    assert sum(r.n for r in files) == 6000 and len(files) > 1


def test_packed_blocks_are_the_plain_postings_in_a_fraction_of_the_bytes(spark, monkeypatch):
    """Documents that don't follow from their chunks, negative ids, several slots and runs; bests by brute force."""
    import random

    import pyarrow as pa

    rng = random.Random(7)
    words = [f"w{int(rng.paretovariate(0.6))}é"[:9] for _ in range(120_000)]
    rows = [(rng.randrange(-(1 << 40), 1 << 40), rng.randrange(-5, 1 << 33), " ".join(words[i : i + rng.randrange(200)])) for i in range(0, 120_000, 200)] + [(1, 1, ""), (2, 2, None)]
    chunks = spark.createDataFrame(rows, "chunk_id long, document_id long, text string").repartition(3)
    plain, packed = fts.postings(chunks), fts.sorted_blocks(chunks, rows=True)
    assert plain.exceptAll(packed).isEmpty() and packed.exceptAll(plain).isEmpty()
    for r in fts.sorted_blocks(chunks).collect():
        pairs = set(zip(r.tfs, r.dls, strict=True))
        best = {(f, d) for f, d in pairs if not any((g >= f and e <= d) and (g, e) != (f, d) for g, e in pairs)}
        assert set(zip(r.best_tfs, r.best_dls, strict=True)) == best and r.n == len(r.tfs) and sum(r.tfs) == len(r.positions)
    cut = pa.RecordBatch.from_pylist([{"chunk_id": c, "document_id": d, "folded": t or "", "number": i} for i, (c, d, t) in enumerate(rows)])
    blocks = list(fts._blocks(iter([cut])))
    blobs = [b for x in fts._pack(iter(blocks)) for b in x.column("blob").to_pylist()]
    assert sum(map(len, blobs)) < 0.5 * sum(b.nbytes for b in blocks)  # ids are random here
    monkeypatch.setattr(fts, "SORTED_BYTES", 1 << 16)
    monkeypatch.setattr(fts, "ROWS", 100)
    made = list(fts._sorted_blocks(iter([pa.RecordBatch.from_pydict({"blob": blobs})])))
    assert len(made) > 5 and max(b.num_rows for b in made) <= 100
    flat = lambda bs: sorted((r["term"], r["range"], *r["chunk_ids"], *r["document_ids"], *r["tfs"], *r["dls"], *r["positions"]) for b in bs for r in b.to_pylist())
    assert flat(made) == flat(blocks)


def test_the_index_leaves_no_shuffle_files(spark, tmp_path):
    import time

    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    chunks, before = spark.createDataFrame([(i, i, f"some words of {i % 7}") for i in range(900)], "chunk_id long, document_id long, text string"), files()
    index = fts.build_blocks(chunks.repartition(3, "chunk_id"), f"file://{tmp_path}/i")
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and index.totals.first().n == 900


def test_wanted_texts_alone_are_cut(spark, tmp_path):
    from docloom.sources.driver_tables import chunks

    spark.createDataFrame([(i, f"text {i}") for i in range(64)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    of = spark.createDataFrame([(3,), (5,), (900,)], "document_id long")
    cut = chunks(spark, f"file://{tmp_path}", of)
    assert sorted((r.document_id, r.text) for r in cut.collect()) == [(3, "text 3"), (5, "text 5")]
    assert "hashpartitioning" not in cut._jdf.queryExecution().executedPlan().toString()
