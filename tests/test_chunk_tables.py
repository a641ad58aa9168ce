"""The table functions of chunking against the plain chunker."""

import pytest

from docloom.operators import chunking

TEXTS = [
    None, "", " \n\n\t", "word " * 900, "abcde " * 500, "x" * 1000, "A" * 20 + "\n\n" + "B" * 15, "\n\n".join(c * 18 for c in "ABCD"), "A" * 18017, "--- Page 3 (model) ---\nsome text", "--- Page 1 ---\n" + "a b " * 60 + "\n--- Page 2 ---\n" + "c d " * 60,
    "one two\n\nthree four\n\nfive", "--- Page 1 ---\n" + "a" * 10 + "\n\n" + "b" * 10 + "\n--- Page 2 ---\n" + "c" * 5 + "\n\n" + "d" * 30, "é" * 70 + "\n \n" + "日本" * 40, "\x0bline\x0cother\x85third",
]


@pytest.fixture(scope="module")
def docs(spark):
    chunking.register_chunking(spark)
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "document_id long, text string").repartition(3)
    rows.createOrReplaceTempView("chunk_docs")
    return rows


@pytest.mark.parametrize(("size", "overlap"), [(22, 6), (200, 40), (2000, 256), (24_000, 0), (20, 10)])
@pytest.mark.parametrize("call", ["SELECT * FROM chunk_documents(rows => TABLE(chunk_docs), size => {0}, overlap => {1})", "SELECT * FROM chunk_documents(rows => TABLE(chunk_docs) PARTITION BY document_id, size => {0}, overlap => {1})", "SELECT document_id, c.* FROM chunk_docs, LATERAL chunk_text(text, {0}, {1}) c"])
def test_table_functions(spark, docs, call, size, overlap):
    got = sorted(tuple(r) for r in spark.sql(call.format(size, overlap)).collect())
    assert got == sorted((k, *c) for k, t in enumerate(TEXTS) for c in chunking.chunk_text(t or "", size, overlap))
    assert got == sorted(tuple(r) for r in chunking.chunk_documents(docs, size, overlap).collect())


@pytest.mark.parametrize(("size", "overlap"), [(30, 5), (100, 20), (5000, 100)])
def test_pages_of_a_document(spark, size, overlap):
    chunking.register_chunking(spark)
    rows = [(d, p, None if (d + p) % 9 == 0 else "\n\n".join(f"d{d} p{p} part{i} " + "w " * (d * 3 + i) for i in range(p % 4))) for d in range(6) for p in range(1, 8)]
    spark.createDataFrame(rows, "document_id long, page int, text string").repartition(5).createOrReplaceTempView("chunk_page_rows")
    got = sorted(tuple(r) for r in spark.sql(f"SELECT * FROM chunk_pages(rows => TABLE(chunk_page_rows) PARTITION BY document_id ORDER BY page, size => {size}, overlap => {overlap})").collect())
    whole = {d: "\n\n".join(f"--- Page {p} ---\n{t or ''}" for k, p, t in rows if k == d) for d in range(6)}
    assert got == sorted((d, *c) for d, t in whole.items() for c in chunking.chunk_text(t, size, overlap))


def test_bad_overlap_is_an_error(spark, docs):
    with pytest.raises(Exception, match="overlap"):
        spark.sql("SELECT * FROM chunk_documents(rows => TABLE(chunk_docs), size => 10, overlap => 10)").collect()


def test_hard_cap_in_one_pass(spark):
    docs = spark.createDataFrame([(1, "ab\ncd é𝐀x"), (2, ""), (3, None), (4, "y" * 3_000_000)], "document_id long, text string")
    got = chunking.hard_cap(docs, 4).where("document_id < 4").collect()
    assert [(r.document_id, r.chunk_index, r.text) for r in got] == [(1, 0, "ab\nc"), (1, 1, "d é𝐀"), (1, 2, "x")]
    assert chunking.hard_cap(docs, 4).where("document_id = 4").count() == 750_000
