"""Operators on a small index with hand-computed results."""

import datetime as dt
import math
import sqlite3

import pytest
from pyspark.sql import functions as F

from docloom import schemas
from docloom.operators import accounting, browse, chunking, filters, fts, fusion, names, pages, ranked, sync, vectors
from docloom.plans.core import ResultCache, Search, SearchSettings
from docloom.plans.indexing import run_cycle
from docloom.plans.providers import HashEmbedder, json_object, parse_plan, parse_score, parse_verdicts
from docloom.plans.specs import broaden, call_budget, intersect, match_name, period, raw_rag_plan, resolve
from docloom.schemas import FilterGuess, PlannedSpec, RetrievalPlan, SearchFilters
from docloom.sources.readers import ndjson
from docloom.sources.store import IndexStore, StaleWriter
from docloom.streaming.throttle import replay, throttle_batch


@pytest.fixture(scope="module")
def index(spark):
    unit = lambda i: [1.0 if j == i else 0.0 for j in range(4)]
    documents = spark.createDataFrame(
        [
            (1, "Alpha Invoice", 10, 20, [101, 102], "2023-01-01T00:00:00+00:00", "2023-03-01T00:00:00+00:00", "hash1", 1, 2, "2025-01-01T00:00:00+00:00"),
            (2, "Beta Scan", 11, None, [102], "2024-06-15T00:00:00+00:00", "2024-08-01T00:00:00+00:00", "hash2", 2, 2, "2025-01-02T00:00:00+00:00"),
        ],
        schemas.DOCUMENTS,
    )
    chunks = spark.createDataFrame(
        [(1, 1, 0, "boiler warranty letter", 1, unit(0)), (2, 1, 1, "invoice total amount due", 1, unit(1)), (3, 2, 0, "electricity bill payment receipt", 1, unit(2)), (4, 2, 1, "account statement balance", 2, unit(3))],
        schemas.CHUNKS,
    )
    taxonomy = spark.createDataFrame([("correspondent", 10, "Alpha Corp"), ("correspondent", 11, "Beta Ltd"), ("document_type", 20, "Invoice"), ("tag", 101, "important"), ("tag", 102, "scanned")], schemas.TAXONOMY)
    return documents, chunks, taxonomy


def ids(df, column="document_id"):
    return [r[column] for r in df.collect()]


def test_vector_search(index):
    documents, chunks, _ = index
    hits = vectors.vector_search(chunks, documents, [1, 0, 0, 0], 2).collect()
    assert hits[0].chunk_id == 1 and abs(hits[0].distance) < 1e-9
    only = vectors.vector_search(chunks, documents, [1, 0, 0, 0], 9, filters.document_filter(SearchFilters(correspondent_id=11)))
    assert ids(only) == [2, 2]
    assert ids(vectors.vector_search(chunks, documents, [1, 0, 0, 0], 9, filters.document_filter(SearchFilters(tag_ids=(101,))))) == [1, 1]
    assert ids(vectors.vector_search(chunks, documents, [1, 0, 0, 0], 9, filters.document_filter(SearchFilters("2023-01-01", "2023-12-31")))) == [1, 1]
    assert ids(vectors.vector_search(chunks, documents, [1, 0, 0, 0], 0)) == [] == ids(vectors.vector_search(chunks, documents, [1, 0, 0, 0], -1))


def test_keyword_search(index):
    documents, chunks, _ = index
    find = lambda q, f=None: ids(ranked.keyword_search(chunks, documents, q, 10, f))
    assert find("INVOICE") == [1] and find("nothing") == [] and find("...") == [] and find("") == []
    assert find("invoice", SearchFilters(correspondent_id=11)) == [] and find("statement", SearchFilters(tag_ids=(101,))) == []
    assert find("total-amount") == [1] and find("amount-total") == []
    assert ranked.keyword_document_count(chunks, documents, "invoice").first().total == 1


@pytest.mark.parametrize("query", ["the", "the that", "of-the", "that for the", "thé"])
def test_bm25_is_that_of_fts5(spark, query):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(text)")
    db.executemany("INSERT INTO t (rowid, text) VALUES (?, ?)", [(r.doc_id + 1, r.text) for r in rows])
    want = dict(db.execute("SELECT rowid - 1, bm25(t) FROM t WHERE t MATCH ?", [" AND ".join(f'"{w}"' for w in query.split())]).fetchall())
    chunks = spark.createDataFrame([(r.doc_id, r.doc_id, r.text) for r in rows], "chunk_id long, document_id long, text string")
    for scores in (fts.keyword_scores(chunks, query), fts.posting_scores(fts.postings(chunks), fts.token_counts(chunks), query)):
        got = {r.chunk_id: r.bm25 for r in scores.collect()}
        assert got.keys() == want.keys()
        assert all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-12) for k in got)


def test_fusion_scores(spark):
    lists = spark.createDataFrame([(1, 10, 0, 1), (2, 20, 0, 2), (2, 20, 1, 1), (3, 30, 1, 2)], "chunk_id long, document_id long, list_no int, pos int")
    got = {r.chunk_id: r.rrf for r in fusion.fuse(lists).collect()}
    assert got[1] == pytest.approx(1 / 61) and got[2] == pytest.approx(1 / 62 + 1 / 61) and got[3] == pytest.approx(1 / 62)
    assert ids(fusion.top_documents(fusion.fuse(lists), 2)) == [20, 10]


def test_cap_comes_after_the_choice_of_documents(spark):
    lists = spark.createDataFrame([(i, 1, 0, i) for i in range(1, 6)] + [(9, 2, 0, 9)], "chunk_id long, document_id long, list_no int, pos int")
    got = fusion.capped_chunks(fusion.fuse(lists), 1, 3)
    assert sorted(ids(got, "chunk_id")) == [1, 2, 3]


@pytest.mark.parametrize(("similarity", "tier"), [(0.9, "strong"), (0.74, "strong"), (0.7, "strong"), (0.69, "good"), (0.66, "good"), (0.65, "partial"), (0.6, "partial"), (0.59, "weak"), (0.3, "weak"), (None, "good")])
def test_tiers(spark, similarity, tier):
    assert spark.createDataFrame([(similarity,)], "s double").select(fusion.relevance_tier(F.col("s"))).first()[0] == tier


@pytest.mark.parametrize(
    ("date_to", "created", "there"),
    [("2025-04-30", "2025-04-30T23:59:59+00:00", True), ("2025-04-30", "2025-05-01T00:00:00+00:00", False), ("2025-04-30T10:00:00", "2025-04-30T23:00:00+00:00", True), ("soon", "2030-01-01", True), ("2025-04-30", None, False)],
)
def test_half_open_dates(spark, date_to, created, there):
    one = spark.createDataFrame([(created,)], "created string")
    assert (one.where(filters.document_filter(SearchFilters(date_to=date_to))).count() == 1) is there


def test_payslip_is_found_by_date(spark):
    docs = spark.createDataFrame([(750, "2025-04-25T00:00:00+00:00"), (1482, "2025-02-05T00:00:00+00:00"), (1483, "2025-01-05T00:00:00+00:00")], "id long, created string")
    chunks = spark.createDataFrame([(i, i, [1.0, 0.0]) for i in (750, 1482, 1483)], "chunk_id long, document_id long, embedding array<float>")
    assert ids(vectors.vector_search(chunks, docs, [1, 0], 5, filters.document_filter(SearchFilters("2025-04-01", "2025-04-30")))) == [750]


def test_browse_and_facets(index):
    documents, chunks, taxonomy = index
    page = browse.browse_page(browse.browse(documents, taxonomy), "created", True, 1, 1)
    assert ids(page, "id") == [2]
    assert ids(browse.browse_page(browse.browse(documents, taxonomy), "title", False, 9, 5), "id") == []
    assert ids(browse.browse(documents, taxonomy, text="ALPHA c"), "id") == [1]
    with pytest.raises(ValueError):
        browse.browse_page(documents, "id; drop")
    counts = {(r.kind, r.id): r.n for r in browse.facet_counts(documents, taxonomy).collect()}
    assert counts == {("correspondent", 10): 1, ("correspondent", 11): 1, ("document_type", 20): 1, ("tag", 101): 1, ("tag", 102): 2}
    assert {r.id: r.tags for r in browse.tag_names(documents, taxonomy).collect()} == {1: ["important", "scanned"], 2: ["scanned"]}
    stats = browse.index_stats(documents, chunks).first()
    assert stats.version == "2:4:2025-01-02T00:00:00+00:00"
    assert browse.index_stats(documents.limit(0), chunks.limit(0)).first().version == "0:0:none"
    assert browse.integrity(documents, chunks, fts.postings(chunks)).count() == 0
    assert browse.integrity(documents.where("id = 1"), chunks, fts.postings(chunks)).count() == 1


@pytest.mark.parametrize(
    ("text", "size", "overlap", "check"),
    [
        ("", 500, 50, lambda c: c == []),
        (" \n\n\t", 500, 50, lambda c: c == []),
        ("word " * 2000, 500, 50, lambda c: len(c) > 1 and all(len(t) <= 500 for _, t, _ in c)),
        ("abcde " * 500, 200, 40, lambda c: all(b[1].startswith(a[1][-40:]) for a, b in zip(c, c[1:], strict=False))),
        ("x" * 1000, 200, 0, lambda c: "".join(t for _, t, _ in c) == "x" * 1000),
        ("A" * 20 + "\n\n" + "B" * 15, 20, 10, lambda c: [t for _, t, _ in c] == ["A" * 20, "B" * 15]),
        ("\n\n".join(x * 18 for x in "ABCD"), 20, 10, lambda c: [t for _, t, _ in c] == [x * 18 for x in "ABCD"]),
        ("A" * 18017, 24000, 0, lambda c: len(c) >= 4 and all(len(t) <= 6000 for _, t, _ in c)),
        ("--- Page 3 (model) ---\nsome text", 200, 0, lambda c: c == [(0, "some text", 3)]),
        ("--- Page 1 ---\n" + "a b " * 60 + "\n--- Page 2 ---\n" + "c d " * 60, 300, 0, lambda c: [h for _, _, h in c] == sorted(h for _, _, h in c)),
        ("one two\n\nthree four\n\nfive", 12, 4, lambda c: [t for _, t, _ in c] == ["one two", "three four", "our\n\nfive"] or len(c) == 3),
    ],
)
def test_chunks(text, size, overlap, check):
    c = chunking.chunk_text(text, size, overlap)
    assert check(c) and [i for i, _, _ in c] == list(range(len(c)))


def test_chunk_overlap_and_pages_across_windows():
    text = "--- Page 1 ---\n" + "a" * 10 + "\n\n" + "b" * 10 + "\n--- Page 2 ---\n" + "c" * 5 + "\n\n" + "d" * 30
    assert chunking.chunk_text(text, 22, 6) == [(0, "a" * 10 + "\n\n" + "b" * 10, 1), (1, "b" * 6 + "\n\n" + "c" * 5, 1), (2, "d" * 22, 2), (3, "d" * 14, 2)]


def test_chunk_frame_and_bad_overlap(spark):
    got = chunking.chunk_documents(spark.createDataFrame([(1, "aaaa\n\nbbbb"), (2, None)], "document_id long, text string"), 5, 0).collect()
    assert [(r.document_id, r.chunk_index, r.text, r.page_hint) for r in got] == [(1, 0, "aaaa", None), (1, 1, "bbbb", None)]
    with pytest.raises(ValueError):
        chunking.chunk_text("x", 10, 10)


TODAY = dt.date(2026, 6, 10)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("salary in April 2025", ("2025-04-01", "2025-04-30")), ("documents from 2024", ("2024-01-01", "2024-12-31")), ("Q2 2025 invoices", ("2025-04-01", "2025-06-30")), ("sept 2025", ("2025-09-01", "2025-09-30")),
        ("last month", ("2026-05-01", "2026-05-31")), ("2025-04-25", ("2025-04-25", "2025-04-25")), ("2025-13-99", (None, None)), ("my salary", (None, None)), ("this year", ("2026-01-01", "2026-12-31")), ("feb 2024", ("2024-02-01", "2024-02-29")),
    ],
)
def test_periods(spark, text, want):
    from docloom.functions.dates import date_range

    assert period(text, TODAY) == want
    r = spark.createDataFrame([(text,)], "t string").select(date_range(F.col("t"), TODAY).alias("r")).first().r
    assert (tuple(r) if r else (None, None)) == want


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_timestamps_are_utc_in_any_session_zone(spark, zone):
    from docloom.functions import dates

    want = {"2024-06-01": "2024-06-01T00:00:00+00:00", "2024-06-01T12:00:00": "2024-06-01T12:00:00+00:00", "2024-06-01T12:00:00+02:00": "2024-06-01T10:00:00+00:00", "2024-06-01T12:00:00.5Z": "2024-06-01T12:00:00.500000+00:00", "soon": "soon", "2024-13-01": "2024-13-01", None: None}
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        t = spark.createDataFrame([(k,) for k in want], "t string")
        assert {r[0]: r[1] for r in t.select("t", dates.normalise_timestamp(F.col("t"))).collect()} == want
        d = spark.createDataFrame([(" 2025-01-02T10:00",), ("2025-01-02 10:00",), ("1899-01-01",), ("9999-12-31",)], "t string")
        assert [r[0] for r in d.select(dates.document_date(F.col("t"), TODAY)).collect()] == ["2025-01-02", None, None, None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize(
    ("guess", "entries", "method", "hit"),
    [
        ("Property Deed", ["Property Deed", "Deed"], "exact", 0), ("gas-bill", ["Gas Bill"], "normalised", 0), ("Contract of Employment", ["Employment Contract"], "loose", 0), ("Employment Contract", ["Contract"], "near_miss", None),
        ("Employment Contract", ["Employment Contract Addendum"], "near_miss", None), ("the contract employment", ["Employment Contract", "Contract of Employment"], "ambiguous", None), ("the", ["The Deed", "The Contract"], "none", None), ("ID", ["Video"], "none", None),
    ],
)
def test_name_match(spark, guess, entries, method, hit):
    m = match_name(guess, list(enumerate(entries)))
    assert (m.method, m.id) == (method, hit)
    r = names.match_names(spark.createDataFrame([(guess,)], "guess string"), spark.createDataFrame(list(enumerate(entries)), "id long, name string")).first()
    assert (r.method, r.id) == (method, hit) and tuple(r.candidates) == m.candidates


def test_match_items(spark):
    from docloom.functions.text import normalise_name

    items = spark.createDataFrame([(1, "Revolut Ltd."), (2, "Acme Holdings")], "id long, name string")
    got = names.match_items(spark.createDataFrame([("revolut",), ("Acme",), ("zzz",)], "guess string"), items, normalise_name)
    assert {r.guess: r.id for r in got.collect()} == {"revolut": 1, "Acme": 2, "zzz": None}


def test_filters_meet():
    a, b = SearchFilters("2024-01-01", "2024-12-31", 1, None, (1,)), SearchFilters("2024-02-01", None, 2, 5, (2, 1))
    assert intersect(a, b) == SearchFilters("2024-02-01", "2024-12-31", 2, 5, (1, 2)) and intersect(a, None) == a


def test_resolve_adds_period_and_twins():
    plan = RetrievalPlan((PlannedSpec("semantic", "rent", filter_guess=FilterGuess(correspondent="alpha corp", tags=("nope",))),))
    got = resolve(plan, {"correspondent": [(10, "Alpha Corp")]}, None, TODAY, "rent in April 2025", 8)
    assert [s.filters for s in got] == [SearchFilters(correspondent_id=10), SearchFilters("2025-04-01", "2025-04-30", 10), SearchFilters()]
    assert len(resolve(plan, {}, None, TODAY, "", 8)) == 1
    assert resolve(RetrievalPlan(()), {}, None, TODAY, "in 2024")[0].filters == SearchFilters("2024-01-01", "2024-12-31")
    assert broaden(plan).specs[0].filter_guess == FilterGuess()
    assert call_budget(True, 1) == 6 and call_budget(False, 1) == 4


def test_model_replies():
    assert json_object('```json\n{"a": 1}\n```') == {"a": 1} and json_object("so: {\"a\": 1} ok") == {"a": 1} and json_object("none") is None and json_object("[1]") is None
    assert parse_plan("?", "q").specs[0].semantic == "q"
    assert parse_plan('{"specs": [{"mode": "keyword", "keywords": ["a", 3]}, {"mode": "semantic"}]}', "q").specs == (PlannedSpec("keyword", None, ("a",)),)
    assert [parse_score(x) for x in (True, "1", 2, -1, 0.5)] == [0.0, 0.0, 1.0, 0.0, 0.5]
    assert [(v["document_id"], v["keep"]) for v in parse_verdicts('{"verdicts": [{"document_id": 1, "keep": false}, {"document_id": 9, "keep": true}]}', [1, 2])] == [(1, False), (2, True)]
    assert all(v["keep"] for v in parse_verdicts("bad", [1, 2]))
    assert list(ndjson([{"n": 1}], {"ok": True})) == ['{"type": "event", "n": 1}\n', '{"type": "result", "ok": true}\n']


def test_cache_expires_and_evicts():
    now = [0.0]
    c = ResultCache(2, 10, lambda: now[0])
    keys = [ResultCache.key(q, None, "v") for q in ("A  b", "c", "d")]
    assert keys[0] == ResultCache.key("a B", None, "v")
    c.put(keys[0], 1), c.put(keys[1], 2)
    assert c.get(keys[0]) == 1
    c.put(keys[2], 3)
    assert c.get(keys[1]) is None and c.get(keys[0]) == 1
    now[0] = 11
    assert c.get(keys[0]) is None


def test_search_answers(spark, index):
    documents, chunks, taxonomy = index
    embedder = HashEmbedder(16)
    texts = [r.text for r in chunks.orderBy("chunk_id").collect()]
    vec = spark.createDataFrame([(i + 1, 1 + i // 2, v) for i, v in enumerate(embedder(texts))], "chunk_id long, document_id long, embedding array<float>")
    s = Search(documents.withColumn("text", F.lit("whole")), chunks.select("chunk_id", "document_id", "text"), vec, taxonomy, embedder, settings=SearchSettings(min_similarity=0.0))
    assert ids(s.retrieve("invoice total"))[0] == 1
    assert s.retrieve("x") is None
    answer = s.answer("electricity bill")
    assert answer["status"] == "answered" and answer["sources"][0]["document_id"] == 2 and answer["calls"] <= call_budget(True, 1)
    assert s.answer("electricity  BILL") is answer
    page, total = s.keyword("invoice", 99)
    assert ids(page) == [1] and total.first().total == 1
    assert [(r.document_id, r.error) for r in s.fetch([1, 7]).orderBy("document_id").collect()] == [(1, None), (7, "not found")]
    failing = Search(documents, chunks, vec, taxonomy, lambda texts: 1 / 0)
    assert ids(failing.retrieve("invoice")) == [1]


def test_pages(spark):
    p = spark.createDataFrame([(1, 1, "one", "m2"), (1, 2, "  ", "m1"), (1, 3, "three", "m1"), (2, 1, "solo", None), (3, 1, " ", "m")], "document_id long, page int, text string, model string")
    got = {r.document_id: (r.text, r.models) for r in pages.assemble_pages(p, True).collect()}
    assert got[1] == ("--- Page 1 (m2) ---\none\n\n--- Page 3 (m1) ---\nthree\n\nTranscribed by model: m1, m2", ["m1", "m2"]) and got[2] == ("solo", []) and got[3][0] == ""
    text = "".join(f"--- Page {i} ---\np{i}\n" for i in range(1, 7)) + "\n\nTranscribed by model: m"
    t = pages.truncate_pages(spark.createDataFrame([(1, text), (2, "x" * 50), (3, "short")], "document_id long, text string"), 2, 1, 20).orderBy("document_id").collect()
    assert t[0].pages == [1, 2, 6] and t[0].text.endswith("Transcribed by model: m") and "1-2, 6" in t[0].note and "Total pages with OCR headers: 6" in t[0].note
    assert t[1].text == "x" * 20 and "first 20 characters" in t[1].note and not t[2].truncated
    cut = spark.createDataFrame([("a" * 30 + "\n\nTranscribed by model: m",)], "t string").select(pages.truncate_chars(F.col("t"), 40)).first()[0]
    assert cut == "a" * 15 + "\n\nTranscribed by model: m"


def test_failures(spark):
    failed = spark.createDataFrame([(1, 4), (2, 1), (3, 2)], schemas.FAILED)
    out = spark.createDataFrame([(1, None), (2, "indexed"), (4, None)], "id long, outcome string")
    assert {r.document_id: (r.failures, r.given_up) for r in sync.update_failures(failed, out).collect()} == {1: (5, True), 3: (2, False), 4: (1, False)}


def test_sweep_needs_a_whole_listing(spark):
    known, source = spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(1,)], "id long")
    assert ids(sync.deletion_candidates(known, source, 1), "id") == [2] and ids(sync.deletion_candidates(known, source, 2), "id") == []


def test_prices_and_health(spark):
    calls = spark.createDataFrame([("u", "gpt-5.4", "openai", 1_000_000, 0), ("u", "x", "ollama", 5, 5), ("v", "x", "openai", 1, 1)], "key string, model string, provider string, prompt long, completion long")
    got = {r.key: (r.usd, r.local) for r in accounting.roll_up_costs(accounting.price_calls(calls, spark.createDataFrame(list(accounting.MODEL_PRICES), schemas.PRICES)), "key").collect()}
    assert got == {"u": (2.5, False), "v": (None, False)}
    assert accounting.overall_health(spark.createDataFrame([("running",), ("stopped",)], "state string")).first().health == "degraded"


def test_throttle(spark):
    _, _, out = replay([], 0.0, [(t, False) for t in range(5)] + [(10.0, True), (905.0, True), (906.0, False)], 5)
    assert [a for _, a, _ in out] == [True] * 5 + [False, True, True] and out[4][2] == 904.0
    frame = spark.createDataFrame([("k", float(t), False) for t in range(6)], "key string, ts double, success boolean")
    assert [r.allowed for r in throttle_batch(frame).orderBy("ts").collect()] == [True] * 5 + [False]


SOURCE = "id long, title string, correspondent_id long, document_type_id long, tag_ids array<long>, created string, modified string, text string"


def test_store_and_cycles(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "store"))
    rows = [(i, f"t{i}", 10, None, [], "2024-01-15", f"2024-06-01T12:00:{i:02d}+00:00", f"text of {i}\n\nmore") for i in range(1, 4)]
    source = spark.createDataFrame(rows, SOURCE)
    first = run_cycle(store, source, HashEmbedder(8), "2024-07-01T00:00:00+00:00")
    assert (first.indexed, first.deleted, first.watermark) == (3, 0, "2024-06-01T11:59:53+00:00")
    again = run_cycle(store, source, HashEmbedder(8), "2024-07-01T00:01:00+00:00")
    assert (again.indexed, again.unchanged) == (0, 3)
    changed = [(*rows[0][:6], "2024-06-02T00:00:00Z", rows[0][7]), (*rows[1][:6], "2024-06-02T00:00:00+00:00", "new text"), (*rows[2][:6], "2024-06-03T00:00:00+00:00", "   ")]
    third = run_cycle(store, spark.createDataFrame(changed, SOURCE), HashEmbedder(8), "2024-07-01T00:02:00+00:00")
    assert (third.metadata_only, third.indexed, third.skipped, third.deleted) == (1, 1, 1, 1)
    state = {r.id: r for r in store.read("documents").collect()}
    assert sorted(state) == [1, 2] and state[1].modified == "2024-06-02T00:00:00+00:00" and state[1].chunk_count == 1
    assert browse.integrity(store.read("documents"), store.read("chunks"), store.read("postings")).count() == 0
    assert store.meta("last_reconcile_at") == "2024-07-01T00:02:00+00:00"
    gone = run_cycle(store, spark.createDataFrame(changed[:1], SOURCE), HashEmbedder(8), "2024-07-01T00:03:00+00:00")
    assert gone.deleted == 1 and ids(store.document_ids(), "id") == [1]
    with pytest.raises(KeyError):
        store.update_metadata(store.read("documents").withColumn("id", F.lit(77).cast("long")))
    old = store.generation()
    other = IndexStore(spark, str(tmp_path / "store"))
    store.write_meta(a="1")
    other.generation = lambda: old  # a writer that read before that commit
    with pytest.raises(StaleWriter):
        other.commit(taxonomy=spark.createDataFrame([], schemas.TAXONOMY))
    assert store.check_model("m1") is False and store.check_model("m2") is True and store.reembed_scope() == (0, 0)
    assert store.meta("watermark") is None
    store.vacuum(0)
    assert store.read("documents").count() == 0


def test_a_slower_writer_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    names = lambda *rows: spark.createDataFrame(list(rows), schemas.TAXONOMY)
    winner, loser = IndexStore(spark, path), IndexStore(spark, path)
    winner.refresh_taxonomy(names(("tag", 1, "old")))
    base = loser._manifest()
    folder = loser.stage("taxonomy", names(("tag", 1, "loser")))
    winner.refresh_taxonomy(names(("tag", 1, "winner")))
    with pytest.raises(StaleWriter):
        loser.publish(base, {"taxonomy": folder})
    assert [r.name for r in winner.read("taxonomy").collect()] == ["winner"] == [r.name for r in loser.read("taxonomy").collect()]
    # a claim without a generation: that of a writer at work, or long dead
    (tmp_path / "store" / "_commits" / f"{winner.generation() + 1:012d}.claim").touch()
    with pytest.raises(StaleWriter):
        winner.write_meta(a="1")
    winner._commits_of = winner._commits
    winner._commits = lambda: [(n, k, t - 10_000) for n, k, t in winner._commits_of()]
    winner.write_meta(a="1")
    assert loser.meta("a") == "1"
    winner.vacuum()
    assert (tmp_path / "store" / folder).exists()  # it may be of a writer at work


def source_row(i, modified, text="some text"):
    return (i, f"t{i}", 10, None, [], "2024-01-15", modified, text)


def test_writes_add_segments_and_compaction_merges_them(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "store"))
    for n in range(4):
        rows = [source_row(i, f"2024-06-0{n + 1}T12:00:00+00:00", f"word{n} of {i}") for i in range(n, n + 3)]
        run_cycle(store, spark.createDataFrame(rows, SOURCE), HashEmbedder(8), "now", sweep=False)
    want = {0: "word0 of 0", 1: "word1 of 1", 2: "word2 of 2", 3: "word3 of 3", 4: "word3 of 4", 5: "word3 of 5"}
    assert store.segments() > 4
    for _ in range(2):
        assert {r.document_id: r.text for r in store.read("chunks").collect()} == want and sorted(ids(store.document_ids(), "id")) == sorted(want)
        assert browse.integrity(store.read("documents"), store.read("chunks"), store.read("postings")).count() == 0
        assert {r.document_id for r in fts.scores(store.index(), "word3").collect()} == {3, 4, 5} and store.read("fts_stats").count() == 6
        store.compact()
    assert store.segments() == 1
    store.delete(spark.createDataFrame([(3,)], "id long"))
    assert sorted(ids(store.document_ids(), "id")) == [0, 1, 2, 4, 5] and {r.document_id for r in fts.scores(store.index(), "word3").collect()} == {4, 5}
    run_cycle(store, spark.createDataFrame([source_row(3, "2024-07-01T00:00:00Z")], SOURCE), HashEmbedder(8), "now", sweep=False, most_segments=1)
    assert store.segments() == 1 and sorted(ids(store.document_ids(), "id")) == [0, 1, 2, 3, 4, 5]


def test_failed_documents_are_tried_again_and_given_up(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "store"))
    good = HashEmbedder(8)

    def failing(texts):
        if any("poison" in t for t in texts):
            raise RuntimeError
        return good(texts)

    rows = [source_row(1, "2024-06-01T12:00:00+00:00"), source_row(2, "2024-06-01T12:00:00+00:00", "poison"), source_row(3, "2024-06-20T12:00:00+00:00")]
    source = spark.createDataFrame(rows, SOURCE)
    left = lambda: {r.document_id: r.failures for r in store.read("failures").collect()}
    for n in range(1, sync.MOST_FAILURES + 1):
        report = run_cycle(store, source, failing, "now")
        assert report.failed == 1 and report.given_up == (n == sync.MOST_FAILURES) and left() == ({2: n} if n < sync.MOST_FAILURES else {}) and sorted(ids(store.document_ids(), "id")) == [1, 3]
    assert run_cycle(store, source, failing, "now").failed == 0 and left() == {}  # given up, until its text changes
    again = spark.createDataFrame([rows[0], source_row(2, "2024-06-20T18:00:00+00:00", "poison again"), rows[2]], SOURCE)
    assert run_cycle(store, again, failing, "now").failed == 1 and left() == {2: 1}  # counted from one
    mended = spark.createDataFrame([rows[0], source_row(2, "2024-06-21T00:00:00+00:00", "well"), rows[2]], SOURCE)
    assert run_cycle(store, mended, failing, "now").indexed == 1 and left() == {} and sorted(ids(store.document_ids(), "id")) == [1, 2, 3]
    # one that had failed is mended by the provider, not by a newer text
    worse = spark.createDataFrame([rows[0], rows[2], source_row(4, "2024-06-21T00:00:00+00:00", "poison")], SOURCE)
    assert run_cycle(store, worse, failing, "now", sweep=False).failed == 1
    assert run_cycle(store, worse, good, "now", sweep=False).indexed == 1 and left() == {}


def test_scan_compares_times_not_texts(spark):
    rows = [(1, "2024-06-01T13:00:00+02:00"), (2, "2024-06-01T10:30:00-08:00"), (3, "2024-06-01T12:00:01Z"), (4, "2024-06-01T12:00:00.5+00:00"), (5, None), (6, "unknown"), (7, "2024-05-31T23:00:00-13:30"), (8, "2024-05-31")]
    frame = spark.createDataFrame(rows, "id long, modified string")
    assert sorted(ids(sync.scan_since(frame, "2024-06-01T12:00:00+00:00"), "id")) == [2, 3, 4, 5, 6, 7]
    assert sorted(ids(sync.scan_since(frame, None), "id")) == [1, 2, 3, 4, 5, 6, 7, 8]


def test_streamed_indexing(spark, tmp_path):
    from docloom.streaming.ingest import start_indexing, stream_source

    rows = [(i, "t", None, None, [], "2024-01-15", "2024-06-01T12:00:00+00:00", f"text {i}") for i in (1, 2)]
    frame = spark.createDataFrame(rows, SOURCE)
    frame.write.parquet(str(tmp_path / "in" / "a"))
    for _ in range(2):
        start_indexing(stream_source(spark, str(tmp_path / "in" / "*"), frame.schema), str(tmp_path / "store"), HashEmbedder(8), str(tmp_path / "cp")).awaitTermination()
    assert sorted(ids(IndexStore(spark, str(tmp_path / "store")).document_ids(), "id")) == [1, 2]


def test_a_stream_keeps_rows_that_come_late(spark, tmp_path):
    from docloom.streaming.ingest import start_indexing, stream_source

    batches = [
        [source_row(1, "2024-06-10T12:00:00+00:00"), source_row(3, "2024-06-10T13:00:00+00:00", "third")],
        [source_row(2, "2024-06-01T12:00:00+00:00"), source_row(3, "2024-06-09T12:00:00+00:00", "older third")],
        [source_row(4, "2024-06-11T00:00:00+02:00"), source_row(4, "2024-06-10T23:30:00+00:00", "newer fourth")],
    ]
    for n, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, SOURCE)
        frame.write.parquet(str(tmp_path / "in" / str(n)))
        start_indexing(stream_source(spark, str(tmp_path / "in" / "*"), frame.schema), str(tmp_path / "store"), HashEmbedder(8), str(tmp_path / "cp")).awaitTermination()
    store = IndexStore(spark, str(tmp_path / "store"))
    assert {r.document_id: r.text for r in store.read("chunks").collect()} == {1: "some text", 2: "some text", 3: "third", 4: "newer fourth"}
    assert store.meta("watermark") == "2024-06-10T23:29:50+00:00"


def test_raw_plan_is_one_semantic_and_one_keyword_search():
    assert [(s.mode, s.semantic, s.keywords) for s in raw_rag_plan("gas bill").specs] == [("semantic", "gas bill", ()), ("keyword", None, ("gas", "bill"))]


def test_settings():
    from docloom import settings

    given = {"a": " 5 ", "blank": "  ", "b": "Yes", "c": "x, ,y", "n": "-1", "bad": "z", "f": "0.5"}
    assert settings.integer(given, "a") == 5 and settings.integer(given, "blank", 7) == 7 and settings.positive(given, "n") is None and settings.number(given, "f", 1.0) == 0.5
    assert settings.flag(given, "b", False) is True and settings.flag(given, "blank", True) is True and settings.names(given, "c") == ["x", "y"] and settings.names(given, "none", ["d", ""]) == ["d"]
    for call in (lambda: settings.integer(given, "bad"), lambda: settings.flag(given, "bad", True), lambda: settings.number(given, "bad", 1.0), lambda: settings.required(given, "blank"), lambda: settings.names(given, "blank", some=True)):
        with pytest.raises(ValueError):
            call()


def test_price_lists():
    good = {"currency": "USD", "as_of": "2025-01-01", "models": {"m": {"input_per_mtok": 1, "output_per_mtok": 2.5}}}
    assert accounting.price_table(good) == ([("m", 1.0, 2.5)], "2025-01-01")
    worse = [[], {}, {**good, "currency": "EUR"}, {**good, "as_of": " "}, {**good, "models": {}}, *({**good, "models": {"m": {"input_per_mtok": x, "output_per_mtok": 1}}} for x in (True, "1", -1, float("nan"), float("inf"), None))]
    for payload in worse:
        with pytest.raises(ValueError):
            accounting.price_table(payload)


def test_models_take_turns():
    from docloom.plans.providers import Unsupported, normalise_query, with_fallbacks

    seen, waits = [], []

    def call(model, **parameters):
        seen.append((model, tuple(parameters)))
        if model == "a":
            raise OSError
        if "effort" in parameters:
            raise Unsupported("effort")
        return "ok"

    assert with_fallbacks(call, ["a", "b"], 2, waits.append, effort=1, top=2) == "ok"
    assert seen == [("a", ("effort", "top"))] * 2 + [("b", ("effort", "top")), ("b", ("top",))] and waits == [1.0]
    with pytest.raises(RuntimeError):
        with_fallbacks(call, ["a"], 1, waits.append)
    assert normalise_query("  x ") == "x"
    for bad in (" ", "y" * 4001):
        with pytest.raises(ValueError):
            normalise_query(bad)


def test_keys_classifiers_and_ligatures(spark):
    from docloom.functions.classification import parse_classification
    from docloom.functions.identity import attempt_key
    from docloom.functions.text import name_key
    from docloom.plans.providers import classify

    frame = spark.createDataFrame([(1, "Straße", None), (2, "ALICE", "1.2.3.4")], "id long, text string, ip string")
    got = frame.select(attempt_key(F.col("ip"), F.col("text")).alias("k")).collect()
    assert [tuple(r.k) for r in got] == [("", "strasse"), ("1.2.3.4", "alice")]
    assert spark.createDataFrame([("ﬁnance oﬃce",)], "t string").select(name_key(F.col("t"))).first()[0] == "financeoffice"
    replies = classify(frame, lambda t: 'so {"title": "T", "tags": [1, "x"]}' if t == "ALICE" else 1 / 0).select("id", parse_classification(F.col("reply")).alias("p")).collect()
    assert {r.id: r.p and (r.p.title, r.p.tags, r.p.person) for r in replies} == {1: None, 2: ("T", ["1", "x"], "")}


def test_long_logs_are_replayed_as_they_stream_by(spark):
    rows = [(k, float(t), t % 7 == 6) for k in ("a", "b") for t in range(0, 3000, 3)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = sorted((r.key, r.ts, r.allowed, r.locked_until) for r in throttle_batch(spark.createDataFrame(rows, "key string, ts double, success boolean").repartition(3)).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = [(k, *r) for k in ("a", "b") for r in replay([], 0.0, [(t, s) for x, t, s in rows if x == k], 5)[2]]
    assert got == want and any(not r[2] for r in got)
