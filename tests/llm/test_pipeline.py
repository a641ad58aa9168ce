"""The pipeline's stages, each on its predecessor's result, and the registered queries against their SQL."""

import glob
import os
import random
from collections import Counter, defaultdict

import duckdb
import pytest
from test_pairs import linked, passages_by_windows

import corpus_pipeline
from docloom.llm import registry
from docloom.llm.scratch import Scratch

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def plain_mix(docs, tmp_path):
    """How often each document is taken, by the mix's SQL over these documents."""
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = con.sql(registry.oracle_sql()["op7_source_mix"])
    at = [found.columns.index(c) for c in ("doc_id", "taken", "size")]
    return Counter({r[at[0]]: r[at[1]] // r[at[2]] for r in found.fetchall() if r[at[1]]})


def sequences(rows):
    """How many sequences there are, after a look at their order: without gaps, and none too long."""
    by = defaultdict(list)
    for _, _, _, length, _, sequence, offset in rows:
        by[sequence].append((offset, length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    return len(by), sum(r[3] for r in rows)


def plain_packing(texts):
    """Best fit decreasing, looking through all open sequences."""
    from tokenizers import Tokenizer

    from docloom.llm.tokens import default_path

    plain = Tokenizer.from_file(default_path())
    pieces, total = [], 0
    for t in texts:
        n = len(plain.encode(t or "", add_special_tokens=False).ids) + 1
        total += n
        pieces += [2048] * (n // 2048) + [n % 2048] * bool(n % 2048)
    rooms = []
    for n in sorted(pieces, reverse=True):
        fits = [r for r in rooms if r >= n]
        room = min(fits) if fits else 2048
        if fits:
            rooms.remove(room)
        rooms.append(room - n)
    return len(rooms), total


def test_quality_on_more_documents(spark):
    """Most documents labelled bad go, and nearly none labelled good."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, docs, "/root/testdata/sf0.01").select("doc_id").collect()}
    good, bad = [i for i, q in labels.items() if q == 1], [i for i, q in labels.items() if q == 0]
    assert sum(i not in kept for i in good) <= 0.01 * len(good) and sum(i not in kept for i in bad) >= 0.7 * len(bad)


def test_stages(spark, tmp_path):
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.keep(stage(spark, docs, SF))
        after = docs.collect()
        if name != "packing":
            assert docs.columns == COLUMNS
        if name == "quality":
            gone = before.keys() - {r.doc_id for r in after}
            assert sum(labels.get(i) == 1 for i in gone) <= 0.03 * sum(v == 1 for v in labels.values())
            assert sum(labels.get(i) == 0 for i in gone) >= 0.3 * sum(v == 0 for v in labels.values())
        elif name == "near_dedup":
            groups = linked([(r.doc_id, r.text) for r in before.values()], 5, 80, 100)
            assert sorted(r.doc_id for r in after) == sorted({c for _, c in groups.values()})
        elif name == "substring_dedup":
            assert not passages_by_windows([(r.doc_id, r.text) for r in after])
            untouched = [r for r in after if r.text == before[r.doc_id].text]
            shared = passages_by_windows([(r.doc_id, r.text) for r in before.values()])
            assert {r.doc_id for r in after} == before.keys() and len(untouched) >= len(after) - 2 * len(shared) - 5
            assert all(r.n_chars == len(r.text) for r in after)
        elif name == "mix":
            assert Counter(r.doc_id for r in after) == plain_mix(spark.createDataFrame(list(before.values()), docs.schema), tmp_path)
            assert all(r.text == before[r.doc_id].text for r in after)
            copies = Counter(r.doc_id for r in after)
        else:
            assert sequences([tuple(r) for r in after]) == plain_packing([before[i].text for i, n in copies.items() for _ in range(n)])
        before = {r.doc_id: r for r in after}
    assert corpus_pipeline.ORACLE_SQL is None


AWKWARD = "text string, doc_id long, source string, lang string, n_chars long, score string, taken string, size string, component_id int, kept string, __id string"


def awkward(spark, rows):
    return spark.createDataFrame([(t, i, s, None, None if t is None else len(t), "own", "own", "own", 7, "own", "own") for i, t, s in rows], AWKWARD)


def awkward_rows():
    rng = random.Random(21)
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage, long = say(60), say(60_000)
    return [(1, f"{say(30)} {passage}", "a"), (2, f"{passage} {say(30)}", "a"), (3, None, "b"), (4, "", None), (None, passage, None), (5, long, "a"), (6, long + " end", "b"), (7, say(40), "c"), (7, say(40), "c"), (8, "same", "a"), (9, "same", "a")]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_awkward_rows_in_each_stage(spark, name):
    """Nulls in any column, empty and very long texts, repeated ids and rows, ties, clashing columns, empty tables."""
    stage, rows = dict(corpus_pipeline.STAGES)[name], awkward_rows()
    docs = awkward(spark, rows).repartition(3)
    out = stage(spark, docs, SF)
    if name == "packing":
        got = out.collect()
        assert len({(r.doc_id, r.piece, r.ids_crc32) for r in got}) <= len(got) and {r.doc_id for r in got} == {i for i, _, _ in rows} and stage(spark, docs.limit(0), SF).count() == 0
        return
    assert out.columns == docs.columns and stage(spark, docs.limit(0), SF).columns == docs.columns and stage(spark, docs.limit(0), SF).count() == 0
    got = out.collect()
    assert all((r.score, r.taken, r.component_id, r["__id"]) == ("own", "own", 7, "own") for r in got if name != "mix")
    texts = [(r.doc_id, r.text) for r in got]
    if name == "quality":
        assert set(texts) <= {(i, t) for i, t, _ in rows}
    elif name == "near_dedup":
        assert sorted(i for i, _ in texts if i is not None) == [1, 2, 3, 4, 5, 7, 8] and sum(i is None for i, _ in texts) == 1
    elif name == "substring_dedup":
        by = dict(texts)
        assert len(texts) == len(rows) and by[2] and len(by[2].split()) == 30 and by[6] == "end" and by[5] == rows[5][1] and by[3] is None and by[4] == "" and by[None] == rows[4][1]
    else:
        assert {i for i, _ in texts} <= {1, 2, None, 5, 6, 7, 8, 9} and len(texts) <= 3 * len(rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got = registry.queries()[name](spark, SF)
    want = con.sql(registry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    pick = [want.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r)) for r in got.select(*columns).collect()) == sorted(repr(tuple(r[i] for i in pick)) for r in want.fetchall())
