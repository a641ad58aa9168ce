"""Near-duplicates, shared passages and components against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import op1_substring_dedup as op1
from docloom.llm import op2_near_dedup as op2
from docloom.llm.components import components
from docloom.llm.scratch import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, component_id int, text2 string"


def prose(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def near(rng, w, edits):
    w = list(w)
    for _ in range(edits):
        i = rng.randrange(len(w))
        w[i : i + rng.randrange(2)] = [f"e{rng.randrange(10**6)}"]
    return w


def documents(seed=5):
    rng = random.Random(seed)
    docs = [prose(rng, rng.randrange(3, 200)) for _ in range(120)]
    for i in range(12):
        docs += [near(rng, docs[i], 1 + k) for k in range(4)]
    base = prose(rng, 150)
    docs += [near(rng, base, rng.randrange(1, 9)) for _ in range(70)]  # more near copies than a leaf holds
    docs += [list(docs[3]), list(docs[3]), ["one"], ["one"], ["two", "words"], []]
    rng.shuffle(docs)
    rows = [(i, " ".join(w)) for i, w in enumerate(docs)]
    rows += [(9001, None), (9002, "  "), (None, rows[0][1]), rows[5], rows[5], (9003, "Long " * 50_000)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, "x", 7, None) for i, t in rows], SCHEMA).repartition(5)


def linked(rows, k, num, den):
    sets = {}
    for i, t in rows:
        if i is not None:
            w = (t or "").encode().lower().split()
            sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    keys = sorted(sets)
    for x, a in enumerate(keys):
        for b in keys[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("k", "num"), [(3, 85), (5, 80)])
def test_near_duplicates_are_those_of_all_pairs(spark, k, num, monkeypatch):
    monkeypatch.setattr(op2, "MAX_DEPTH", 3)
    monkeypatch.setattr(op2, "BLOCK", 16)
    monkeypatch.setattr(op2, "LEAF", 24)
    rows = documents()
    got = op2.near_duplicates(frame(spark, rows), k, num, 100).collect()
    assert len(got) == len(rows)
    want = linked(rows, k, num, 100)
    for r in got:
        if r.doc_id is None:
            assert r.kept and r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)


@pytest.mark.parametrize(("k", "num", "depth"), [(3, 85, 10), (5, 80, 2)])
def test_a_large_group_of_near_copies(spark, k, num, depth, monkeypatch):
    """500 copies with ever more edits: a core that is linked, and a fringe of which few are."""
    monkeypatch.setattr(op2, "MAX_DEPTH", depth)
    rng = random.Random(17)
    base = prose(rng, 120)
    rows = [(i, " ".join(near(rng, base, rng.randrange(1, 18)))) for i in range(500)] + [(5000 + i, " ".join(prose(rng, 40))) for i in range(50)]
    want = linked(rows, k, num, 100)
    assert 100 < len({c for _, c in want.values()}) < 500
    got = op2.near_duplicates(frame(spark, rows), k, num, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_a_near_copy_is_compared_for_one_pivot_of_its_group(spark, monkeypatch):
    """The trees choose several pivots of one group; a class that more than one of them links was compared with what is near each of them."""
    monkeypatch.setattr(op2, "BLOCK", 16)
    monkeypatch.setattr(op2, "LEAF", 24)
    seen = []
    blocks = op2._Search.blocks
    monkeypatch.setattr(op2._Search, "blocks", lambda self, lone, rest: (seen.append((lone.collect(), rest.collect())), blocks(self, lone, rest))[1])
    rng = random.Random(11)
    base = prose(rng, 150)
    rows = [(i, " ".join(near(rng, base, rng.randrange(1, 12)))) for i in range(150)]
    got = op2.near_duplicates(frame(spark, rows), 5, 80, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == linked(rows, 5, 80, 100)
    held = [r.id for _, rest in seen for r in rest]
    assert seen and len(held) == len(set(held))
    pivot_of = {r.group: r.component for _, rest in seen for r in rest}
    assert not [r for lone, _ in seen for r in lone if r.component == pivot_of.get(r.group)]


def test_as_many_trees_as_the_recall_needs():
    rng = random.Random(3)

    def together(t, depth, n=4000):
        """Simulated share of pairs that one tree keeps together."""
        def alive(d):
            return d == 0 or any(rng.random() < t and alive(d - 1) for _ in range(1 + (rng.random() < 1 / t - 1)))

        return sum(alive(depth) for _ in range(n)) / n

    for t in (0.8, 0.85):
        s = op2.survival(t, op2.PLAN_DEPTH)
        assert abs(together(t, op2.PLAN_DEPTH) - s) < 0.04
        assert 1 - (1 - s) ** op2.tree_count(t) >= 0.9999


def test_one_of_each_group_stays(spark):
    rows = documents()
    left = op2.keep_one_each(frame(spark, rows)).collect()
    want = linked(rows, 5, 80, 100)
    assert sorted(r.doc_id for r in left if r.doc_id is not None) == sorted({c for _, c in want.values()})
    assert sum(r.doc_id is None for r in left) == 1 and left[0].asDict().keys() == dict.fromkeys(f.split()[0] for f in SCHEMA.split(", ")).keys()


def test_nothing_in_nothing_out(spark):
    empty = frame(spark, documents()).limit(0)
    assert op2.near_duplicates(empty).count() == 0 and op2.keep_one_each(empty).count() == 0
    assert op1.shared_passages(empty).count() == 0 and op1.remove_passages(empty, op1.shared_passages(empty)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark)).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(50)}}


def passages_by_windows(rows, n=50):
    """Documents that share a run of n words with a smaller doc_id."""
    first, hit = {}, set()
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = (t or "").lower().split()
        for p in range(len(w) - n + 1):
            key = tuple(w[p : p + n])
            if first.setdefault(key, i) != i:
                hit.add(i)
    return hit


def shared(seed=8):
    rng = random.Random(seed)
    passage = [prose(rng, 60, 10**6) for _ in range(6)]
    rows = []
    for i in range(160):
        w = prose(rng, rng.randrange(20, 150), 10**6)
        if i % 3 == 0:
            p = passage[i % 6]
            cut = rng.randrange(len(w))
            w[cut:cut] = p if i % 2 else near(rng, p, 1)
        rows.append((i, " ".join(w)))
    short = " ".join(prose(rng, 30, 10**6))
    rows += [(200 + i, f"{short} {' '.join(prose(rng, 60, 10**6))}") for i in range(5)]
    return rows + [(300, None), (301, ""), (None, rows[0][1]), rows[3], (302, "same word " * 4000), (303, "same word " * 3000)]


def test_shared_passages(spark):
    rows = shared()
    got = op1.shared_passages(frame(spark, rows)).collect()
    found = {r.doc_id for r in got}
    assert passages_by_windows(rows) <= found
    carriers = set(range(0, 160, 3))
    assert found - {303} <= carriers and len(found - {303}) >= len(carriers) - 4  # the first holders are left out, and copies edited at an end may be too short
    words = {i: (t or "").lower().split() for i, t in rows if i is not None}
    for r in got:
        assert r.partner_doc_id < r.doc_id and r.n_words == r.end_word - r.start_word >= 50 and r.identity >= 0.8
        a, b = words[r.doc_id][r.start_word : r.end_word], words[r.partner_doc_id][r.partner_start : r.partner_end]
        assert len(set(a) & set(b)) >= 0.7 * len(set(a))
        if r.identity == 1:
            assert a == b


@pytest.mark.parametrize("parts", [1, 5])
def test_a_passage_of_which_smaller_documents_hold_parts(spark, parts):
    rng = random.Random(4)
    around = lambda w: " ".join(prose(rng, 40, 10**6) + w + prose(rng, 40, 10**6))
    passage = prose(rng, 60, 10**6)
    rows = [(10, around(passage[:36])), (20, around(passage[25:])), (500, around(passage)), (900, around(passage))]
    got = op1.shared_passages(frame(spark, rows).repartition(parts)).collect()
    assert {(r.doc_id, r.partner_doc_id) for r in got} == {(900, 500)}
    assert all((r.start_word, r.end_word, r.partner_start, r.partner_end, r.identity) == (40, 100, 40, 100, 1) for r in got)


@pytest.mark.parametrize("every", [6, 7, 8])
def test_passages_with_an_edit_in_every_few_words(spark, every):
    rng = random.Random(every)
    around = lambda w: " ".join(prose(rng, 40, 10**6) + w + prose(rng, 40, 10**6))
    rows = []
    for i in range(40):
        passage = prose(rng, 59, 10**6)
        rows += [(i, around(passage)), (100 + i, around([f"e{rng.randrange(10**6)}" if j % every == every - 1 else w for j, w in enumerate(passage)]))]
    assert {(r.doc_id, r.partner_doc_id) for r in op1.shared_passages(frame(spark, rows)).collect()} == {(100 + i, i) for i in range(40)}


def test_passages_go_but_the_first_holder_keeps_them(spark):
    rows = shared()
    docs = frame(spark, rows)
    found = op1.shared_passages(docs)
    left = op1.remove_passages(docs, found).collect()
    assert len(left) == len(rows)
    after = [(r.doc_id, r.text) for r in left]
    assert not passages_by_windows(after)
    spans = defaultdict(list)
    for r in found.collect():
        spans[r.doc_id].append((r.start_word, r.end_word))
    before = dict(r for r in rows if r[0] is not None)
    for i, t in after:
        if i is None or before[i] is None or i not in spans:
            continue
        w = before[i].split()
        gone = {k for a, b in spans[i] for k in range(a, b)}
        assert t.split() == [x for k, x in enumerate(w) if k not in gone]
    assert all(r.n_chars == (len(r.text) if r.doc_id in spans else None) for r in left)


def test_chain_is_the_best_ordered_one():
    rng = random.Random(2)
    for _ in range(60):
        runs = [(rng.randrange(40), rng.randrange(40), rng.randrange(1, 6)) for _ in range(7)]
        best = 0.0
        for mask in range(1, 1 << 7):
            path = sorted(runs[i] for i in range(7) if mask >> i & 1)
            ok = all(p[0] + p[2] <= q[0] and p[1] + p[2] <= q[1] for p, q in zip(path, path[1:], strict=False))
            if ok:
                best = max(best, sum(p[2] for p in path) - 0.3 * sum(q[0] - p[0] - p[2] + q[1] - p[1] - p[2] for p, q in zip(path, path[1:], strict=False)))
        first = [runs[i] for i in op1.chain(runs, 0.3)[0]]
        score = sum(p[2] for p in first) - 0.3 * sum(q[0] - p[0] - p[2] + q[1] - p[1] - p[2] for p, q in zip(first, first[1:], strict=False))
        assert score == pytest.approx(best)


def test_edit_distance():
    assert op1.edits([1, 2, 3], [1, 3]) == 1 and op1.edits([], [1, 2]) == 2 and op1.edits([1, 2], [2, 1]) == 2
    rng = random.Random(6)
    for _ in range(200):
        x, y = ([rng.randrange(4) for _ in range(rng.randrange(1, 90))] for _ in range(2))
        row = list(range(len(y) + 1))
        for i, u in enumerate(x, 1):
            row = _next_row(row, i, u, y)
        assert op1.edits(x, y) == row[-1]


def _next_row(row, i, u, y):
    out = [i]
    for j, v in enumerate(y, 1):
        out.append(min(row[j] + 1, out[j - 1] + 1, row[j - 1] + (u != v)))
    return out


def test_key_minima_cover_every_window():
    rng = np.random.default_rng(1)
    s = rng.integers(0, 2**63, 300).astype(np.uint64)
    o = np.array([0, 5, 5, 120, 300])
    for size in (1, 4, 8):
        m = op1.seed_mask(s, o, size)
        for a, b in zip(o, o[1:], strict=False):
            for i in range(a, max(a, b - size) + 1):
                if b > a:
                    w = slice(i, min(b, i + size))
                    assert m[w][s[w].argmin()]


def test_ties_of_few_and_of_many_holders():
    rows = sorted([(7, d, p) for d in range(3) for p in (1, 5)] + [(9, d, 2) for d in range(op1.HOLDERS + 1)] + [(11, 4, 0)])
    key, doc, pos = (np.array(x) for x in zip(*rows, strict=True))
    few, hot, many, first = op1._ties(key.astype(np.uint64), doc)
    pairs = {(rows[x], rows[y]) for x, y in few.T.tolist()}
    assert pairs == {((7, d, p), (7, e, 1)) for d in range(3) for p in (1, 5) for e in range(d)}
    assert {(rows[x], rows[y]) for x, y in hot.T.tolist()} == {((9, d, 2), (9, 0, 2)) for d in range(1, op1.HOLDERS + 1)}
    assert many.tolist() == [r[0] == 9 for r in rows] and first.tolist() == [r[:2] in ((7, 0), (9, 0), (11, 4)) for r in rows]


@pytest.mark.parametrize("edited", [0, 12])
@pytest.mark.parametrize(("size", "step"), [(16, 4), (24, 12), (40, 28)])
def test_a_passage_whose_parts_stand_in_many_earlier_documents(spark, edited, size, step):
    rng = random.Random(4)
    around = lambda w: " ".join(prose(rng, 40, 10**6) + w + prose(rng, 40, 10**6))
    passage = prose(rng, 120, 10**6)
    other = [f"e{rng.randrange(10**6)}" if edited and j % edited == edited - 1 else w for j, w in enumerate(passage)]
    rows = [(i, around(passage[at : at + size])) for i, at in enumerate(range(0, 120 - size + 1, step))] + [(1000, around(passage)), (1001, around(other))]
    found = [sorted(map(tuple, op1.shared_passages(frame(spark, rows).repartition(parts)).collect())) for parts in (1, 5)]
    assert found[0] == found[1]
    assert [(r[0], r[1], r[3]) for r in found[0]] == [(1001, 40, 1000)] and found[0][0][6] >= 119


def test_a_document_needed_by_many_windows(spark, monkeypatch):
    monkeypatch.setattr(op1, "CUTS", 3)
    rng = random.Random(12)
    passage = prose(rng, 70, 10**6)
    rows = [(i, " ".join(prose(rng, 30, 10**6) + passage + prose(rng, 30, 10**6))) for i in range(40)]
    got = op1.shared_passages(frame(spark, rows)).collect()
    assert {(r.doc_id, r.partner_doc_id, r.start_word, r.n_words) for r in got} == {(i, 0, 30, 70) for i in range(1, 40)}


def test_removal_with_clashing_columns_and_nulls(spark):
    rng = random.Random(13)
    passage = " ".join(prose(rng, 60, 10**6))
    rows = [(1, f"a {passage}", 0), (2, f"{passage} b", 1), (None, passage, 2), (3, None, 3), (2, f"{passage} b", 4)]
    docs = spark.createDataFrame([(*r, "x", 5, "y") for r in rows], "doc_id long, text string, n int, __id string, __spans int, __text string")
    left = {r.n: r for r in op1.remove_passages(docs, op1.shared_passages(docs)).collect()}
    assert [left[i].text for i in range(5)] == [f"a {passage}", "b", passage, None, "b"]
    assert left[0].asDict().keys() == {"doc_id", "text", "n", "__id", "__spans", "__text"} and all((r["__id"], r["__spans"]) == ("x", 5) for r in left.values())


def test_a_passage_of_which_many_different_documents_hold_every_part(spark):
    """Every key of the passage has more than HOLDERS holders, the smallest of which differ from part to part."""
    rng = random.Random(21)
    around = lambda w: " ".join(prose(rng, 40, 10**6) + w + prose(rng, 40, 10**6))
    passage = prose(rng, 60, 10**6)
    parts = [passage[at : at + 36] for at in range(25)]
    rows = [(100 * k + i, around(part)) for i, part in enumerate(parts) for k in range(op1.HOLDERS + 1)]
    rows += [(5000, around(passage)), (5001, around(passage))]
    found = [r for r in op1.shared_passages(frame(spark, rows)).collect() if r.doc_id == 5001]
    assert [(r.partner_doc_id, r.start_word, r.end_word) for r in found] == [(5000, 40, 100)]


def test_copies_are_members_of_the_first(spark):
    rng = random.Random(22)
    text, short = " ".join(prose(rng, 80)), " ".join(prose(rng, 20))
    got = op1.shared_passages(frame(spark, [(i, text if i % 2 else text.replace(" ", "\n").upper()) for i in range(9, 30)] + [(40, short), (41, short), (50, f"{text} {short}")])).collect()
    assert sorted((r.doc_id, r.partner_doc_id, r.start_word, r.end_word) for r in got) == [(i, 9, 0, 80) for i in range(10, 30)] + [(50, 9, 0, 80)]


def test_parts_that_are_still_open():
    s = lambda lo, hi, hot=True: {"lo": lo, "hi": hi, "hot": hot}
    assert op1.open_parts([s(0, 60)], []) == [(0, 60)] and op1.open_parts([s(0, 49)], []) == []
    assert op1.open_parts([s(0, 60)], [{"start": 0, "end": 60}]) == [] and op1.open_parts([s(0, 60, False)], []) == []
    assert op1.open_parts([s(0, 200)], [{"start": 60, "end": 130}]) == [(0, 60), (130, 200)]


def chance_runs(frequent):
    """A document of 200 words that shares five words with each of eight others, 20 words apart, and 35 words with a ninth."""
    places = np.append(np.arange(0, 160, 20), np.arange(160, 191))
    d, a = np.full(len(places), 100), np.append(np.arange(8), np.full(31, 50))
    return op1._regions(d, a, places, places, places + 7, np.full(len(places), op1.K), np.full(len(places), frequent))


def test_windows_that_cannot_hold_a_passage_are_not_cut_out():
    assert {row[1] for row in chance_runs(False)} == {50}
    # what lies between may be equal too if other documents hold its keys
    everywhere = np.append(np.arange(40, 75), 90)
    d, a, frequent = np.full(36, 100), np.append(np.zeros(35, np.int64), 60), np.append(np.ones(35, dtype=bool), False)
    row = (100, 60, 26, 159, 26, 159, False, None)
    assert op1._may_align([row], d, a, everywhere, everywhere + op1.K, frequent) == [row]
    assert op1._may_align([row], d, a, everywhere, everywhere + op1.K, ~frequent) == []


def test_words_of_windows_in_intervals():
    rng = np.random.default_rng(3)
    key, lo = rng.integers(0, 4, 60), rng.integers(0, 300, 60)
    hi, of, start = lo + rng.integers(1, 20, 60), rng.integers(0, 5, 40), rng.integers(0, 300, 40)
    end = start + rng.integers(1, 80, 40)
    places = [{x for k, u, v in zip(key, lo, hi, strict=True) if k == o for x in range(u, v)} for o in of]
    expected = [len(p & set(range(u, v))) for p, u, v in zip(places, start, end, strict=True)]
    assert op1._words_in(key, lo, hi, of, start, end).tolist() == expected
    none = np.zeros(0, np.int64)
    assert op1._words_in(none, none, none, of, start, end).tolist() == [0] * 40


def test_slices_keep_equal_values_together(monkeypatch):
    monkeypatch.setattr(op1, "SORTED", 50)
    rng = np.random.default_rng(4)
    parts = [[np.sort(rng.integers(0, 40, n)), rng.integers(0, 9, n)] for n in (0, 70, 200, 1)]
    found = list(op1._slices(parts))
    assert len(found) > 3
    assert sum(len(x[0]) for x in found) == 271
    assert all(p[0].max() < q[0].min() for p, q in zip(found, found[1:], strict=False))
    both = np.concatenate([np.stack(x) for x in found], axis=1)
    assert sorted(map(tuple, both.T.tolist())) == sorted((int(k), int(v)) for x in parts for k, v in zip(*x, strict=True))


def test_a_bucket_is_tied_in_little_memory():
    """600,000 keys of one bucket, each held twice: what is held besides the bucket itself stays under 64 bytes a key."""
    import tracemalloc

    import pyarrow as pa

    n = 600_000
    key = np.sort(np.random.default_rng(1).integers(1 << 40, 1 << 62, n // 2).astype(np.uint64))
    blob = lambda doc: op1._squeezed(op1._packed_keys(key) + op1._planes(np.full(n // 2, doc, np.int64), np.arange(n // 2, dtype=np.uint32), np.zeros(n // 2, np.uint32)))
    batch = op1._packed_rows(np.zeros(2, np.int64), None, 2, [blob(1), blob(2)])
    tracemalloc.start()
    try:
        made = sum(len(d) for b in op1._bucket_matches(1)(iter([batch])) for d, *_ in op1._matches(b.column("blob")))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert made == n // 2 and peak < n * (24 + 64), peak


def test_slices_of_keys_windows_and_open_runs_change_nothing(spark, monkeypatch):
    """Keys in four slices, windows aligned in parts, runs looked up with a map each for slices of them."""
    rng = random.Random(21)
    around = lambda w: " ".join(prose(rng, 40, 10**6) + w + prose(rng, 40, 10**6))
    passage = prose(rng, 60, 10**6)
    parts = [passage[at : at + 36] for at in range(25)]
    rows = [(10000 + 100 * k + i, around(part)) for i, part in enumerate(parts) for k in range(op1.HOLDERS + 1)]
    docs = frame(spark, [*shared(), *rows, (15000, around(passage)), (15001, around(passage))])
    want = sorted(map(tuple, op1.shared_passages(docs).collect()))
    made = {"_seed_rows": [], "_align_part": [], "_holders": []}
    for name, calls in made.items():
        monkeypatch.setattr(op1, name, lambda *a, f=getattr(op1, name), calls=calls: (calls.append(a), f(*a))[1])
    monkeypatch.setattr(op1, "SLICE_BYTES", 1000)
    monkeypatch.setattr(op1, "WINDOWS_SHARE", 0.1)
    monkeypatch.setattr(op1, "REST_BITS", (15, 15))
    monkeypatch.setattr(op1, "KEY_BITS", 3000)
    assert sorted(map(tuple, op1.shared_passages(docs).collect())) == want and any(r[0] == 15001 and r[3] == 15000 for r in want)
    assert len(made["_seed_rows"]) == op1.PASSES and len(made["_align_part"]) > 2 and len(made["_holders"]) > 1


def test_slices_hold_all_keys_once():
    import pyarrow as pa

    rng = random.Random(3)
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array([" ".join(prose(rng, 200, 10**6)) for _ in range(50)])], ["doc_id", "text"])

    def held(*slices):
        rows = [r for b in op1._seed_rows(8, 8, *slices)(iter([batch])) for r in b.to_pylist() if r["to"] is None]
        return sorted((r["bucket"] // 8, int(k), int(d), int(p)) for r in rows for k, d, p, _ in zip(*op1._unpacked(op1._whole(r["blob"])), strict=True))

    parts = [held(i, 4) for i in range(4)]
    assert sorted(sum(parts, [])) == held()
    assert all(max(k for level, k, *_ in p if level == 0) < min(k for level, k, *_ in q if level == 0) for p, q in zip(parts, parts[1:], strict=False))
    assert [any(level for level, *_ in p) for p in parts] == [False, False, False, True]


def test_runs_that_few_look_for_are_few_rows(spark):
    """Keys at a sixteenth of the map's bits: all of them are found, and of a hundred others one or two."""
    import pyarrow as pa

    rng = random.Random(5)
    texts = [" ".join(prose(rng, 20_049, 10**6)) for _ in range(2)]
    keys = [op1.keys_of(*op1.words([t.encode()]), op1.MIN_WORDS, 1)[0] for t in texts]
    bits = op1._key_map(spark.createDataFrame([(int(k),) for k in keys[0].view(np.int64)[:2048]], "key long"), 15)
    found = [{r["key"] for b in op1._holders(bits, 15)(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([t])], ["doc_id", "text"])])) for r in b.to_pylist()} for t in texts]
    assert set(keys[0].view(np.int64)[:2048].tolist()) <= found[0] and len(found[1]) < 0.03 * len(keys[1])


@pytest.mark.parametrize(("spans", "ids"), [(100_000, 3_000_000), (3, 3_000_000), (3, 3)])
def test_spans_of_any_number_are_joined(spark, monkeypatch, spans, ids):
    monkeypatch.setattr(op1, "SPANS_ROWS", spans)
    monkeypatch.setattr(op1, "IDS_ROWS", ids)
    docs = spark.createDataFrame([(i if i < 30 else None, f"a{i} b c d") for i in range(33)], "doc_id long, text string")
    found = spark.createDataFrame([(i, 1, 3) for i in range(0, 30, 3)], "doc_id long, start_word long, end_word long")
    left = op1.remove_passages(docs, found)
    assert sorted(left.collect(), key=lambda r: int(r.text.split()[0][1:])) == [(i if i < 30 else None, f"a{i} d" if i < 30 and i % 3 == 0 else f"a{i} b c d") for i in range(33)]
    assert "SortMergeJoin" not in left._jdf.queryExecution().executedPlan().toString()


def test_shuffle_files_go_when_a_table_is_written(spark):
    import time

    from docloom.llm.scratch import Scratch

    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before, rows = files(), spark.range(100_000).repartition(7, "id").groupBy(F.col("id") % 10).count()
    kept = Scratch(spark).keep(rows)
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before
    assert kept.count() == 10 and rows.count() == 10
