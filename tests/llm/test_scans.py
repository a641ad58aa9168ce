"""License scans, source audit and spelling variants against plain computations; test_pipeline.py holds the queries against their SQL."""

import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from docloom.llm import op11_license_scan as op11
from docloom.llm import op12_source_audit as op12
from docloom.llm import op13_spelling_variants as op13
from docloom.llm.license_rules import BASE, CONFIDENCE, Rule, rules, spaced


# --- op11


def plain_scan(text, found_by):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    norm, found = "".join(f" {w} " for w in words), []
    for r in found_by:
        for m in re.finditer(r.regex, norm):
            at = norm[: m.start()].count(" ") // 2
            found.append((at, at + m.group().count(" ") // 2, r))
    stays = [(s, e, r) for s, e, r in found if not any((s2, e2, q.no) != (s, e, r.no) and s2 <= s and e2 >= e and (q.tier > r.tier or q.tier == r.tier and (e2 - s2 > e - s or q.no < r.no)) for s2, e2, q in found)]
    base = [(s, r) for s, _, r in found if r.base]
    return (
        len(words), len(base), min((s for s, _ in base), default=None), max((s for s, _ in base), default=None), ",".join(sorted({r.label for _, r in base})),
        ",".join(sorted({r.label for _, r in base} | {r.label for _, _, r in stays})), max((CONFIDENCE[r.tier] for _, _, r in stays), default=0.0),
    )


TEXTS = [
    None, "", "   \n", "Nothing to see here, in general public.", "CC BY", "cc-by cc by, CC/BY\nall rights reserved", "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under CC BY-NC 4.0.", "Released under the MIT license.", "Licensed under the Apache License, Version 2.0.", "Copyright (c) 2019 Jane Roe and others. All rights reserved.",
    "Redistribution and use in source and binary forms, with or without modification, are permitted", "SPDX-License-Identifier: BSD-3-Clause", "accord by cc bye xcc by", "general publiK license all rights reserved",
    "creative commons attribution-noncommercial-sharealike 3.0 unported", "public domain é all rights reservedé tous droits réservés", "word " * 200_000 + "all rights reserved " + "word " * 200_000 + "cc by", "all rights reserved " * 3000,
    "licensed under the Mozilla Public License v. 2.0; redistributed under the GNU Lesser General Public License version 2.1 or the Artistic License 2.0",
]


def test_scan_is_plain_scan(spark):
    docs = spark.createDataFrame([Row(doc_id=i, text=t, row="x", found=1, n_words="y") for i, t in enumerate(TEXTS)] + [Row(doc_id=4, text="CC BY", row="x", found=1, n_words="y")], "doc_id long, text string, row string, found int, n_words string")
    found_by = rules()
    got = Counter(tuple(r) for r in op11.scan_licenses(docs.repartition(3)).collect())
    small = [r for r in found_by if set(r.needs) & set("all rights reserved cc by".split())]
    want = Counter((i, *plain_scan(t, found_by if i < 17 or i == 19 else small)) for i, t in enumerate(TEXTS))
    want[(4, *plain_scan("CC BY", found_by))] += 1
    assert got == want
    assert op11.scan_licenses(docs.limit(0)).collect() == []


def expansions(parsed):
    """Texts that a parsed regex matches: all alternatives, both ends of classes, options taken and left."""
    from itertools import product

    out = [""]
    for op, av in parsed:
        op = str(op)
        if op == "LITERAL":
            some = [chr(av)]
        elif op == "NOT_LITERAL":
            some = ["q"]
        elif op == "IN":
            some = ["q"] if str(av[0][0]) == "NEGATE" else [chr(v) if str(o) == "LITERAL" else chr(v[0]) for o, v in av]
        elif op == "BRANCH":
            some = [x for branch in av[1] for x in expansions(branch)]
        elif op == "SUBPATTERN":
            some = expansions(av[3])
        else:
            assert op == "MAX_REPEAT", op
            least, most, inner = av
            some = ["".join(x) for k in {least, min(most, least + 1)} for x in product(expansions(inner), repeat=k)]
        out = [a + b for a in out for b in some]
    return out


def test_words_that_must_be_there_are_in_every_match():
    """The prefilter loses nothing."""
    for r in rules():
        some = expansions(re._parser.parse(r.regex))
        assert some and all(re.fullmatch(r.regex, x) for x in some)
        for x in some:
            assert set(r.needs) <= set(x.split()), (r, x)


def test_suppression(spark):
    def rule(no, label, tier, regex, base=False):
        return Rule(no, label, tier, tuple(regex.split(" ")), spaced(regex), base)

    own = [rule(0, "short", 1, "b c", True), rule(1, "long", 2, "a b c"), rule(2, "same", 2, "a b c"), rule(3, "high", 3, "b"), rule(4, "partial", 1, "c d")]
    docs = spark.createDataFrame([(1, "a b c d"), (2, "b c d"), (3, "b")], "doc_id long, text string")
    got = {r.doc_id: (r.base_labels, r.labels, r.score) for r in op11.scan_licenses(docs, with_rules=own).collect()}
    assert got == {1: ("short", "high,long,partial,short", 0.8), 2: ("short", "high,partial,short", 0.8), 3: ("", "high", 0.8)}


def test_rule_table():
    found = rules()
    assert len(found) > 300 and [r.no for r in found] == list(range(len(found)))
    assert {r.label for r in found if r.base} == set(BASE.values()) and not {r.label for r in found if not r.base} & set(BASE.values())


# --- op12


def plain_audit(rows, min_docs, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        own = term.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        counts[lang, source].update(own)
        docs[lang].update(set(own))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]

        def shares(count, kept=kept):
            whole = sum(count[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 5) // whole for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            out += [(lang, s, "pair", o.decode(), -v, i + 1) for i, (v, o) in enumerate(pairs)]
            own = sorted((q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t])
            out += [(lang, s, "term", t.decode(), -v, i + 1) for i, (v, t) in enumerate(own[:top])]
    return Counter(out)


def audit_rows():
    rows = [(f"Alpha beta{'é' * (i % 3)} gamma x{i % 5}y delta-{'epsilon' if i % 2 else 'zeta'} ALPHA", ("en", "fr", None)[i % 3], f"s{i % 11}" if i % 7 else None) for i in range(400)]
    rows += [(None, "en", "s1"), ("", "xx", "only"), (None, "xx", "other"), ("rare words never kept", "yy", "a"), ("word " * 300_000 + "end", "en", "long")]
    return rows + [("alpha alpha beta", "en", "hot")] * 200


@pytest.mark.parametrize("block, slice_", [(4, 1 << 15), (2, 3), (1, 2)])
def test_audit_is_plain_audit(spark, monkeypatch, block, slice_):
    monkeypatch.setattr(op12, "BLOCK", block)
    monkeypatch.setattr(op12, "SLICE", slice_)
    docs = spark.createDataFrame(audit_rows(), "text string, lang string, source string").withColumns({"term": F.lit("t"), "n": F.lit(1), "whole": F.lit(2)})
    got = op12.audit_sources(docs.repartition(5), min_docs=20, top=3)
    assert Counter(map(tuple, got.collect())) == plain_audit(audit_rows(), 20, 3)


def test_audit_without_rows_or_terms(spark):
    docs = spark.createDataFrame([], "text string, lang string, source string")
    assert op12.audit_sources(docs).collect() == []
    one = spark.createDataFrame([(None, None, "b"), ("", None, "a"), ("x", "l", "alone")], "text string, lang string, source string")
    assert Counter(map(tuple, op12.audit_sources(one).collect())) == Counter([("", "a", "pair", "b", 0, 1), ("", "b", "pair", "a", 0, 1)])


def test_every_pair_of_blocks_meets_once(spark):
    for n in range(1, 12):
        met = Counter()
        blocks = spark.range(n).select(F.col("id").cast("int").alias("b"), F.lit(n).alias("n"))
        for r in range(n + n % 2 + 2):
            for b, o in blocks.select("b", op12.opponent(F.col("b"), F.col("n"), r)).collect():
                if o < n:
                    assert b != o
                    met[min(b, o), max(b, o)] += 1
        assert met == Counter({(i, j): 2 for i in range(n) for j in range(i + 1, n)})


def test_shares_are_exact():
    import numpy as np

    for whole in (7, 10**9 + 7, 2**53 - 3, 2**61 + 11):
        counts = [0, 1, whole // 3, whole - 1, whole]
        assert op12.share(np.array(counts), whole).tolist() == [1 + 1_000_000_000 * c // whole for c in counts]


# --- op13


def plain_variants(rows, slips):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if slips and h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, out = {}, {}
    for w, n in counts.items():
        around = [x for x in counts if near(w, x)]
        best = min(around, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
        out[w] = (len(around), counts[best] if form[w] else None)
    roots = {}
    for w in counts:
        at = w
        while form[at]:
            at = form[at]
        roots[w] = at
    return {(w, form[w], roots[w], n, *out[w]) for w, n in counts.items()}


def variant_rows():
    base = ["letter", "lettre", "letters", "better", "bettter", "Ünïcode", "ünicode", "aaaaa", "aaaaaa", "aaaaaaa", "abcde", "abcdef", "xabcde", "abxde", "façade", "facade", "niño÷", "wordy", "wordyy"]
    rows = [(i, " ".join(base[(i * k) % len(base)] for k in range(1, 12))) for i in range(300)]
    rows += [(None, "letter lettar letter-lettar lettar"), (5, None), (6, ""), (7, "б letter日letter"), (8, "a" * 3000 + " " + "a" * 2999 + "b"), (9, "a" * 3000 + " " + "a" * 2999 + "b"), (10, "a" * 3000 + " " + "a" * 2999 + "b")]
    return rows + [(11, "hotword " * 600_000), (12, "hotward " * 5), (13, "hotwardd " * 3)]


@pytest.mark.parametrize("slips", [False, True])
def test_variants_are_plain_variants(spark, slips):
    docs = spark.createDataFrame(variant_rows(), "doc_id long, text string").withColumns({"word": F.lit("w"), "n": F.lit(1), "key": F.lit(2)})
    got = {tuple(r) for r in op13.spelling_variants(docs.repartition(4), slips=slips).collect()}
    assert got == plain_variants(variant_rows(), slips)


def test_no_variants_of_nothing(spark):
    assert op13.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert op13.spelling_variants(spark.createDataFrame([(1, "few words")], "doc_id long, text string")).collect() == []


def test_long_chains_of_forms(spark):
    from docloom.llm.scratch import Scratch

    links = spark.createDataFrame([(str(i), str(i + 1)) for i in range(100)], "word string, form string")
    assert {r.word: r.root for r in op13.follow(links, Scratch(spark)).collect()} == {str(i): "100" for i in range(100)}


def test_small_tallies_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame(variant_rows()[:300], "doc_id long, text string").repartition(2)
    want = {tuple(r) for r in op13.spelling_variants(docs).collect()}
    monkeypatch.setattr(op13, "TALLY", 2)
    monkeypatch.setattr(op13, "PIECE", 7)
    assert {tuple(r) for r in op13.spelling_variants(docs).collect()} == want
