"""Vectorised words, shingles and token pieces against plain Python."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import tokens, words

TEXTS = [b"", b" ", b"one", b" Two  words\n", b"a b c d e f", "été Été \x0b\x0cß".encode(), b"\t\r\nx\ty"]


def split(t):
    return t.lower().split()  # bytes: ASCII white space and ASCII case only


def test_words_are_those_of_bytes():
    h, o = words.words(TEXTS)
    seen = {}
    for t, a, b in zip(TEXTS, o, o[1:], strict=False):
        assert b - a == len(split(t))
        for w, x in zip(split(t), h[a:b].tolist(), strict=True):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


@given(st.lists(st.text(alphabet="aB é\n\t.'", max_size=40), max_size=6))
@settings(max_examples=60, deadline=None)
def test_shingles_are_sets_of_word_runs(texts):
    raw = [t.encode() for t in texts]
    for k in (1, 3, 5):
        s, o = words.shingles(*words.words(raw), k)
        for t, a, b in zip(raw, o, o[1:], strict=False):
            w = split(t)
            want = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)] if w else []
            assert len(want) == b - a
            assert len(set(want)) == len(set(s[a:b].tolist()))


def test_long_texts_go_in_pieces(monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choice(["ab ", "c", "  ", "\n", "été ", "x" * 30]) for _ in range(3000)).encode()
    whole = words.words([text])[0]
    spans = words.word_spans(text)
    monkeypatch.setattr(words, "PASS_BYTES", 256)
    assert b"".join(words.pieces(text, 256)) == text
    assert np.array_equal(words.words([text, b"x y"])[0][:-2], whole)
    assert [len(p) for p in words.pieces(text, 256)] != [len(text)]
    assert [text[a:b] for a, b in zip(*spans, strict=True)] == text.split()


ALPHABET = ["a", "B", "é", "1", "²", " ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "’", ".", "--", "中", "　", "<|endoftext|>", "😀", "'d", "'S"]


@given(st.lists(st.lists(st.sampled_from(ALPHABET), max_size=12).map("".join), max_size=5))
@settings(max_examples=150, deadline=None)
def test_ids_are_those_of_the_tokenizer(texts):
    enc = tokens.encoder(tokens.default_path())
    want = [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in enc.encode(texts)] == want


def test_keys_of_near_words_do_not_pass_through_the_driver(spark):
    from docloom.llm.op13_spelling_variants import near_words

    near = near_words(spark.createDataFrame([("vogels", 9), ("vogel", 3)], "word string, n long"))
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()
    assert {(r.word, r.n_near, r.best.near) for r in near.collect()} == {("vogels", 1, "vogel"), ("vogel", 1, "vogels")}
