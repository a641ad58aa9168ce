"""Names by compatibility forms: the column against the standard library, and both forms of matching over the same cases."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from docloom.functions.text import _COMPOSED, name_key, name_tokens
from docloom.operators.names import match_names
from docloom.plans.specs import match_name


def plain(text):
    return unicodedata.normalize("NFKC", text).lower()


def key(text):
    return re.sub("[^a-z0-9]", "", plain(text))


def tokens(text):
    return sorted({w for w in re.split("[^a-z0-9]+", plain(text)) if w and w not in ("of", "the", "and", "for", "to")})


def assert_equal(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", name_key(F.col("t")).alias("k"), name_tokens(F.col("t")).alias("w")).collect()
    wrong = [(r.t, [hex(ord(c)) for c in r.t], r.k, key(r.t), r.w, tokens(r.t)) for r in rows if (r.k, r.w) != (key(r.t), tokens(r.t))]
    assert not wrong, (len(wrong), wrong[:5])


def test_every_code_point(spark):
    assert_equal(spark, [f"a{chr(c)}b" for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000])


def test_letters_with_marks(spark):
    rng = random.Random(1)
    marks = [chr(c) for a, b in ((0x300, 0x370), (0x1AB0, 0x1AC0), (0x1DC0, 0x1E00), (0x20D0, 0x20F1), (0xFE20, 0xFE30)) for c in range(a, b) if unicodedata.combining(chr(c))]
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0129 éİŉⅣ㎏𝐀ﬁ²ªK"
    pairs = [a + m for a in letters for m in marks[:112]]
    runs = ["".join(x for _ in range(4) for x in (rng.choice(letters), *rng.choices(marks[:90] if rng.random() < 0.8 else marks, k=rng.randint(0, 3)))) for _ in range(4000)]
    assert_equal(spark, pairs + runs)
    assert len(_COMPOSED) < 60_000


@pytest.mark.parametrize(("text", "want"), [("Form Ⅳ", "formiv"), ("m²", "m2"), ("5 ㎏", "5kg"), ("𝐀lpha", "alpha"), ("ﬁnance oﬃce", "financeoffice"), ("Ｈ＆Ｍ", "hm"), ("½", "12"), ("№ 7", "no7"), ("café", "caf"), ("①②", "12")])
def test_known_forms(spark, text, want):
    assert key(text) == want and spark.createDataFrame([(text,)], "t string").select(name_key(F.col("t"))).first()[0] == want


def test_driver_and_column_forms_of_matching_agree(spark):
    names = ["Acme Ltd", "ACME  ltd.", "Bank of the North", "North Bank", "Form Ⅳ", "Form 4", "m²", "Ｈ＆Ｍ", "City of London Council", "London City", "Tax Office", "Office of Tax", "Tax", "", "ﬁnance"]
    entries = list(enumerate(names))
    guesses = [*names, "acme ltd", "bank north", "form iv", "m2", "h&m", "hm", "council london city", "tax-office", "Finance", "zzz", "office", "north", "the of"]
    got = {r.guess: r for r in match_names(spark.createDataFrame([(g,) for g in guesses], "guess string"), spark.createDataFrame(entries, "id long, name string")).collect()}
    for g in set(guesses):
        want = match_name(g, entries)
        assert (got[g].id, got[g].method) == (want.id, want.method), (g, got[g], want)


def test_casefold_of_every_code_point(spark):
    from docloom.functions.identity import attempt_key
    from docloom.functions.text import casefold

    texts = [f"A{chr(c)}b" for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000] + ["ΜΆΪΟΣ", "STRASSE ẞß", "ŉ ǰ ΐ ﬁ", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", casefold(F.col("t")).alias("f")).collect()
    wrong = [(r.t, r.f, r.t.casefold()) for r in rows if r.f != r.t.casefold() and unicodedata.category(r.t[1:2] or "x") != "Cn"]
    assert not wrong, (len(wrong), wrong[:5])
    assert spark.createDataFrame([(None, "STRAẞE")], "ip string, u string").select(attempt_key(F.col("ip"), F.col("u")).alias("k")).first().k.asDict() == {"client_ip": "", "username": "strasse"}
