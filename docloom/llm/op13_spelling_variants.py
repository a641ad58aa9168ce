"""Spelling variants: words that differ by one edit, grouped by a symmetric-delete join.

Runs of Latin letters (A-Z, a-z, U+00C0 to U+00FF) are lower-cased in A-Z and counted inside tasks, flushed at
TALLY entries, and summed by Spark; words are those of at least MIN_LENGTH code points and MIN_COUNT
occurrences. Every word emits a 64-bit key of itself and one of each distinct string that a single
deletion leaves, from prefix sums, so that a word costs its length and no string is built. Words that
share a key are joined and their distance of exactly one is verified on the words. How many can share a
key is bounded by the alphabet and the word's length, not by the input, and each near pair shares exactly
one: a longer word's deletion is the shorter word itself, and two words of equal length that differ in one
place leave the same string without that place only.

A word's form is its near word of most occurrences, the smallest in code-point order among equals, if
it has at least twice the word's own; the near pairs are aggregated before their shuffle. Roots follow forms to
the last by joining the table of links with itself, which doubles the step each round; counts at least
double along a link, so there are no cycles and a few rounds end it.

The query's words come with made slips: in one of SLIP (document, run) combinations, by a checksum, one
letter is deleted first (`slips`); without it texts are counted as they are.

Defined results: null texts have no words; a null doc_id enters the checksum as empty text; a word without near
words has n_near 0, null form and form_n, and is its own root; repeated rows count each time; texts and
runs of any length are read whole; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.runs import trimmed
from docloom.llm.scratch import Scratch
from docloom.llm.words import U, mix, powers

MIN_LENGTH = 5
MIN_COUNT = 3
SLIP = 97
#: Entries of a task's tally before it is sent on.
TALLY = 300_000
#: Letters whose keys are made in one numpy pass.
PASS = 1 << 18
PIECE = 1 << 22

#: By Latin-1 byte: lower-cased A-Z, letters as they are, anything else a space.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def _runs(text: str) -> Iterator[list[bytes]]:
    """Lower-cased runs of letters, one byte a code point, in lists of bounded size."""
    letters = text.encode("latin-1", "replace").translate(_LETTERS)
    at = 0
    while at < len(letters):
        cut = letters.find(b" ", at + PIECE)
        cut = len(letters) if cut < 0 else cut
        yield letters[at:cut].split()
        at = cut


def slipped(word: bytes, start: int) -> bytes:
    """The word, or without one letter if its checksum says so; start is the checksum of what stands before it."""
    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
    if h % SLIP:
        return word
    i = h % len(word)
    return word[:i] + word[i + 1 :]


def _emitted(tally: Counter) -> Iterator[pa.RecordBatch]:
    words = pa.array([w.decode("latin-1") for w in tally], pa.string())
    yield from pa.Table.from_arrays([words, pa.array(list(tally.values()), pa.int64())], names=["word", "n"]).to_batches(max_chunksize=20_000)


def _tally(slips: bool):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter = Counter()
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                own: Counter = Counter()
                for runs in _runs(text.as_py() or ""):
                    own.update(runs)
                start = zlib.crc32(f"{doc_id}:".encode())
                for word, n in own.items():
                    if len(word) >= MIN_LENGTH:
                        word = slipped(word, start) if slips else word
                        if len(word) >= MIN_LENGTH:
                            tally[word] += n
                if len(tally) >= TALLY:
                    yield from _emitted(tally)
                    tally.clear()
        yield from _emitted(tally)

    return run


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slips: bool = False) -> DataFrame:
    """word, n: words of MIN_LENGTH letters and MIN_COUNT occurrences or more."""
    plain = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return plain.mapInArrow(trimmed(_tally(slips)), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each word and of its distinct single deletions, and the index of the word of each key."""
    length = np.array([len(w) for w in words], dtype=np.int64)
    first = np.append(0, np.cumsum(length))
    letters = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
    p, inverse = powers(len(letters) + 2)
    values = mix(letters.astype(U) + U(1))
    sums = np.zeros(len(letters) + 1, dtype=U)
    np.cumsum(values * p[: len(letters)], out=sums[1:])
    whole = (sums[first[1:]] - sums[first[:-1]]) * inverse[first[:-1]]
    word = np.repeat(np.arange(len(words)), length)
    place = np.arange(len(letters))
    left = sums[place] - sums[first[:-1]][word]
    right = (sums[first[1:]][word] - sums[place + 1]) * inverse[1]
    cut = (left + right) * inverse[first[:-1]][word]
    last = np.ones(len(letters), dtype=bool)  # of a run of equal letters
    last[:-1] = (letters[1:] != letters[:-1]) | (word[1:] != word[:-1])
    own, without = mix(whole + length.astype(U)), mix(cut + (length[word] - 1).astype(U))[last]
    return np.concatenate([own, without]), np.concatenate([np.arange(len(words)), word[last]])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words, at = b.column("word").to_pylist(), 0
        while at < len(words):
            end, size = at, 0
            while end < len(words) and (size < PASS or end == at):
                size += len(words[end])
                end += 1
            keys, index = deletion_keys(words[at:end])
            taken = b.slice(at, end - at)
            for i in range(0, len(keys), 10_000):
                rows = taken.take(pa.array(index[i : i + 10_000]))
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 10_000].view(np.int64)), rows.column("word"), rows.column("n")], names=["key", "word", "n"])
            at = end


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near and best, the struct (-n, word) of its most frequent near word, for words that have near words."""
    keyed = words.select("word", "n").mapInArrow(trimmed(_keyed), "key long, word string, n long")
    a, b = keyed.select("key", F.col("word").alias("a"), F.col("n").alias("na")), keyed.select("key", F.col("word").alias("b"), F.col("n").alias("nb"))
    # a broadcast, which Spark picks by compressed sizes, would gather a side in the driver
    pairs = a.join(b.hint("merge"), "key").where((F.col("a") < F.col("b")) & (F.levenshtein("a", "b", 1) == 1))
    both = pairs.select(F.inline(F.array(F.struct(F.col("a").alias("word"), (-F.col("nb")).alias("minus"), F.col("b").alias("near")), F.struct(F.col("b").alias("word"), (-F.col("na")).alias("minus"), F.col("a").alias("near")))))
    return both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct("minus", "near")).alias("best"))


def follow(links: DataFrame, scratch: Scratch, rounds: int = 64) -> DataFrame:
    """word and root of links (word, form) without cycles; every round doubles the way that is followed."""
    links = scratch.keep(links.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    for _ in range(rounds):
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = scratch.keep(links.join(on.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        scratch.drop(links)
        links = after
        if links.where("moved").isEmpty():
            return links.select("word", "root")
    raise RuntimeError("roots didn't settle")


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slips: bool = False) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    scratch = Scratch(docs.sparkSession)
    words = scratch.keep(word_counts(docs, doc_id, text, slips))
    near = words.join(near_words(words).hint("merge"), "word", "left")
    fits = -F.col("best.minus") >= 2 * F.col("n")
    formed = scratch.keep(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.minus")).alias("form_n")))
    roots = follow(formed.where("form IS NOT NULL"), scratch)
    result = scratch.keep(formed.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
    scratch.only(result)
    return result


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"), slips=True)


#: DuckDB has no checksum function: its table and the fold over bytes are written out.
SQL = r"""
WITH RECURSIVE crc AS (
  SELECT i AS k, i::BIGINT AS c, 0 AS bit FROM range(256) r(i)
  UNION ALL SELECT k, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, bit + 1 FROM crc WHERE bit < 8),
tab AS (SELECT list(c ORDER BY k) AS t FROM crc WHERE bit = 8),
d AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
low AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM d WHERE length(run) >= 5 GROUP BY ALL),
hex AS (SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM low),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM hex, tab),
word AS (SELECT CASE WHEN h % 97 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM word WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
keys AS (SELECT word, n, word AS key FROM w UNION ALL SELECT DISTINCT word, n, word[1:i] || word[i + 2:] FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM w)),
place AS (SELECT word, n, i, word[1:i] || chr(1) || word[i + 2:] AS key FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM w)),
pairs AS (
  SELECT DISTINCT a.word, b.word AS near, b.n AS m FROM keys a JOIN keys b ON a.key = b.key AND a.word <> b.word AND length(a.word) <> length(b.word) AND (a.key = a.word OR b.key = b.word)
  UNION SELECT a.word, b.word, b.n FROM place a JOIN place b ON a.key = b.key AND a.word <> b.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY m DESC, near) AS near, max(m) AS m FROM pairs GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 2 * w.n THEN near END AS form, CASE WHEN m >= 2 * w.n THEN m END::BIGINT AS form_n FROM w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS at, form AS next FROM f UNION ALL SELECT walk.word, walk.next, f.form FROM walk JOIN f ON f.word = walk.next)
SELECT f.word, f.form, walk.at AS root, f.n, f.n_near, f.form_n FROM f JOIN walk ON walk.word = f.word AND walk.next IS NULL
"""
