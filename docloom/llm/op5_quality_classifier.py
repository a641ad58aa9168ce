"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from the text alone, by numpy over a batch's bytes; labels, language, source and
doc_id never enter a score. Training takes the labelled rows with crc32(doc_id) mod 5 <> 0, at most
TRAIN_ROWS of them by least hash (the documented bound), and runs on the driver over binned
statistics. The model is a few flat arrays, which a numpy traversal applies to a batch at a time,
a level of all trees' nodes together.

Null and empty texts have statistics of zero and are scored; texts of any length are measured whole,
in pieces; documents with equal statistics get equal scores; repeated rows get equal scores;
labelled rows without a document, documents without a label and null labels don't train, and of
several labels of a document all count; with no label of either kind the score is 1; an empty table
gives no rows; extra columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.runs import trimmed
from docloom.llm.scratch import Scratch, broadcast_if_small
from docloom.llm.words import PASS_BYTES, SPACE, column_bytes, groups, pieces, run_hashes, shingles
from docloom.llm.words import _TABLE_LOWER as BYTE_VALUES

TRAIN_ROWS = 20_000
THRESHOLD = 0.3
BINS, TREES, DEPTH, RATE, LEAST, RIDGE = 64, 60, 4, 0.2, 20, 1.0

STATISTICS = (
    "chars", "words", "lines", "chars_per_word", "words_per_line", "upper_share", "digit_share", "other_letter_share", "symbol_share", "bar_share", "exclaim_share",
    "comma_share", "stop_share", "distinct_words", "distinct_triples", "repeats_next", "repeated_lines", "upper_words", "ends_in_symbol", "longest_word", "capital_after_stop", "short_words",
)

_UPPER, _DIGIT, _LOWER_LETTER, _CONT, _HIGH, _SYMBOL, _STOP = (np.zeros(256, dtype=bool) for _ in range(7))
_STOP[[46, 63]] = True
_UPPER[65:91] = True
_DIGIT[48:58] = True
_LOWER_LETTER[97:123] = True
_CONT[128:192] = True
_HIGH[128:] = True
_SYMBOL[[ord(c) for c in "#*$%&<>=@^~{}[]\\_/+"]] = True


#: What a pass counts, by text. Distinct things travel as hashes beside them.
_COUNTS = ("chars", "solid", "words", "upper", "digit", "high", "symbol", "bar", "exclaim", "comma", "stop", "same", "upper_words", "ends_in_symbol", "capital", "short", "lines", "triples")


def _measured(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Of a group of texts: counts by _COUNTS, longest words, (hashes, offsets) of words, of triples of words and of lines that hold anything, and each word's marks: ends in a stop, starts with a capital."""
    m = len(texts)
    buf = b"\n".join(texts) + b"\n"
    a = np.frombuffer(buf, dtype=np.uint8)
    begins = np.zeros(m + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begins[1:])

    def per_text(mask: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return np.diff(upto[begins]).astype(np.float64)

    space = SPACE[a]
    edge = np.empty(len(a), dtype=bool)
    edge[0] = not space[0]
    np.not_equal(space[1:], space[:-1], out=edge[1:])
    at = np.flatnonzero(edge)
    starts, ends = at[::2], at[1::2]
    offsets = np.searchsorted(starts, begins).astype(np.int64)
    which = np.repeat(np.arange(m), np.diff(offsets))
    h = run_hashes(BYTE_VALUES[a], starts, ends)

    def per_word(mask: np.ndarray) -> np.ndarray:
        return np.bincount(which[mask], minlength=m).astype(np.float64)

    s, so = shingles(h, offsets, 3)
    newline = np.flatnonzero(a == 10)
    line_lo = np.concatenate([[0], newline[:-1] + 1])
    filled = newline > line_lo
    line_lo, line_hi = line_lo[filled], newline[filled]
    lines = run_hashes(BYTE_VALUES[a], line_lo, line_hi), np.searchsorted(line_lo, begins).astype(np.int64)
    size = ends - starts
    upper_upto = np.concatenate([[0], np.cumsum(_UPPER[a], dtype=np.int64)])
    letters_upto = np.concatenate([[0], np.cumsum(_UPPER[a] | _LOWER_LETTER[a], dtype=np.int64)])
    uppers, letters = upper_upto[ends] - upper_upto[starts], letters_upto[ends] - letters_upto[starts]
    same, capital = np.zeros(len(h), dtype=bool), np.zeros(len(h), dtype=bool)
    neighbours = which[1:] == which[:-1]
    same[1:] = (h[1:] == h[:-1]) & neighbours
    longest = np.zeros(m)
    np.maximum.at(longest, which, size)
    stop = _STOP[a]
    ended, opens = stop[ends - 1], _UPPER[a[starts]]
    capital[1:] = ended[:-1] & opens[1:] & neighbours
    columns = (
        per_text(~_CONT[a]) - 1, per_text(~space & ~_CONT[a]), np.diff(offsets), per_text(_UPPER[a]), per_text(_DIGIT[a]), per_text(_HIGH[a] & ~_CONT[a]), per_text(_SYMBOL[a]), per_text(a == 124), per_text(a == 33), per_text(a == 44), per_text(stop),
        per_word(same), per_word((uppers > 1) & (uppers == letters)), per_word(_SYMBOL[a[ends - 1]] | (a[ends - 1] == 33)), per_word(capital), per_word(size <= 2), np.diff(lines[1]), np.diff(so),
    )
    return np.stack(columns, axis=1).astype(np.float64), longest, [(h, offsets), (s, so), lines], np.stack([ended, opens])


def _distinct(keys: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Distinct keys of each text."""
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((keys, of))
    k, o = keys[order], of[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[new], minlength=len(offsets) - 1).astype(np.float64)


def _rows(counts: np.ndarray, longest: np.ndarray, distinct_words: np.ndarray, distinct_triples: np.ndarray, distinct_lines: np.ndarray) -> np.ndarray:
    c = dict(zip(_COUNTS, counts.T, strict=True))
    words, solid, lines = np.maximum(c["words"], 1), np.maximum(c["solid"], 1), np.maximum(c["lines"], 1)
    columns = (
        np.log1p(np.maximum(c["chars"], 0)), np.log1p(c["words"]), np.log1p(lines), solid / words, c["words"] / lines, c["upper"] / solid, c["digit"] / solid, c["high"] / solid, c["symbol"] / solid, c["bar"] / words, c["exclaim"] / words,
        c["comma"] / words, c["stop"] / words, distinct_words / words, distinct_triples / np.maximum(c["triples"], 1), c["same"] / words, 1 - distinct_lines / lines, c["upper_words"] / words, c["ends_in_symbol"] / words, longest, c["capital"] / words, c["short"] / words,
    )
    return np.stack(columns, axis=1)


def _long_statistics(text: bytes) -> np.ndarray:
    """The statistics of one text, measured piece by piece; what lies between pieces is mended after."""
    counts, longest = np.zeros(len(_COUNTS)), 0.0
    hashes: list[np.ndarray] = []
    words = marks = None
    for piece in pieces(text):
        c, most, ((h, _), _, _), m = _measured([piece])
        longest = max(longest, float(most[0]))
        counts += c[0]
        hashes.append(h)
        if words is not None and len(words) and len(h):
            counts[_COUNTS.index("same")] += h[0] == words[-1]
            counts[_COUNTS.index("capital")] += marks[0, -1] and m[1, 0]
        if len(h):
            words, marks = h, m
    h = np.concatenate(hashes)
    s, so = shingles(h, np.array([0, len(h)]), 3)
    lines = _line_hashes(text)
    counts[_COUNTS.index("lines")], counts[_COUNTS.index("triples")] = len(lines), len(s)
    one = [np.array([float(len(np.unique(x)))]) for x in (h, s, lines)]
    return _rows(counts[None, :], np.array([longest]), *one)


def _line_hashes(text: bytes) -> np.ndarray:
    """Digests of the lines that hold anything, with A-Z lower-cased."""
    return np.fromiter((xxhash.xxh64_intdigest(x.lower()) for x in text.split(b"\n") if x), dtype=np.uint64)


def statistics(texts: Sequence[bytes]) -> np.ndarray:
    """Rows of STATISTICS; whole texts, a group at a time and long ones by themselves."""
    parts = []
    for i, j in groups(texts):
        if j == i + 1 and len(texts[i]) > 2 * PASS_BYTES:
            parts.append(_long_statistics(texts[i]))
            continue
        counts, longest, kinds, _ = _measured(texts[i:j])
        parts.append(_rows(counts, longest, *(_distinct(*x) for x in kinds)))
    return np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))


@dataclass
class Trees:
    """All trees in flat arrays of complete binary trees: node i of a tree has the children 2i + 1 and 2i + 2; a leaf's split never goes right."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    value: np.ndarray  # trees x leaves of the last level
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        out = np.full(len(x), self.base)
        for lo in range(0, len(x), 4096):
            part = x[lo : lo + 4096]
            node = np.zeros((len(part), trees), dtype=np.int64)
            row, tree = np.arange(len(part))[:, None], np.arange(trees)[None, :]
            for _ in range(int(np.log2(inner + 1))):
                node = 2 * node + 1 + (part[row, self.feature[tree, node]] > self.threshold[tree, node])
            out[lo : lo + 4096] += self.value[tree, node - inner].sum(axis=1)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS) -> Trees:
    """Logistic loss; a level of a tree is split from one histogram a feature over all its nodes."""
    n, f = x.shape
    inner = 2**depth - 1
    feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    share = float(y.mean()) if n else 1.0
    if share in (0.0, 1.0):
        return Trees(feature, threshold, value, 40.0 if share else -40.0)
    base = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    raw = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        for d in range(depth):
            width = 2**d
            best = np.full(width, 1e-6)
            pick, at = np.full(width, -1), np.zeros(width, np.int64)
            for j in range(f):
                cell = node * bins + binned[:, j]
                gs, hs, ns = (np.cumsum(np.bincount(cell, w, width * bins).reshape(width, bins), axis=1) for w in (g, h, None))
                gl, hl, nl = gs[:, :-1], hs[:, :-1], ns[:, :-1]
                gt, ht, nt = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
                gain[(nl < LEAST) | (nt - nl < LEAST)] = -1
                k = gain.argmax(axis=1)
                top = gain[np.arange(width), k]
                better = top > best
                best[better], pick[better], at[better] = top[better], j, k[better]
            split = pick >= 0
            first = width - 1
            feature[t, first : first + width][split] = pick[split]
            for q in np.flatnonzero(split):
                threshold[t, first + q] = cuts[pick[q]][at[q]]
            right = split[node] & (binned[np.arange(n), np.maximum(pick[node], 0)] > at[node])
            node = 2 * node + right
        gs, hs = np.bincount(node, g, inner + 1), np.bincount(node, h, inner + 1)
        value[t] = rate * gs / (hs + RIDGE)
        raw += value[t][node]
    return Trees(feature, threshold, value, base)


def fold(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 5


def training_rows(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most `bound` labelled documents outside the held-out fifth, by least hash."""
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    usable = usable.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(bound)
    rows = docs.join(broadcast_if_small(Scratch(docs.sparkSession).keep(chosen)), "doc_id").select("doc_id", "text", "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(column_bytes(b.column(1))).astype(np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2).cast(pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "y", "x"])

    t = rows.mapInArrow(trimmed(run), "doc_id long, y int, x binary").orderBy("doc_id", "y", "x").toArrow()  # bound rows, 200 bytes each
    x = np.frombuffer(b"".join(t.column("x").to_pylist()), dtype=np.float64).reshape(-1, len(STATISTICS))
    return x, t.column("y").to_numpy().astype(np.float64)


def classify(docs: DataFrame, model: Trees, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """The kept columns and score, which stands for any column of that name."""
    names = [c for c in keep if c.lower() != "score"]
    picked = docs.select(*names) if text in names else docs.select(*names, text)
    at = picked.columns.index(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[: len(names)]) + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = model.score(statistics(column_bytes(b.column(at))))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(score, pa.float64())], [*names, "score"])

    return picked.mapInArrow(trimmed(run), schema)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(*training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return classify(docs, model).select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


SQL = None
