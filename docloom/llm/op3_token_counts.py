"""Edit-aware token counts: a segment tree per document over its pre-token pieces.

A leaf holds the text and token count of a run of pieces, a node the sums below it. An edit goes
down by character sums to the leaves that it touches; these and one leaf of context on either side
are split and counted anew, the context to the right growing until the new split meets an old
boundary, and the sums above are updated. The rest of the text isn't read. A leaf holds at most twice LEAF_PIECES
pieces: after an insertion that would overfill it more leaves take its place, and after a deletion that empties many
fewer do, so that a later edit rereads a few leaves wherever it is. Only the sums are built again then.

The split looks at most one character past a piece and never back, so a piece that ends two or more
characters before an edit stays as it is, and from a boundary that both splits share they agree.

The edits of a batch's documents go in rounds, the first of each, then the second, so that the
pieces of a round are counted in one pass.

Null texts are empty: 0 tokens, and inserted text alone counts; texts of any length are counted
whole, 512 kB of text a pass; ties can't arise; repeated rows are counted each; an empty table gives
no rows; other columns of the input aren't read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.runs import trimmed
from docloom.llm.tokens import Encoder, default_path, encoder
from docloom.llm.words import groups

LEAF_PIECES = 32
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


class TokenTree:
    """Token count of a text under edits. leaves: (text, tokens) runs of whole pieces."""

    def __init__(self, leaves: Sequence[tuple[str, int]], count) -> None:
        self.count = count  # pieces -> token counts
        self.read = 0
        self._build([t for t, _ in leaves] or [""], [n for _, n in leaves] or [0])

    def _build(self, texts: list[str], tokens: list[int]) -> None:
        """The sums over leaves; no text is read."""
        self.texts = texts
        self.size = 1 << max(0, len(texts) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        self.chars[self.size : self.size + len(texts)] = map(len, texts)
        self.tokens[self.size : self.size + len(texts)] = tokens
        for k in range(self.size - 1, 0, -1):
            self.chars[k], self.tokens[k] = self.chars[2 * k] + self.chars[2 * k + 1], self.tokens[2 * k] + self.tokens[2 * k + 1]

    def total(self) -> int:
        return self.tokens[1]

    def length(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(self.texts)

    def _leaf(self, at: int) -> tuple[int, int]:
        """The leaf of character `at` and its place there."""
        k = 1
        while k < self.size:
            k *= 2
            if at >= self.chars[k] and self.chars[k + 1]:
                at -= self.chars[k]
                k += 1
        return min(k - self.size, len(self.texts) - 1), at

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        self.texts[leaf] = text
        k = leaf + self.size
        self.chars[k], self.tokens[k] = len(text), tokens
        while k > 1:
            k >>= 1
            self.chars[k], self.tokens[k] = self.chars[2 * k] + self.chars[2 * k + 1], self.tokens[2 * k] + self.tokens[2 * k + 1]

    def edit(self, at: int, delete: int, insert: str) -> None:
        """Replace `delete` characters from `at` on by `insert`."""
        lo, hi, pieces = self.touched(at, delete, insert)
        self.update(lo, hi, pieces, self.count(pieces))

    def touched(self, at: int, delete: int, insert: str) -> tuple[int, int, list[str]]:
        """The leaves that an edit changes, first and last, and their new pieces."""
        at = max(0, min(at, self.length()))
        delete = max(0, min(delete, self.length() - at))
        lo, place = self._leaf(at)
        hi = self._leaf(at + delete)[0] if delete else lo
        context = place
        while lo > 0 and context < 2:  # also a whole leaf before, if the edit is near the leaf's start
            lo -= 1
            context += len(self.texts[lo])
            place += len(self.texts[lo])
        last = len(self.texts) - 1
        held = sum(len(t) for t in self.texts[lo : hi + 1])
        while True:
            while hi < last and held < place + delete + 2:
                hi += 1
                held += len(self.texts[hi])
            old = "".join(self.texts[lo : hi + 1])
            new = old[:place] + insert + old[place + delete :]
            ahead, k = "", hi + 1
            while k <= last and len(ahead) < 2:
                ahead += self.texts[k]
                k += 1
            pieces, upto = [], 0
            for m in _SPLIT.finditer(new + ahead[:2]):
                if upto >= len(new):
                    break
                pieces.append(m[0])
                upto = m.end()
            if hi >= last and not ahead or upto == len(new):
                break
            hi += 1
            held += len(self.texts[hi])
        self.read += len(new)
        return lo, hi, pieces

    def update(self, lo: int, hi: int, pieces: list[str], counts: Sequence[int]) -> None:
        """Deal new pieces and their counts to leaves and update the sums above. Where they would overfill the leaves or leave most of them
        empty, as many leaves as they need take the place of these, and the sums are built again."""
        held, need = hi - lo + 1, max(1, -(-len(pieces) // LEAF_PIECES))
        if len(pieces) <= 2 * LEAF_PIECES * held and held <= 4 * need + 4:
            share = -(-len(pieces) // held) or 1
            for j, leaf in enumerate(range(lo, hi + 1)):
                self._set(leaf, "".join(pieces[j * share : (j + 1) * share]), sum(counts[j * share : (j + 1) * share]))
            return
        cuts = range(0, need * LEAF_PIECES, LEAF_PIECES)
        texts = ["".join(pieces[i : i + LEAF_PIECES]) for i in cuts]
        tokens = self.tokens[self.size : self.size + len(self.texts)]
        self._build(self.texts[:lo] + texts + self.texts[hi + 1 :], tokens[:lo] + [sum(counts[i : i + LEAF_PIECES]) for i in cuts] + tokens[hi + 1 :])


def piece_counts(pieces: Sequence[str], enc: Encoder) -> list[int]:
    """Tokens of each piece."""
    if not pieces:
        return []
    _, slots, offsets, _ = enc.pieces(pieces)
    lens = np.concatenate([[0], np.cumsum(enc.lens[slots])])
    return np.diff(lens[offsets]).tolist()


def trees(texts: Sequence[str], enc: Encoder) -> Iterator[TokenTree]:
    """A tree for each text."""

    def count(pieces: Sequence[str]) -> list[int]:
        return piece_counts(pieces, enc)

    for i, j in groups(texts, 1 << 19):
        part = texts[i:j]
        at, slots, offsets, chars = enc.pieces(part)
        upto = np.concatenate([[0], np.cumsum(enc.lens[slots])]).astype(np.int64)
        for k, text in enumerate(part):
            ks = np.append(np.arange(offsets[k], offsets[k + 1], LEAF_PIECES), offsets[k + 1])
            ends, sums = (at[ks] - chars[k]).tolist(), np.diff(upto[ks]).tolist()
            yield TokenTree([(text[a:b], n) for a, b, n in zip(ends, ends[1:], sums, strict=False)], count)


def example_edits(doc_id: int | None, n: int) -> list[tuple[int, int, str]]:
    """The edits of the registered query: a cut at a quarter, an insertion at half and a replacement at three quarters."""
    d = (doc_id or 0) % 97
    return [(n // 4, 5 + d % 7, ""), (n // 2, 0, f" edit {d}'s"), (3 * n // 4, 8, "re-placed\n")]


_SCHEMA = "doc_id long, n_chars long, n_tokens long, n_edits int, edited_chars long, edited_tokens long, reread_chars long"


def count_tokens(docs: DataFrame, edits=example_edits, tokenizer: str | None = None) -> DataFrame:
    """Counts before and after edits, and the characters split again; docs: doc_id, text; edits: (doc_id, n_chars) -> (at, delete, insert), each at places of the text as it then is."""
    path = tokenizer or default_path()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            ids, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            rows = []
            for i, j in groups(texts, 1 << 19):
                grown = list(trees(texts[i:j], enc))
                first = [(tree.length(), tree.total()) for tree in grown]
                made = [edits(doc_id, n) for doc_id, (n, _) in zip(ids[i:j], first, strict=True)]
                for r in range(max(map(len, made), default=0)):
                    at = [k for k, e in enumerate(made) if len(e) > r]
                    todo = [grown[k].touched(*made[k][r]) for k in at]
                    counts = piece_counts([p for _, _, pieces in todo for p in pieces], enc)
                    upto = 0
                    for k, (lo, hi, pieces) in zip(at, todo, strict=True):
                        grown[k].update(lo, hi, pieces, counts[upto : upto + len(pieces)])
                        upto += len(pieces)
                rows += [(d, n, before, len(e), t.length(), t.total(), t.read) for d, (n, before), e, t in zip(ids[i:j], first, made, grown, strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 3 else pa.int64()) for i, c in enumerate(zip(*rows, strict=True))], [x.split()[0] for x in _SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(trimmed(run), _SCHEMA)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = None
