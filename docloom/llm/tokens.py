"""Token ids of whole batches with a byte-level BPE of the `tokenizers` library.

The split before the merges (contractions, letters, numbers, other, white space) is found by numpy
for a batch at once; each distinct piece is then given to the tokenizer only once a worker and its
ids are looked up by hash from then on. The ids are those of encoding each whole text.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Sequence

import numpy as np
import pandas as pd

from docloom.llm.words import U, groups, mix, run_hashes

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Unicode White_Space.
_SPACES = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_classes: np.ndarray | None = None
_mixed: np.ndarray | None = None


def classes() -> np.ndarray:
    global _classes
    if _classes is None:
        kinds = {"L": LETTER, "N": NUMBER}
        t = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        t[_SPACES] = SPACE
        _classes = t
    return _classes


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def split_starts(cps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Marks where a piece starts; first marks where a text starts."""
    n = len(cps)
    kind = classes()[cps]
    space = kind == SPACE
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    # the last of several spaces stands apart, and a blank joins what follows
    start[:-1] |= space[:-1] & ~space[1:] & ~first[1:]
    joins = np.zeros(n, dtype=bool)
    joins[1:] = (cps[:-1] == 32) & ~space[1:] & ~first[1:]
    start &= ~joins
    # 's 't 'm 'd 're 've 'll, if no blank joins the apostrophe
    at = np.flatnonzero((cps[:-1] == 39) & start[:-1] & (kind[1:] == LETTER) & ~first[1:])
    if len(at):
        a = cps[at + 1]
        b = np.where((at + 2 < n) & ~first[np.minimum(at + 2, n - 1)], cps[np.minimum(at + 2, n - 1)], 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        for hit, size in ((one, 1), (two & ~one, 2)):
            i = at[hit]
            start[i + 1] = False
            j = i + 1 + size
            j = j[j < n]
            j = j[(kind[j] == LETTER) & ~first[j]]
            start[j] = True
    return start


class Encoder:
    """One a worker and vocabulary file; get it by encoder()."""

    def __init__(self, path: str, most: int = 500_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.most = most
        self._reset()

    def _reset(self) -> None:
        self.slots: dict[int, int] = {}
        self.lens, self.offs, self.flat = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint32)
        self.used = 0

    def _learn(self, hashes: list[int], texts: list[str]) -> None:
        for h, e in zip(hashes, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            k, ids = len(self.slots), e.ids
            if k == len(self.lens):
                self.lens, self.offs = np.resize(self.lens, 2 * k), np.resize(self.offs, 2 * k)
            while self.used + len(ids) > len(self.flat):
                self.flat = np.resize(self.flat, 2 * len(self.flat))
            self.slots[h], self.lens[k], self.offs[k] = k, len(ids), self.used
            self.flat[self.used : self.used + len(ids)] = ids
            self.used += len(ids)

    def pieces(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts of all pieces in the joined texts (and the end), their slots, and each text's offsets into pieces and characters."""
        chars = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)
        joined = "".join(texts)
        cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        n = len(cps)
        if n == 0:
            return np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64), chars
        first = np.zeros(n, dtype=bool)
        first[chars[:-1][chars[:-1] < n]] = True
        at = np.flatnonzero(split_starts(cps, first))
        ends = np.append(at[1:], n)
        global _mixed
        if _mixed is None:
            _mixed = mix(np.arange(1, 0x110001, dtype=U))
        h = run_hashes(_mixed[cps], at, ends)
        codes, unique = pd.factorize(h)
        if len(self.slots) > self.most:
            self._reset()
        keys = unique.tolist()
        new = [i for i, x in enumerate(keys) if x not in self.slots]
        if new:
            where = np.empty(len(unique), dtype=np.int64)
            where[codes[::-1]] = np.arange(len(codes))[::-1]
            w = where[new]
            self._learn([keys[i] for i in new], [joined[a:b] for a, b in zip(at[w].tolist(), ends[w].tolist(), strict=True)])
        slots = np.fromiter(map(self.slots.__getitem__, keys), np.int64, len(keys))[codes]
        return np.append(at, n), slots, np.searchsorted(at, chars), chars

    def _plain(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        _, slots, offsets, _ = self.pieces(texts)
        lens = self.lens[slots]
        upto = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
        ids = self.flat[np.arange(upto[-1]) + np.repeat(self.offs[slots] - upto[:-1], lens)]
        return ids, upto[offsets]

    def encode(self, texts: Sequence[str]):
        """Yields each text's ids, as encode(text, add_special_tokens=False) of the tokenizer gives them."""
        for i, j in groups(texts, 1 << 19):
            part = texts[i:j]
            odd = {k for k, t in enumerate(part) if any(s in t for s in self.special)}
            ids, offsets = self._plain(["" if k in odd else t for k, t in enumerate(part)])
            for k in range(len(part)):
                if k in odd:
                    yield np.array(self.tokenizer.encode(part[k], add_special_tokens=False).ids, dtype=np.uint32)
                else:
                    yield ids[offsets[k] : offsets[k + 1]]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
