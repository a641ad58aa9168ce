"""Words, shingles and their hashes for whole batches of texts, by numpy over UTF-8 bytes.

Words are the maximal runs of bytes outside space and 0x09-0x0D, with A-Z lower-cased. The
hash of a word is a random-table polynomial modulo 2**64, taken from prefix sums and then
mixed; equal words have equal hashes everywhere and unequal ones differ but for a chance of
about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

U = np.uint64
_MASK = (1 << 64) - 1


def _splitmix(seed: int, n: int) -> np.ndarray:
    out, x = [], seed
    for _ in range(n):
        x = (x + 0x9E3779B97F4A7C15) & _MASK
        z = x
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
        out.append(z ^ (z >> 31))
    return np.array(out, dtype=U)


SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_TABLE = _splitmix(1, 256)
_TABLE_LOWER = _TABLE[LOWER]
_BASE = 0xD6E8FEB86659FD93
_POW = np.ones(1, dtype=U)
_INV = np.ones(1, dtype=U)
_COMBINE = _splitmix(7, 64) | U(1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of the base and of its inverse."""
    global _POW, _INV
    if len(_POW) < n:
        m = 1 << (n - 1).bit_length()
        for name, base in (("_POW", _BASE), ("_INV", pow(_BASE, -1, 1 << 64))):
            x = np.full(m, base & _MASK, dtype=U)
            x[0] = 1
            globals()[name] = np.multiply.accumulate(x)
    return _POW[:n], _INV[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end] for 64-bit values."""
    p, q = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=U)
    np.cumsum(values * p[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * q[starts] + (ends - starts).astype(U))


#: Bytes of text that one numpy pass takes; about 60 times as much memory at the peak.
PASS_BYTES = 1 << 17


def pieces(text: bytes, most: int | None = None) -> Iterator[bytes]:
    """text cut before single spaces between non-spaces, into pieces of about `most` bytes."""
    most = most or PASS_BYTES
    at = 0
    while len(text) - at > most:
        cut = at + most
        while True:
            cut = text.find(b" ", cut)
            if cut < 0 or cut + 1 >= len(text):
                cut = len(text)
                break
            if not SPACE[text[cut - 1]] and not SPACE[text[cut + 1]] and text[cut - 1] < 128 and text[cut + 1] < 128:
                break
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def groups(texts: Sequence[bytes], most: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of `most` bytes or so together."""
    most = most or PASS_BYTES
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _few_words(texts: Sequence[bytes], spans: bool) -> tuple:
    buf = b"\n".join(texts) + b"\n"
    a = np.frombuffer(buf, dtype=np.uint8)
    space = SPACE[a]
    edge = np.empty(len(a), dtype=bool)
    edge[0] = not space[0]
    np.not_equal(space[1:], space[:-1], out=edge[1:])
    at = np.flatnonzero(edge)
    starts, ends = at[::2], at[1::2]
    h = run_hashes(_TABLE_LOWER[a], starts, ends)
    begins = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begins[1:])
    offsets = np.searchsorted(starts, begins)
    if spans:
        return h, offsets, starts, ends, begins
    return h, offsets


def words(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts, and each text's offsets into them (one more than texts)."""
    hashes, counts = [np.zeros(0, dtype=U)], []
    for i, j in groups(texts):
        if j == i + 1 and len(texts[i]) > 2 * PASS_BYTES:
            parts = [_few_words([p], False)[0] for p in pieces(texts[i])]
            hashes += parts
            counts.append(sum(map(len, parts)))
        else:
            h, o = _few_words(texts[i:j], False)
            hashes.append(h)
            counts += np.diff(o).tolist()
    return np.concatenate(hashes), np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).astype(np.int64)


def word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the starts and ends of the words of one text."""
    out, at = [], 0
    for p in pieces(text):
        if p:
            _, _, s, e, _ = _few_words([p], True)
            out.append((s + at, e + at))
        at += len(p)
    if not out:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate([s for s, _ in out]), np.concatenate([e for _, e in out])


def shingles(h: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text, in order, and offsets; shorter texts have their whole sequence as one."""
    n = np.diff(offsets)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    out_offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
    at = np.arange(out_offsets[-1]) + np.repeat(offsets[:-1] - out_offsets[:-1], count)
    left = np.repeat(offsets[1:], count) - at
    s = np.full(len(at), k, dtype=U)
    short = left < k
    if short.any():
        s[short] = left[short].astype(U) + U(1 << 32)
    for j in range(k):
        inside = left > j
        if inside.all():
            s += h[at + j] * _COMBINE[j]
        else:
            s[inside] += h[at[inside] + j] * _COMBINE[j]
    return mix(s), out_offsets


def column_bytes(column) -> list[bytes]:
    """An Arrow string column's texts as UTF-8 bytes; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]
