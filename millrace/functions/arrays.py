"""Hashes of a text's character shingles as numpy arrays, for functions that run on Arrow batches inside tasks."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa

from millrace.functions.hashing import PRIME

_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Rows hashed at a time, so that the words stay in the processor's cache.
CHUNK = 32768
_SHIFTS = (7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_START = 0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476
#: Per number of bytes of a word that belong to the message: what is kept of it, and the end mark behind.
_KEEP = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], dtype=np.uint32)
_END = np.array([0x80, 0x8000, 0x800000, 0x80000000, 0], dtype=np.uint32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, in order. Texts shorter than ``k`` (or NULL) have none."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = len(points) - k + 1
    if n < 1:
        return np.empty(0, dtype=np.uint64)
    x = np.full(n, k, dtype=np.uint64)
    for at in range(0, k, 3):  # a character has 21 bits
        word = points[at : n + at].copy()
        for i in range(1, min(3, k - at)):
            word |= points[at + i : n + at + i] << np.uint64(21 * i)
        x = _mixed(x * _STEP + word)
    x.sort()  # the hash table of ``np.unique`` takes ten times as long
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def _md5_first(words: list[np.ndarray | None]) -> np.ndarray:
    """The first word of the md5 of one block each; a word that is None is zero in all."""
    n = len(words[0])
    a, b, c, d = (np.full(n, x, dtype=np.uint32) for x in _START)
    f, g = np.empty(n, dtype=np.uint32), np.empty(n, dtype=np.uint32)
    # The first word of the state after step 63 is what step 60 has made.
    for i in range(61):
        kind = i // 16
        if kind == 0:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif kind == 1:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif kind == 2:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        word = words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[kind] % 16]
        f += a
        f += _SINES[i]
        if word is not None:
            f += word
        turn = _SHIFTS[kind][i % 4]
        np.left_shift(f, np.uint32(turn), out=g)
        f >>= np.uint32(32 - turn)
        g |= f
        g += b
        a, b, c, d, g = d, g, b, c, a
    return b + np.uint32(_START[0])


def base_hashes(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """``hashing.base_hash`` of each shingle of some texts, in order of places, repeats included; and how many each text has."""
    encoded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    raw = b"".join(encoded)
    data = np.frombuffer(raw + b"\0" * 64, dtype=np.uint8)
    begins = np.append(np.flatnonzero((data[: len(raw)] & 0xC0) != 0x80), len(raw))
    # Where each text begins, in characters.
    limits = np.searchsorted(begins, np.cumsum([0] + [len(e) for e in encoded]))
    counts = np.maximum(np.diff(limits) - k + 1, 0)
    places = np.repeat(limits[:-1] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    if not len(places):
        return np.empty(0, dtype=np.uint64), counts
    starts = begins[places]
    sizes = begins[places + k] - starts
    if sizes.max() > 55:  # more than a block of md5 holds
        heads = [int.from_bytes(hashlib.md5(raw[s : s + m]).digest()[:4], "big") for s, m in zip(starts.tolist(), sizes.tolist())]
        return np.array(heads, dtype=np.uint64) % np.uint64(PRIME), counts
    wide = data.astype(np.uint32)
    four = wide[:-3] | wide[1:-2] << np.uint32(8) | wide[2:-1] << np.uint32(16) | wide[3:] << np.uint32(24)
    out = np.empty(len(starts), dtype=np.uint32)
    for at in range(0, len(starts), CHUNK):
        first, size = starts[at : at + CHUNK], sizes[at : at + CHUNK]
        words: list[np.ndarray | None] = [None] * 16
        for i in range(int(size.max()) // 4 + 1):
            inside = np.clip(size - 4 * i, 0, 4)
            words[i] = four[first + 4 * i] & _KEEP[inside]
            words[i] |= np.where(size >= 4 * i, _END[inside], np.uint32(0))
        words[14] = size.astype(np.uint32) * np.uint32(8)
        out[at : at + CHUNK] = _md5_first(words)
    return out.byteswap().astype(np.uint64) % np.uint64(PRIME), counts


def hashed_texts(texts: pa.Array, k: int, characters: int = 1 << 18):
    """``(rows, values, counts)`` of :func:`base_hashes` for slices of a column of texts, each of about so many characters."""
    start, size, some = 0, 0, []
    for row, text in enumerate(texts):
        some.append(text.as_py())
        size += len(some[-1] or "")
        if size >= characters or row + 1 == len(texts):
            yield slice(start, row + 1), *base_hashes(some, k)
            start, size, some = row + 1, 0, []


def least_seeded(values: np.ndarray, counts: np.ndarray, family: list[tuple[int, int]]) -> np.ndarray:
    """A row per group of ``counts`` values, none empty, with the least ``(a * x + b) mod PRIME`` for each member (a, b) of
    the family. Values lie below ``PRIME``."""
    if not len(counts):
        return np.empty((0, len(family)), dtype=np.uint32)
    ends = np.cumsum(counts)
    least = np.full((len(counts), len(family)), PRIME, dtype=np.uint32)
    members = [(np.uint64(a), np.uint64(b)) for a, b in family]
    low, bits, one = np.uint64(PRIME), np.uint64(31), np.uint32(PRIME)
    for at in range(0, len(values), CHUNK):
        x = values[at : at + CHUNK]
        y, high = np.empty_like(x), np.empty_like(x)
        short, wrapped = np.empty(len(x), dtype=np.uint32), np.empty(len(x), dtype=np.uint32)
        first, last = np.searchsorted(ends, [at, at + len(x) - 1], side="right")
        cuts = np.maximum(ends[first : last + 1] - counts[first : last + 1] - at, 0)
        rows = slice(first, last + 1)
        for i, (a, b) in enumerate(members):
            np.multiply(x, a, out=y)
            np.add(y, b, out=y)
            # 2^31 is 1 modulo the prime, so both halves add up; the sum lies below twice the prime.
            np.right_shift(y, bits, out=high)
            np.bitwise_and(y, low, out=y)
            np.add(y, high, out=y)
            np.copyto(short, y, casting="unsafe")
            # Below the prime the difference wraps round and is the larger one.
            np.subtract(short, one, out=wrapped)
            np.minimum(short, wrapped, out=short)
            least[rows, i] = np.minimum(least[rows, i], np.minimum.reduceat(short, cuts))
    return least
