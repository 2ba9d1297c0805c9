"""Sets of word shingles, straight from the bytes of Arrow columns.

A word's hash is a polynomial of its bytes (A-Z as a-z), read off running sums over a piece of the column; a shingle's hash mixes those of
its words. No Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes that are worked on at a time, and words beyond which a hash of their own is taken.
PIECE, LONG_WORD = 1 << 20, 256
#: An odd number, 3 modulo 8, so that words whose characters are swapped differ in high bits.
BASE = 0x9E3779B97F4A7C13
_BYTES = np.random.default_rng(20240101).integers(1 << 62, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES[65:91] = _BYTES[97:123]
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: What separates words.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0 .. n - 1; those of a usual piece are kept."""
    if n > PIECE:
        return _run(BASE, n), _run(pow(BASE, -1, 1 << 64), n)
    if PIECE not in _powers:
        _powers[PIECE] = _run(BASE, PIECE + 1), _run(pow(BASE, -1, 1 << 64), PIECE + 1)
    return _powers[PIECE]


def _run(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words of each row) of rows whose bytes stand one after another in data, each up to its end."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    space = _SPACE[data]
    first = np.empty(len(data), bool)  # where a word may begin: after a space, and where a row begins
    first[0], first[1:] = True, space[:-1]
    first[ends[ends < len(data)]] = True
    last = np.empty(len(data), bool)
    last[:-1] = first[1:] | space[1:]
    last[-1] = True
    starts, stops = np.flatnonzero(first & ~space), np.flatnonzero(last & ~space) + 1
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):  # whole words of a piece, one at least
        at = int(starts[lo])
        hi = max(lo + 1, int(np.searchsorted(stops, at + PIECE, side="right")))
        piece = data[at : int(stops[hi - 1])]
        power, inverse = _powers_of(len(piece))
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_BYTES[piece] * power[: len(piece)], out=sums[1:])
        s, e = starts[lo:hi] - at, stops[lo:hi] - at
        out[lo:hi] = (sums[e] - sums[s]) * inverse[s]
        lo = hi
    for i in np.flatnonzero(stops - starts > LONG_WORD).tolist():
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : stops[i]].tobytes().translate(_LOWER))
    at = np.searchsorted(starts, ends)
    return _mixed(out), np.diff(at, prepend=0)


def _shingled(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of every run of k of the words h."""
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = (out ^ h[i : n + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) > 1 else x


def sets_of(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Of each text, the sorted distinct hashes of its n-word shingles; of the whole sequence if it has fewer words; none without words.
    Null texts count as empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(texts):  # rows of a piece, one at least
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + PIECE, side="right")) - 1)
        h, counts = word_hashes(data[offsets[lo] : offsets[hi]], offsets[lo + 1 : hi + 1] - offsets[lo])
        full = _shingled(h, n) if len(h) >= n else h[:0]
        at = 0
        for c in counts.tolist():
            yield distinct(full[at : at + c - n + 1]) if c >= n else _shingled(h[at : at + c], c) if c else h[:0]
            at += c
        lo = hi


def shingles(text: str | None, n: int) -> np.ndarray:
    return next(sets_of(pa.array([(text or "").encode("utf-8", "surrogatepass")], pa.large_binary()), n))
