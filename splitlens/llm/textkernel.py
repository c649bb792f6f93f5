"""Vectorised text kernels: word and shingle hashes straight from Arrow's UTF-8 buffers.

Words are the runs of bytes other than space and 0x09-0x0D, with A-Z lowered; UTF-8
continuation bytes are never separators, so splitting bytes splits characters rightly.  A word's
hash is a polynomial over its bytes modulo 2**64, read off prefix sums, then mixed.  Equality of
words and shingles is equality of these 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20  # bytes looked at at once; longer rows are cut
HASHED = 1 << 17  # of words hashed at once, which takes some 40 times that; longer rows are cut at white space
BASE = 0x9E3779B97F4A7C55
INVERSE = pow(BASE, -1, 1 << 64)
SHINGLE = 5
_MULT = [np.uint64(m) for m in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB,
                                0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
_POWERS: dict[str, np.ndarray] = {}


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, min(PIECE + 1, 1 << n.bit_length()))
        for name, base in (("up", BASE), ("down", INVERSE)):
            t = np.full(size, base, dtype=np.uint64)
            t[0] = 1
            _POWERS[name] = np.multiply.accumulate(t)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values (splitmix)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], dtype=wide, count=column.offset + len(column) + 1)[column.offset:].astype(np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf, off


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def word_classes() -> np.ndarray:
    """0 for white space (space, 0x09-0x0D), 1 for the rest."""
    t = np.ones(256, dtype=np.uint8)
    t[[32, 9, 10, 11, 12, 13]] = 0
    return t


def token_runs(part: np.ndarray, classes: np.ndarray, row_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of one non-zero class; rows never share a run."""
    c = classes[part]
    change = np.empty(len(c) + 1, dtype=bool)
    change[0] = change[-1] = True
    np.not_equal(c[1:], c[:-1], out=change[1:-1])
    change[row_starts] = True
    edges = np.flatnonzero(change)
    live = c[edges[:-1]] != 0
    return edges[:-1][live], edges[1:][live]


def run_hashes(part: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: np.ndarray) -> np.ndarray:
    up, down = power_tables(len(part) + 1)
    total = np.zeros(len(part) + 1, dtype=np.uint64)
    np.cumsum((lower[part].astype(np.uint64) + np.uint64(1)) * up[:len(part)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _cuts(part: np.ndarray, classes: np.ndarray) -> list[int]:
    """Where to cut one long row: after white space, at least every HASHED bytes where there is any."""
    cuts, at = [0], 0
    while len(part) - at > HASHED:
        gap = np.flatnonzero(classes[part[at + 1:at + HASHED]] == 0)
        if len(gap):
            at += int(gap[-1]) + 1
        else:  # one huge word
            rest = np.flatnonzero(classes[part[at + HASHED:]] == 0)
            if not len(rest):
                break
            at += HASHED + int(rest[0])
        cuts.append(at)
    return [*cuts, len(part)]


def word_hashes(buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For groups of rows: (first row, end row, word hashes, word bounds of each row)."""
    classes, lower = word_classes(), lower_table()
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + HASHED, side="right")) - 1
        j = min(max(j, i + 1), n)
        part = buf[off[i]:off[j]]
        if len(part) <= HASHED:
            starts, ends = token_runs(part, classes, np.minimum(off[i:j] - off[i], len(part)))
            yield i, j, run_hashes(part, starts, ends, lower), np.searchsorted(starts, off[i:j + 1] - off[i])
        else:
            cuts = _cuts(part, classes)
            found = []
            for a, b in zip(cuts, cuts[1:]):
                starts, ends = token_runs(part[a:b], classes, np.zeros(1, np.int64))
                found.append(run_hashes(part[a:b], starts, ends, lower))
            words = np.concatenate(found)
            yield i, j, words, np.array([0, len(words)])
        i = j


def shingles(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hash of every k consecutive words (no regard to rows)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, np.uint64(k), dtype=np.uint64)
    for i in range(k):
        out += words[i:i + n] * _MULT[i]
    return mix(out)


def row_shingles(words: np.ndarray, all_shingles: np.ndarray, a: int, b: int) -> np.ndarray:
    """Sorted distinct shingles of the row with words [a, b); fewer than five words form one."""
    if b - a >= SHINGLE:
        s = np.sort(all_shingles[a:b - SHINGLE + 1])
        return s[np.r_[True, s[1:] != s[:-1]]]
    return shingles(words[a:b], b - a) if b > a else np.zeros(0, dtype=np.uint64)


def shingle_sets(buf: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
    """The shingle set of each row, in order."""
    for i, j, words, bounds in word_hashes(buf, off):
        every = shingles(words)
        for r in range(j - i):
            yield row_shingles(words, every, int(bounds[r]), int(bounds[r + 1]))
