"""Vectorised words and word shingles of Arrow text columns.

A chunk of documents is handled as one byte buffer: byte positions, word
bounds and 64-bit hashes of words and shingles are numpy arrays over all of
its documents, so a task does no Python work per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_rng = np.random.default_rng(20240501)
#: One random 64-bit value for each byte value; A-Z share those of a-z.
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = _BYTE.copy()
_FOLD[65:91] = _BYTE[97:123]
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base`` modulo 2**64 (kept between calls)."""
    if len(_POWERS.get(base, ())) < n:
        out = np.full(n + n // 4, base, np.uint64)
        out[0] = 1
        _POWERS[base] = np.multiply.accumulate(out)
    return _POWERS[base][:n]


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and its n + 1 offsets; nulls are empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def words(column: pa.Array, fold: bool = True, outside: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first byte, end byte, hash) of every word, in order. Words are
    runs of bytes other than those that ``outside`` marks (space and 0x09-0x0D);
    ``fold`` lower-cases A-Z."""
    raw, ends = buffer(column)
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    inside = ~outside[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    bounds = ends[1:-1][(ends[1:-1] > 0) & (ends[1:-1] < n)]
    first[bounds] = inside[bounds]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(ends, a, side="right") - 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_FOLD if fold else _BYTE)[raw] * powers(BASE, n), out=sums[1:])
    return row, a, b, mix((sums[b] - sums[a]) * powers(INVERSE, n)[a] + (b - a).astype(np.uint64))


def shingles(row: np.ndarray, h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every run of ``width`` words that
    lies in one row."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        s = np.zeros(n, np.uint64)
        for k in range(width):
            s = s * np.uint64(0x100000001B3) + mix(h[k:n + k] + np.uint64(k))
    at = np.flatnonzero(row[:n] == row[width - 1:])
    return at, mix(s[at])


def shingle_sets(column: pa.Array, width: int, hot: np.ndarray | None = None
                 ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, first place of each row) of the distinct shingles of every
    row, sorted by row and then by one global order: shingles outside ``hot``
    by hash, then those of ``hot`` (sorted hashes) by hash. A row with fewer
    than ``width`` words has its whole sequence as one shingle."""
    row, _, _, h = words(column)
    at, s = shingles(row, h, width)
    r = row[at]
    n_words = np.bincount(row, minlength=len(column)) if len(row) else np.zeros(len(column), np.int64)
    few = np.flatnonzero((n_words > 0) & (n_words < width))
    if len(few):
        start = (np.cumsum(n_words) - n_words)[few]
        with np.errstate(over="ignore"):
            whole = n_words[few].astype(np.uint64)
            for k in range(width - 1):
                more = np.flatnonzero(n_words[few] > k)
                whole[more] = whole[more] * np.uint64(0x100000001B3) + mix(h[start[more] + k] + np.uint64(k + 99))
        r, s = np.concatenate([r, few]), np.concatenate([s, mix(whole)])
    order = s >> np.uint64(1)
    if hot is not None and len(hot):
        place = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
        order = np.where(hot[place] == s, order | np.uint64(1 << 63), order)
    o = np.argsort(order)
    key = r[o].astype(np.uint16) if len(column) <= 65536 else r[o]
    o = o[np.argsort(key, kind="stable")]
    r, s = r[o], s[o]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != s[:-1]) | (r[1:] != r[:-1])
    r, s = r[keep], s[keep]
    return r, s, np.searchsorted(r, np.arange(len(column) + 1))
