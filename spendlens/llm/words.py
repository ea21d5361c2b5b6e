"""Words of whole Arrow batches as 64-bit hashes, with numpy only: no Python object per word."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time; a longer stretch without a blank is taken whole.
CHUNK = 1 << 20

_U = np.uint64


def mix(z: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers (a bijection)."""
    z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


def spread(n: int, seed: int = 0) -> np.ndarray:
    """n fixed numbers without a pattern."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(seed))


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
FACTOR = 0xD1342543DE82EF95  # odd, so that it has an inverse
INVERSE = pow(FACTOR, -1, 1 << 64)


@functools.lru_cache(maxsize=2)
def _byte_values(lower: bool) -> np.ndarray:
    values = spread(256, 17)
    values[_BLANK] = 0
    if lower:
        values[65:91] = values[97:123]
    return values


@functools.lru_cache(maxsize=8)
def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1), modulo 2 ** 64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def power_table(base: int, n: int) -> np.ndarray:
    return powers(base, max(CHUNK, 1 << max(n - 1, 1).bit_length()))


def layout(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null rows are empty."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if wide else np.int32
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if buffers[2] is None or not len(texts):
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


class Words:
    """``hashes`` of the words of all rows in order, ``first`` their first bytes, ``last`` one past their last, and
    ``rows``: row i has the words from rows[i] to rows[i + 1]. Words are runs of bytes other than the six ASCII blanks;
    with ``lower``, A-Z count as a-z."""

    def __init__(self, texts: pa.Array, lower: bool = False) -> None:
        self.data, self.offsets = layout(texts)
        data, n = self.data, len(self.data)
        blank = _BLANK[data]
        edge = np.zeros(n + 1, bool)  # a row begins
        edge[self.offsets[:-1]] = True
        edge[n:] = True
        begins = ~blank
        begins[1:] &= blank[:-1] | edge[1:-1]
        ends = ~blank
        ends[:-1] &= blank[1:] | edge[1:-1]
        self.first, self.last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.rows = np.searchsorted(self.first, self.offsets)
        self.hashes = np.empty(len(self.first), np.uint64)
        values, at = _byte_values(lower), 0
        while at < len(self.first):
            upto = max(at + 1, int(np.searchsorted(self.last, self.first[at] + CHUNK, "right")))
            low, high = int(self.first[at]), int(self.last[upto - 1])
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(values[data[low:high]] * power_table(FACTOR, high - low)[: high - low], out=sums[1:])
            a, b = self.first[at:upto] - low, self.last[at:upto] - low
            self.hashes[at:upto] = mix((sums[b] - sums[a]) * power_table(INVERSE, high - low)[a])
            at = upto


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` values."""
    n = len(hashes)
    if n < width:
        return np.empty(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * power_table(FACTOR, n)[:n], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * power_table(INVERSE, n)[: n - width + 1])


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values the position of the smallest, the leftmost of equals."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best, at, span = values.copy(), np.arange(len(values)), 1
    while span < width:  # doubling: the minimum of two overlapping runs
        step = min(span, width - span)
        right = best[step:]
        take = right < best[: len(right)]
        best, at = np.where(take, right, best[: len(right)]), np.where(take, at[step:], at[: len(right)])
        span += step
    return at
