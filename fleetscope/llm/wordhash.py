"""Hashes of words and of runs of words, vectorised over Arrow batches.

A word's hash is a polynomial over its bytes, a run's hash a polynomial over its
words' hashes, both modulo 2**64 and finished by a bit mixer.  Prefix sums give
the hash of any run in a few array operations.  Words are separated by the
bytes 0x20 and 0x09-0x0D.
"""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Odd multipliers of the byte polynomial and of two independent word polynomials.
BYTE_STEP, WORD_STEP, CHECK_STEP = 0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_PIECE = 1 << 19


class _Powers:
    """Powers of an odd number modulo 2**64, grown on demand."""

    def __init__(self, step: int):
        self.step, self.table = np.uint64(step), np.ones(1, np.uint64)

    def up_to(self, n: int) -> np.ndarray:
        if len(self.table) < n:
            full = np.full(max(n, 1 << 16), self.step, np.uint64)
            full[0] = 1
            self.table = np.multiply.accumulate(full)
        return self.table[:n]


_POWERS: dict[int, tuple[_Powers, _Powers]] = {}


def _powers(step: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if step not in _POWERS:
        _POWERS[step] = _Powers(step), _Powers(pow(step, -1, 1 << 64))
    up, down = _POWERS[step]
    return up.up_to(n), down.up_to(n)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher that spreads every input bit (changes ``x`` in place)."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def raw_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts in a row, offsets) of an Arrow string column; null texts have no bytes."""
    import pyarrow as pa

    if pa.types.is_large_string(column.type):
        width = np.int64
    else:
        width = np.int32
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, width)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


class Words:
    """The words of a batch of texts: ``hash``, ``begin``/``end`` bytes, and ``first`` (offsets of texts in words)."""

    def __init__(self, column, lower: bool = False):
        self.raw, at = raw_bytes(column)
        raw = _LOWER[self.raw] if lower else self.raw
        inside = ~_SPACE[raw]
        edge = np.zeros(len(raw) + 1, bool)  # a text begins here
        edge[at[:-1]] = True
        prev = np.concatenate([[False], inside[:-1]]) if len(raw) else inside
        self.begin = np.flatnonzero(inside & (~prev | edge[:len(raw)]))
        nxt = np.concatenate([inside[1:], [False]]) if len(raw) else inside
        self.end = np.flatnonzero(inside & (~nxt | edge[1:])) + 1
        self.first = np.searchsorted(self.begin, at)
        self.count = np.diff(self.first)
        self.at = at
        self.hash = self._hash(raw)

    def _hash(self, raw: np.ndarray) -> np.ndarray:
        out, n, at = np.empty(len(self.begin), np.uint64), len(self.begin), 0
        while at < n:
            lo = self.begin[at]
            to = max(at + 1, int(np.searchsorted(self.end, lo + _PIECE, side="right")))
            hi = self.end[to - 1]
            up, down = _powers(BYTE_STEP, int(hi - lo))
            total = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(_BYTES[raw[lo:hi]] * up, out=total[1:])
            b, e = self.begin[at:to] - lo, self.end[at:to] - lo
            out[at:to] = (total[e] - total[b]) * down[b]
            at = to
        return mix(out)

    def text_begin(self, i: int) -> int:
        return int(self.at[i])

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)


class Runs:
    """Hash of any run of words of a batch."""

    def __init__(self, hashes: np.ndarray, step: int = WORD_STEP):
        up, self.down = _powers(step, len(hashes) + 1)
        self.total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * up[:-1], out=self.total[1:])

    def all(self, n: int) -> np.ndarray:
        """Hashes of the runs of ``n`` words at every position, also across texts."""
        if len(self.total) <= n:
            return np.zeros(0, np.uint64)
        return mix((self.total[n:] - self.total[:-n]) * self.down[:len(self.total) - n])

    def some(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = (self.total[end] - self.total[begin]) * self.down[begin]
        return mix(out + (end - begin).astype(np.uint64))


def slices(batch, column: int, most: int = 1 << 20):
    """Slices of a batch holding about ``most`` bytes of text each (one text at least)."""
    _, at = raw_bytes(batch.column(column))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + most, side="right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end
