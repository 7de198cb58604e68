"""Words of whole Arrow batches as 64-bit hashes, without a Python step for each word.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Word hashes are differences of one running polynomial
sum over the batch's bytes (mod 2**64, odd base), spread by a finaliser; hashes of n consecutive words come
from a running sum over word hashes in the same way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Odd bases of the running sums.
BYTE_BASE, WORD_BASES = 0x9E3779B97F4A7C15, (0xBF58476D1CE4E5B9, 0xD6E8FEB86659FD93)


#: Powers of each base that a worker keeps, and the most it keeps of one.
KEPT: dict[int, tuple[np.ndarray, np.ndarray]] = {}
MOST_KEPT = 1 << 21


def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i below ``size``."""
    held = KEPT.get(base)
    if held is None or len(held[0]) < size:
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(max(size, 1 << 16), b, U)
            p[0] = 1
            out.append(np.cumprod(p, dtype=U))
        held = out[0], out[1]
        if size <= MOST_KEPT:
            KEPT[base] = held
    return held[0][:size], held[1][:size]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and each row's offsets; nulls are empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


class Words:
    """Words of a string column: ``hash``, byte ``start`` and ``end``, and ``row``, the first word of each row."""

    def __init__(self, column: pa.Array) -> None:
        self.raw, self.offsets = bytes_of(column)
        self.plain = self.raw.tobytes()
        size = len(self.raw)
        black = ~WHITE[self.raw]
        first, last = np.ones(size, bool), np.ones(size, bool)
        first[1:] = ~black[:-1]
        last[:-1] = ~black[1:]
        inner = self.offsets[(self.offsets > 0) & (self.offsets < size)]
        first[inner] = True
        last[inner - 1] = True
        self.start = np.flatnonzero(black & first)
        self.end = np.flatnonzero(black & last) + 1
        self.row = np.searchsorted(self.start, self.offsets)
        up, down = powers(BYTE_BASE, size + 1)
        total = np.zeros(size + 1, U)
        np.cumsum((self.raw.astype(U) + U(1)) * up[:size], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(U))

    def __len__(self) -> int:
        return len(self.start)

    def runs(self, n: int, base: int = 0) -> np.ndarray:
        """The hash of the ``n`` words from each word on, where there are so many in the batch (rows aside)."""
        count = len(self)
        if count < n:
            return np.zeros(0, U)
        up, down = powers(WORD_BASES[base], count + 1)
        total = np.zeros(count + 1, U)
        np.cumsum(self.hash * up[:count], out=total[1:])
        return mix((total[n:] - total[:-n]) * down[: count - n + 1])

    def of_row(self, i: int) -> list[bytes]:
        """The words of a row."""
        return self.plain[self.offsets[i] : self.offsets[i + 1]].split()

    def text(self, i: int, n: int) -> bytes:
        """Words i .. i+n-1 of one row, joined by one space."""
        return b" ".join(self.plain[self.start[i] : self.end[i + n - 1]].split())


def parts(batch: pa.RecordBatch, text: int, most: int = 600_000):
    """Slices of a batch whose texts have about ``most`` bytes at most (a longer text is a slice of its own)."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), np.int64)
    group = np.cumsum(sizes) // most if len(sizes) else sizes
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)
