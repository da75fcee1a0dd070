"""Words of whole Arrow columns of texts as numpy arrays.

A word is a longest run of bytes other than space and \\t..\\r, so words never depend on Unicode tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BYTE = np.random.default_rng(20240611).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@dataclass
class Words:
    data: np.ndarray  #: bytes of all texts
    bounds: np.ndarray  #: text i is data[bounds[i]:bounds[i + 1]]
    start: np.ndarray  #: first byte of each word
    end: np.ndarray
    count: np.ndarray  #: words of each text

    @property
    def doc(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)

    @property
    def first(self) -> np.ndarray:
        """The number of words before each text, and at the end of all."""
        return np.concatenate([[0], np.cumsum(self.count)])

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: a polynomial over its bytes, then mixed."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        size = self.end - self.start
        at = np.concatenate([[0], np.cumsum(size)])
        inside = np.arange(at[-1]) - np.repeat(at[:-1], size)
        from_byte = inside + np.repeat(self.start, size)
        terms = _BYTE[self.data[from_byte]] * powers(int(size.max()))[inside]
        return mix64(np.add.reduceat(terms, at[:-1]) + size.astype(np.uint64))


def words(texts: list[bytes], lower: bool = False) -> Words:
    data = np.frombuffer(b"".join(texts), np.uint8)
    if lower:
        data = _LOWER[data]
    bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))]).astype(np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    count = np.diff(np.searchsorted(start, bounds))
    return Words(data, bounds, start, end, count)


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 18) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Runs of rows with about `most` bytes of text each, or one longer text; null texts are empty."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0), dtype=np.int64)
        total, at = np.cumsum(sizes), 0
        while at < len(sizes):
            done = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, done + most, "right")))
            rows = batch.slice(at, to - at)
            yield rows, [x or b"" for x in column.slice(at, to - at).to_pylist()]
            at = to


def strings(values: list[str | bytes]) -> pa.Array:
    return pa.array(values, pa.string())
