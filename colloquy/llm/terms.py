"""Runs of bytes of whole Arrow columns of texts as Arrow arrays, so that equal runs share one number."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute

from .text import mix64, powers

_CODE = np.random.default_rng(20250117).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, and where each text begins and the last one ends."""
    bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))]).astype(np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), bounds


@dataclass
class Runs:
    terms: pa.Array  #: the distinct runs, as binary
    ids: np.ndarray  #: the term of each run
    start: np.ndarray  #: first byte of each run
    doc: np.ndarray  #: the text of each run
    easy: np.ndarray | None = None  #: a mark of each run, for callers


def runs(data: np.ndarray, bounds: np.ndarray, inside: np.ndarray) -> Runs:
    """The maximal runs of bytes that are inside, none of them over the end of a text."""
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    encoded = binary(data[inside], end - start).dictionary_encode()
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(np.searchsorted(start, bounds)))
    return Runs(encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), start, doc)


def binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Strings of bytes that stand one after another in data."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def hashes(values: pa.Array) -> np.ndarray:
    """A 64-bit hash of each value of a binary array without nulls: a polynomial over its bytes, then mixed."""
    values = values.cast(pa.large_binary())
    at = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    size = np.diff(at)
    out = size.astype(np.uint64)
    some = np.flatnonzero(size)
    if len(some):
        data = np.frombuffer(values.buffers()[2], np.uint8)[at[0] : at[-1]]
        inside = np.arange(len(data)) - np.repeat(at[:-1] - at[0], size)
        out[some] += np.add.reduceat(_CODE[data] * powers(int(size.max()))[inside], (at[:-1] - at[0])[some])
    return mix64(out)


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The place of each distinct key's first occurrence, the number of each key among the distinct ones, and how often
    each of these occurs; by a hash table, in the order of their first places."""
    number, distinct = pd.factorize(keys)
    first = np.empty(len(distinct), np.int64)
    first[number[::-1]] = np.arange(len(keys))[::-1]
    return first, number.astype(np.int64), np.bincount(number, minlength=len(distinct))


def repeated(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (n[0] numbers), first[1], ...: places in ragged rows."""
    begin = np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n
    return np.arange(int(n.sum())) - np.repeat(begin, n) + np.repeat(first, n)
