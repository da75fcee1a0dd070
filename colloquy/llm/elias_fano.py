"""Elias-Fano sequences and a two-level n-gram trie in a file that is memory-mapped."""

from __future__ import annotations

import struct

import numpy as np


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    """The low `bits` of each value, one after another, least bit first."""
    if not bits or not len(values):
        return np.zeros(8, np.uint8)
    out = np.zeros((len(values) * bits + 7) // 8 + 8, np.uint8)
    for lo in range(0, len(values), 8 << 14):  # runs of whole bytes keep the unpacked bits small
        part = np.unpackbits(values[lo : lo + (8 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little", count=64)[:, :bits]
        raw = np.packbits(part.ravel(), bitorder="little")
        out[lo * bits // 8 : lo * bits // 8 + len(raw)] = raw
    return out


class EliasFano:
    """A non-decreasing sequence: the low bits packed, the high parts in unary.

    Opened over bytes that may be memory-mapped; a directory of the zeros in the unary part is built on opening.
    """

    def __init__(self, n: int, bits: int, high: np.ndarray, low: np.ndarray):
        self.n, self.bits, self.high, self.low = n, bits, high, low
        ones = np.unpackbits(high, bitorder="little")
        self._zeros = np.flatnonzero(ones == 0)
        self._ones = np.flatnonzero(ones)[:n]
        # the 8 bytes from every byte on, so that one look gives any value's low bits
        self._windows = np.ndarray((max(0, len(low) - 7),), "<u8", np.ascontiguousarray(low), strides=(1,))

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = min(56, max(0, (top // n).bit_length() - 1)) if n else 0
        parts = (values >> np.uint64(bits)).astype(np.int64)
        high = np.zeros((int(parts[-1]) if n else 0) + n + 2, np.uint8)
        high[parts + np.arange(n)] = 1
        high, low = np.packbits(high, bitorder="little"), _pack(values & np.uint64((1 << bits) - 1), bits)
        return struct.pack("<4q", n, bits, len(high), len(low)) + high.tobytes() + low.tobytes()

    @classmethod
    def open(cls, raw: np.ndarray, at: int) -> tuple[EliasFano, int]:
        n, bits, high, low = struct.unpack("<4q", raw[at : at + 32].tobytes())
        at += 32
        return cls(n, bits, raw[at : at + high], raw[at + high : at + high + low]), at + high + low

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        bit = i * self.bits
        return (self._windows[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self._ones[i] - i).astype(np.uint64) << np.uint64(self.bits)) | self._low(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """The first place whose value is at least x; n if there is none.

        The unary part gives the run of values that share x's high part; a binary search of the low bits goes on
        within it.
        """
        part = (x >> np.uint64(self.bits)).astype(np.int64)
        beyond = part >= len(self._zeros)
        part = np.minimum(part, len(self._zeros) - 1)
        lo = np.where(part > 0, self._zeros[part - 1] - part + 1, 0)
        hi = np.minimum(self._zeros[part] - part, self.n)
        want = x & np.uint64((1 << self.bits) - 1)
        lo = np.minimum(lo, hi)
        busy = np.flatnonzero(lo < hi)
        while len(busy):
            mid = (lo[busy] + hi[busy]) >> 1
            less = self._low(mid) < want[busy]
            lo[busy] = np.where(less, mid + 1, lo[busy])
            hi[busy] = np.where(less, hi[busy], mid)
            busy = busy[lo[busy] < hi[busy]]
        return np.where(beyond, self.n, lo)


def _quantised(v: np.ndarray, bits: int) -> bytes:
    low, high = (float(v.min()), float(v.max())) if len(v) else (0.0, 0.0)
    step = (high - low) / (2**bits - 1) or 1.0
    return struct.pack("<2d", low, step) + np.round((v - low) / step).astype("<u2").tobytes()


class Trie:
    """Levels of n-grams: for each level pointers to the successors of every node above, codes, quantised values.

    A node is known by its number within its level. Successors are stored with the number of the node above them
    over their code, which makes a whole level one non-decreasing sequence, as its pointers are; a lookup is a
    successor search relative to the node above. The first level hangs from one root.
    """

    @staticmethod
    def encode(levels: list[tuple[np.ndarray, np.ndarray, list[np.ndarray]]], bits: int = 16) -> bytes:
        """levels: for each node its parent's number (ascending) and code (ascending within a parent), and values."""
        width = max((int(codes.max()).bit_length() for _, codes, _ in levels if len(codes)), default=1)
        out, above = [struct.pack("<2q", width, len(levels))], 1
        for parents, codes, values in levels:
            first = np.searchsorted(parents, np.arange(above + 1))
            out.append(EliasFano.encode(first.astype(np.uint64)))
            out.append(EliasFano.encode((parents.astype(np.uint64) << np.uint64(width)) | codes.astype(np.uint64)))
            out.append(struct.pack("<q", len(values)))
            out += [_quantised(v, bits) for v in values]
            above = len(codes)
        return b"".join(out)

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        self.width, n_levels = struct.unpack("<2q", raw[:16].tobytes())
        at, self.levels = 16, []
        for _ in range(n_levels):
            first, at = EliasFano.open(raw, at)
            keys, at = EliasFano.open(raw, at)
            (n_values,) = struct.unpack("<q", raw[at : at + 8].tobytes())
            at, values = at + 8, []
            for _ in range(n_values):
                low, step = struct.unpack("<2d", raw[at : at + 16].tobytes())
                values.append((low, step, np.frombuffer(raw, "<u2", keys.n, at + 16) if keys.n else np.zeros(0, np.uint16)))
                at += 16 + 2 * keys.n
            self.levels.append((first, keys, values))

    def find(self, level: int, parent: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The number of each code below its parent; -1 if it is not held, or has no parent (-1)."""
        first, keys, _ = self.levels[level]
        out = np.full(len(codes), -1, np.int64)
        ask = np.flatnonzero((parent >= 0) & (codes >> self.width == 0))
        if len(ask) and keys.n:
            key = (parent[ask].astype(np.uint64) << np.uint64(self.width)) | codes[ask].astype(np.uint64)
            i = keys.successor(key)
            inside = i < first.get(parent[ask] + 1).astype(np.int64)
            hit = inside & (keys.get(np.minimum(i, keys.n - 1)) == key)
            out[ask[hit]] = i[hit]
        return out

    def value(self, level: int, which: int, number: np.ndarray, missing: float) -> np.ndarray:
        low, step, v = self.levels[level][2][which]
        out = np.full(len(number), missing)
        there = number >= 0
        out[there] = low + step * v[number[there]]
        return out
