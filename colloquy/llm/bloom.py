"""Blocked Bloom filters over 64-bit hashes, built in Spark and of bounded size."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import mix64

#: Bits of a block, bits set in it for each key, and bits of the filter for each key.
BLOCK, MARKS, BITS = 512, 6, 16
#: Most bytes of all filters of one build together. Beyond them a filter lets more keys through that are not in it,
#: never fewer that are.
MOST_BYTES = 64 << 20


def _places(h: np.ndarray) -> list[np.ndarray]:
    """The MARKS bits of each key within its block."""
    own = mix64(h)
    return [(own >> np.uint64(9 * j)) & np.uint64(BLOCK - 1) for j in range(MARKS)]


def _block(h: np.ndarray, blocks: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)


class Blocked:
    """A filter of `blocks` blocks; bits holds each block's 8 numbers in turn."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.blocks = bits, len(bits) // 8

    def __contains__(self, h: int) -> bool:
        return bool(self.test(np.array([h], np.uint64))[0])

    def test(self, h: np.ndarray) -> np.ndarray:
        """False for keys that are not in the filter, but for some; true for all that are."""
        at, block = np.arange(len(h)), _block(h, self.blocks) * np.uint64(8)
        own = mix64(h)
        for j in range(MARKS):  # few keys that are not in it outlast the first bits
            bit = (own >> np.uint64(9 * j)) & np.uint64(BLOCK - 1)
            hit = (self.bits[block + (bit >> np.uint64(6))] >> (bit & np.uint64(63))) & np.uint64(1) == 1
            at, block, own = at[hit], block[hit], own[hit]
        out = np.zeros(len(h), bool)
        out[at] = True
        return out


def sizes(keys: dict[int, int], most: int = MOST_BYTES) -> dict[int, int]:
    """Blocks of each part's filter: BITS for each key, all together within `most` bytes where one block each allows it."""
    want = {p: math.ceil(n * BITS / BLOCK) or 1 for p, n in keys.items()}
    part = min(1.0, most / (BLOCK / 8) / max(1, sum(want.values())))
    return {p: max(1, int(n * part)) for p, n in want.items()}


def build(keys: DataFrame, hashed: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], most: int = MOST_BYTES, shard: int = 4096) -> dict[int, Blocked]:
    """A filter for each part of keys, whose batches `hashed` turns into (part, hash) arrays.

    Each key goes to its shard of blocks, a task's group; only the finished blocks, `most` bytes in all, come together.
    An empty table gives no filters.
    """

    def told(batches):
        for batch in batches:
            part, h = hashed(batch)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(h.view(np.int64))], names=["part", "h"])

    rows = keys.mapInArrow(told, "part int, h long")
    blocks = sizes({r.part: r.n for r in rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}, most)

    def placed(batches):
        for batch in batches:
            part, h = hashed(batch)
            n = np.array([blocks[p] for p in np.unique(part).tolist()], np.uint64)[np.unique(part, return_inverse=True)[1]] if len(part) else h
            block = ((h >> np.uint64(32)) * n) >> np.uint64(32)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array((block // np.uint64(shard)).astype(np.int32)), pa.array(h.view(np.int64))], names=["part", "shard", "h"])

    def set_bits(key, t: pa.Table) -> pa.Table:
        part, at = key[0].as_py(), key[1].as_py()
        h = np.asarray(t["h"]).view(np.uint64)
        out = np.zeros(8 * min(shard, blocks[part] - at * shard), np.uint64)
        first = (_block(h, blocks[part]) - np.uint64(at * shard)) * np.uint64(8)
        for bit in _places(h):
            np.bitwise_or.at(out, first + (bit >> np.uint64(6)), np.uint64(1) << (bit & np.uint64(63)))
        return pa.table({"part": [part], "shard": [at], "bits": [out.tobytes()]}, schema=pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("bits", pa.binary())]))

    found = keys.mapInArrow(placed, "part int, shard int, h long").groupBy("part", "shard").applyInArrow(lambda key, t: set_bits(key, t), "part int, shard int, bits binary").collect()
    out = {p: np.zeros(8 * n, np.uint64) for p, n in blocks.items()}
    for r in found:
        own = np.frombuffer(r.bits, np.uint64)
        out[r.part][8 * shard * r.shard : 8 * shard * r.shard + len(own)] = own
    return {p: Blocked(x) for p, x in out.items()}
