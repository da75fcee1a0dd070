"""Removal of repeated word windows: Rabin-Karp hashes of every window, counted in Spark."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import attach, in_small_batches, materialise
from .text import Words, mix64, powers, slices, words

WINDOW = 20
_ROLL = np.uint64(0xD1342543DE82EF95)
_NULL_ID = -(2**63) + 1


def window_hashes(w: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The Rabin-Karp hash of every window of `window` words within a text, and its first word's number.

    Each word counts with its hash; the sum over a window of hash * base^place is taken from running sums over
    the whole slice, modulo 2^64, and scaled by the inverse power of the window's place.
    """
    n = len(w.start)
    if n < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w.hashes() * powers(n, _ROLL))])
    inverse = np.uint64(pow(int(_ROLL), -1, 1 << 64))
    at = np.flatnonzero(w.first[1:][w.doc] - np.arange(n) >= window)
    return mix64((total[at + window] - total[at]) * powers(n, inverse)[at]), at


def packed(h: np.ndarray, doc: np.ndarray, tie: np.ndarray, at: np.ndarray) -> bytes:
    """Places with ascending hashes, as compressed byte planes of the differences."""
    planes = [
        np.diff(h, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T,
        *(x.astype("<i8").view(np.uint8).reshape(-1, 8).T for x in (doc, tie)),
        at.astype("<i4").view(np.uint8).reshape(-1, 4).T,
    ]
    return zstandard.compress(b"".join(np.ascontiguousarray(p).tobytes() for p in planes), 1)


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(28, -1)
    own = [np.ascontiguousarray(planes[a:b].T).view(t)[:, 0] for a, b, t in ((0, 8, "<u8"), (8, 16, "<i8"), (16, 24, "<i8"), (24, 28, "<i4"))]
    return np.cumsum(own[0]), own[1], own[2], own[3]


def starts(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where a new combination of values begins."""
    n = len(sorted_columns[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in sorted_columns])
    return np.flatnonzero(new)


def parted(doc: np.ndarray, tie: np.ndarray, at: np.ndarray, parts: int) -> tuple[list[int], list[bytes]]:
    """Places packed by the part of their document, so that a row tells many documents."""
    order = np.lexsort((at, tie, doc))
    doc, tie, at = doc[order], tie[order], at[order]
    first = starts(doc, tie)
    each = np.fromiter((zlib.crc32(f"{d}:{t}".encode()) % parts for d, t in zip(doc[first].tolist(), tie[first].tolist())), np.int64, len(first))
    part = np.repeat(each, np.diff(np.append(first, len(doc))))
    order = np.argsort(part, kind="stable")
    part, doc, tie, at = part[order], doc[order], tie[order], at[order]
    edge = np.append(starts(part), len(part))
    return part[edge[:-1]].tolist(), [packed(np.zeros(b - a, np.uint64), doc[a:b], tie[a:b], at[a:b]) for a, b in zip(edge, edge[1:])]


def part_of(parts: int) -> Column:
    return (F.crc32(F.encode(F.concat_ws(":", "doc_id", "tie"), "UTF-8")) % parts).alias("part")


def later_places(h: np.ndarray, doc: np.ndarray, tie: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of places in the order of hash, document and start: those that are not the first of their hash."""
    first = np.zeros(len(h), np.int64)
    edge = starts(h)
    first[edge] = edge
    first = np.maximum.accumulate(first) if len(h) else first
    return (doc != doc[first]) | (tie != tie[first]) | (at != at[first])


def repeats(docs: DataFrame, window: int, buckets: int, slice_bytes: int = 4 << 20) -> DataFrame:
    """(part, blob): packed places of windows that also start at an earlier place, by part of their documents.

    Each slice of texts tells its windows' hashes with their places, sorted and packed by hash bucket. A hash
    that a slice holds again needs no counting elsewhere: its later places are told at once and only the first
    goes to the bucket, so no hash has more rows than there are slices.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text", slice_bytes):
            ids, ties = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            order = np.lexsort((ties, ids))
            w = words([texts[i] for i in order])
            h, at = window_hashes(w, window)
            doc, tie, at = ids[order][w.doc[at]], ties[order][w.doc[at]], at - w.first[:-1][w.doc[at]]
            order = np.argsort(h, kind="stable")  # equal hashes stay in the order of their places
            h, doc, tie, at = h[order], doc[order], tie[order], at[order]
            later = later_places(h, doc, tie, at)
            parts, found = parted(doc[later], tie[later], at[later], buckets)
            first = starts(h)
            h, doc, tie, at = h[first], doc[first], tie[first], at[first]
            bucket = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            edge = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
            some = np.flatnonzero(np.diff(edge))
            blobs = [packed(h[a:b], doc[a:b], tie[a:b], at[a:b]) for a, b in zip(edge[some], edge[some + 1])]
            keys = [*some.tolist(), *parts]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([False] * len(some) + [True] * len(parts)), pa.array(blobs + found, pa.binary())], names=["bucket", "told", "blob"])

    def counted(key, t: pa.Table) -> pa.Table:
        told = t.filter(t["told"])
        told = pa.table({"part": pa.array([key[0].as_py()] * len(told), pa.int64()), "blob": told["blob"]})
        blobs = t.filter(pa.compute.invert(t["told"]))["blob"].to_pylist()
        if not blobs:
            return told
        h, doc, tie, at = (np.concatenate(x) for x in zip(*map(unpacked, blobs)))
        order = np.argsort(h)
        same = h[order][1:] == h[order][:-1]
        rows = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
        h, doc, tie, at = h[rows], doc[rows], tie[rows], at[rows]
        order = np.lexsort((at, tie, doc, h))
        h, doc, tie, at = h[order], doc[order], tie[order], at[order]
        later = later_places(h, doc, tie, at)
        parts, found = parted(doc[later], tie[later], at[later], buckets)
        return pa.concat_tables([told, pa.table({"part": pa.array(parts, pa.int64()), "blob": pa.array(found, pa.binary())})])

    rows = in_small_batches(docs).mapInArrow(hashed, "bucket long, told boolean, blob binary")
    return rows.groupBy("bucket").applyInArrow(lambda key, t: counted(key, t), "part long, blob binary")


def remove_repeats(docs: DataFrame, window: int = WINDOW, bucket_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and text (the kept words, joined by one space) of each document.

    A word goes if a window of `window` words over it also starts at an earlier place: in a smaller doc_id, or
    earlier in the same document. Windows are judged on the input, and overlapping ones merge.

    Null and empty texts, and texts shorter than a window, lose nothing. A null doc_id sorts before all others. Different
    texts without an id, or with one id, are documents of their own, in the order of a hash of the text; rows of one id
    and text are one document, so exact copies of a row stay. An empty table gives no rows. Other columns are ignored.
    """
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"), "text")
    # only rows whose id is not theirs alone need the hash, so it takes no room elsewhere
    shared = own.where(F.col("doc_id") != _NULL_ID).groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias("shared"))
    own = attach(own, materialise(shared, "shared-ids"), ["doc_id"], F.col("tie"))
    own = own.select("doc_id", F.when(F.col("shared") | (F.col("doc_id") == _NULL_ID), F.col("tie")).otherwise(0).alias("tie"), "text")
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    found = repeats(own, window, buckets)

    def cut(texts: pa.Table, blobs: pa.Table) -> pa.Table:
        parts = [unpacked(x)[1:] for x in blobs["blob"].to_pylist()]
        doc, tie, at = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))
        order = np.lexsort((tie, doc))
        doc, tie, at = doc[order], tie[order], at[order]
        edge = np.append(starts(doc, tie), len(doc))
        held = {(d, t): (a, b) for d, t, a, b in zip(doc[edge[:-1]].tolist(), tie[edge[:-1]].tolist(), edge.tolist(), edge[1:].tolist())}
        rows = []
        for i, t, text in zip(texts["doc_id"].to_pylist(), texts["tie"].to_pylist(), texts["text"]):
            a, b = held.get((i, t), (0, 0))
            own = (text.as_py() or "").encode().split()
            left = own
            if a < b:
                change = np.zeros(len(own) + window + 1, np.int64)
                first = at[a:b][at[a:b] < len(own)]
                np.add.at(change, first, 1)
                np.add.at(change, first + window, -1)
                left = [own[k] for k in np.flatnonzero(np.cumsum(change)[: len(own)] <= 0)]
            line = b" ".join(left)
            rows.append((None if i == _NULL_ID else i, len(own), len(own) - len(left), hashlib.sha256(line).hexdigest(), line.decode()))
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "text"]
        columns = zip(*rows) if rows else [[]] * 5
        return pa.table([pa.array(c, pa.int64() if k < 3 else pa.string()) for k, c in enumerate(columns)], names=names)

    by_part = own.withColumn("part", part_of(buckets)).groupBy("part").cogroup(found.groupBy("part"))
    return by_part.applyInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, text string")
