"""Packing of tokenised documents into sequences of equal length, balanced by attention cost."""

from __future__ import annotations

import heapq
import json
import math
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import in_small_batches

LENGTH = 2048
END_ID = 1
#: Fixed value: how byte-level vocabularies split texts into words.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_PARTS_TYPE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, draw long"
PARTS = [x.split()[0] for x in _PARTS_TYPE.split(", ")]


class Encoder:
    """Ids of whole texts by a byte-level tokenizer file.

    Texts that hold a special token's string go through the tokenizer itself. All others are merged by tiktoken over
    the ranks of the same file, which gives the same ids in a quarter of the time, provided that ids are in the order
    of the merges and that words are split alike; both are checked when the file is loaded.
    """

    #: Texts on which both libraries must agree: white space, digits, contractions, scripts, marks, special strings.
    PROBES = (
        "", " ", "\n\n  two  spaces\t\tand tabs \r\n", "It's we'll they'd I'M don't ''s", "abc123 4567.89 1,000 \u0663\u0664", "Stra\u00dfe \u00c9t\u00e9 e\u0301 na\u00efve",
        "\u4e2d\u6587\u5b57\u7b26 \u65e5\u672c\u8a9e\u30c6\u30ad\u30b9\u30c8 \ud55c\uad6d\uc5b4", "\U0001f600\U0001f469\u200d\U0001f52c!", "a\u00a0b\u2003c\u3000d\u0085e\x1cf\x00g", "***$$$ %%% &&& ###|||", "x" * 300 + " " * 50 + "y",
    )

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec["added_tokens"]]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        ids = {token: i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        merged = [ids["".join(pair.split(" ") if isinstance(pair, str) else pair)] for pair in spec["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError(f"{path}: ids are not in the order of the merges")
        ranks = {bytes(shown[c] for c in token): i for token, i in ids.items()}
        self.fast = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for text in self.PROBES:
            if self.fast(text) != self.tokenizer.encode(text, add_special_tokens=False).ids:
                raise ValueError(f"{path}: texts are split in another way than assumed")

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit numbers, without the end id."""
        if any(s in text for s in self.special):
            return raw(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return raw(self.fast(text))


def raw(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if sys.byteorder == "little" else np.asarray(ids, "<u4").tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for all tasks of a worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pack_group(items: list[tuple[int, int]], length: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int]]:
    """(item, part start, part length, sequence) for items (index, size), sizes under `length`.

    Sequences are as few as can hold all tokens. Items in descending size each go to the sequence of lowest cost,
    linear * tokens + quadratic * sum of squares, that has room; one that fits nowhere is cut over the sequences
    with most room.
    """
    total = sum(size for _, size in items)
    room = [length] * math.ceil(total / length)
    heap = [(0.0, s) for s in range(len(room))]
    out, whole = [], []
    for i, size in sorted(items, key=lambda x: (-x[1], x[0])):
        aside = []
        while heap and room[heap[0][1]] < size:
            aside.append(heapq.heappop(heap))
        if heap:
            spent, s = heapq.heappop(heap)
            room[s] -= size
            out.append((i, 0, size, s))
            if room[s]:
                heapq.heappush(heap, (spent + linear * size + quadratic * size * size, s))
        else:
            whole.append((i, size))
        # a sequence too full for this item may have room for a smaller one
        for x in aside:
            heapq.heappush(heap, x)
    left = sorted((s for s in range(len(room)) if room[s]), key=lambda s: (-room[s], s))
    for i, size in whole:
        at = 0
        while at < size:
            s = left[0]
            n = min(size - at, room[s])
            out.append((i, at, n, s))
            at, room[s] = at + n, room[s] - n
            if not room[s]:
                left.pop(0)
    return out


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, linear: float = 1.0, quadratic: float = 1.0 / LENGTH, group_docs: int = 4096) -> DataFrame:
    """Pieces of all documents in sequences of at most `length` tokens.

    Every document is its ids by the tokenizer file plus the end id. Its whole runs of `length` ids are sequences
    of their own; all pieces are dealt by the hash of their row's place, never by an id or text that many rows may
    share, into groups of about group_docs documents. pack_group packs each group's rests, so a group's last sequence
    alone is not full. Returns PIECES; sequence ids are unique over all groups. Another split of the same rows over
    tasks packs them otherwise, and as well.

    docs is a table or another frame whose partitions do not change when they are computed again.

    Null and empty texts have the end id alone. Copies and repeated rows are packed each for itself. An empty
    table gives no rows. Other columns are ignored, whatever their names.
    """
    groups = max(1, math.ceil(docs.count() / group_docs))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        end, task, number = raw([END_ID]), TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            for at in range(0, len(batch), 256):
                rows = []
                for doc_id, text in zip(batch.column(0).slice(at, 256).to_pylist(), batch.column(1).slice(at, 256).to_pylist()):
                    ids, number = encode(text or "") + end, number + 1
                    n = len(ids) // 4
                    for start in range(0, n, length):
                        piece = ids[4 * start : 4 * (start + length)]
                        rest = None
                        if len(piece) < 4 * length:
                            numbers = np.frombuffer(piece, "<u4")
                            rest = numbers.astype("<u2" if numbers.max() < 65536 else "<u4").tobytes()
                        rows.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), n, rest, task + number))
                columns = list(zip(*rows)) if rows else [[]] * 7
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.binary()), pa.array(columns[6], pa.int64())], names=PARTS)

    def packed(key, table: pa.Table) -> pa.Table:
        t = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")]).to_pydict()
        group, n = int(key[0].as_py()), len(t["doc_id"])
        rests = [(i, t["length"][i]) for i in range(n) if t["ids"][i] is not None]
        size = sum(x for _, x in rests)
        base, rows, filled = group << 32, [], {}
        for i, at, size_, s in pack_group(rests, length, linear, quadratic):
            crc = t["ids_crc32"][i]
            if size_ != t["length"][i]:
                rest = t["ids"][i]
                crc = zlib.crc32(np.frombuffer(rest, "<u2" if len(rest) == 2 * t["length"][i] else "<u4")[at : at + size_].astype("<u4").tobytes())
            rows.append((t["doc_id"][i], t["start"][i] + at, size_, crc, t["doc_tokens"][i], base + s, filled.get(s, 0)))
            filled[s] = filled.get(s, 0) + size_
        s = math.ceil(size / length)
        for i in range(n):
            if t["ids"][i] is None:
                rows.append((t["doc_id"][i], t["start"][i], length, t["ids_crc32"][i], t["doc_tokens"][i], base + s, 0))
                s += 1
        return pa.table([pa.array(c, pa.int64()) for c in zip(*rows)], names=[x.split()[0] for x in PIECES.split(", ")])

    parts = in_small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(tokens, _PARTS_TYPE)
    group = F.pmod(F.xxhash64("draw", "start"), F.lit(groups))
    return parts.withColumn("__group", group).drop("draw").groupBy("__group").applyInArrow(lambda key, t: packed(key, t), PIECES)
