"""Language-model scoring: trigram tries in Elias-Fano form, one for each shard of contexts."""

from __future__ import annotations

import math
import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .elias_fano import Trie
from .tables import in_small_batches, materialise
from .text import mix64, slices, words

#: Most words and most pairs that are told to all tasks as frequent, those with over 1 / HOT of the input's bytes.
HOT = 1 << 20
BEGIN, END = np.uint64(0xC2B2AE35), np.uint64(0x5BD1E995)
#: Ids below every word's: no third word, and words that the training documents do not hold.
NONE, UNKNOWN = 0, 1
#: The least log10 of a probability behind a context: below one in as many tokens as can be counted.
LEAST = -20.0
_BLOB = "slice long, part long, blob binary"


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 1, F.lit(False))


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as byte planes, each compressed by itself; a plane of one value is that value."""
    out, zstd = [len(arrays[0]).to_bytes(8, "little")], zstandard.ZstdCompressor(1)
    for a in arrays:
        for plane in np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T:
            same = not len(plane) or bool((plane == plane[0]).all())
            data = plane[:1].tobytes() if same else zstd.compress(plane.tobytes())
            out += [(len(data) << 1 | same).to_bytes(4, "little"), data]
    return b"".join(out)


def _unpack(blob: bytes, *types: str) -> list[np.ndarray]:
    n, at, out = int.from_bytes(blob[:8], "little"), 8, []
    zstd = zstandard.ZstdDecompressor()
    for t in types:
        a = np.empty((n, np.dtype(t).itemsize), np.uint8)
        for k in range(a.shape[1]):
            head = int.from_bytes(blob[at : at + 4], "little")
            data = blob[at + 4 : at + 4 + (head >> 1)]
            at += 4 + len(data)
            if n:
                a[:, k] = data[0] if head & 1 else np.frombuffer(zstd.decompress(data), np.uint8)
        out.append(a.view(t)[:, 0])
    return out


def _share(h: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each hash, ascending with it."""
    return (((h >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def _blobs(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    a, b, c = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.binary())], names=["slice", "part", "blob"])


def _cut(at: np.ndarray, shards: int) -> Iterator[tuple[int, int, int]]:
    """(shard, first, last) of the runs in ascending shard numbers."""
    edge = np.searchsorted(at, np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(edge)).tolist():
        yield s, int(edge[s]), int(edge[s + 1])


def _sequence(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's beginning, words and end, and their number for each text."""
    w = words(texts, lower=True)
    size = w.count + 2
    last = np.cumsum(size)
    seq = np.empty(int(last[-1]) if len(last) else 0, np.uint64)
    seq[np.arange(len(w.start)) + 2 * w.doc + 1] = w.hashes()
    seq[last - size], seq[last - 1] = BEGIN, END
    return seq, size


@dataclass
class Slice:
    """The tokens of a run of documents: each text's beginning, words and end, as numbers of distinct hashes."""

    hashes: np.ndarray  #: distinct, ascending
    token: np.ndarray  #: the place in hashes of every token
    size: np.ndarray  #: tokens of each document
    held: np.ndarray  #: held-out documents

    @classmethod
    def of(cls, texts: list[bytes], batch: pa.RecordBatch) -> Slice:
        seq, size = _sequence(texts)
        hashes, token = np.unique(seq, return_inverse=True)
        return cls(hashes, token, size, np.asarray(batch.column(2)))

    @property
    def trained(self) -> np.ndarray:
        """Whether each token is of a training document."""
        return np.repeat(~self.held, self.size)

    def starts(self) -> np.ndarray:
        """Places of tokens that another follows in their text."""
        ends = np.cumsum(self.size) - 1
        return np.delete(np.arange(len(self.token)), ends)

    def packed(self) -> bytes:
        docs = _pack(self.size.astype("<u4"), self.held.astype("<u1"))
        return len(docs).to_bytes(8, "little") + docs + _pack(self.token.astype("<u4"))

    @classmethod
    def unpacked(cls, blob: bytes) -> Slice:
        at = 8 + int.from_bytes(blob[:8], "little")
        size, held = _unpack(blob[8:at], "<u4", "<u1")
        return cls(np.zeros(0, np.uint64), _unpack(blob[at:], "<u4")[0].astype(np.int64), size.astype(np.int64), held.astype(bool))


def _read(docs: DataFrame, each, schema: str, slice_bytes: int) -> DataFrame:
    """each(name, texts, batch) -> record batch, for every slice of docs; names are the same in every reading."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch, texts in slices(batches, "text", slice_bytes):
            yield each((part << 32) | number, texts, batch)
            number += 1

    return in_small_batches(docs).mapInArrow(run, schema)


def _count_words(name: int, s: Slice, shards: int) -> pa.RecordBatch:
    """Each shard's distinct words of a slice, with their count in training documents."""
    n = np.bincount(s.token[s.trained], minlength=len(s.hashes))
    return _blobs([(name, k, _pack(np.diff(s.hashes[a:b], prepend=np.uint64(0)), n[a:b].astype("<u4"))) for k, a, b in _cut(_share(s.hashes, shards), shards)])


def _number_words(k: int, t: pa.Table, shards: int, hot: float) -> pa.Table:
    """Told to every slice: id and count of its words. Beside them, as slice -1 tokens, -2 words, -3 frequent words.

    Ids are dense over all shards and small for frequent words.
    """
    names = t["slice"].to_pylist()
    parts = [_unpack(x, "<u8", "<u4") for x in t["blob"].to_pylist()]
    each = [np.cumsum(p[0]) for p in parts]
    h, inverse = np.unique(np.concatenate(each), return_inverse=True)
    count = np.bincount(inverse, weights=np.concatenate([p[1] for p in parts]), minlength=len(h)).astype(np.int64)
    ids = np.full(len(h), UNKNOWN, np.int64)
    order = np.argsort(-count, kind="stable")[: int((count > 0).sum())]
    ids[order] = (np.arange(len(order)) + 1) * shards + k + 1
    at, rows = 0, []
    for name, own in zip(names, each):
        i = inverse[at : at + len(own)]
        rows.append((name, k, _pack(ids[i].astype("<u8"), count[i].astype("<u8"))))
        at += len(own)
    told = h != BEGIN
    rows += [(-1, int(count[told].sum()), None), (-2, int((count[told] > 0).sum()), None)]
    often = count >= hot
    if often.any():
        rows.append((-3, k, _pack(h[often], ids[often].astype("<u8"), count[often].astype("<u8"))))
    return pa.Table.from_batches([_blobs(rows)])


@dataclass
class Grams:
    """The distinct trigrams of a slice in the order in which shards are asked for them."""

    words: np.ndarray  #: ids of first, second and third word, one row for each
    trained: np.ndarray  #: occurrences in training documents
    shard: np.ndarray
    inverse: np.ndarray  #: the trigram of each start


def _grams(s: Slice, ids: np.ndarray, count: np.ndarray, hot_pairs: np.ndarray, hot: float, shards: int) -> Grams:
    """A trigram goes to the shard of its first word; of a frequent word to that of its first two, of a frequent
    pair to that of all three."""
    i, n = s.starts(), len(ids) + 1
    a, b = s.token[i], s.token[i + 1]
    doc_end = np.repeat(np.cumsum(s.size) - 1, s.size)[i]
    c = np.where(i + 2 <= doc_end, s.token[np.minimum(i + 2, len(s.token) - 1)] + 1, 0)
    pairs, of_pair = np.unique(a * n + b, return_inverse=True)
    triples, inverse = np.unique(of_pair * n + c, return_inverse=True)
    c = triples % n
    a, b = np.divmod(pairs[triples // n], n)
    u, v, w = ids[a], ids[b], np.where(c > 0, ids[c - 1], NONE)
    key = mix64(u.astype(np.uint64))
    wide = count[a] >= hot
    key[wide] = mix64(key[wide] + v[wide].astype(np.uint64))
    if len(hot_pairs):
        pair = _pair(u, v)
        widest = wide & (hot_pairs[np.minimum(np.searchsorted(hot_pairs, pair), len(hot_pairs) - 1)] == pair)
        key[widest] = mix64(key[widest] + w[widest].astype(np.uint64))
    shard = _share(key, shards)
    order = np.argsort(shard, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    trained = np.bincount(inverse[s.trained[i]], minlength=len(triples))
    return Grams(np.stack([u, v, w])[:, order], trained[order], shard[order], place[inverse])


def _pair(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return mix64(mix64(u.astype(np.uint64)) + v.astype(np.uint64))


def _answer(t: pa.Table, strength: float, hot_words: tuple[np.ndarray, np.ndarray], hot_pairs: tuple[np.ndarray, np.ndarray]) -> pa.Table:
    """Builds a shard's trie from its trigrams and answers every slice.

    Levels: words; pairs with log10 of c(u v) / (c(u) + strength) and of strength / (c(u v) + strength); triples with
    log10 of c(u v w) / (c(u v) + strength).
    """
    names = t["slice"].to_pylist()
    parts = [_unpack(x, "<u8", "<u8", "<u8", "<u4") for x in t["blob"].to_pylist()]
    size = [len(p[0]) for p in parts]
    u = np.concatenate([np.cumsum(p[0]) for p in parts]).astype(np.int64)
    v, w = (np.concatenate([p[k] for p in parts]).astype(np.int64) for k in (1, 2))
    n = np.concatenate([p[3] for p in parts]).astype(np.int64)
    del parts
    order = np.lexsort((w, v, u))
    u, v, w, n = u[order], v[order], w[order], n[order]

    def runs(*columns: np.ndarray) -> np.ndarray:
        new = np.ones(len(columns[0]), bool)
        new[1:] = np.any([x[1:] != x[:-1] for x in columns], axis=0)
        return new

    # the distinct questions
    ask1, ask2, ask3 = runs(u), runs(u, v), runs(u, v, w)
    some = np.flatnonzero(n)
    a, b, c, n = u[some], v[some], w[some], n[some]
    new1, new2, new3 = (runs(*x) if len(some) else np.zeros(0, bool) for x in ((a,), (a, b), (a, b, c)))
    at1, at2, at3 = map(np.flatnonzero, (new1, new2, new3))
    n1, n2, n3 = (np.add.reduceat(n, x) if len(x) else n for x in (at1, at2, at3))

    def known(own: np.ndarray, keys: np.ndarray, told: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Counts of frequent words and pairs, whose occurrences lie in several shards."""
        if not len(told[0]):
            return own
        i = np.minimum(np.searchsorted(told[0], keys), len(told[0]) - 1)
        return np.where(told[0][i] == keys, told[1][i], own)

    n1 = known(n1, a[at1].astype(np.uint64), hot_words)
    n2 = known(n2, _pair(a[at2], b[at2]), hot_pairs)
    up2, up3 = (np.cumsum(x) - 1 for x in (new1, new2))
    up2, up3 = up2[at2], up3[at3]
    third = c[at3] != NONE
    levels = [
        (np.zeros(len(at1), np.int64), a[at1], []),
        (up2, b[at2], [np.log10(n2 / (n1[up2] + strength)), np.log10(strength / (n2 + strength))]),
        (up3[third], c[at3][third], [np.log10(n3[third] / (n2[up3[third]] + strength))]),
    ]
    encoded = Trie.encode(levels)
    del levels, some, a, b, c
    with tempfile.TemporaryDirectory() as folder:
        with open(os.path.join(folder, "trie"), "wb") as f:
            f.write(encoded)
        del encoded
        trie = Trie(f.name)
        one, two = np.cumsum(ask1) - 1, np.cumsum(ask2) - 1
        word = trie.find(0, np.zeros(int(ask1.sum()), np.int64), u[ask1])
        pair = trie.find(1, word[one[ask2]], v[ask2])
        triple = trie.find(2, pair[two[ask3]], w[ask3])
        told = [trie.value(1, 0, pair, -np.inf)[two], trie.value(1, 1, pair, 0.0)[two], trie.value(2, 0, triple, -np.inf)[np.cumsum(ask3) - 1]]
        del trie
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    codes = [np.where(x > LEAST, np.round(x / LEAST * 65534), 65535).astype("<u2")[back] for x in told]
    edge = np.concatenate([[0], np.cumsum(size)])
    shard = t["part"][0].as_py()
    return pa.Table.from_batches([_blobs([(name, shard, _pack(*(x[i:j] for x in codes))) for name, i, j in zip(names, edge, edge[1:])])])


def score(docs: DataFrame, strength: float = 100.0, shard_bytes: int = 8 << 20, slice_bytes: int = 2 << 20) -> DataFrame:
    """Base and trigram scores of every document; see the columns at the end.

    P(w | u v) = (c(u v w) + strength * P(w | v)) / (c(u v) + strength), P(w | v) likewise from P(w) = (c(w) + 0.5) /
    (N + 0.5 (V + 1)): MacKay and Peto's Dirichlet smoothing. The first word's context is the beginning alone.

    One reading of the texts counts words: a slice of documents tells each of its distinct words to the word's
    shard, which answers with a number and the count. A second counts pairs of frequent words. A third tells each
    slice's distinct trigrams to the shard of the first word, or of the pair or the whole trigram where the word
    or pair alone would fill a quarter of a shard. A shard counts, writes an Elias-Fano trie of quantised log
    probabilities to a file, maps it and answers from it; the last reading adds up. Slices send a trigram once, so a
    repeated one has a row's entry for each slice. Shards are in proportion to the text; a slice sends each shard
    at most one row, and never more rows than it has trigrams. Tries are files of one task in its
    machine's temporary folder: a lost executor's tasks build theirs again.

    Words are told apart by 64-bit hashes, pairs of frequent words too. Frequent words and pairs, at most HOT of each,
    are broadcast as numbers.

    docs is a table or another frame whose partitions do not change when they are computed again.

    Null and empty texts consist of the end alone. A null doc_id is a training document. Repeated rows count each.
    Without training documents every word is unknown. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out().alias("held_out"))
    size = own.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    shards = max(1, math.ceil(size / shard_bytes))
    hot = max(shard_bytes / 24, size / HOT)

    counted = _read(own, lambda name, texts, batch: _count_words(name, Slice.of(texts, batch), shards), _BLOB, slice_bytes)
    numbered = counted.groupBy("part").applyInArrow(lambda key, t: _number_words(key[0].as_py(), t, shards, hot), _BLOB)
    numbered = materialise(numbered, "words")
    n_tokens, n_types = numbered.agg(*[F.coalesce(F.sum(F.when(F.col("slice") == x, F.col("part"))), F.lit(0)) for x in (-1, -2)]).first()
    found = [_unpack(r.blob, "<u8", "<u8", "<u8") for r in numbered.where("slice = -3").select("blob").collect()]
    hot_h, hot_id, hot_n = (np.concatenate([np.zeros(0, np.uint64), *(f[k] for f in found)]) for k in range(3))
    order = np.argsort(hot_h)
    hot_h, hot_id, hot_n = hot_h[order], hot_id[order], hot_n[order].astype(np.int64)
    sent = spark.sparkContext.broadcast((hot_h, hot_id))

    def frequent_pairs(name: int, texts: list[bytes], batch: pa.RecordBatch) -> pa.RecordBatch:
        hot_h, hot_id = sent.value
        seq, size = _sequence(texts)
        at = np.minimum(np.searchsorted(hot_h, seq), len(hot_h) - 1)
        use = (hot_h[at] == seq) & np.repeat(~np.asarray(batch.column(2)), size)
        i = np.flatnonzero(use[:-1] & use[1:] & (seq[:-1] != END))
        pair, n = np.unique(_pair(hot_id[at[i]], hot_id[at[i + 1]]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(pair.view(np.int64)), pa.array(n.astype(np.int64))], names=["pair", "n"])

    pairs = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    if len(hot_h):
        t = _read(own, frequent_pairs, "pair long, n long", slice_bytes).groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= hot).toArrow()
        pair = np.asarray(t["pair"]).astype(np.int64).view(np.uint64)
        order = np.argsort(pair)
        pairs = (pair[order], np.asarray(t["n"]).astype(np.int64)[order])
    by_id = np.argsort(hot_id)
    known = spark.sparkContext.broadcast(((hot_id[by_id], hot_n[by_id]), pairs))

    def with_words(t: pa.Table) -> tuple[Slice, np.ndarray, np.ndarray]:
        parts = t["part"].to_pylist()
        blobs = t["blob"].to_pylist()
        s = Slice.unpacked(blobs[parts.index(-1)])
        told = [_unpack(blobs[i], "<u8", "<u8") for i in sorted(range(len(parts)), key=parts.__getitem__) if parts[i] >= 0]
        return s, *(np.concatenate([x[k] for x in told]).astype(np.int64) for k in range(2))

    def told(t: pa.Table) -> pa.Table:
        s, ids, count = with_words(t)
        g = _grams(s, ids, count, known.value[1][0], hot, shards)
        u, v, w = g.words.astype("<u8")
        name = t["slice"][0].as_py()
        return pa.Table.from_batches([_blobs([(name, k, _pack(np.diff(u[a:b], prepend=np.uint64(0)), v[a:b], w[a:b], g.trained[a:b].astype("<u4"))) for k, a, b in _cut(g.shard, shards)])])

    whole = n_tokens + 0.5 * (n_types + 1)

    def added(t: pa.Table, answers: pa.Table) -> pa.Table:
        s, ids, count = with_words(t)
        g = _grams(s, ids, count, known.value[1][0], hot, shards)
        parts, blobs = answers["part"].to_pylist(), answers["blob"].to_pylist()
        answers = [_unpack(blobs[i], "<u2", "<u2", "<u2") for i in sorted(range(len(parts)), key=parts.__getitem__)]
        level = np.append(10 ** (np.arange(65535) / 65534 * LEAST), 0.0)  # 65535: not held
        in_pair, rest, in_triple = (level[np.concatenate([x[k] for x in answers])][g.inverse] for k in range(3))
        meta = pa.ipc.open_stream(t["blob"][t["part"].to_pylist().index(-2)].as_py()).read_all()
        low = (count + 0.5) / whole
        i = s.starts()
        p = in_pair + strength / (count[s.token[i]] + strength) * low[s.token[i + 1]]
        longer = np.flatnonzero(np.diff(i) == 1) + 1  # starts whose token before is of the same text
        p[longer] = in_triple[longer - 1] + rest[longer - 1] * p[longer]
        doc = np.repeat(np.arange(len(s.size)), s.size - 1)
        word = s.token[i + 1]
        sums = [np.bincount(doc, weights=x, minlength=len(s.size)) for x in (np.log10(low[word]), np.log10(p), count[word] > 0)]
        columns = [meta["doc_id"], meta["held_out"], pa.array(s.size - 1), pa.array(sums[2].astype(np.int64)), pa.array(np.full(len(s.size), n_tokens, np.int64)), pa.array(sums[0]), pa.array(sums[1])]
        return pa.table(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    def state(name: int, texts: list[bytes], batch: pa.RecordBatch) -> pa.RecordBatch:
        """A slice's tokens (part -1) and its documents (part -2)."""
        sink = pa.BufferOutputStream()
        meta = pa.table({"doc_id": batch.column(0), "held_out": batch.column(2)})
        with pa.ipc.new_stream(sink, meta.schema) as w:
            w.write_table(meta)
        return _blobs([(name, -1, Slice.of(texts, batch).packed()), (name, -2, sink.getvalue().to_pybytes())])

    # asked for trigrams and again for the sums, by one exchange
    rows = _read(own, state, _BLOB, slice_bytes).unionByName(numbered.where("slice >= 0")).groupBy("slice")
    answered = rows.applyInArrow(told, _BLOB).groupBy("part").applyInArrow(lambda t: _answer(t, strength, *known.value), _BLOB)
    columns = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.cogroup(answered.groupBy("slice")).applyInArrow(added, columns)
