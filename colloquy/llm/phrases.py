"""Collocations by Toivonen's mining: a sample proposes frequent phrases, full passes count them and their border."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bloom, terms
from .tables import attach, in_small_batches, materialise
from .text import _LOWER, mix64, slices

#: Part of the texts, by their hash, that proposes phrases, and the fewest occurrences there. They bear on what each full
#: pass counts, never on the result.
SAMPLE, SAMPLE_COUNT = 1 / 16, 2
SALTS = 64
#: Bytes of text for each bucket of hashes, which one task counts at a time.
BUCKET_BYTES = 16 << 20
#: Occurrences by hash, and bytes of phrases, that a task holds before it deals them out to the buckets.
HELD, HELD_BYTES = 1 << 22, 16 << 20
_NEXT = np.uint64(0xA24BAED4963EE407)
_WORD, _GAP, _CUT = 0, 1, 2
_KIND = np.full(256, _WORD, np.uint8)
_KIND[[0x20, 0x09]] = _GAP
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = _CUT
_HASHED, _ROWS = "size int, h long", "lang string, size int, phrase string, n long"
_PACKED = pa.ipc.IpcWriteOptions(compression="zstd")


class All:
    """The filter that lets every phrase through."""

    def test(self, h: np.ndarray) -> np.ndarray:
        return np.ones(len(h), bool)


def passed(filters: dict[int, bloom.Blocked | All], size: int, h: np.ndarray) -> np.ndarray:
    return filters[size].test(h) if size in filters else np.zeros(len(h), bool)


def lang_hashes(langs: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x, 7) for x in langs], np.uint64)


class Worded:
    """The words of texts in lower case, and the distinct ones of each lang."""

    def __init__(self, texts: list[bytes], lang: np.ndarray, langs: list[str]):
        data, bounds = terms.joined(texts)
        data = _LOWER[data]
        kind = _KIND[data]
        cut = kind == _CUT
        self.w = w = terms.runs(data, bounds, kind == _WORD)
        cuts = np.cumsum(cut, dtype=np.int32 if len(cut) < 1 << 31 else np.int64)[w.start]
        #: whether each word follows the one before it in its piece
        self.follows = np.concatenate([[False], (cuts[1:] == cuts[:-1]) & (w.doc[1:] == w.doc[:-1])]) if len(w.ids) else np.zeros(0, bool)
        self.lang, self.langs = lang[w.doc], langs
        #: of the distinct words: the first place, the hash and how often each occurs; and the number of each word
        self.at, self.number, self.n = terms.numbered(self.lang * len(w.terms) + w.ids)
        self.h = mix64(terms.hashes(w.terms)[w.ids[self.at]] + lang_hashes(langs)[self.lang[self.at]]) if len(w.ids) else np.zeros(0, np.uint64)


def border(s: Worded, proposed: dict, most: int, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """(size, hashes) of the occurrences of all words, and of longer phrases whose two longest parts, without their last
    and without their first word, pass; of words `least` of each at most."""
    yield 1, np.repeat(s.h, np.minimum(s.n, least))
    word = s.h[s.number]
    good, h = passed(proposed, 1, s.h)[s.number], word
    for size in range(2, most + 1):
        both = good[:-1] & good[1:]
        pos = np.flatnonzero(both & s.follows[1:] if size == 2 else both)
        if not len(pos):
            return
        own = mix64(h[pos] * _NEXT + word[pos + size - 1])
        yield size, own
        if size < most:
            h, good = np.zeros(len(word), np.uint64), np.zeros(len(word), bool)
            h[pos], good[pos] = own, passed(proposed, size, own)


def left(s: Worded, proposed: dict | None, known: dict, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(size, hashes, first places, n) of the phrases that may be frequent: those that `border` tells and that pass `known`,
    and those that it does not tell and whose two longest parts may be frequent. Without `proposed` it told all."""
    h, inverse, word = s.h, s.number, s.number
    live, good = passed(known, 1, h), np.ones(len(h), bool) if proposed is None else passed(proposed, 1, h)
    yield 1, h[live], s.at[live], s.n[live]
    for size in range(2, most + 1):
        mine = live[inverse] & (inverse >= 0)
        both = mine[:-1] & mine[1:]
        pos = np.flatnonzero(both & s.follows[1:] if size == 2 else both)
        if not len(pos):
            return
        first, number, n = terms.numbered(inverse[pos] * len(h) + inverse[pos + 1])
        at = pos[first]
        told = good[inverse[at]] & good[inverse[at + 1]]
        h = mix64(h[inverse[at]] * _NEXT + s.h[word[at + size - 1]])
        live = ~told
        live[told] = passed(known, size, h[told])
        yield size, h[live], at[live], n[live]
        if size < most:
            good = told
            if proposed is not None:
                good[told] = passed(proposed, size, h[told])
            inverse = np.full(len(word), -1)
            inverse[pos] = number


def by_lang(batch: pa.RecordBatch) -> tuple[list[str], np.ndarray]:
    own = batch.column(0).dictionary_encode()
    return own.dictionary.to_pylist(), own.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def worded(batches: Iterator[pa.RecordBatch], slice_bytes: int) -> Iterator[Worded]:
    for batch, texts in slices(batches, "text", slice_bytes):
        langs, code = by_lang(batch)
        yield Worded(texts, code, langs)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def dealt(size: int, rows: pa.RecordBatch, bucket: np.ndarray, buckets: int) -> pa.RecordBatch:
    """rows, whose buckets ascend, packed by bucket."""
    edge = np.searchsorted(bucket, np.arange(buckets + 1, dtype=bucket.dtype))
    some = np.flatnonzero(np.diff(edge))
    blobs = []
    for a, b in zip(edge[some].tolist(), edge[some + 1].tolist()):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=_PACKED) as out:
            out.write_batch(rows.slice(a, b - a))
        blobs.append(sink.getvalue().to_pybytes())
    sizes = pa.array(np.full(len(some), size, np.int32))
    return pa.RecordBatch.from_arrays([sizes, pa.array(some.astype(np.int32)), pa.array(blobs, pa.binary())], names=["size", "bucket", "blob"])


def undealt(t: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in t["blob"]])


def runs_of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of an ascending array, and how often each occurs."""
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.diff(np.append(first, len(h)))


def count(docs: DataFrame, proposed: dict, most: int, least: int, slice_bytes: int, buckets: int) -> DataFrame:
    """size and h of the hashes that `border` tells `least` times or more.

    Each task tells its hashes sorted, with how often each occurs there, packed by bucket. More than `least` tell nothing
    more than `least`, so a bucket is counted by a sort of its hashes, each repeated as often as it occurs or `least` times.
    """
    held = docs.sparkSession.sparkContext.broadcast(proposed)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list[np.ndarray]] = {}

        def packed() -> Iterator[pa.RecordBatch]:
            for size in list(kept):
                h = np.concatenate(kept.pop(size))
                h.sort()
                h, n = runs_of(h)
                rows = pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.minimum(n, least).astype(np.int32))], names=["h", "n"])
                yield dealt(size, rows, bucket_of(h, buckets), buckets)

        for s in worded(batches, slice_bytes):
            for size, h in border(s, held.value, most, least):
                kept.setdefault(size, []).append(h)
            if sum(len(h) for x in kept.values() for h in x) >= HELD:
                yield from packed()
        yield from packed()

    def counted(key, t: pa.Table) -> pa.Table:
        rows = undealt(t)
        h = np.repeat(rows["h"].to_numpy(), rows["n"].to_numpy())
        h.sort()
        h, n = runs_of(h)
        h = h[n >= least]
        return pa.table({"size": pa.array(np.full(len(h), key[0].as_py(), np.int32)), "h": pa.array(h.view(np.int64))})

    rows = docs.mapInArrow(told, "size int, bucket int, blob binary")
    return rows.groupBy("size", "bucket").applyInArrow(lambda key, t: counted(key, t), _HASHED)


def spelled(docs: DataFrame, known: dict, most: int, least: int, slice_bytes: int, proposed: dict | None = None, buckets: int = 1) -> DataFrame:
    """lang, size, phrase and n of the phrases that `left` tells and that occur `least` times or more, by size 0 the words
    of each lang. Counted by the phrases themselves, so hashes that two phrases share do no harm."""
    held = docs.sparkSession.sparkContext.broadcast((proposed, known))

    def spelt(s: Worded) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
        """(hashes, phrases, n), behind each phrase a line end, which none holds, and its lang."""
        words, langs = s.w.terms.cast(pa.large_string()), pa.array(s.langs, pa.large_string())
        told = lambda phrase, code: pa.compute.binary_join_element_wise(phrase, langs.take(pa.array(code)), pa.scalar("\n", pa.large_string()))
        total = np.bincount(s.lang, minlength=len(langs))
        yield lang_hashes(s.langs), told(pa.array([""] * len(langs), pa.large_string()), np.arange(len(langs))), total
        last = told(words.take(pa.array(s.w.ids[s.at])), s.lang[s.at])
        for size, h, at, n in left(s, *held.value, most):
            parts = [words.take(pa.array(s.w.ids[at + k])) for k in range(size - 1)] + [last.take(pa.array(s.number[at + size - 1]))]
            yield h, parts[0] if size == 1 else pa.compute.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())), n

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []

        def packed() -> Iterator[pa.RecordBatch]:
            if kept:
                h, phrase, n = zip(*kept)
                kept.clear()
                bucket = bucket_of(np.concatenate(h), buckets).astype(np.uint16 if buckets < 1 << 16 else np.uint32)
                order = np.argsort(bucket, kind="stable")
                rows = pa.RecordBatch.from_arrays([pa.concat_arrays(phrase).take(pa.array(order)), pa.array(np.concatenate(n)[order])], names=["phrase", "n"])
                yield dealt(0, rows, bucket[order], buckets)

        for s in worded(batches, slice_bytes):
            if len(s.w.ids):
                kept.extend(spelt(s))
            if sum(phrase.nbytes for _, phrase, _ in kept) >= HELD_BYTES:
                yield from packed()
        yield from packed()

    def counted(t: pa.Table) -> pa.Table:
        rows = undealt(t)
        own = rows["phrase"].combine_chunks().dictionary_encode()
        n = np.zeros(len(own.dictionary), np.int64)
        np.add.at(n, own.indices.to_numpy(), rows["n"].to_numpy())
        ok = (n >= least) | np.asarray(pa.compute.starts_with(own.dictionary, "\n"))
        parts = pa.compute.split_pattern(own.dictionary.filter(pa.array(ok)), "\n", max_splits=1)
        phrase, lang = (pa.compute.list_element(parts, k).cast(pa.string()) for k in range(2))
        size = pa.compute.add(pa.compute.count_substring(phrase, " "), pa.compute.not_equal(phrase, "").cast(pa.int32()))
        return pa.table({"lang": lang, "size": size.cast(pa.int32()), "phrase": phrase, "n": n[ok]})

    rows = docs.mapInArrow(told, "size int, bucket int, blob binary")
    return rows.groupBy("bucket").applyInArrow(lambda t: counted(t), _ROWS)


def frequent(docs: DataFrame, most: int, least: int, sample: float = SAMPLE, sample_count: int = SAMPLE_COUNT, slice_bytes: int = 2 << 20, filter_bytes: int = bloom.MOST_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """lang, size, phrase and n of all phrases of 1 to `most` words that occur `least` times or more, exactly; with size 0
    the words of each lang.

    Toivonen's mining. Phrases with sample_count occurrences in the sample are proposed. A full pass counts them and
    their negative border: the phrases not proposed whose longest parts all are, that is all words, all pairs of proposed
    words and so on. A border phrase that turns out frequent is a failure: phrases that the first pass did not count may be
    frequent then, whose longest parts are frequent or were not counted either. One more pass counts just these, together
    with those that are frequent already, whatever the number of words.

    The first pass counts by 64-bit hashes, and phrases travel as Bloom filters of bounded size; shared hashes and what
    filters let through besides only add phrases to the last pass, which counts by the phrases themselves and drops them.
    """
    own = in_small_batches(docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text"))
    buckets = max(1, math.ceil((own.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / bucket_bytes))
    hashed = lambda batch: (np.asarray(batch.column(0)), np.asarray(batch.column(1)).view(np.uint64))
    drawn = own.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < round(sample * (1 << 20)))
    every = {k: All() for k in range(1, most)}
    some = materialise(count(drawn, every, max(1, most - 1), sample_count, slice_bytes, max(1, math.ceil(buckets * sample))), "proposals")
    proposed = bloom.build(some, hashed, filter_bytes)
    found = materialise(count(own, proposed, most, least, slice_bytes, buckets), "phrases")
    return materialise(spelled(own, bloom.build(found, hashed, filter_bytes), most, least, slice_bytes, proposed, buckets), "spelled")


def part(start: Column, length: Column) -> Column:
    """The `length` words of a phrase from the start-th, counted from 1."""
    return F.call_function("substring_index", F.call_function("substring_index", F.col("phrase"), F.lit(" "), start + length - 1), F.lit(" "), -length)


def keyed(rows: DataFrame) -> DataFrame:
    """rows with a hash of lang and phrase, by which joins sort faster than by the phrases; these are compared all the same."""
    return rows.withColumn("key", F.xxhash64("lang", "phrase"))


def collocations(docs: DataFrame, most: int = 3, least: int = 10, share: int = 50, top: int = 2000, **mining) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each lang's `top` phrases of 2 to `most` words.

    Texts are lower-cased (A-Z), split into pieces at .,;:!? and line ends, and those into words at spaces and tabs.
    a: the phrase's occurrences, `least` or more; n: all words of the lang; l and r: the occurrences of its parts, cut
    where floor(1000000 * a * a / (l * r)), the score, is least (ties: at the first such word). Phrases that stand in a
    longer candidate of at least `share` percent of their occurrences are left out. Ranks follow score and a, both
    descending, then the phrase by its bytes.

    A null lang is `und`, together with a lang of that name. Null and empty texts hold no words; repeated rows count
    each time. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    found = frequent(docs, most, least, **mining)
    words = found.where("size = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    counts = keyed(found.where("size > 0").select("lang", "size", "phrase", F.col("n").alias("a")))
    own = counts.where("size > 1")

    # the longest-lived phrase around each part of a longer candidate
    lengths = F.sequence(F.lit(2), F.col("size") - 1)
    inner = F.flatten(F.transform(lengths, lambda k: F.transform(F.sequence(F.lit(1), F.col("size") - k + 1), lambda i: part(i, k))))
    around = keyed(own.where("size > 2").select("lang", F.explode(inner).alias("phrase"), "a")).groupBy("key", "lang", "phrase").agg(F.max("a").alias("longer"))
    own = own.join(around, ["key", "lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))).drop("longer")

    cuts = own.drop("key").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        # a part that very many phrases share makes a large partition, which Spark splits: counts has each part once
        parts = counts.select("key", "lang", F.col("phrase").alias(side), F.col("a").alias(name))
        cuts = cuts.withColumn("key", F.xxhash64("lang", side)).join(parts, ["key", "lang", side]).drop("key", side)
    wide = {x: f"cast({x} as decimal(38,0))" for x in "alr"}
    cuts = cuts.withColumn("score", F.expr(f"({wide['a']} * {wide['a']} * 1000000) div ({wide['l']} * {wide['r']})").cast("long"))
    order = F.col("score") * most + F.col("k")  # a score is at most 1000000, as a phrase is no more frequent than its parts
    rows = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min_by("l", order).alias("l"), F.min_by("r", order).alias("r"), F.min("score").alias("score"))

    # the first of each salt's phrases, then the first of all
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return attach(ranked.drop("salt"), words, ["lang"], F.col("phrase"), "inner").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = """
WITH d AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), piece AS (
  SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS p FROM d)
), gram AS (
  SELECT lang, k, unnest([array_to_string(w[i : i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS phrase
  FROM piece, (VALUES (1), (2), (3)) AS sizes(k) WHERE len(w) >= k
), f AS (
  SELECT lang, k, phrase, count(*) AS a FROM gram GROUP BY ALL
), total AS (
  SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10
), kept AS (
  SELECT * FROM c WHERE NOT EXISTS (
    SELECT 1 FROM (
      SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM c WHERE k = 3
      UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE k = 3
    ) AS o WHERE o.lang = c.lang AND o.phrase = c.phrase AND c.k = 2 AND 100 * o.a >= 50 * c.a)
), cut AS (
  SELECT kept.lang, kept.phrase, kept.a, j, x.a AS l, y.a AS r,
         ((1000000::HUGEINT * kept.a * kept.a) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM kept JOIN (VALUES (1), (2)) AS places(j) ON j < kept.k
  JOIN f AS x ON x.lang = kept.lang AND x.phrase = array_to_string(w[1:j], ' ')
  JOIN f AS y ON y.lang = kept.lang AND y.phrase = array_to_string(w[j + 1 :], ' ')
), best AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
)
SELECT best.lang, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, n, score
FROM best JOIN total USING (lang)
QUALIFY rank <= 2000
"""
