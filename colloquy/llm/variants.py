"""Spelling variants: words one edit apart, found by probing Bloom filters of each length and joined exactly."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom, terms
from .tables import in_small_batches, materialise
from .text import _LOWER, mix64, slices

#: The characters of words once A-Z is lower-cased.
ALPHABET = np.array([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)], np.uint64)
_BASE = np.uint64(0x9FB21C651E98DF25)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_VALUE = np.random.default_rng(20250203).integers(1, 2**63, 0x100, dtype=np.uint64) | np.uint64(1)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
#: Most probes at once.
PROBES = 1 << 20


def spoiled(word: str, h: int) -> str:
    """word without its code point h % length."""
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def vocabulary(docs: DataFrame, shortest: int, least: int, slips: int, slice_bytes: int = 2 << 20) -> DataFrame:
    """word and n of the words of `shortest` code points or more that occur `least` times or more."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text", slice_bytes):
            prefix = [zlib.crc32(f"{i}:".encode()) for i in batch.column(0).to_pylist()]
            data, bounds = terms.joined(texts)
            data = _LOWER[data]
            lead = data == 0xC3  # U+00C0 to U+00FF, with the byte behind it
            inside = _LETTER[data] | lead
            inside[1:] |= lead[:-1]
            w = terms.runs(data, bounds, inside)
            names = w.terms.cast(pa.large_string()).to_pylist()
            long = np.fromiter((len(x) >= shortest for x in names), bool, len(names))
            some = long[w.ids] if len(names) else np.zeros(0, bool)
            pair, n = np.unique(w.doc[some] * max(1, len(names)) + w.ids[some], return_counts=True)
            doc, word = pair // max(1, len(names)), pair % max(1, len(names))
            raw, crc = w.terms.to_pylist(), zlib.crc32
            h = np.fromiter((crc(raw[i], prefix[d]) for i, d in zip(word.tolist(), doc.tolist())), np.int64, len(pair))
            slip = np.flatnonzero(h % slips == 0)
            plain = np.bincount(word, n, len(names)).astype(np.int64)
            np.subtract.at(plain, word[slip], n[slip])
            out = [(names[i], n_) for i, n_ in enumerate(plain.tolist()) if n_]
            out += [(spoiled(names[word[k]], int(h[k])), int(n[k])) for k in slip.tolist()]
            out = [(x, n_) for x, n_ in out if len(x) >= shortest]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([k for _, k in out], pa.int64())], names=["word", "n"])

    own = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    rows = in_small_batches(own).mapInArrow(told, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of all words, where each word begins, and its length."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4"), np.concatenate([[0], np.cumsum(size)]), size


def sealed(h: np.ndarray, size: np.ndarray) -> np.ndarray:
    return mix64(h + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def terms_of(code: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each code point's place in its word, base^place, and its term of the word's hash."""
    place = np.arange(len(code)) - np.repeat(at[:-1], size)
    power = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(int(size.max(initial=1)) - 1, 0), _BASE)]))[place]
    return place, power, _VALUE[code] * power


def word_hashes(words: list[str]) -> np.ndarray:
    code, at, size = codes(words)
    if not len(code):
        return np.zeros(len(words), np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms_of(code, at, size)[2])])
    return sealed(total[at[1:]] - total[at[:-1]], size)


def edits(words: list[str], filters: dict[int, bloom.Blocked]) -> Iterator[tuple[int, str]]:
    """(word's number, its edit) of deletions, and of replacements by a later letter, that pass their length's filter.

    An edit's hash follows from the word's by the changed letter's term alone, so the edit itself is written only if it
    passes. The insertions and the other replacements are these edits, seen from the other word.
    """
    code, at, size = codes(words)
    place, power, term = terms_of(code, at, size)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(term)])
    owner = np.repeat(np.arange(len(words)), size)
    whole = (total[at[1:]] - total[at[:-1]])[owner]
    before = total[:-1] - total[at[:-1]][owner]
    after = whole - before - term
    for k, f in filters.items():
        shorter = np.flatnonzero(size[owner] == k + 1)
        hit = shorter[f.test(sealed(before[shorter] + after[shorter] * _INVERSE, size[owner[shorter]] - 1))]
        # deleting either of two equal neighbours is one edit
        hit = hit[(place[hit] == 0) | (code[hit] != code[np.maximum(hit - 1, 0)])]
        for i in hit.tolist():
            w, p = words[owner[i]], place[i]
            yield int(owner[i]), w[:p] + w[p + 1 :]
        same = np.flatnonzero(size[owner] == k)
        for lo in range(0, len(same), max(1, PROBES // len(ALPHABET))):
            pos = same[lo : lo + max(1, PROBES // len(ALPHABET))]
            row, letter = np.nonzero(ALPHABET[None, :] > code[pos].astype(np.uint64)[:, None])
            changed = whole[pos][row] - term[pos][row] + _VALUE[ALPHABET[letter].astype(np.int64)] * power[pos][row]
            ok = f.test(sealed(changed, size[owner[pos]][row]))
            for r, c in zip(row[ok].tolist(), ALPHABET[letter[ok]].tolist()):
                i = pos[r]
                w, p = words[owner[i]], place[i]
                yield int(owner[i]), w[:p] + chr(int(c)) + w[p + 1 :]


def neighbours(vocab: DataFrame, most: int = bloom.MOST_BYTES) -> DataFrame:
    """word, n, other and m of all words of vocab(word, n) that differ by one inserted, deleted or replaced code point,
    both ways round. Words consist of ALPHABET.

    Each word's edits are probed against broadcast filters, one for each length, of `most` bytes in all; those that pass
    are joined with the vocabulary, which drops the false ones. Fuller filters cost more such rows and no result.
    """

    def hashed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        words = batch.column(0).to_pylist()
        return np.fromiter(map(len, words), np.int32, len(words)), word_hashes(words)

    held = vocab.sparkSession.sparkContext.broadcast(bloom.build(vocab.select("word"), hashed, most))

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 2048):
                rows = batch.slice(lo, 2048)
                words, sizes = rows.column(0).to_pylist(), set()
                for w in words:
                    sizes |= {len(w), len(w) - 1}
                found = list(edits(words, {k: f for k, f in held.value.items() if k in sizes}))
                number = pa.array([i for i, _ in found], pa.int64())
                yield pa.RecordBatch.from_arrays([rows.column(0).take(number), rows.column(1).take(number), pa.array([x for _, x in found], pa.string())], names=["word", "n", "other"])

    maybe = vocab.mapInArrow(probed, "word string, n long, other string")
    pairs = maybe.join(vocab.select(F.col("word").alias("other"), F.col("n").alias("m")), "other").select("word", "n", "other", "m")
    both = F.explode(F.array(F.struct("word", "n", "other", "m"), F.struct(F.col("other").alias("word"), F.col("m").alias("n"), F.col("word").alias("other"), F.col("n").alias("m"))))
    return pairs.select(both.alias("pair")).select("pair.*")


def spellings(docs: DataFrame, shortest: int = 7, least: int = 2, ratio: int = 10, slips: int = 31, most: int = bloom.MOST_BYTES) -> DataFrame:
    """word, form, root, n, n_near and form_n of the words of all texts.

    Runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased. If `slips` divides the crc32 of `<doc_id>:<run>`, the run
    loses the code point at that number modulo its length. Words: the results of `shortest` code points or more that
    occur `least` times or more (n). n_near: words one inserted, deleted or replaced code point away. form: the most
    frequent of these (ties: the first by code points), if it occurs ratio * n times or more; root: where forms lead.

    Null and empty texts have no words; a null doc_id is the empty string; repeated rows count each time. Words of any
    length take part. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    vocab = materialise(vocabulary(docs, shortest, least, slips), "vocabulary")
    near = neighbours(vocab, most).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    own = vocab.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.other").alias("other"), (-F.col("best.m")).alias("m"))
    far = F.col("m") >= ratio * F.col("n")
    own = materialise(own.select("word", "n", "n_near", F.when(far, F.col("other")).alias("form"), F.when(far, F.col("m")).alias("form_n")), "forms")
    # each form occurs `ratio` times as often as its word, so few doublings reach every root
    root = own.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        step = root.select(F.col("word").alias("root"), F.col("root").alias("next"))
        root = materialise(root.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if root.where("moved").isEmpty():
            break
        root = root.drop("moved")
    return own.join(root.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
