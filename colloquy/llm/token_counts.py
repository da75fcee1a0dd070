"""Token counts of documents: pieces once for each distinct pre-token, joined to each document's pre-tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import terms
from .tables import in_small_batches, materialise
from .text import _SPACE, slices

LIMIT = 2048
#: Most bytes of the pre-tokens that every task holds, the most frequent ones; all others are joined by a shuffle.
HEAD_BYTES = 24 << 20
#: Bytes that a held pre-token takes besides its own, about.
ENTRY_BYTES = 100
#: Most words whose pre-tokens a worker remembers.
REMEMBERED = 1 << 17
#: Kinds of bytes: white space, letters, digits, other marks, and those whose words are split one by one.
_SPACES, _LETTERS, _DIGITS, _MARKS, _HARD = range(5)
_KIND = np.full(256, _HARD, np.uint8)
_KIND[0x21:0x7F] = _MARKS
_KIND[_SPACE] = _SPACES
_KIND[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = _LETTERS
_KIND[[*b"0123456789"]] = _DIGITS
_KIND[[*b"'<"]] = _HARD


class Pieces:
    """Pre-tokens of words and pieces of pre-tokens by a tokenizer file.

    A text's tokens are those of its runs between ASCII white space, as the file drops white space and looks at no
    character beyond it; that is checked on hard texts when the file is loaded. Runs with a special token's string
    are pre-tokens by themselves and go through the whole tokenizer. Runs of ASCII and Latin letters, digits and marks are
    split where kinds of bytes change, if all pairs of such characters show that the file splits so; others by the tokenizer.
    """

    PROBES = (
        "", " ", "a b", "It's we'll they'd I'M don't ''s 'S x'Ve", "abc123 4567.89 1,000 ٣٤", "Straße Été é naïve ́x ΣΣ İI",
        "中文字符 日本語テキスト 한국어", "\U0001f600\U0001f469‍\U0001f52c!", "a b c　d\u0085e\x1cf\x00g\x7fh", "***$$$ %%% &&& ###|||",
        "<|endoftext|> x<|startoftext|>y <|EndOfText|> <|end oftext|>", "tab\there\r\nnew \x0b\x0c lines\n\n\n", "x" * 300 + " " * 50 + "y_z-w(q)\"`~^{}[]\\/", " ́ 가 q̣̇",
    )
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.seen: dict[str, list[str]] = {}
        self.plain = self.splits_by_kind()
        for text in self.PROBES:
            if self.total(text) != len(self.tokenizer.encode(text, add_special_tokens=False).ids):
                raise ValueError(f"{path}: tokens of a text are not those of its words")

    def splits_by_kind(self) -> bool:
        """Whether pairs of characters that are not hard are split by kind alone."""
        chars = [chr(x) for x in range(0x21, 0x100) if x < 0x7F and _KIND[x] != _HARD or x >= 0xC0 and x not in (0xD7, 0xF7)]
        words = [x + y for x in chars for y in chars]
        units = plain_units(*terms.joined([w.encode() for w in words]), True)
        names = units.terms.cast(pa.large_string()).to_pylist()
        own = [[] for _ in words]
        for doc, i in zip(units.doc.tolist(), units.ids.tolist()):
            own[doc].append(names[i])
        return not any("<" in t or not t.isascii() for t in self.special if t[:1] != "<") and all(self.by_library(w) == x for w, x in zip(words, own))

    def by_library(self, word: str) -> list[str]:
        t = self.tokenizer
        plain = t.normalizer.normalize_str(word) if t.normalizer else word
        return [plain[a:b] for _, (a, b) in t.pre_tokenizer.pre_tokenize_str(plain)]

    def split(self, word: str) -> list[str]:
        """The pre-tokens of a run without white space."""
        if any(s in word for s in self.special):
            return [word]
        return self.by_library(word)

    def count(self, pre_token: str) -> int:
        """The tokens of a pre-token."""
        return len(self.tokenizer.encode(pre_token, add_special_tokens=False).ids)

    def total(self, text: str) -> int:
        return sum(self.count(p) for w in re.split(r"[\x20\x09-\x0D]+", text) if w for p in self.split(w))

    def remembered(self, word: str) -> list[str]:
        out = self.seen.get(word)
        if out is None:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            out = self.seen[word] = self.split(word)
        return out


_PIECES: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One tokenizer for all tasks of a worker."""
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def plain_units(data: np.ndarray, bounds: np.ndarray, plain: bool) -> terms.Runs:
    """The units of texts: pre-tokens of words of plain characters, in small letters, and whole words that hold a hard one."""
    kind = _KIND[data]
    pair = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7))  # letters of U+00C0 to U+00FF
    kind[pair] = kind[pair + 1] = _LETTERS
    inside = kind != _SPACES
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    before = np.concatenate([[False], inside[:-1]])
    word = np.flatnonzero(inside & (~before | edge[:-1]))
    hard = np.logical_or.reduceat((kind == _HARD) | (not plain), word) if len(word) else np.zeros(0, bool)
    easy = np.repeat(~hard, np.diff(np.append(word, len(data)))) if len(word) else np.zeros(0, bool)
    easy = np.concatenate([np.zeros(len(data) - len(easy), bool), easy]) & inside
    low = data.copy()
    low[easy & (data >= 0x41) & (data <= 0x5A)] += 0x20
    pair = pair[easy[pair] & (data[pair + 1] <= 0x9E)] + 1
    low[pair] += 0x20
    start = inside & (~before | edge[:-1])
    start[1:] |= easy[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGITS))
    at = np.flatnonzero(start)
    size = np.add.reduceat(inside, at, dtype=np.int64) if len(at) else np.zeros(0, np.int64)
    encoded = terms.binary(low[inside], size).dictionary_encode()
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(np.searchsorted(at, bounds)))
    return terms.Runs(encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), at, doc, easy[at])


def frequencies(texts: list[bytes], split, plain: bool) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pre-tokens of texts, and rows (text, pre-token, occurrences)."""
    w = plain_units(*terms.joined(texts), plain)
    if not len(w.ids):
        return pa.array([], pa.large_string()), *(np.zeros(0, np.int64) for _ in range(3))
    easy = np.zeros(len(w.terms), bool)
    easy[w.ids[w.easy]] = True  # a hard word and a plain unit are never the same bytes
    own = w.terms.cast(pa.large_string())
    hard = [split(x) for x in own.filter(pa.array(~easy)).to_pylist()]
    size, begin = np.ones(len(easy), np.int64), np.zeros(len(easy), np.int64)
    size[~easy] = np.fromiter(map(len, hard), np.int64, len(hard))
    begin[easy] = np.arange(easy.sum())
    begin[~easy] = easy.sum() + np.cumsum(size[~easy]) - size[~easy]
    flat = pa.concat_arrays([own.filter(pa.array(easy)), pa.array([p for x in hard for p in x], pa.large_string())]).dictionary_encode()
    number = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    names = max(1, len(flat.dictionary))
    at, _, n = terms.numbered(w.doc * len(easy) + w.ids)
    doc, unit = w.doc[at], w.ids[at]
    key = np.repeat(doc, size[unit]) * names + number[terms.repeated(begin[unit], size[unit])]
    first, inverse, _ = terms.numbered(key)
    total = np.bincount(inverse, np.repeat(n, size[unit]), len(first)).astype(np.int64)
    return flat.dictionary, key[first] // names, key[first] % names, total


def vocabulary(docs: DataFrame, tokenizer: str, slice_bytes: int) -> DataFrame:
    """pre_token, n (occurrences in all texts) and pieces (its tokens), once for each distinct pre-token."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, plain = pieces(tokenizer).remembered, pieces(tokenizer).plain
        for _, texts in slices(batches, "text", slice_bytes):
            names, _, number, n = frequencies(texts, split, plain)
            total = np.bincount(number, n, len(names)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([names.cast(pa.string()), pa.array(total)], names=["pre_token", "n"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = pieces(tokenizer).count
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([count(p) for p in batch.column(0).to_pylist()], pa.int64())], names=["pre_token", "n", "pieces"])

    rows = in_small_batches(docs.select("text")).mapInArrow(told, "pre_token string, n long")
    return rows.groupBy("pre_token").agg(F.sum("n").alias("n")).mapInArrow(counted, "pre_token string, n long, pieces long")


def head(known: DataFrame, most: int) -> int:
    """The least n, a power of two, so that all pre-tokens of that many occurrences take `most` bytes together or fewer."""
    level = F.floor(F.log2("n")).cast("int").alias("level")
    held = sorted(known.groupBy(level).agg(F.sum(F.octet_length("pre_token") + ENTRY_BYTES).alias("bytes")).collect(), reverse=True)
    least, total = 62, 0
    for r in held:
        total += r.bytes
        if total > most:
            break
        least = r.level
    return 1 << least


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT, head_bytes: int = HEAD_BYTES, slice_bytes: int = 2 << 20) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of each row's whole text.

    n_tokens is what the tokenizer file gives without added special tokens; special strings inside texts are tokens, as is the
    library's default. Each distinct pre-token's pieces are counted once. The most frequent pre-tokens, at most
    head_bytes of them, are looked up by the tasks that split the texts; the others, none of which holds a great
    part of all rows, join by a shuffle. No ids are kept.

    docs is a table or another frame whose partitions do not change when they are computed again.

    Null and empty texts have no tokens and no bytes. Rows are counted each by its place, so repeated rows and null or
    shared doc_ids each keep their own count. An empty table gives no rows. Other columns are ignored.
    """
    known = materialise(vocabulary(docs, tokenizer, slice_bytes), "pre-tokens")
    least = head(known, head_bytes)
    held = dict(known.where(F.col("n") >= least).select("pre_token", "pieces").toLocalIterator())
    held = docs.sparkSession.sparkContext.broadcast(held)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, plain, frequent = pieces(tokenizer).remembered, pieces(tokenizer).plain, held.value
        task, at = TaskContext.get().partitionId() << 40, 0
        for batch, texts in slices(batches, "text", slice_bytes):
            names, doc, number, n = frequencies(texts, split, plain)
            each = np.array([frequent.get(p, -1) for p in names.to_pylist()] or [0], np.int64)
            own = each[number]
            rare = np.flatnonzero(own < 0)
            total = np.zeros(len(texts), np.int64)
            np.add.at(total, doc, np.maximum(own, 0) * n)
            place = task + at + np.arange(len(texts))
            at += len(texts)
            some = names.take(pa.array(number[rare])).cast(pa.string())
            none = lambda kind, k: pa.nulls(k, kind)
            rows = [
                pa.concat_arrays([pa.array(place), pa.array(place[doc[rare]])]),
                pa.concat_arrays([batch.column(0), none(pa.int64(), len(rare))]),
                pa.concat_arrays([pa.array([len(x) for x in texts], pa.int64()), none(pa.int64(), len(rare))]),
                pa.concat_arrays([none(pa.string(), len(texts)), some]),
                pa.concat_arrays([pa.array(total), pa.array(n[rare])]),
            ]
            yield pa.RecordBatch.from_arrays(rows, names=["place", "doc_id", "n_bytes", "pre_token", "n"])

    rows = in_small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(told, "place long, doc_id long, n_bytes long, pre_token string, n long")
    # a document's own row meets no pre-token; pre-tokens hold no space, so it goes to a task by its place
    keyed = rows.withColumn("key", F.coalesce("pre_token", F.concat(F.lit(" "), F.col("place").cast("string"))))
    rare = known.where(F.col("n") < least).select(F.col("pre_token").alias("key"), "pieces")
    met = keyed.join(rare, "key", "left").select("place", "doc_id", "n_bytes", (F.col("n") * F.coalesce("pieces", F.lit(1))).alias("n"))
    one = met.groupBy("place").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
    return one.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
