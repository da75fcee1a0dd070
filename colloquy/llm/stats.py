"""Statistics of whole texts, for the quality rules and the quality classifier."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tables import in_small_batches
from .text import mix64, slices, words

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lower", "n_upper", "n_digits", "n_marks", "n_bang", "n_stops", "n_lines", "n_distinct", "n_word_runs")


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_SYMBOL = _class("#*$%&|<>")
_LOWER, _UPPER, _DIGIT = _class("abcdefghijklmnopqrstuvwxyz"), _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789")
_MARK, _BANG, _STOP, _LINE = _class(",;:'\"()-"), _class("!?"), _class("."), _class("\n")


def counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The COUNTS of each text: characters are code points, words and lines as in text.words and split at \\n.

    n_repeat_words: words in 3-word windows that the text holds twice or more. n_word_runs: words equal to the
    word before. n_distinct: different words.
    """
    w = words(texts)
    h, doc, first = w.hashes(), w.doc, w.first

    def per_text(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[w.bounds[1:]] - total[w.bounds[:-1]]

    def per_word(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[first[1:]] - total[first[:-1]]

    begins = (w.data & 0xC0) != 0x80
    total = np.concatenate([[0], np.cumsum(begins)])
    n = len(h)
    in_repeat = np.zeros(n, bool)
    place = mix64(doc.astype(np.uint64) + np.uint64(1))
    if n >= 3:
        key = mix64(h[:-2] + mix64(h[1:-1] + mix64(h[2:]))) ^ place[:-2]
        at = np.flatnonzero(doc[:-2] == doc[2:])
        _, inverse, n_same = np.unique(key[at], return_inverse=True, return_counts=True)
        again = at[n_same[inverse] > 1]
        for k in range(3):
            in_repeat[again + k] = True
    seen = np.zeros(n, bool)
    seen[np.unique(h ^ place, return_index=True)[1]] = True
    run = np.zeros(n, bool)
    run[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    dup_lines = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if b"\n" in text:
            lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
            dup_lines[i] = len(lines) - len(set(lines))
    out = {
        "n_words": w.count, "word_chars": per_word(total[w.end] - total[w.start]), "n_symbols": per_text(_SYMBOL[w.data]), "n_dup_lines": dup_lines, "n_repeat_words": per_word(in_repeat),
        "n_chars": per_text(begins), "n_lower": per_text(_LOWER[w.data]), "n_upper": per_text(_UPPER[w.data]), "n_digits": per_text(_DIGIT[w.data]), "n_marks": per_text(_MARK[w.data]),
        "n_bang": per_text(_BANG[w.data]), "n_stops": per_text(_STOP[w.data]), "n_lines": per_text(_LINE[w.data]), "n_distinct": per_word(seen), "n_word_runs": per_word(run),
    }
    return {k: v.astype(np.int64) for k, v in out.items()}


def text_stats(docs: DataFrame, keep: dict[str, str]) -> DataFrame:
    """The columns named in keep (name to type) and the COUNTS of each row's text; null texts are empty."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            found = counts(texts)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *(pa.array(found[c]) for c in COUNTS)], names=[*keep, *COUNTS])

    schema = ", ".join([*(f"`{k}` {t}" for k, t in keep.items()), *(f"{c} long" for c in COUNTS)])
    return in_small_batches(docs.select(*keep, "text")).mapInArrow(counted, schema)
