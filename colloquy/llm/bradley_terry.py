"""Quality classifier: Bradley-Terry ranking learned from preference pairs of labelled documents."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import COUNTS, text_stats
from .tables import in_small_batches, materialise

#: A document is good from this score on.
GOOD = 0.3
#: Documents of the larger class in a block of comparisons, the fewest of the other it meets, most of a class in one product.
BLOCK, RARE, PIECE = 128, 16, 1024
#: Ranges counted at once in looking for the threshold.
RANGES = 1024


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """Features of texts from their COUNTS alone."""
    c = {k: v.astype(float) for k, v in c.items()}

    def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return part / np.maximum(whole, 1)

    n, chars, letters = c["n_words"], c["n_chars"], c["n_lower"] + c["n_upper"]
    long = np.log1p(n)
    columns = [
        long, np.maximum(0, math.log(60) - long), np.log2(np.maximum(share(c["word_chars"], n), 0.5)), np.sqrt(share(c["n_symbols"], chars)), share(c["n_repeat_words"], n), share(c["n_dup_lines"], c["n_lines"] + 1),
        share(c["n_upper"], letters), share(letters, chars), np.sqrt(share(c["n_digits"], chars)), np.sqrt(share(c["n_marks"], chars)), np.sqrt(share(c["n_bang"], chars)), np.sqrt(share(c["n_stops"], n)), share(c["n_lines"], n),
        np.log1p(c["n_distinct"]) - long, share(c["n_word_runs"], n), (share(c["n_repeat_words"], n) > 0.5).astype(float), np.minimum(share(c["n_symbols"], n), 1), np.minimum(share(c["n_bang"], n), 1),
    ]
    return np.stack(columns, axis=1)


def newton(means: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], size: int, penalty: float, steps: int = 30) -> np.ndarray:
    """Weights of least mean loss: means gives the mean gradient and Hessian of all pairs at some weights."""
    w = np.zeros(size)
    for _ in range(steps):
        grad, hess = means(w)
        step = np.linalg.solve(hess + penalty * np.eye(size), grad - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(x: np.ndarray, good: np.ndarray, pairs: int, penalty: float, seed: int, steps: int = 30) -> dict[str, np.ndarray]:
    """The model of rows in memory from seeded (good, bad) pairs, for comparison; `learned` is what scores are made of.

    The threshold is the quantile of all training scores that is the share of bad documents. Without both
    classes all weights are zero.
    """
    centre, spread = x.mean(axis=0) if len(x) else np.zeros(x.shape[1]), np.maximum(x.std(axis=0), 1e-6) if len(x) else np.ones(x.shape[1])
    w, at = np.zeros(x.shape[1]), 0.0
    a, b = np.flatnonzero(good), np.flatnonzero(~good)
    if len(a) and len(b):
        z = (x - centre) / spread
        rng = np.random.default_rng(seed)
        d = z[rng.choice(a, pairs)] - z[rng.choice(b, pairs)]

        def means(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
            return d.T @ (1 - p) / pairs, (d * (p * (1 - p))[:, None]).T @ d / pairs

        w = newton(means, x.shape[1], penalty, steps)
        at = float(np.quantile(z @ w, len(b) / len(x)))
    return {"centre": centre, "spread": spread, "w": w, "threshold": np.asarray(at)}


def task_sums(rows: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum of `part` over all batches of rows; each task sends one array."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += part(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["total"])

    return np.sum([np.zeros(size), *(np.array(r.total) for r in rows.mapInArrow(told, "total array<double>").collect())], axis=0)


def _counted(batch: pa.RecordBatch) -> np.ndarray:
    return features({c: np.asarray(batch.column(c)) for c in COUNTS})


def compared(known: DataFrame, n_good: int, n_bad: int, centre: np.ndarray, spread: np.ndarray) -> DataFrame:
    """Blocks of labelled documents whose good ones are compared with their bad ones: `good` and `bad` hold their scaled features.

    The larger class is dealt by hash into blocks of about BLOCK documents, the smaller into as many groups, or fewer with
    about RARE each; every block has one group. So each document is compared with RARE or more of the other class, and work
    grows with the documents. A block of very many rows (of one doc_id) is several rows here, with all its pairs.
    """
    common, rare = (1, 0) if n_good >= n_bad else (0, 1)
    blocks = max(1, -(-max(n_good, n_bad) // BLOCK))
    groups = max(1, min(blocks, min(n_good, n_bad) // RARE))
    is_good = (F.col("quality") == 1).cast("int")
    dealt = lambda n: F.pmod(F.xxhash64("doc_id", F.lit("pairs")), F.lit(n).cast("long"))
    rows = known.select("draw", "doc_id", *COUNTS, is_good.alias("is_good"))
    many = rows.where(F.col("is_good") == common).withColumn("block", dealt(blocks))
    few = rows.where(F.col("is_good") == rare).withColumn("block", F.explode(F.sequence(dealt(groups), F.lit(blocks - 1).cast("long"), F.lit(groups).cast("long"))))

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("draw", "doc_id", *COUNTS)])
        z = (features({c: table.column(c).to_numpy() for c in COUNTS}) - centre) / spread
        mark = table.column("is_good").to_numpy() == 1
        cut = lambda x: [x[i : i + PIECE].tobytes() for i in range(0, len(x), PIECE)]
        pairs = [(a, b) for a in cut(z[mark]) for b in cut(z[~mark])]
        return pa.table({"good": pa.array([a for a, _ in pairs], pa.binary()), "bad": pa.array([b for _, b in pairs], pa.binary())})

    return materialise(many.unionByName(few).groupBy("block").applyInArrow(packed, "good binary, bad binary"), "compared")


def order_statistics(values: DataFrame, k: int) -> tuple[float, float]:
    """The value number k (from 0) and the next one in the order of all values s, by counts of ever narrower ranges."""
    s = F.col("s")
    lo, hi = values.agg(F.min("s"), F.max("s")).first()
    below = 0
    while lo < hi:
        within = values.where((s >= lo) & (s <= hi)).groupBy(F.floor((s - lo) / (hi - lo) * RANGES).alias("range"))
        for r in within.agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi")).orderBy("range").collect():  # RANGES + 1 rows at most
            if below + r.n > k:
                lo, hi = r.lo, r.hi
                break
            below += r.n
    same, after = values.agg(F.count_if(s == lo), F.min(F.when(s > lo, s))).first()
    return lo, lo if k + 1 < below + same or after is None else after


def learned(known: DataFrame, penalty: float) -> dict[str, np.ndarray]:
    """The model of all labelled documents: weights by logistic loss on feature differences of (good, bad) pairs, and the
    threshold, which is the quantile of all their scores that is the share of bad documents.

    Every document is compared, see `compared`; each step of Newton's method is one pass over the blocks that brings a
    gradient and a Hessian from each task. Without both classes all weights are zero.
    """
    size = features({c: np.zeros(1) for c in COUNTS}).shape[1]
    counted = known.agg(F.count_if(F.col("quality") == 1), F.count_if(F.col("quality") != 1)).first()
    n_good, n_bad = counted[0], counted[1]
    n = n_good + n_bad
    centre, spread, w, at = np.zeros(size), np.ones(size), np.zeros(size), 0.0
    if n_good and n_bad:
        centre = task_sums(known, lambda batch: _counted(batch).sum(axis=0), size) / n
        spread = np.maximum(np.sqrt(task_sums(known, lambda batch: ((_counted(batch) - centre) ** 2).sum(axis=0), size) / n), 1e-6)
        centre, spread = np.round(centre, 12), np.round(spread, 12)
        blocks = in_small_batches(compared(known, n_good, n_bad, centre, spread))

        def means(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            def part(batch: pa.RecordBatch) -> np.ndarray:
                total = np.zeros(1 + size + size * size)
                for good, bad in zip(batch.column("good"), batch.column("bad")):
                    a, b = (np.frombuffer(x.as_buffer()).reshape(-1, size) for x in (good, bad))
                    p = 1 / (1 + np.exp(-np.clip((a @ w)[:, None] - b @ w, -30, 30)))
                    v = p * (1 - p)
                    cross = a.T @ v @ b
                    hess = (a * v.sum(axis=1)[:, None]).T @ a + (b * v.sum(axis=0)[:, None]).T @ b - cross - cross.T
                    total += np.concatenate([[p.size], (1 - p).sum(axis=1) @ a - (1 - p).sum(axis=0) @ b, hess.ravel()])
                return total

            total = task_sums(blocks, part, 1 + size + size * size)
            mean = total[1:] / max(total[0], 1)
            return mean[:size], mean[size:].reshape(size, size)

        # sums of other cuts into tasks differ in their last digits
        w = np.round(newton(means, size, penalty), 9)

        def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array((_counted(batch) - centre) / spread @ w)], names=["s"])

        place = n_bad / n * (n - 1)
        k = math.floor(place)
        low, high = order_statistics(materialise(known.mapInArrow(ranked, "s double"), "ranking"), k)
        at = low + (high - low) * (place - k)
    return {"centre": centre, "spread": spread, "w": w, "threshold": np.asarray(at)}


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, labels: DataFrame, penalty: float = 1e-3) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from GOOD on) of every document.

    Learned from all labelled documents that are not held out; scores come from the whole text alone. A score is the
    logistic of the ranking score, shifted so that the threshold quantile lies at GOOD.

    Null and empty texts are scored by their zero counts. A null doc_id is not held out and has no label; labels
    that are null or of unknown documents are unused. Without labels of both kinds all scores are equal.
    Repeated rows are scored each. An empty table gives no rows. Other columns are ignored.
    """
    stats = materialise(text_stats(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), {"doc_id": "long"}), "statistics")
    marks = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("quality")).where(~held_out())
    known = materialise(stats.join(marks, "doc_id").select(F.xxhash64("doc_id").alias("draw"), "doc_id", *COUNTS, "quality"), "labelled")
    model = learned(known, penalty)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {k: np.asarray(batch.column(i + 1)) for i, k in enumerate(COUNTS)}
            z = (features(c) - model["centre"]) / model["spread"]
            s = np.clip(z @ model["w"] - model["threshold"], -30, 30) + math.log(GOOD / (1 - GOOD))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-s)))], names=["doc_id", "score"])

    out = stats.select("doc_id", *COUNTS).mapInArrow(scored, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))
