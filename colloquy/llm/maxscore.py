"""Exact top-k by inner product: MaxScore over the components of integer vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge(best: tuple[np.ndarray, np.ndarray], score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest of best and of new scores, ties to smaller ids."""
    score, ids = np.concatenate([best[0], score]), np.concatenate([best[1], ids])
    order = np.lexsort((ids, -score))[:k]
    return score[order], ids[order]


def thresholds(q: np.ndarray, x: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """The k-th highest score of each query over rows x, own(query, row) left out; -inf with fewer rows."""
    score = np.where(own, -np.inf, q @ x.T)
    if score.shape[1] < k:
        return np.full(len(q), -np.inf)
    return np.partition(score, -k, axis=1)[:, -k]


def search_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, theta: np.ndarray | None = None, chunk: int = 2048, step: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """(query number, id, score) of each query's k best rows of a shard at or over theta; pairs skipped, pairs in all.

    A term is a component; its postings are the shard's values of it. No row's contribution to a query exceeds the
    term's bound, the greater of the products with its least and greatest value. Terms in ascending order of their
    bounds are non-essential as long as their bounds together stay below the query's k-th score so far, theta: a row
    must gain from the others to compete. The essential postings are traversed; rows whose score so far and the bounds
    to come reach theta are probed for the other terms, `step` at a time and greatest bounds first, while they do.
    A pair is skipped if a term of it was never looked at.
    """
    postings = np.ascontiguousarray(x.T)
    theta = np.full(len(q), -np.inf) if theta is None else theta.copy()
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in q_ids]
    skipped = 0
    for at in range(0, len(x), chunk):
        part, row_ids = postings[:, at : at + chunk], ids[at : at + chunk]
        bounds = np.maximum(q * part.min(axis=1), q * part.max(axis=1))
        order = np.argsort(-bounds, axis=1)
        ahead = np.take_along_axis(bounds, order, axis=1)[:, ::-1].cumsum(axis=1)[:, ::-1]  # bounds of the terms from each on
        ahead = np.concatenate([ahead, np.zeros((len(q), 1))], axis=1)
        for i in range(len(q)):
            n = int((ahead[i] >= theta[i]).argmin()) if ahead[i, -1] < theta[i] else q.shape[1]
            terms, weight = order[i], q[i, order[i]]
            score = weight[:n] @ part[terms[:n]] if n else np.zeros(len(row_ids))
            row = np.flatnonzero((score + ahead[i, n] >= theta[i]) & (row_ids != q_ids[i]))
            score = score[row]
            while n < len(terms) and len(row):
                some = terms[n : n + step]
                score = score + weight[n : n + step] @ part[some[:, None], row]
                n += len(some)
                still = score + ahead[i, n] >= theta[i]
                row, score = row[still], score[still]
            if n == len(terms):
                skipped += len(row_ids) - len(row)
                if len(row):
                    best[i] = merge(best[i], score.astype(np.int64), row_ids[row], k)
                    if len(best[i][0]) == k:
                        theta[i] = max(theta[i], best[i][0][-1])
            else:
                skipped += len(row_ids)
    n = [len(s) for s, _ in best]
    return np.repeat(np.arange(len(q_ids)), n), np.concatenate([i for _, i in best] + [ids[:0]]), np.concatenate([s for s, _ in best] + [ids[:0]]), skipped, len(q) * len(x)


def top_k(queries: DataFrame, rows: DataFrame, k: int = 20, shard_rows: int = 8192, block_queries: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k highest inner products over rows(vec_id, x), queries(vec_id, x).

    x holds whole numbers as array<double>; a row never answers a query of the same vec_id, ties go to the smaller
    vec_id. Rows are dealt by hash into shards, queries into blocks. Every block first meets one shard alone, which
    gives each query a threshold to start from, then every shard once; the shards' answers are merged by a window
    over at most k rows for each query and shard.

    Rows whose x differs in length from a block's are searched with the missing components as zeros. Repeated rows
    answer once each, repeated queries are answered each. Empty tables give no rows.
    """
    shards = max(1, -(-rows.count() // shard_rows))
    blocks = max(1, -(-queries.count() // block_queries))

    def stacked(vectors: list) -> np.ndarray:
        out = np.zeros((len(vectors), max(map(len, vectors), default=0)))
        for i, v in enumerate(vectors):
            out[i, : len(v)] = v
        return out

    def block(key, t: pa.Table) -> pa.Table:
        x = stacked(t["x"].to_numpy())
        dims = np.asarray(x.shape, "<i8").tobytes()
        held = [[np.asarray(t[c]).astype("<i8").tobytes()] for c in ("number", "vec_id")]
        return pa.table(
            [pa.array([key[0].as_py()], pa.int64()), *(pa.array(h, pa.binary()) for h in held), pa.array([dims + x.astype("<f8").tobytes()], pa.binary())],
            names=["part", "numbers", "ids", "data"],
        )

    def blocked(df: DataFrame, n: int) -> DataFrame:
        numbered = df.select(F.col("vec_id").cast("long").alias("vec_id"), "x", F.monotonically_increasing_id().alias("number"))
        dealt = numbered.withColumn("part", F.pmod(F.xxhash64("vec_id", "number"), F.lit(n)))
        return dealt.groupBy("part").applyInArrow(lambda key, t: block(key, t), "part long, numbers binary, ids binary, data binary")

    def read(ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        n, d = np.frombuffer(data[:16], "<i8")
        return np.frombuffer(ids, "<i8"), np.frombuffer(data[16:], "<f8").reshape(n, d)

    def met(q_ids: bytes, q_data: bytes, ids: bytes, data: bytes) -> list[np.ndarray]:
        (qi, q), (xi, x) = read(q_ids, q_data), read(ids, data)
        d = max(q.shape[1], x.shape[1])
        q, x = (np.pad(m, ((0, 0), (0, d - m.shape[1]))) for m in (q, x))
        return [qi, q, xi, x]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, q_ids, q_data, ids, data in zip(*(c.to_pylist() for c in batch.columns)):
                theta = np.full(len(q_ids) // 8, -np.inf)
                if ids is not None:
                    qi, q, xi, x = met(q_ids, q_data, ids, data)
                    theta = thresholds(q, x, qi[:, None] == xi[None, :], k)
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in (number, q_ids, q_data, theta.astype("<f8").tobytes())], names=["q_numbers", "q_ids", "q_data", "theta"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, q_ids, q_data, theta, ids, data in zip(*(c.to_pylist() for c in batch.columns)):
                qi, q, xi, x = met(q_ids, q_data, ids, data)
                u, v, s, _, _ = search_block(qi, q, xi, x, k, np.frombuffer(theta, "<f8"))
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(number, "<i8")[u]), pa.array(qi[u]), pa.array(v), pa.array(s)], names=["number", "query_id", "vec_id", "score"])

    held = blocked(rows, shards).drop("numbers")
    asked = blocked(queries, blocks).select(F.lit(0).cast("long").alias("part"), F.col("numbers").alias("q_numbers"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    seeded = asked.join(held.where("part = 0"), "part", "left").drop("part").mapInArrow(first, "q_numbers binary, q_ids binary, q_data binary, theta binary")
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("part")
    pairs = seeded.select(parts, "*").join(held, "part").drop("part")
    found = pairs.mapInArrow(search, "number long, query_id long, vec_id long, score long")
    order = Window.partitionBy("number").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def whole_vectors(embeddings: DataFrame, scale: float = 64.0) -> DataFrame:
    """vec_id and x = floor(scale * component); vectors that are null or hold null or non-finite components go."""
    e = F.col("embedding")
    fine = e.isNotNull() & F.col("vec_id").isNotNull() & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return embeddings.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda v: F.floor(F.lit(scale) * v.cast("double")).cast("double")).alias("x"))


def search_table(embeddings: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """Searches all vectors for the queries whose vec_id is divisible by `every`."""
    rows = whole_vectors(embeddings)
    return top_k(rows.where(F.pmod("vec_id", F.lit(every)) == 0), rows, k)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(64 * c::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, r.vec_id, list_dot_product(q.x, r.x)::BIGINT AS score
  FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""
