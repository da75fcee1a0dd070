"""Connected components of large graphs by alternating star contractions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import SALTS, materialise

#: Hubs are nodes with over this part of all links, so there are at most so many of them.
HUBS = 4096


def forest(pairs: np.ndarray) -> np.ndarray:
    """A spanning forest of pairs (a, b): each node linked to the least node of its component."""
    nodes, inverse = np.unique(pairs.ravel(), return_inverse=True)
    a, b = inverse.reshape(-1, 2).T
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = np.flatnonzero(label != np.arange(len(nodes)))
    return np.stack([nodes[far], nodes[label[far]]], axis=1)


def thinned(pairs: DataFrame, most: int = 1 << 18) -> DataFrame:
    """pairs(a long, b long) without most of those that others connect: each task keeps a spanning forest of its own,
    of about `most` pairs, and holds twice as many at once."""
    blocks = max(1, -(-pairs.count() // most))

    def kept(batches):
        held = np.zeros((0, 2), np.int64)
        for batch in batches:
            held = np.concatenate([held, np.column_stack([np.asarray(batch.column(0)), np.asarray(batch.column(1))])])
            if len(held) > 2 * most:
                held = forest(held)
                if len(held) > most:
                    yield told(held)
                    held = held[:0]
        if len(held):
            yield told(forest(held))

    def told(held: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held[:, k].copy()) for k in (0, 1)], names=["a", "b"])

    return pairs.select("a", "b").coalesce(blocks).mapInArrow(kept, "a long, b long")


def join_least(links: DataFrame, least: DataFrame, rows: int) -> DataFrame:
    """links(u, v, ...) with m of least(u, m, n), where n counts a node's links and rows bounds the sum of all n.

    Links of a hub are dealt over SALTS tasks by v, and the hub's row of least goes to each of them.
    """
    most = max(64, rows // HUBS)
    hubs = F.broadcast(least.where(F.col("n") > most).select("u", F.lit(True).alias("hub")))
    salt = F.when(F.col("hub"), F.pmod(F.xxhash64("v"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    salts = F.sequence(F.lit(0), F.when(F.col("n") > most, SALTS - 1).otherwise(0))
    dealt = links.join(hubs, "u", "left").withColumn("salt", salt).drop("hub")
    return dealt.join(least.select("u", "m", F.explode(salts).alias("salt")), ["u", "salt"]).drop("salt")


def components(nodes: DataFrame, pairs: DataFrame, rounds: int = 60) -> DataFrame:
    """node and component for nodes(node long, name long) and pairs(a long, b long) of nodes.

    Large and small stars alternate until each component is one star; every round's pairs are written to the
    shared folder. The component's name is the least name of its nodes. A node's pairs are summed up as minima,
    so a hub is never gathered into one row, and its links are dealt over several tasks.
    """
    pairs = materialise(pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "pairs")
    mark = None
    for _ in range(rounds):
        now = pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first()
        if now[0] == 0 or now == mark:
            break
        mark = now
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        # large star: larger neighbours link to the least of the neighbourhood
        large = join_least(both.where("v > u"), least, 2 * now[0]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: smaller neighbours and the node itself link to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_least(large, low, 2 * now[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        pairs = materialise(small.where("u <> v").distinct(), "pairs")
    else:
        raise RuntimeError("components did not settle")
    root = nodes.join(pairs.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select(F.coalesce("root", "node").alias("u"), F.col("node").alias("v"), "name")
    names = root.groupBy("u").agg(F.min("name").alias("m"), F.count(F.lit(1)).alias("n"))
    return join_least(root, names, nodes.count()).select(F.col("v").alias("node"), F.col("m").alias("component"))
