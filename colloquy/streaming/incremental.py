"""Tables kept up to date from changed sources and from streams of new rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def fingerprints(lines: DataFrame, epoch: int = 1) -> DataFrame:
    """(path, fingerprint) of sources: a hash of their size and their lines' hashes, which is combined before the shuffle."""
    h = lines.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("raw")).alias("size"), F.bit_xor(F.xxhash64("line_no", "raw")).alias("h"))
    return h.select("path", F.xxhash64(F.lit(epoch), "n", "size", "h").alias("fingerprint"))


def plan_build(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(path, action): skip where the fingerprint is the same, else compute; prune what has no source any more."""
    both = stored.select("path", F.col("fingerprint").alias("old")).join(current.select("path", F.col("fingerprint").alias("new")), "path", "full_outer")
    return both.select("path", F.when(F.col("new").isNull(), "prune").when(F.col("old") == F.col("new"), "skip").otherwise("compute").alias("action"))


def refresh(stored: DataFrame, plan: DataFrame, computed: DataFrame, carried: list[str]) -> DataFrame:
    """The stored table after a build: computed rows with the carried columns of their old ones, all others as they were.

    A source whose computation failed gives no row in `computed` and keeps its old one.
    """
    kept = stored.join(plan.where("action = 'prune'").select("path"), "path", "left_anti").join(computed.select("path"), "path", "left_anti")
    new = computed.join(stored.select("path", *carried), "path", "left").select(*stored.columns)
    return kept.unionByName(new)


def append_above(stored: DataFrame, rows: DataFrame, key: str, chat: str, ts: str) -> DataFrame:
    """Rows above each chat's highest stored key, and whether they came in time order."""
    mark = stored.groupBy(chat).agg(F.max(key).alias("mark"), F.max(ts).alias("latest"))
    new = rows.join(mark, chat, "left").where(F.col("mark").isNull() | (F.col(key) > F.col("mark")))
    before = F.max(ts).over(Window.partitionBy(chat).orderBy(key).rowsBetween(Window.unboundedPreceding, -1))
    return new.withColumn("in_order", F.coalesce(F.col(ts) >= F.greatest("latest", before), F.lit(True))).drop("mark", "latest")


def keep_rollup(stream: DataFrame, read: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str) -> StreamingQuery:
    """Sessions recomputed as their rows arrive: each batch writes its keys' own roll-up under its batch id, once.

    `read` must give sums, minima or maxima that `merged` can add; a batch that is run again replaces its own folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        read(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(parts: DataFrame, keys: list[str], sums: list[str], least: list[str] = (), most: list[str] = ()) -> DataFrame:
    """One row for each key from the roll-ups of all batches."""
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], *[F.min(c).alias(c) for c in least], *[F.max(c).alias(c) for c in most])
