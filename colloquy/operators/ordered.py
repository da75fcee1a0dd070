"""Running values, neighbours and ranks over rows in order, without one task for all rows of a key or of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import saved


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & left[n].eqNullSafe(right[f"__{n}"])
    return out


def carried(rows: DataFrame, keys: list[str], bucket: str, order: list[str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None) -> DataFrame:
    """rows with running values of their key's rows in order: sums up to each row itself, last values that are not null
    from the rows before it.

    bucket is a column that never falls along the order, such as a day. Windows go over one bucket of a key; what the
    key's earlier buckets bring is taken from one summary row of each, so a key of very many rows is spread over tasks.
    Null keys are a key. `order` must tell the rows of a bucket apart, else ties fall in any order. rows are read twice, so
    they are written to the shared folder first.
    """
    sums, lasts, rows = sums or {}, lasts or {}, saved(rows, "ordered")
    own = [*keys, bucket]
    place = F.struct(*order)
    parts = [F.sum(c).alias(f"__{n}") for n, c in sums.items()] + [F.max_by(c, F.when(c.isNotNull(), place)).alias(f"__{n}") for n, c in lasts.items()]
    past = Window.partitionBy(*[f"__{k}" for k in keys]).orderBy(f"__{bucket}").rowsBetween(Window.unboundedPreceding, -1)
    summary = rows.groupBy(*[F.col(k).alias(f"__{k}") for k in own]).agg(*parts)
    brought = [F.sum(f"__{n}").over(past).alias(f"__{n}") for n in sums] + [F.last(f"__{n}", True).over(past).alias(f"__{n}") for n in lasts]
    summary = summary.select(*[f"__{k}" for k in own], *brought)
    w = Window.partitionBy(*own).orderBy(*order)
    values = {n: F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)) for n, c in sums.items()}
    values |= {n: F.last(c, True).over(w.rowsBetween(Window.unboundedPreceding, -1)) for n, c in lasts.items()}
    inner = rows.withColumns(values)
    joined = inner.join(summary, _same(inner, summary, own), "left")
    both = {n: F.coalesce(n, F.lit(0)) + F.coalesce(f"__{n}", F.lit(0)) for n in sums} | {n: F.coalesce(n, f"__{n}") for n in lasts}
    return joined.withColumns(both).select(*inner.columns)


def bordered(rows: DataFrame, at: str, before: int, after: int = 0, width: int | None = None) -> DataFrame:
    """rows with `bucket` and `own`: windows over keys and bucket that look at most `before` and `after` units of the whole
    number `at` away see for each own row all rows that they would see over the keys alone.

    Rows near a bucket's edge are copied to the buckets that look at them, with own = false; callers drop these after the
    window. A bucket is `width` units long, ten times the farther look at least. Rows without `at` fall.
    """
    width = max(width or 0, 10 * max(before, after, 1))
    first, last = F.floor((F.col(at) - after) / width), F.floor((F.col(at) + before) / width)
    copies = rows.withColumn("bucket", F.explode(F.sequence(first, last)))
    return copies.withColumn("own", F.col("bucket") == F.floor(F.col(at) / width))


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """rows with their number (from 1) in the order of all rows.

    Ranges of the order are dealt to tasks and numbered there, and written to the shared folder so that every reader sees
    the same ranges; each range's offset comes from the counts of those before it, one row for each range.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    placed = saved(placed.withColumn("__part", F.shiftright("__id", 33)).withColumn("__n", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + 1), "ranked")
    counts = placed.groupBy("__part").agg(F.max("__n").alias("__rows"))
    past = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offset = counts.select(F.col("__part").alias("__of"), F.coalesce(F.sum("__rows").over(past), F.lit(0)).alias("__before"))
    return placed.join(F.broadcast(offset), F.col("__part") == F.col("__of")).withColumn(name, F.col("__n") + F.col("__before")).select(*rows.columns, name)
