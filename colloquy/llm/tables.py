"""Shared helpers: tables in the shared folder, and joins with small keyed tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a keyed table that a join may broadcast; beyond it the join is salted.
BROADCAST_ROWS = 50_000
SALTS = 32
#: Most bytes of rows handed to Python at once, where the session sets no limit of its own.
BATCH_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. A local session without one gets a temporary folder, a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="colloquy-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _tables(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/colloquy/{spark.sparkContext.applicationId}"


def drop_tables(spark: SparkSession) -> None:
    """Deletes the tables that this application's operators wrote; call it when their results have been read."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_tables(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def in_small_batches(df: DataFrame) -> DataFrame:
    """df, whose rows with texts go to Python in batches of about BATCH_BYTES instead of 10,000 rows of any size."""
    conf = df.sparkSession.conf
    if not conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None):
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    Cuts the lineage with files that every executor sees, so a lost executor costs only its running tasks. The files
    stay until drop_tables, as frames that read them may be used at any time.
    """
    spark = df.sparkSession
    path = f"{_tables(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality of the keys."""
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(right[k])
    return on


def attach(rows: DataFrame, small: DataFrame, keys: list[str], spread: Column, how: str = "left") -> DataFrame:
    """rows with the columns of small, whose keys are unique; null keys match each other.

    small is broadcast when it has at most BROADCAST_ROWS rows. Above that it is copied to SALTS salts and rows
    take one by `spread`, so that a hot key's rows go to many tasks.
    """
    held = small.select(*[F.col(c).alias(f"__{c}" if c in keys else c) for c in small.columns])
    on = F.lit(True)
    for k in keys:
        on = on & rows[k].eqNullSafe(held[f"__{k}"])
    if held.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(held), on, how).drop(*[f"__{k}" for k in keys])
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    copies = held.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    return salted.join(copies, on & (F.col("__salt") == F.col("__copy")), how).drop("__salt", "__copy", *[f"__{k}" for k in keys])
