"""Folders that all executors share, for tables that outlive a query."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. A local session without one gets a temporary folder, a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="colloquy-store-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def version_of(rows: DataFrame) -> str:
    """A name for the state of a table's files: their paths, sizes and times, without reading their rows."""
    files = rows.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    state = files.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("*"))).first()
    return hashlib.md5(str(tuple(state)).encode()).hexdigest()[:16]


def saved(rows: DataFrame, name: str) -> DataFrame:
    """rows written to the shared folder and read again: the same rows for every reader, and no lineage before them."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/colloquy/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def in_small_batches(rows: DataFrame, size: int = 8 << 20) -> DataFrame:
    """rows, which go to Python in batches of about `size` bytes, where the session sets no limit itself."""
    conf = rows.sparkSession.conf
    if not conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None):
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    return rows
