"""Tables that builds and digests keep up to date in place: versions of their parts, marks of what was told."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import exists, saved
from .incremental import fingerprints, plan_build, refresh

_MANIFEST = "version int, part int"


@dataclass
class SessionTable:
    """Rows by source path, in `parts` parts by the crc32 of the path, of which a build writes only those it changes.

    A part's rows lie in a folder of their own for each version. The manifest names the parts that a version wrote, and is
    written last: a build that fails leaves readers the versions before it, and the next one writes its folders anew.
    columns: DDL of what builds compute and carry; path, agent and fingerprint come with it.
    """

    spark: SparkSession
    path: str
    columns: str
    carried: list[str] = field(default_factory=list)
    parts: int = 64

    @property
    def schema(self) -> str:
        return f"path string, agent string, fingerprint long, {self.columns}"

    def _part(self):
        return (F.crc32(F.encode("path", "UTF-8")) % self.parts).cast("int")

    def versions(self) -> dict[int, int]:
        """The newest version of each part that has one."""
        if not exists(self.spark, f"{self.path}/manifest"):
            return {}
        newest = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest").groupBy("part").agg(F.max("version").alias("version"))
        return {r.part: r.version for r in newest.collect()}  # one for each part

    def read(self, parts: list[int] | None = None) -> DataFrame:
        """The rows, or those of some parts alone."""
        at = [f"{self.path}/rows/version={v}/part={p}" for p, v in sorted(self.versions().items()) if (parts is None or p in parts) and exists(self.spark, f"{self.path}/rows/version={v}/part={p}")]
        return self.spark.read.schema(self.schema).parquet(*at) if at else self.spark.createDataFrame([], self.schema)

    def build(self, lines: DataFrame, compute: Callable[[DataFrame], DataFrame], agent: str | None = None, full: bool = True, least: float = 0.5, epoch: int = 1) -> dict[str, int]:
        """Brings the table up to date with lines(path, agent, line_no, raw); the number of paths by what was done.

        Paths whose fingerprint is unchanged are skipped, new and changed ones computed from their lines; one that gives no
        row failed and keeps its old row and fingerprint, so the next build tries it again. `carried` columns keep their old values.
        Paths that vanished are pruned, but only after a full listing, and of no agent whose listing holds less than `least`
        of its stored paths: such a listing failed. With `agent` nothing of other agents is read, computed or pruned.
        """
        mine = lines if agent is None else lines.where(F.col("agent") == agent)
        sources = mine.groupBy("path").agg(F.max("agent").alias("agent"))
        now = saved(fingerprints(mine, epoch).join(sources, "path"), "listing")
        stored = self.read() if agent is None else self.read().where(F.col("agent") == agent)
        plan = plan_build(stored, now)
        held = stored.select("path", "agent").join(now.select("path", F.lit(1).alias("here")), "path", "left")
        failed = held.groupBy("agent").agg(F.avg(F.coalesce("here", F.lit(0))).alias("share")).where(F.col("share") < least)
        owner = stored.select("path", F.col("agent").alias("__agent"))
        keep = F.lit(not full) | F.col("__failed").isNotNull()
        plan = plan.join(owner, "path", "left").join(failed.select(F.col("agent").alias("__agent"), F.lit(1).alias("__failed")), "__agent", "left")
        plan = plan.select("path", F.when((F.col("action") == "prune") & keep, "kept").otherwise(F.col("action")).alias("action"))
        plan = saved(plan.withColumn("part", self._part()), "plan")
        done = {r.action: r.n for r in plan.groupBy("action").agg(F.count(F.lit(1)).alias("n")).collect()}
        touched = sorted(r.part for r in plan.where("action IN ('compute', 'prune')").select("part").distinct().collect())  # parts at most
        if not touched:
            return done
        todo = plan.where("action = 'compute'").select("path")
        rows = compute(mine.join(todo, "path", "left_semi")).join(now.select("path", "agent", "fingerprint"), "path")
        names = [x.strip().split()[0] for x in self.schema.split(",")]
        for name in self.carried:
            if name not in rows.columns:
                rows = rows.withColumn(name, F.lit(None))
        old = self.read(touched)
        new = refresh(old, plan, rows.select(*[n for n in names if n not in self.carried]), self.carried).select(*[F.col(n) for n in names])
        version = max(self.versions().values(), default=0) + 1
        new.withColumn("part", self._part()).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/rows/version={version}")
        manifest = self.spark.createDataFrame([(version, p) for p in touched], _MANIFEST)
        manifest.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return done


@dataclass
class DigestMarks:
    """The newest time of each chat that a digest has told; kept in a folder, advanced when the digest has been written."""

    spark: SparkSession
    path: str

    def read(self) -> DataFrame:
        """chat_id and mark."""
        schema = "chat_id string, mark timestamp_ntz"
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path).groupBy("chat_id").agg(F.max("mark").alias("mark"))

    def new(self, rows: DataFrame) -> DataFrame:
        """rows(chat_id, ts, ...) after their chat's mark; those of chats without a mark, and of no chat, all."""
        marks = self.read().withColumnRenamed("chat_id", "__chat")
        told = rows.join(marks, rows["chat_id"].eqNullSafe(F.col("__chat")), "left")
        return told.where(F.col("mark").isNull() | (F.col("ts") > F.col("mark"))).drop("mark", "__chat")

    def tell(self, rows: DataFrame, write: Callable[[DataFrame], None]) -> int:
        """Hands the digest of the new rows (chat_id, messages, senders, first, last) to `write`, then advances the marks; the
        number of chats. If `write` fails the marks stay, and the next digest holds the same rows and newer ones."""
        digest = saved(
            self.new(rows)
            .groupBy("chat_id")
            .agg(F.count(F.lit(1)).alias("messages"), F.count_distinct("sender").alias("senders"), F.min("ts").alias("first"), F.max("ts").alias("last")),
            "digest",
        )
        write(digest)
        digest.select("chat_id", F.col("last").alias("mark")).write.mode("append").parquet(self.path)
        return digest.count()

    def tell_stream(self, rows: DataFrame, write: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
        """The same for what a stream has brought since it was last run. A batch that is run again after its marks were
        written tells nothing twice, as its rows are no longer after them."""
        return rows.writeStream.foreachBatch(lambda batch, number: self.tell(batch, write) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
