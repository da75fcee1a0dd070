"""A stored full-text index: postings with positions in buckets of terms, beside a table of lengths; batches are appended."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import exists, in_small_batches
from .search import tokens

POSTINGS = "term string, key long, positions array<int>, batch int, bucket int"
TERMS = "term string, df long, batch int, bucket int"
BATCHES = "batch int, docs long, terms long"
#: Tasks over which the rows of a bucket are dealt, and most rows that come back from Python at once.
PARTS, ROWS = 8, 20_000


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, key and positions (from 0) of the terms of each row (key, terms), by one sort of a batch's terms."""
    for batch in batches:
        lists = batch.column(1)
        sizes = np.diff(lists.offsets.to_numpy())
        coded = lists.flatten().dictionary_encode()
        if not len(coded):
            continue
        code, row = coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)
        place = (np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        pair = code * len(sizes) + row
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        ends = np.concatenate([first, [len(pair)]]).astype(np.int32)
        positions = pa.ListArray.from_arrays(pa.array(ends), pa.array(place[order]))
        columns = [coded.dictionary.take(pa.array(code[order[first]])), batch.column(0).take(pa.array(row[order[first]])), positions]
        for at in range(0, len(first), ROWS):
            yield pa.RecordBatch.from_arrays([x.slice(at, ROWS) for x in columns], names=["term", "key", "positions"])


def _minus(n: int):
    return lambda x: x - n


@dataclass
class PhraseIndex:
    """An index at `path` with the columns `kept` of its rows, whose ids (long) are in the column `key`.

    postings: term, key and positions, by batch and bucket (crc32 of the term modulo `buckets`), each file sorted by term
    and key. terms: in how many rows each term stands, dealt alike. rows: key, length and kept columns, by batch. batches:
    number of rows and of terms of each finished batch; a batch without its row there does not exist for readers, so a
    build that fails midway leaves nothing to be seen.
    """

    spark: SparkSession
    path: str
    key: str
    kept: dict[str, str]
    buckets: int = 64

    def batches(self) -> DataFrame:
        """batch, docs and terms of the finished batches."""
        if not exists(self.spark, f"{self.path}/batches"):
            return self.spark.createDataFrame([], BATCHES)
        return self.spark.read.schema(BATCHES).parquet(f"{self.path}/batches")

    def _read(self, name: str, schema: str) -> DataFrame:
        done = [r.batch for r in self.batches().select("batch").collect()]  # one number for each append
        if not done:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(*[f"{self.path}/{name}/batch={b}" for b in sorted(done)])

    def rows(self) -> DataFrame:
        """key, len and the kept columns of all rows."""
        kept = "".join(f", `{c}` {kind}" for c, kind in self.kept.items())
        return self._read("rows", f"key long, len int{kept}, batch int").drop("batch")

    def append(self, docs: DataFrame, text: str = "text") -> int:
        """Adds the rows of docs whose key the index does not hold, as one batch; the number of rows added.

        Earlier batches are not read but for their keys, and not written. Of rows with one key in docs one is taken. Null
        and empty texts have no terms, but count as rows; a null key is left out.
        """
        number = (self.batches().agg(F.max("batch")).first()[0] or 0) + 1
        new = docs.where(F.col(self.key).isNotNull()).select(F.col(self.key).cast("long").alias("key"), *self.kept, F.coalesce(F.col(text), F.lit("")).alias("__text"))
        if not new.groupBy("key").count().where("count > 1").isEmpty():  # else texts need no exchange
            new = new.dropDuplicates(["key"])
        if number > 1:
            new = new.join(self.rows().select("key"), "key", "left_anti")
        new = new.select("key", *self.kept, tokens(F.col("__text")).alias("__terms"))
        at = f"{self.path}/{{}}/batch={number}"
        new.select("key", F.size("__terms").alias("len"), *self.kept).write.mode("overwrite").parquet(at.format("rows"))
        # positions are gathered in each row's own task; a bucket's rows go to several tasks by key, so a frequent term is spread
        found = in_small_batches(new.select("key", "__terms")).mapInArrow(_postings, "term string, key long, positions array<int>")
        spread = found.withColumn("bucket", (F.crc32(F.encode("term", "UTF-8")) % self.buckets).cast("int"))
        dealt = spread.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(PARTS)))
        dealt.sortWithinPartitions("bucket", "term", "key").write.mode("overwrite").partitionBy("bucket").parquet(at.format("postings"))
        own = self.spark.read.schema(POSTINGS).parquet(at.format("postings"))
        (
            own.groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df")).repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite")
            .partitionBy("bucket")
            .parquet(at.format("terms"))
        )
        done = self.spark.read.parquet(at.format("rows")).agg(F.lit(number).alias("batch"), F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("len"), F.lit(0)).alias("terms"))
        added = done.first()
        done.coalesce(1).write.mode("append").parquet(f"{self.path}/batches")
        return added.docs

    def bucket(self, term: str) -> int:
        return zlib.crc32(term.encode()) % self.buckets

    def of_terms(self, name: str, schema: str, terms: list[str]) -> DataFrame:
        """The rows of some terms; Spark reads their buckets' folders alone, and in these the row groups that hold them."""
        return self._read(name, schema).where(F.col("bucket").isin(sorted({self.bucket(w) for w in terms})) & F.col("term").isin(*terms))

    def terms_of(self, phrase: str) -> list[str]:
        return [r[0] for r in self.spark.range(1).select(F.explode(tokens(F.lit(phrase)))).collect()]  # the query's own terms

    def hits(self, phrase: str, where: Column | str | None = None) -> DataFrame:
        """key, tf (how often the phrase stands in the row), len and the kept columns of the rows that hold the phrase and for
        which `where`, a condition on kept columns, is true.

        The rarest term's postings come first; each other term's are joined by key, shifted by its place in the phrase,
        and the places that all share are kept.
        """
        want = self.terms_of(phrase)
        rows = self.rows() if where is None else self.rows().where(where)
        if not want:
            return rows.select("key", F.lit(0).alias("tf"), "len", *self.kept).where("false")
        df = dict(self.of_terms("terms", TERMS, want).groupBy("term").agg(F.sum("df")).collect())
        found = None
        for term in sorted(set(want), key=lambda w: (df.get(w, 0), w)):
            starts = None
            for place in [i for i, w in enumerate(want) if w == term]:
                shifted = F.transform("positions", _minus(place))
                starts = shifted if starts is None else F.array_intersect(starts, shifted)
            own = self.of_terms("postings", POSTINGS, [term]).select("key", starts.alias("own"))
            found = own.withColumnRenamed("own", "starts") if found is None else found.join(own, "key").select("key", F.array_intersect("starts", "own").alias("starts"))
            found = found.where(F.size("starts") > 0)
        return found.select("key", F.size("starts").alias("tf")).join(rows, "key").select("key", "tf", "len", *self.kept)

    def scored(self, hits: DataFrame, k: float = 1.2, b: float = 0.75) -> DataFrame:
        """Hits with their BM25 score over all rows of the index; idf is floored at 1e-6, higher is better."""
        all_rows = self.batches().agg(F.sum("docs").alias("n_all"), (F.sum("terms") / F.sum("docs")).alias("avg_len"))
        figures = F.broadcast(all_rows.crossJoin(hits.agg(F.count(F.lit(1)).alias("n_hit"))))  # one row
        idf = F.greatest(F.log((F.col("n_all") - F.col("n_hit") + 0.5) / (F.col("n_hit") + 0.5)), F.lit(1e-6))
        score = idf * F.col("tf") * (k + 1) / (F.col("tf") + k * (1 - b + b * F.col("len") / F.col("avg_len")))
        return hits.crossJoin(figures).withColumn("score", score).drop("n_all", "avg_len", "n_hit")

    def search(self, phrase: str, limit: int = 20, where: Column | str | None = None) -> DataFrame:
        """The `limit` best rows (0: all) for a phrase: key, tf, score with six digits, kept columns."""
        out = self.scored(self.hits(phrase, where)).select("key", "tf", F.round("score", 6).alias("score"), *self.kept).orderBy(F.desc("score"), "key")
        return out.limit(limit) if limit > 0 else out

    def groups(self, phrase: str, by: str, limit: int = 10, where: Column | str | None = None) -> DataFrame:
        """The `limit` best groups by the score of their best row; conditions bear on the choice, not on a page of it."""
        best = self.scored(self.hits(phrase, where)).groupBy(by).agg(F.round(F.max("score"), 6).alias("score"), F.count(F.lit(1)).alias("hits"))
        return best.orderBy(F.desc("score"), by).limit(limit)

    def facets(self, phrase: str, by: str, where: Column | str | None = None) -> DataFrame:
        """How many rows hold the phrase, by a kept column; rows that are no longer in the index do not count."""
        return self.hits(phrase, where).groupBy(by).agg(F.count(F.lit(1)).alias("hits"))

    def completions(self, prefix: str, top: int = 10) -> DataFrame:
        """Terms that begin with prefix and in how many rows they stand, by the terms' own table."""
        t = self._read("terms", TERMS).where(F.startswith("term", F.lit(prefix))).groupBy("term").agg(F.sum("df").alias("df"))
        return t.orderBy(F.desc("df"), "term").limit(top)
