"""Mixing sources to target weights by capped water-filling; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import attach, materialise

WORD = r"[^\x20\x09-\x0D]+"


def water_fill(sources: DataFrame, weights: tuple = (5, 2, 1), multiple: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """Targets of sources(source, source_size, source_rows): adds `target`.

    Clamping at the caps and resharing the excess until no source is above its cap ends where one water level
    times its weight, or its cap, is each source's target. Sorted by cap per weight the clamped sources come
    first, so the level follows from running sums over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    size = F.col("source_size").cast("double")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("weight", w).withColumn("cap", F.lit(float(max_epochs)) * size)
    s = s.withColumn("ratio", F.col("cap") / F.col("weight")).withColumn("goal", F.lit(float(multiple)) * F.sum(size).over(everything))
    s = s.withColumn("caps_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("weight_left", F.sum("weight").over(everything) - F.col("weight_before"))
    s = s.withColumn("clamped", F.col("ratio") * F.col("weight_left") <= F.col("goal") - F.col("caps_before"))
    s = s.withColumn(
        "level",
        (F.col("goal") - F.sum(F.when(F.col("clamped"), F.col("cap")).otherwise(0.0)).over(everything)) / F.nullif(F.sum(F.when(F.col("clamped"), F.lit(0.0)).otherwise(F.col("weight"))).over(everything), F.lit(0.0)),
    )
    s = s.withColumn("target", F.when(F.col("clamped"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("level"))))
    return s.select("source", "source_size", "source_rows", "target")


def mix(docs: DataFrame, weights: tuple = (5, 2, 1), multiple: float = 1.5, max_epochs: float = 2.0, seed: int = 17, bucket_rows: int = 4096) -> DataFrame:
    """How many words of each document the mix takes.

    Returns doc_id, source, size, source_size, target, taken (long): floor(target / source_size) whole
    repetitions of every document, and of the rest whole documents in a seeded order until the source's
    fraction is used up; the document at the edge gives a part. The order runs within buckets of about
    bucket_rows documents, so that a hot source is spread over many tasks; each bucket meets its share to
    half a word.

    Null text: size 0. Empty texts: 0 words taken. A null source is a source of its own, sorted last. Rows with
    the same doc_id count each for itself; equal rows are interchangeable. An empty table gives no rows. Other
    columns are ignored, whatever their names.
    """
    sizes = docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"))
    sizes = materialise(sizes, "sizes")
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    sources = materialise(water_fill(totals, weights, multiple, max_epochs), "sources")
    rows = attach(sizes, sources, ["source"], F.col("doc_id"))
    rows = rows.withColumn("__draw", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}"))))
    buckets = F.ceil(F.col("source_rows") / F.lit(bucket_rows))
    rows = rows.withColumn("__bucket", F.pmod(F.conv(F.substring("__draw", 1, 8), 16, 10).cast("long"), buckets))
    bucket = Window.partitionBy("source", "__bucket")
    ran = bucket.orderBy("__draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("__epochs", epochs).withColumn("__whole", F.floor("__epochs"))
    rows = rows.withColumn("__budget", F.floor((F.col("__epochs") - F.col("__whole")) * F.sum("size").over(bucket) + F.lit(0.5)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("__budget") - F.coalesce(F.sum("size").over(ran), F.lit(0))))
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("__whole") * F.col("size") + part).cast("long").alias("taken"))


def repeat(docs: DataFrame, **params) -> DataFrame:
    """The mixed corpus itself, with the columns of docs: each document as often as mix() takes it.

    A document taken in part appears once more with the words of that part. Documents that share a doc_id are
    taken alike: their counts are those of mix() summed over the copies, dealt in the order of the rows' hash.
    """
    names = docs.columns
    taken = mix(docs, **params).groupBy("doc_id").agg(F.sum("taken").alias("__taken"), F.sum("size").alias("__size"))
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    rows = docs.select(*names, words.alias("__words")).withColumn("__key", F.col("doc_id"))
    taken = taken.withColumnRenamed("doc_id", "__id")
    rows = rows.join(taken, rows["__key"].eqNullSafe(taken["__id"])).where("__words > 0")
    share = F.floor(F.col("__taken") * F.col("__words") / F.col("__size") + F.lit(0.5)).cast("long")
    rows = rows.withColumn("__share", share).withColumn("__whole", F.floor(F.col("__share") / F.col("__words")).cast("int")).withColumn("__part", (F.col("__share") % F.col("__words")).cast("int"))
    copies = F.concat(F.array_repeat(F.col("__words").cast("int"), F.col("__whole")), F.when(F.col("__part") > 0, F.array(F.col("__part"))).otherwise(F.array().cast("array<int>")))
    rows = rows.withColumn("__n", F.explode(copies))
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, F.col("__n")), " ")
    text = F.when(F.col("__n") == F.col("__words"), F.col("text")).otherwise(part)
    out = rows.withColumn("__text", text)
    length = F.length("__text").cast(dict(docs.dtypes).get("n_chars", "bigint"))
    return out.select(*[F.col("__text").alias("text") if c == "text" else length.alias(c) if c == "n_chars" else F.col(c) for c in names])


ORACLE = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS source_rows FROM sizes GROUP BY source
), named AS (
  SELECT *, list_extract([5.0, 2.0, 1.0], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT)::DOUBLE AS weight,
         2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE AS goal FROM totals
), runs AS (
  SELECT *, cap / weight AS ratio, coalesce(sum(cap) OVER b, 0) AS caps_before,
         sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS weight_left
  FROM named WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), clamps AS (SELECT *, ratio * weight_left <= goal - caps_before AS clamped FROM runs),
levels AS (
  SELECT *, (goal - sum(CASE WHEN clamped THEN cap ELSE 0 END) OVER ()) / nullif(sum(CASE WHEN clamped THEN 0 ELSE weight END) OVER (), 0) AS level FROM clamps
), targets AS (
  SELECT source, source_size, source_rows, CASE WHEN clamped THEN cap ELSE least(cap, weight * level) END AS target FROM levels
), drawn AS (
  SELECT s.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS epochs,
         md5(coalesce(doc_id::VARCHAR, '') || ':17') AS draw, ceil(t.source_rows / 4096.0)::BIGINT AS buckets
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), dealt AS (SELECT *, ('0x' || substr(draw, 1, 8))::BIGINT % buckets AS bucket FROM drawn),
budgets AS (
  SELECT *, floor((epochs - floor(epochs)) * sum(size) OVER (PARTITION BY source, bucket) + 0.5) AS budget,
         coalesce(sum(size) OVER (PARTITION BY source, bucket ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ran
  FROM dealt
)
SELECT doc_id, size, source_size, target, (floor(epochs) * size + greatest(0, least(size, budget - ran)))::BIGINT AS taken FROM budgets
"""
