"""Token usage: models, families of sessions, cache rates; and git and repository tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import carried

#: Added before rounding, so that halves round up in every engine.
_HALF = 1e-9
LEGS = ("input_tokens", "output_tokens", "cache_read_tokens")


def cache_rate(read: Column, tokens: Column, includes_cache: Column | None = None) -> Column:
    """Share of cached input, 0 to 1: over the input if that includes the cache, else over both; null without a base.

    Where the policy is unknown the cache is taken as included if it is no larger than the input.
    """
    inside = read <= tokens if includes_cache is None else includes_cache
    base = F.when(inside, tokens).otherwise(tokens + read)
    return F.round(F.when(base > 0, F.least(F.greatest(read / base, F.lit(0.0)), F.lit(1.0)) + _HALF), 4)


def by_model(usage: DataFrame) -> DataFrame:
    legs = [F.sum(c).alias(c) for c in LEGS]
    s = usage.groupBy("model").agg(F.count(F.lit(1)).alias("requests"), *legs)
    return s.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens")).withColumn("rate", cache_rate(F.col("cache_read_tokens"), F.col("input_tokens")))


def primary_model(usage: DataFrame, weight: int = 3) -> DataFrame:
    """The session's first useful model, else the one with most votes."""
    votes = usage.groupBy("session_id", "model").agg((F.count(F.lit(1)) * weight).alias("votes"), F.min("request_seq").alias("seq"))
    return (
        votes.groupBy("session_id")
        .agg(F.min_by("model", F.struct("seq", "model")).alias("first"), F.max_by("model", F.struct("votes", -F.col("seq"), "model")).alias("most"))
        .select("session_id", F.when(F.col("first") != "NO", F.col("first")).otherwise(F.col("most")).alias("model"))
    )


def cumulative_max(usage: DataFrame) -> DataFrame:
    """Usage from snapshots that count up over a session."""
    return usage.groupBy("session_id").agg(*[F.max(c).alias(c) for c in LEGS])


def run_reset(usage: DataFrame) -> DataFrame:
    """Usage from snapshots that count up over a run: a drop in calls begins a run, each run's last counts."""
    w = Window.partitionBy("session_id").orderBy("request_seq")
    runs = usage.withColumn("reset", F.coalesce((F.col("calls") < F.lag("calls").over(w)).cast("int"), F.lit(0))).withColumn("run", F.sum("reset").over(w))
    last = runs.groupBy("session_id", "run").agg(*[F.max_by(c, "request_seq").alias(c) for c in LEGS])
    return last.groupBy("session_id").agg(F.count(F.lit(1)).alias("runs"), *[F.sum(c).alias(c) for c in LEGS])


def rooted(usage: DataFrame, tree: DataFrame) -> DataFrame:
    """Usage with the root of its session's family and whether the session is a child."""
    t = tree.select(F.col("id").alias("session_id"), "parent")
    return usage.join(t, "session_id", "left").withColumn("root", F.coalesce("parent", "session_id")).withColumn("child", F.col("parent").isNotNull())


def by_mode(usage: DataFrame, tree: DataFrame) -> DataFrame:
    """Usage by model counted per family, per root session, and raw, in one pass."""
    r = rooted(usage, tree)
    kept = F.when(F.col("child"), F.array(F.lit("raw"), F.lit("family"))).otherwise(F.array(F.lit("raw"), F.lit("family"), F.lit("session")))
    return (
        r.withColumn("mode", F.explode(kept))
        .groupBy("mode", "model")
        .agg(
            F.count_distinct(F.when(F.col("mode") == "family", F.col("root")).otherwise(F.col("session_id"))).alias("units"),
            *[F.sum(c).alias(c) for c in LEGS],
        )
    )


def family_report(usage: DataFrame, tree: DataFrame) -> DataFrame:
    """Per family: standalone without children; separate if a child model's input exceeds the parent's; else rollup."""
    r = rooted(usage, tree)
    by = (
        r.groupBy("root", "model")
        .agg(
            F.sum(F.when(~F.col("child"), F.col("input_tokens")).otherwise(0)).alias("own"),
            F.sum(F.when(F.col("child"), F.col("input_tokens")).otherwise(0)).alias("below"), F.max("child").alias("child"),
        )
    )
    s = (
        by.groupBy("root")
        .agg(
            F.max("child").alias("child"), F.bool_or(F.col("below") > F.col("own")).alias("over"), F.sum("own").alias("own"),
            F.sum("below").alias("below"), F.sum(F.greatest(F.col("own") - F.col("below"), F.lit(0))).alias("net"),
        )
    )
    kind = F.when(~F.col("child"), "standalone").when(F.col("over"), "separate").otherwise("rollup")
    return s.select("root", kind.alias("accounting"), F.when(kind == "rollup", F.col("net")).otherwise(F.col("own")).alias("parent_input"), F.col("below").alias("children_input"))


def session_rates(usage: DataFrame) -> DataFrame:
    s = usage.groupBy("session_id").agg(F.max("model").alias("model"), *[F.sum(c).alias(c) for c in LEGS])
    return s.withColumn("rate", cache_rate(F.col("cache_read_tokens"), F.col("input_tokens")))


def mean_rate(rate: Column) -> Column:
    """Plain mean of rates in (0, 1]; a missing and a zero rate count for nothing.

    Rates have four digits, so they are summed as whole ten-thousandths: the mean, ties up, depends on no order.
    """
    parts = F.when((rate > 0) & (rate <= 1), F.round(rate * 10000).cast("long"))
    n = F.count(parts)
    return F.when(n > 0, F.floor((2 * F.sum(parts) + n) / (2 * F.greatest(n, F.lit(1)))) / 10000)


def cache_tables(rates: DataFrame, group: Column, least: int = 3) -> DataFrame:
    """Eligible and excluded sessions by group, model and both, in one pass."""
    why = F.when(F.col("rate").isNull(), "no_rate").when(F.col("rate") == 0, "zero").otherwise("eligible")
    r = rates.withColumn("grp", group).withColumn("why", why)
    out = (
        r.groupingSets([["grp"], ["grp", "model"], []], "grp", "model")
        .agg(
            F.count_if(F.col("why") == "eligible").alias("eligible"), F.count_if(F.col("why") == "zero").alias("zero"),
            F.count_if(F.col("why") == "no_rate").alias("no_rate"), mean_rate(F.col("rate")).alias("mean_rate"),
        )
    )
    return out.where(F.col("eligible") >= least)


def cache_audit(rates: DataFrame) -> DataFrame:
    s = (
        rates.groupBy("model")
        .agg(
            F.count(F.lit(1)).alias("sessions"), mean_rate(F.col("rate")).alias("mean_rate"),
            cache_rate(F.sum("cache_read_tokens"), F.sum("input_tokens"), F.lit(True)).alias("weighted_rate"),
            F.count_if(F.col("rate") == 0).alias("zero"), F.count_if(F.col("rate").isNull()).alias("missing"),
        )
    )
    return s.withColumn("grade", F.when(F.col("weighted_rate") >= 0.8, "A").when(F.col("weighted_rate") >= 0.5, "B").when(F.col("weighted_rate") >= 0.2, "C").otherwise("D"))


def hotspots(commits: DataFrame, files: DataFrame, top: int = 20) -> DataFrame:
    j = files.distinct().join(commits, "hash")
    s = j.groupBy("path").agg(F.count(F.lit(1)).alias("commits"), F.count_distinct("author").alias("authors"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return s.orderBy(F.desc("commits"), "path").limit(top)


def sunday_week(ts: Column, monday: bool = True) -> Column:
    """Week of the year 00-53 whose weeks begin on Monday (strftime %W)."""
    yday, wday = F.dayofyear(ts), F.weekday(ts)
    return F.floor((yday + 6 - wday) / 7)


def commit_frequency(commits: DataFrame, files: DataFrame) -> DataFrame:
    week = F.concat(F.year("ts").cast("string"), F.lit("-"), F.lpad(sunday_week(F.col("ts")).cast("string"), 2, "0"))
    n_files = files.groupBy("hash").agg(F.count_distinct("path").alias("files"))
    j = commits.withColumn("week", week).join(n_files, "hash", "left")
    return j.groupBy("week").agg(F.count(F.lit(1)).alias("commits"), F.sum(F.coalesce("files", F.lit(0))).alias("changes"), F.count_distinct("author").alias("authors"))


def work_sessions(commits: DataFrame, gap: int = 3600, by: str = "author") -> DataFrame:
    """Clusters of commits no further apart than `gap` seconds."""
    w = Window.partitionBy(by).orderBy("ts", "hash")
    far = F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.lag("ts").over(w).cast("timestamp")) > gap
    s = commits.withColumn("new", F.coalesce(far.cast("int"), F.lit(1))).withColumn("cluster", F.sum("new").over(w))
    return s.groupBy(by, "cluster").agg(F.count(F.lit(1)).alias("commits"), F.min("ts").alias("started"), F.max("ts").alias("ended"))


def session_commits(sessions: DataFrame, commits: DataFrame, by: list[str] = (), base: int = 60) -> DataFrame:
    """Commits whose time lies within a session, of the same `by` columns (such as the project).

    Each session has a level, at which buckets of base * 2^level seconds are as long as it or longer, so it stands in two
    buckets at most however long it is; a commit stands in one bucket of each level that sessions have, some forty at most.
    """
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    level = F.greatest(F.ceil(F.log2(F.greatest(seconds("modified") - seconds("created") + 1, F.lit(1)) / base)), F.lit(0)).cast("int")
    number = lambda c: F.floor(seconds(c) / (F.lit(base) * F.pow(F.lit(2), F.col("level")))).cast("long")
    s = sessions.where("created <= modified").withColumn("level", level)
    levels = sorted(r[0] for r in s.select("level").distinct().collect())
    s = s.withColumn("bucket", F.explode(F.array_distinct(F.array(number("created"), number("modified")))))
    c = commits.withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>"))).withColumn("bucket", number("ts"))
    return s.join(c, [*by, "level", "bucket"]).where((F.col("ts") >= F.col("created")) & (F.col("ts") <= F.col("modified"))).drop("level", "bucket")


def session_commit_counts(sessions: DataFrame, commits: DataFrame, by: list[str] = (), bucket: int = 3600) -> DataFrame:
    """session_id and the number of commits whose time lies within the session, of the same `by` columns, where there are any.

    A session's number is the running count of commits up to its end less that before its start, so no pair of a session and
    a commit is built; work grows with the rows, however many commits the sessions share. Running counts go by buckets of seconds.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    known = F.lit(True)
    for c in by:
        known = known & F.col(c).isNotNull()
    made = commits.where(known).select(*by, micros("ts").alias("at")).where("at IS NOT NULL").groupBy(*by, "at").agg(F.count(F.lit(1)).alias("n"))
    ends = F.explode(F.array(F.struct(micros("created").alias("at"), F.lit(0).alias("side")), F.struct(micros("modified").alias("at"), F.lit(2).alias("side"))))
    ends = sessions.where("created <= modified").where(known).select("session_id", *by, ends.alias("e")).select("session_id", *by, "e.at", "e.side", F.lit(0).cast("long").alias("n"))
    rows = ends.unionByName(made.withColumn("side", F.lit(1)), allowMissingColumns=True).withColumn("bucket", F.floor(F.col("at") / (bucket * 1_000_000)))
    run = carried(rows, list(by), "bucket", ["at", "side"], {"upto": F.col("n")})
    counted = F.sum(F.when(F.col("side") == 2, F.col("upto")).otherwise(-F.col("upto")))
    return run.where("side <> 1").groupBy("session_id").agg(counted.alias("commits")).where("commits > 0")


def snapshot_diff(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    x, y = a.select(key, F.col(value).alias("old")), b.select(key, F.col(value).alias("new"))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return x.join(y, key, "full").withColumn("change", kind).where((F.col("change") != "changed") | (F.col("old") != F.col("new")))


def coverage(rows: DataFrame, thin: int) -> DataFrame:
    """Rows of every month between the first and the last, empty and thin months marked."""
    by = rows.groupBy(F.date_trunc("month", "ts").cast("timestamp_ntz").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    span = by.agg(F.min("month").alias("a"), F.max("month").alias("b")).select(F.explode(F.sequence(F.to_date("a"), F.to_date("b"), F.expr("INTERVAL 1 MONTH"))).alias("day"))
    out = span.select(F.col("day").cast("timestamp_ntz").alias("month")).join(by, "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("n"))
    return out.withColumn("state", F.when(F.col("n") == 0, "empty").when(F.col("n") < thin, "thin").otherwise("full"))


def month_forecast(rows: DataFrame, months: int = 6) -> DataFrame:
    """Each month against the regression line of the months before it; an anomaly is over two residual deviations off.

    Closed-form sums over a window of one row for each month.
    """
    by = rows.groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).cast("double").alias("y"))
    order = Window.orderBy("month")
    w = order.rowsBetween(-months, -1)
    s = by.withColumn("x", F.row_number().over(order).cast("double"))
    s = (
        s.withColumn("n", F.count("y").over(w))
        .withColumn("sx", F.sum("x").over(w))
        .withColumn("sy", F.sum("y").over(w))
        .withColumn("sxy", F.sum(F.col("x") * F.col("y")).over(w))
        .withColumn("sxx", F.sum(F.col("x") * F.col("x")).over(w))
        .withColumn("syy", F.sum(F.col("y") * F.col("y")).over(w))
        .where(F.col("n") == months)
    )
    s = (
        s.withColumn("slope", (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / (F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")))
        .withColumn("cut", (F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n"))
    )
    rest = F.greatest(F.col("syy") - F.col("cut") * F.col("sy") - F.col("slope") * F.col("sxy"), F.lit(0.0))
    sigma = F.sqrt(rest / F.col("n"))
    off = F.col("y") - (F.col("cut") + F.col("slope") * F.col("x"))
    z = F.when(sigma > 1e-9, off / sigma).when(F.abs(off) >= 1, F.lit(99.0)).otherwise(0.0)
    return s.select("month", F.col("y").cast("long").alias("n"), F.round("slope", 3).alias("slope"), (F.abs(z) > 2).alias("anomaly"))
