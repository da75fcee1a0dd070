"""Trends and diagnosis over sessions and tool calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .facts import is_error, rate


def period(ts: Column, unit: str) -> Column:
    """ISO week YYYY-Www, or month YYYY-MM; both sort as text."""
    if unit == "week":
        return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))
    return F.date_format(ts, "yyyy-MM")


def summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Sessions, calls, error rate and mean length of sessions with one, by columns."""
    return (
        rows.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("sessions"), F.sum("messages").alias("turns"), F.sum("tool_calls").alias("tool_calls"),
            rate(F.sum("errors"), F.sum("tool_calls"), 3).alias("error_rate"),
            F.round(F.avg(F.when(F.col("duration_seconds") > 0, F.col("duration_seconds"))), 3).alias("mean_seconds"),
        )
    )


def direction(delta: Column, good: int = -1, least: float = 0.01) -> Column:
    return F.when(delta.isNull(), None).when(delta * good >= least, "improving").when(delta * good <= -least, "worsening").otherwise("stable")


def period_over_period(rows: DataFrame, unit: str = "week", last: int = 8) -> DataFrame:
    """Summaries of the last periods, with differences to the period before."""
    s = summary(rows.withColumn("period", period(F.col("created"), unit)), ["period"])
    s = s.orderBy(F.desc("period")).limit(last)
    w = Window.orderBy("period")  # at most `last` rows
    s = s.withColumn("d_sessions", F.col("sessions") - F.lag("sessions").over(w)).withColumn("d_error_rate", F.round(F.col("error_rate") - F.lag("error_rate").over(w), 3))
    return s.withColumn("direction", direction(F.col("d_error_rate")))


def tool_changes(calls: DataFrame, unit: str = "week", least: float = 0.10) -> DataFrame:
    """Tools whose error rate differs by `least` or more between their first and last period."""
    by = calls.groupBy("name", period(F.col("ts"), unit).alias("period")).agg((F.count_if(is_error()) / F.count(F.lit(1))).alias("r"))
    ends = by.groupBy("name").agg(F.min_by("r", "period").alias("first"), F.max_by("r", "period").alias("last"), F.count(F.lit(1)).alias("periods")).where("periods >= 2")
    change = F.round(F.col("last") - F.col("first"), 4)
    return (
        ends.select(
            "name", F.round("first", 4).alias("first_rate"), F.round("last", 4).alias("last_rate"), change.alias("change"),
            F.when(change >= least, "regression").when(change <= -least, "improvement").alias("kind"),
        )
        .where("kind IS NOT NULL")
    )


def anomalies(rows: DataFrame, calls: DataFrame, error_rate: float = 0.25, retries: int = 15, messages: int = 50, newest: int = 50) -> DataFrame:
    """Sessions with many errors (newest first), with a tool called often, or that are long."""
    order = [F.desc("created"), F.asc("session_id")]
    high = (
        rows.where(F.col("errors") / F.col("tool_calls") >= error_rate)
        .orderBy(*order)
        .limit(newest)
        .select("session_id", F.lit("high_error_rate").alias("kind"), rate(F.col("errors"), F.col("tool_calls")).alias("value"))
    )
    loops = (
        calls.groupBy("session_id", "name")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= retries)
        .groupBy("session_id")
        .agg(F.max("n").cast("double").alias("value"))
        .select("session_id", F.lit("retry_loop").alias("kind"), "value")
    )
    long = rows.where(F.col("messages") >= messages).orderBy(*order).limit(newest).select("session_id", F.lit("long_conversation").alias("kind"), F.col("messages").cast("double").alias("value"))
    return high.unionByName(loops).unionByName(long)


def advantages(rows: DataFrame, top: int = 10) -> DataFrame:
    """Sessions without errors and many calls, and short ones that called tools."""
    clean = rows.where("errors = 0 AND tool_calls >= 3").orderBy(F.desc("tool_calls"), "session_id").limit(top).select("session_id", F.lit("clean_efficient").alias("kind"))
    fast = rows.where("tool_calls >= 3 AND duration_seconds > 0").orderBy("duration_seconds", "session_id").limit(top).select("session_id", F.lit("fast_resolution").alias("kind"))
    return clean.unionByName(fast)


def recent_sessions(rows: DataFrame, since: str, agent: str | None = None, least: int = 2, limit: int = 20) -> DataFrame:
    """Largest recent sessions; all filters apply before the selection."""
    out = rows.where((F.col("created") >= F.lit(since).cast("timestamp_ntz")) & (F.col("messages") >= least))
    if agent:
        out = out.where(F.col("agent") == agent)
    out = out.orderBy(F.desc("messages"), "session_id")
    return out.limit(limit) if limit > 0 else out


def tool_error_patterns(calls: DataFrame, error_rate: float = 0.25, least: int = 3, evidence: int = 10) -> DataFrame:
    """Tools with a high error rate in `least` sessions or more, and the first sessions as evidence."""
    by = calls.groupBy("name", "session_id").agg((F.count_if(is_error()) / F.count(F.lit(1))).alias("r")).where(F.col("r") >= error_rate)
    first = by.withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy("session_id"))).where(F.col("k") <= evidence)
    shown = first.groupBy("name").agg(F.array_join(F.array_sort(F.collect_list("session_id")), ",").alias("evidence"))
    return by.groupBy("name").agg(F.count(F.lit(1)).alias("sessions")).where(F.col("sessions") >= least).join(shown, "name")


def project_outliers(rows: DataFrame, over: float = 0.10, floor: float = 0.15, least: int = 3) -> DataFrame:
    """Projects whose error rate is well above the rate of all."""
    by = rows.groupBy("project").agg(F.count(F.lit(1)).alias("sessions"), F.sum("errors").alias("errors"), F.sum("tool_calls").alias("calls"))
    everything = by.agg((F.sum("errors") / F.sum("calls")).alias("overall"))  # one row
    out = by.withColumn("r", F.col("errors") / F.col("calls")).crossJoin(F.broadcast(everything)).where((F.col("sessions") >= least) & (F.col("r") >= F.col("overall") + over) & (F.col("r") > floor))
    return out.select("project", "sessions", F.round("r", 4).alias("error_rate"), F.round("overall", 4).alias("overall"))


def half_trend(rows: DataFrame, buckets: int = 64) -> DataFrame:
    """First and second half of the sessions in time.

    The middle is found from counts by day and, within its day, by rank, so that no window holds all rows.
    """
    day = F.to_date("created")
    days = rows.groupBy(day.alias("day")).count()
    w = Window.orderBy("day")  # one row for each day
    days = days.withColumn("before", F.sum("count").over(w) - F.col("count")).withColumn("all", F.sum("count").over(Window.partitionBy())).select(F.col("day").alias("the_day"), "before", "all")
    ranked = rows.join(days, day == F.col("the_day")).withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("the_day").orderBy("created", "session_id")))
    half = F.when(F.col("rank") <= F.floor(F.col("all") / 2), "first").otherwise("second")
    return (
        ranked.groupBy(half.alias("half"))
        .agg(
            F.count(F.lit(1)).alias("sessions"), F.round(F.avg("messages"), 4).alias("avg_messages"),
            F.round(F.avg("errors"), 4).alias("errors_per_session"),
            F.round(F.sum("duration_seconds") / 60, 2).alias("minutes"),
        )
    )


def env_health(calls: DataFrame, family: Column) -> DataFrame:
    """Error rate, number of tools and the tool behind most errors of each family, and a status."""
    by = calls.withColumn("family", family).groupBy("family", "name").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_error()).alias("bad"))
    out = by.groupBy("family").agg(F.sum("n").alias("calls"), F.sum("bad").alias("errors"), F.count(F.lit(1)).alias("tools"), F.max(F.struct("bad", "name")).alias("worst"))
    r = F.col("errors") / F.col("calls")
    dominant = F.when((F.col("worst.bad") >= 5) & (F.col("worst.bad") / F.col("errors") >= 0.3), F.col("worst.name"))
    return out.select(
        "family", "calls", "tools", F.round(r, 4).alias("error_rate"), dominant.alias("dominant_tool"),
        F.when(F.col("calls") < 10, "UNKNOWN").when(r >= 0.08, "CRITICAL").when(r >= 0.04, "WARNING").otherwise("OK").alias("status"),
    )


def issue_scores(issues: DataFrame, penalty: dict[str, float], weights: dict[str, float]) -> DataFrame:
    """Per entity and run: 100 less penalties by dimension, their weighted mean, band and change since the last run."""
    cost = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in penalty.items() for x in kv]), F.col("severity")), F.lit(0.0))
    by = issues.groupBy("entity", "run", "dimension").agg(F.greatest(F.lit(100.0) - F.sum(cost), F.lit(0.0)).alias("s"))
    wide = by.groupBy("entity", "run").pivot("dimension", list(weights)).agg(F.first("s"))
    total = sum((F.coalesce(F.col(d), F.lit(100.0)) * w for d, w in weights.items()), F.lit(0.0)) / sum(weights.values())
    s = wide.select("entity", "run", F.round(total, 4).alias("score"))
    change = F.round(F.col("score") - F.lag("score").over(Window.partitionBy("entity").orderBy("run")), 4)
    return s.select("entity", "run", "score", change.alias("change"), F.when(F.col("score") >= 80, "good").when(F.col("score") >= 60, "fair").otherwise("poor").alias("band"))
