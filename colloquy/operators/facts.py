"""Session facts from tool calls: roll-ups, flags, tool and turn performance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_error() -> Column:
    return F.col("status") == "error"


def rate(part: Column, whole: Column, digits: int = 4) -> Column:
    """part / whole rounded, null without a whole."""
    return F.round(F.when(whole != 0, part / whole), digits)


def seconds_between(first: Column, last: Column) -> Column:
    return (F.unix_micros(last.cast("timestamp")) - F.unix_micros(first.cast("timestamp"))) / 1e6


def sessions(calls: DataFrame) -> DataFrame:
    """One row for each session of calls(session_id, agent, project, ts, status, duration_ms), in one aggregation.

    Without messages of its own a session counts its calls as such.
    """
    return calls.groupBy("session_id").agg(
        F.any_value("agent").alias("agent"), F.any_value("project").alias("project"), F.min("ts").alias("created"), F.max("ts").alias("modified"),
        F.count(F.lit(1)).alias("messages"), F.count(F.lit(1)).alias("tool_calls"), F.count_if(is_error()).alias("errors"), F.sum("duration_ms").alias("total_ms"), seconds_between(F.min("ts"), F.max("ts")).alias("duration_seconds"),
    )


def rich_stats(calls: DataFrame, error_rate: float = 0.25, turns: int = 40, retries: int = 15) -> DataFrame:
    """Tool counts and errors of each session as sorted maps, and its flags.

    Counts first by session and tool, so a session's map is built from its tools, not its calls.
    """
    by_tool = calls.groupBy("session_id", "name").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_error()).alias("bad"))
    entry = lambda v: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col(v) > 0, F.struct("name", F.col(v).alias("value"))))))
    s = by_tool.groupBy("session_id").agg(entry("n").alias("tool_usage"), entry("bad").alias("tool_errors"), F.sum("n").alias("calls"), F.sum("bad").alias("errors"), F.max("n").alias("most"))
    flags = F.array_compact(
        F.array(
            F.when(F.col("errors") / F.col("calls") > error_rate, F.lit("high_error_rate")),
            F.when(F.col("calls") > turns, F.lit("long_conversation")), F.when(F.col("most") > retries, F.lit("retry_loop")),
        ),
    )
    return s.select("session_id", "tool_usage", "tool_errors", "calls", "errors", flags.alias("flags"))


def tool_perf(calls: DataFrame) -> DataFrame:
    """Per tool: calls, errors, rate, mean, total and the percentiles at index int(n * p / 100) of the sorted durations.

    Ranks come from running counts over (tool, duration) groups, so no tool's durations are gathered in one row.
    """
    bins = calls.groupBy("name", "duration_ms").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_error()).alias("bad"))
    w = Window.partitionBy("name")
    run = bins.withColumn("upto", F.sum("n").over(w.orderBy("duration_ms"))).withColumn("all", F.sum("n").over(w))
    at = lambda p: F.min(F.when(F.col("upto") > F.least(F.floor(F.col("all") * p / 100), F.col("all") - 1), F.col("duration_ms")))
    return (
        run.groupBy("name")
        .agg(
            F.sum("n").alias("calls"), F.sum("bad").alias("errors"), rate(F.sum("bad"), F.sum("n")).alias("error_rate"),
            F.round(F.sum(F.col("n") * F.col("duration_ms")) / F.sum("n"), 4).alias("avg_ms"), at(50).alias("p50_ms"),
            at(95).alias("p95_ms"), F.sum(F.col("n") * F.col("duration_ms")).alias("total_ms"),
        )
    )


def retry_runs(calls: DataFrame, least: int = 3) -> DataFrame:
    """Runs of `least` or more consecutive errors of one tool within a session."""
    w = Window.partitionBy("session_id").orderBy("ts", "seq")
    key = F.concat_ws("|", "name", "status")
    runs = calls.withColumn("key", key).withColumn("change", F.coalesce((F.lag("key").over(w) != F.col("key")).cast("int"), F.lit(1)))
    runs = runs.withColumn("run", F.sum("change").over(w)).where(is_error())
    return (
        runs.groupBy("session_id", "run", "name")
        .agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("started"), F.max("ts").alias("ended"))
        .where(F.col("n") >= least)
        .select("session_id", "name", "n", "started", "ended")
    )


def call_results(calls: DataFrame, results: DataFrame, on: list[str]) -> DataFrame:
    """Calls with their results; a call without one counts as ok."""
    r = results.withColumn("has_result", F.lit(True))
    return (
        calls.join(r, on, "left")
        .withColumn("status", F.coalesce("status", F.lit("ok")))
        .withColumn("result", F.when(F.col("has_result"), F.col("result")).otherwise(F.lit("(no result captured)")))
        .drop("has_result")
    )


def active_minutes(rows: DataFrame) -> DataFrame:
    """Minutes by span, or by activity where a long span saw little of it."""
    span = F.col("duration_seconds") / 60
    activity = 2.5 * F.col("messages") + 0.8 * F.col("tool_calls")
    return rows.withColumn("minutes", F.round(F.when((span > 90) & (activity < 0.2 * span), activity).otherwise(span), 4))


def fair_merge(rows: DataFrame, limit: int = 20) -> DataFrame:
    """Newest first within each agent, then in turn across agents."""
    w = Window.partitionBy("agent").orderBy(F.col("created").desc_nulls_last(), "session_id")
    ranked = rows.withColumn("turn", F.row_number().over(w)).select("turn", "agent", "session_id", "created")
    out = ranked.orderBy("turn", "agent")
    return out.limit(limit) if limit > 0 else out


def candidate_rules(runs: DataFrame) -> DataFrame:
    """A rule text for each tool with retry runs."""
    return (
        runs.groupBy("name")
        .agg(F.count(F.lit(1)).alias("runs"), F.max("n").alias("longest"))
        .withColumn("rule", F.format_string("check inputs before calling %s again (%d runs, longest %d)", "name", "runs", "longest"))
    )
