"""Reports over sessions, usage, graded runs and files: insights, environments, habits, benchmarks, marked lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import saved
from .facts import rate
from .ordered import ranked

# Tools of every trade, limits of the habits, tags of debt and words of security.
GENERIC_TOOLS = ("read", "write", "edit", "bash", "grep", "glob", "ls", "websearch", "webfetch", "todowrite", "todoread", "askuserquestion", "sendmessage", "readsessioncontext")
WATCH, FLAGGED, LONG = 0.10, 0.30, 30
TAGS = ("TODO", "FIXME", "HACK", "XXX")
SECURITY = ("password", "secret", "token", "credential", "api_key")


def usage_insights(usage: DataFrame, model: str = "model", top: int = 12, least: int = 6) -> DataFrame:
    """(of, name, sessions, tokens, detail): by model (the `top` ones), by month with its top model, and by half of the sessions
    in time with its top model, where there are `least` sessions or more.

    usage has session_id, model, ts and tokens. Rows are added up by session, model and month once; all parts come from that.
    """
    base = saved(usage.groupBy("session_id", F.col(model).alias("model"), F.date_format("ts", "yyyy-MM").alias("month")).agg(F.sum("tokens").alias("tokens"), F.min("ts").alias("first")), "usage")
    best = lambda rows, by: rows.groupBy(by, "model").agg(F.sum("tokens").alias("tokens")).groupBy(by).agg(F.max(F.struct("tokens", "model"))["model"].alias("detail"))

    def part(rows: DataFrame, of: str, by: str) -> DataFrame:
        sums = rows.groupBy(by).agg(F.count_distinct("session_id").alias("sessions"), F.sum("tokens").alias("tokens"))
        sums = sums.join(best(rows, by), by) if by != "model" else sums.withColumn("detail", F.lit(None).cast("string"))
        return sums.select(F.lit(of).alias("of"), F.col(by).alias("name"), "sessions", "tokens", "detail")

    models = part(base, "model", "model").orderBy(F.desc("tokens"), "name").limit(top)
    order = ranked(base.groupBy("session_id").agg(F.min("first").alias("first")), [F.asc("first"), F.asc("session_id")], "place")
    total = order.agg(F.count(F.lit(1)).alias("total"))  # one row
    half = order.crossJoin(F.broadcast(total)).where(F.col("total") >= least).select("session_id", F.when(F.col("place") <= F.floor(F.col("total") / 2), "first").otherwise("second").alias("half"))
    return models.unionByName(part(base, "month", "month")).unionByName(part(base.join(half, "session_id"), "half", "half"))


def env_profiles(sessions: DataFrame, fields: dict[str, Column], by: str = "agent", usable: float = 0.5) -> DataFrame:
    """Each environment's number of sessions, the share of them with each field, the field that most have (primary, the first of
    equals), and how many fields at least `usable` of them have; one row `_all` for all, in one reading."""
    shares = [F.round(F.avg(F.coalesce(c, F.lit(False)).cast("int")), 4).alias(n) for n, c in fields.items()]
    out = sessions.rollup(by).agg(F.count(F.lit(1)).alias("sessions"), F.grouping(by).alias("__all"), *shares)
    primary = F.array_max(F.array(*[F.struct(F.col(n).alias("share"), F.lit(-i).alias("place"), F.lit(n).alias("name")) for i, n in enumerate(fields)]))["name"]
    layers = sum((F.when(F.col(n) >= usable, 1).otherwise(0) for n in fields), F.lit(0))
    name = F.when(F.col("__all") == 1, "_all").otherwise(F.col(by))
    return out.select(name.alias(by), "sessions", *fields, primary.alias("primary"), layers.alias("layers"))


def habits(sessions: DataFrame, calls: DataFrame, by: str = "agent", top: int = 10) -> DataFrame:
    """Each agent's error rate (watch over 10 %), share of flagged sessions (over 30 %), mean messages (long over 30), calls of skills,
    and its `top` tools that are not of every trade; of all tools where it has no others.

    sessions has errors, tool_calls, messages and flagged; calls has the agent and a tool's name. Calls are counted by tool first.
    """
    s = sessions.groupBy(by).agg(
        rate(F.sum("errors"), F.sum("tool_calls")).alias("error_rate"), F.round(F.avg(F.col("flagged").cast("int")), 4).alias("flag_share"), F.round(F.avg("messages"), 4).alias("avg_messages")
    )
    counts = calls.groupBy(by, "name").agg(F.count(F.lit(1)).alias("n")).withColumn("own", ~F.lower("name").isin(*GENERIC_TOOLS))
    some = F.max(F.col("own").cast("int")).over(Window.partitionBy(by))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "name"))
    best = counts.withColumn("some", some).where(F.col("own") | (F.col("some") == 0)).withColumn("k", place).where(F.col("k") <= top)
    tools = best.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("k", F.concat_ws(":", "name", F.col("n").cast("string")).alias("t")))).alias("t"))
    skills = counts.groupBy(by).agg(F.sum(F.when(F.col("name") == "Skill", F.col("n")).otherwise(0)).alias("skill_calls"))
    out = s.join(tools.select(by, F.array_join(F.col("t")["t"], ",").alias("tools")), by, "left").join(skills, by, "left")
    marks = {"watch": F.col("error_rate") > WATCH, "flagged": F.col("flag_share") > FLAGGED, "long": F.col("avg_messages") > LONG}
    return out.select(by, "error_rate", "flag_share", "avg_messages", F.coalesce("tools", F.lit("")).alias("tools"), F.coalesce("skill_calls", F.lit(0)).alias("skill_calls"), *[c.alias(n) for n, c in marks.items()])


def eval_benchmark(runs: DataFrame) -> DataFrame:
    """Each case's pass rates with and without help, and a row for all: runs(case, helped, passed, score).

    Mean, sample deviation, least and most score of both arms, the difference of pass rates, and whether a case tells the
    arms apart; in the row of all (case null) the number of cases that do.
    """
    arm = lambda on: F.col("helped") if on else ~F.col("helped")
    passed = lambda on: F.avg(F.when(arm(on), F.col("passed").cast("int")))
    stats = lambda on, name: [f(F.when(arm(on), F.col("score"))).alias(f"{n}_{name}") for n, f in (("mean", F.avg), ("stddev", F.stddev_samp), ("min", F.min), ("max", F.max))]
    both = [passed(True).alias("rate_with"), passed(False).alias("rate_without"), *stats(True, "with"), *stats(False, "without")]
    cases = runs.groupBy("case").agg(F.count(F.lit(1)).alias("runs"), *both)
    apart = cases.agg(F.count_if(F.col("rate_with") != F.col("rate_without")).alias("apart"))
    each = cases.withColumn("apart", F.coalesce(F.col("rate_with") != F.col("rate_without"), F.lit(False)).cast("long"))
    every = runs.agg(F.count(F.lit(1)).alias("runs"), *both).crossJoin(apart).withColumn("case", F.lit(None).cast(cases.schema["case"].dataType))
    out = each.unionByName(every.select(*each.columns))
    digits = [F.round(c, 4).alias(c) for c in out.columns if c.startswith(("rate", "mean", "stddev"))]
    return out.select("case", "runs", *digits, *[c for c in out.columns if c.startswith(("min", "max"))], "apart", F.round(F.col("rate_with") - F.col("rate_without"), 4).alias("delta"))


def marked_lines(files: DataFrame, key: str = "id", text: str = "text", tags: tuple[str, ...] = TAGS) -> DataFrame:
    """(key, line, tag, note, security): lines with a tag of debt, what stands behind the tag, and whether it speaks of security."""
    tag = rf"\b({'|'.join(tags)})\b"
    lines = files.select(key, F.posexplode(F.split(text, "\n")).alias("line", "code"))
    found = lines.select(key, "line", F.regexp_extract("code", tag, 1).alias("tag"), F.regexp_extract("code", tag + r"[:\s]*(.*)$", 2).alias("note")).where("tag <> ''")
    return found.withColumn("security", F.lower("note").rlike("|".join(SECURITY)))


def debt_counts(lines: DataFrame) -> DataFrame:
    """Marked lines by tag: how many, how many of them on security, in how many files."""
    return lines.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.count_if("security").alias("security"), F.count_distinct("id").alias("files"))
