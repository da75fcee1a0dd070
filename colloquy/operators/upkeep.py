"""Upkeep of notes, versions, analyses and open items: staleness, budgets, differences, matches, error texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
HALF_LIVES = {"project": 14, "feedback": 90, "user": 180, "reference": 60, "value": 365, "unknown": 30}
TIER_HOURS = {"periodic": 7 * 24, "once": 24}
CONFIDENCE = {"confirmed": 3, "high": 2, "medium": 1, "low": 0}
FAILING = ("error", "failed", "failure", "fatal", "traceback", "exception", "cannot", "could not", "unable to")
PASSING = ("successfully", "done", "completed")


def _look_up(values: dict[str, int], key: Column, default: int | None) -> Column:
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.element_at(table, key), F.lit(default))


def _any_word(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def is_error_text(text: Column) -> Column:
    """An error word anywhere and no word of success; null texts are none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return _any_word(low, FAILING) & ~_any_word(low, PASSING)


def age_days(ts: Column, at: str) -> Column:
    return (F.unix_micros(F.lit(at).cast("timestamp_ntz").cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 86_400e6


def staleness(age: Column, kind: Column) -> Column:
    """0 (new) to 100: the decayed part of a note's worth, in whole per cents, by its kind's half-life."""
    gone = 1 - F.exp(-age * F.lit(0.6931471805599453) / _look_up(HALF_LIVES, kind, HALF_LIVES["unknown"]))
    return F.least(F.greatest(F.floor(100 * gone + 1e-9), F.lit(0)), F.lit(100)).cast("int")


def with_staleness(notes: DataFrame, at: str) -> DataFrame:
    score = staleness(age_days(F.col("ts"), at), F.col("kind"))
    return notes.withColumn("score", score).withColumn("action", F.when(F.col("score") < 50, "keep").when(F.col("score") < 75, "review").otherwise("prune"))


def note_stats(notes: DataFrame, at: str) -> DataFrame:
    """Number, size, tokens and staleness histogram of each project's notes."""
    s, score = with_staleness(notes, at), F.col("score")
    return s.groupBy("project").agg(
        F.count(F.lit(1)).alias("files"), F.sum(F.octet_length("text")).alias("bytes"), F.floor(F.sum(F.length("text")) / 4).alias("tokens"),
        F.count_if(score < 25).alias("fresh"), F.count_if((score >= 25) & (score < 50)).alias("aging"), F.count_if((score >= 50) & (score < 75)).alias("review"), F.count_if(score >= 75).alias("stale"),
    )


def valid_analyses(analyses: DataFrame, at: str) -> DataFrame:
    """The newest analysis of each session that is no older than its source and within its tier's time."""
    hours = _look_up(TIER_HOURS, F.col("tier"), None)
    live = analyses.where((F.col("analyzed") >= F.col("modified")) & (hours.isNull() | (age_days(F.col("analyzed"), at) * 24 <= hours)))
    return live.groupBy("session_id").agg(F.max_by("analysis_id", F.struct("analyzed", "analysis_id")).alias("analysis_id"))


def version_order(a: Column, b: Column) -> Column:
    """-1, 0 or 1: numbers part by part, missing parts as zero; as texts if one has no leading number."""

    def numbers(v: Column) -> Column:
        heads = F.transform(F.split(v, r"[.\-+]"), lambda x: F.regexp_extract(x, "^[0-9]+", 0))
        stop = F.array_position(heads, "")
        return F.transform(F.when(stop > 0, F.slice(heads, 1, (stop - 1).cast("int"))).otherwise(heads), lambda x: x.cast("long"))

    x, y = numbers(a), numbers(b)
    n = F.greatest(F.size(x), F.size(y))
    zero = F.lit(0).cast("long")
    x_all, y_all = (F.concat(v, F.array_repeat(zero, n - F.size(v))) for v in (x, y))

    def sign(less: Column, more: Column) -> Column:
        return F.when(less, -1).when(more, 1).otherwise(0)

    return F.when((F.size(x) == 0) | (F.size(y) == 0), sign(a < b, a > b)).otherwise(sign(x_all < y_all, x_all > y_all))


def best_matches(names: DataFrame, name: str, wanted: str) -> DataFrame:
    """Rows whose name equals the wanted text if there are any, else those that contain it."""
    level = F.when(F.col(name) == wanted, 0).when(F.contains(F.lower(name), F.lit(wanted.lower())), 1)
    ranked = names.withColumn("level", level).where("level IS NOT NULL")
    best = ranked.agg(F.min("level").alias("level"))  # one row
    return ranked.join(F.broadcast(best), "level", "left_semi")


def changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Keys that are new, gone or kept between two runs, with the change of their rows."""
    both = before.select(key, F.lit(-1).alias("d")).unionByName(after.select(key, F.lit(1).alias("d")))
    s = both.groupBy(key).agg(F.bool_or(F.col("d") < 0).alias("old"), F.bool_or(F.col("d") > 0).alias("new"), F.sum("d").alias("delta"))
    return s.select(key, F.when(~F.col("old"), "new").when(~F.col("new"), "gone").otherwise("kept").alias("change"), "delta")


def unused(names: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """Distinct names that no row uses."""
    return names.select(key).distinct().join(used.select(key), key, "left_anti")


def archive(analyses: DataFrame) -> DataFrame:
    """Analyses by tier, by agent and in all, and how many are older than their source, in one pass."""
    by = analyses.groupingSets([["agent"], ["tier"], []], "agent", "tier")
    return by.agg(F.count(F.lit(1)).alias("analyses"), F.count_if(F.col("analyzed") < F.col("modified")).alias("outdated"), F.max("analyzed").alias("last"))


def today(items: DataFrame, day: str, limit: int = 20) -> DataFrame:
    """Open items: due ones first, then by priority, confidence and last signal."""
    due = F.coalesce(F.col("follow_up") <= F.lit(day).cast("date"), F.lit(True))
    rank = _look_up(CONFIDENCE, F.col("confidence"), 1)
    return items.where("status = 'open'").withColumn("due", due).orderBy(F.desc("due"), F.desc("priority"), F.desc(rank), F.desc("last_signal"), "item_id").limit(limit)


def relevance(priority: Column, text: Column, trust: Column, include: list[str], exclude: list[str], boost: int = 1) -> Column:
    """Priority 0 to 5 under a profile: excluded topics fall to 0, included ones rise, a chat's trust is added."""
    low = F.lower(F.coalesce(text, F.lit("")))
    value = priority + F.when(_any_word(low, include), boost).otherwise(0) + F.coalesce(trust, F.lit(0))
    return F.when(_any_word(low, exclude), 0).otherwise(F.least(F.greatest(value, F.lit(0)), F.lit(5))).cast("int")


def codes(text: Column, confirm: list[str]) -> Column:
    """Runs of exactly six digits that begin with 0, 3 or 6, where a confirming word is in the text."""
    runs = F.filter(F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0)), lambda x: (F.length(x) == 6) & F.substring(x, 1, 1).isin("0", "3", "6"))
    return F.when(_any_word(F.lower(text), confirm), F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def repeated_subjects(rows: DataFrame, session: str, code: str, cost: str) -> DataFrame:
    """Codes of more than one session, with their rows' cost."""
    s = rows.groupBy(F.col(code).alias("code")).agg(F.count_distinct(session).alias("sessions"), F.sum(cost).alias("cost"))
    return s.where("sessions > 1")


def pack_budget(samples: DataFrame, by: str, order: list[str], per_group: int, budget: int) -> DataFrame:
    """The first `per_group` samples of each group in the given order, while their characters stay within the budget."""
    w = Window.partitionBy(by).orderBy(*order)
    ran = F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    top = samples.withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_group)  # few rows a group from here
    return top.withColumn("chars", ran).where(F.col("chars") <= budget)
