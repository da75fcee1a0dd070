"""Facts and turns of sessions from their transcript records of mixed types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.transcripts import blocks_text, field, records

# Records that mark a cut context, the model of answers that no model gave, openings of made turns.
COMPACTIONS = ("compact_boundary", "microcompact_boundary")
SYNTHETIC = "<synthetic>"
INTERRUPTED = "[Request interrupted"
LEGS = {"input_tokens": "input_tokens", "output_tokens": "output_tokens", "cache_read_tokens": "cache_read_input_tokens", "cache_create_tokens": "cache_creation_input_tokens"}


def _yes(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "boolean"), F.lit(False))


def _blocks(v: Column) -> Column:
    """The blocks of a message; none where its content is a string or missing."""
    return F.coalesce(F.try_variant_get(v, "$.message.content", "array<variant>"), F.array().cast("array<variant>"))


def _of_type(v: Column, kind: str) -> Column:
    return F.filter(_blocks(v), lambda b: F.coalesce(F.try_variant_get(b, "$.type", "string") == kind, F.lit(False)))


def spoken(text: Column) -> Column:
    """A text without the reminder that a system put before it; nothing is left of one that is not closed."""
    plain = F.trim(text)
    rest = F.trim(F.regexp_replace(plain, r"(?s)^<system-reminder.*?</system-reminder>", ""))
    return F.when(F.startswith(rest, F.lit("<system-reminder")), "").otherwise(rest)


def turn_kind(v: Column) -> Column:
    """What a user's or assistant's record is: `user` or `assistant` for turns of theirs, else why it is none: meta, summary,
    tool_result, empty, reminder, interrupted, synthetic; null for records of other types."""
    text = F.coalesce(F.trim(blocks_text(v, "$.message.content")), F.lit(""))
    user = (
        F.when(_yes(v, "$.isMeta"), "meta").when(_yes(v, "$.isCompactSummary"), "summary").when(F.size(_of_type(v, "tool_result")) > 0, "tool_result")
        .when(text == "", "empty").when(spoken(text) == "", "reminder").when(F.startswith(text, F.lit(INTERRUPTED)), "interrupted").otherwise("user")
    )
    answer = F.when(F.coalesce(field(v, "$.message.model"), F.lit("")) == SYNTHETIC, "synthetic").otherwise("assistant")
    kind = field(v, "$.type")
    return F.when(kind == "user", user).when(kind == "assistant", answer)


def turns(lines: DataFrame) -> DataFrame:
    """(path, line_no, role, time, text) of what users and assistants said, without made turns; tool calls alone are no text."""
    v = F.col("v")
    r = records(lines).withColumn("kind", turn_kind(v)).where("kind IN ('user', 'assistant')")
    out = r.select("path", "line_no", F.upper("kind").alias("role"), field(v, "$.timestamp").alias("time"), spoken(blocks_text(v, "$.message.content")).alias("text"))
    return out.where(F.col("text") != "")


def session_records(lines: DataFrame) -> DataFrame:
    """One row for each path of transcript lines: turns, tool calls, errors, tokens by leg, first branch, slug and model,
    last summary, most edited files, compactions, first and last time.

    A request whose answer is written in several records counts its last usage once; records without a request id count
    each. Rows are added up by request first and then by path, so one path's rows never meet in one task unreduced.
    Reminders and interruptions count as user messages here, as they stand for a user's act.
    """
    v = F.col("v")
    kind, answer = turn_kind(v), F.col("kind") == "assistant"
    legs = {n: F.try_variant_get(v, f"$.message.usage.{p}", "bigint") for n, p in LEGS.items()}
    r = records(lines).withColumn("kind", kind).withColumn("type", field(v, "$.type"))
    failed = _yes(v, "$.isError") | _yes(v, "$.is_error") | ((F.col("type") == "user") & F.exists(_blocks(v), lambda b: _yes(b, "$.is_error")))
    files = F.size(F.map_keys(F.try_variant_get(v, "$.snapshot.trackedFileBackups", "map<string,variant>")))
    own = r.select(
        "path", "line_no", F.coalesce(F.when(answer, field(v, "$.requestId")), F.concat(F.lit("line "), F.col("line_no").cast("string"))).alias("request"),
        F.col("kind").isin("user", "reminder", "interrupted").cast("int").alias("user_messages"), F.coalesce(answer, F.lit(False)).cast("int").alias("assistant_messages"),
        F.when(answer, F.size(_of_type(v, "tool_use"))).otherwise(0).alias("tool_calls"), F.coalesce(failed, F.lit(False)).cast("int").alias("errors"),
        F.when(F.col("type") == "file-history-snapshot", files).alias("files_edited"), ((F.col("type") == "system") & F.coalesce(field(v, "$.subtype"), F.lit("")).isin(*COMPACTIONS)).cast("int").alias("compactions"),
        F.nullif(field(v, "$.gitBranch"), F.lit("")).alias("branch"), F.nullif(field(v, "$.slug"), F.lit("")).alias("slug"), F.when(answer, F.nullif(field(v, "$.message.model"), F.lit(""))).alias("model"),
        F.when(F.col("type") == "summary", field(v, "$.summary")).alias("summary"), F.nullif(field(v, "$.timestamp"), F.lit("")).alias("time"),
        F.when(answer & field(v, "$.message.usage").isNotNull() | F.try_variant_get(v, "$.message.usage.input_tokens", "bigint").isNotNull() & answer, F.struct("line_no", *[F.coalesce(c, F.lit(0)).alias(n) for n, c in legs.items()])).alias("usage"),
    )
    sums, firsts = ("user_messages", "assistant_messages", "tool_calls", "errors", "compactions"), ("branch", "slug", "model")
    at = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col("line_no"), F.col(c).alias("value")))
    one = own.groupBy("path", "request").agg(
        *[F.sum(c).alias(c) for c in sums], F.max("files_edited").alias("files_edited"), *[F.min(at(c)).alias(c) for c in firsts], F.max(at("summary")).alias("summary"),
        F.min("time").alias("started"), F.max("time").alias("ended"), F.max("usage").alias("usage"),
    )
    return one.groupBy("path").agg(
        *[F.sum(c).alias(c) for c in sums], F.coalesce(F.max("files_edited"), F.lit(0)).alias("files_edited"), *[F.coalesce(F.sum(f"usage.{n}"), F.lit(0)).alias(n) for n in LEGS],
        *[F.min(c)["value"].alias(c) for c in firsts], F.max("summary")["value"].alias("summary"), F.min("started").alias("started"), F.max("ended").alias("ended"),
    )
