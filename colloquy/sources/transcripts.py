"""Transcripts as lines of JSON: reading, detection of the layout, messages of declared and unknown layouts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# What names a speaker.
USER = ("user", "human", "user_message", "turn.prompt", "prompt")
ASSISTANT = ("assistant", "ai", "bot", "agent", "model", "agent_message", "assistant_msg")
FLAT_TYPES = ("user", "assistant", "system", "tool_result", "reasoning", "tool_use", "tool_call", "function_call")
TOP_ROLES = ("user", "assistant", "system", "tool", "human", "model")


def read_lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, line_no, raw) of text files; bytes that are not UTF-8 are replaced.

    A file's blocks may be read apart, so a line's place is that of its block, then that within it.
    """
    m = spark.read.text(paths).select("value", "_metadata.file_path", "_metadata.file_block_start")
    m = m.withColumn("id", F.monotonically_increasing_id())
    w = Window.partitionBy("file_path").orderBy("file_block_start", "id")
    return m.select(F.col("file_path").alias("path"), F.row_number().over(w).alias("line_no"), F.col("value").alias("raw"))


def records(lines: DataFrame) -> DataFrame:
    """Lines that are JSON objects, parsed once; blank and broken ones fall."""
    v = F.try_parse_json(F.when(F.startswith(F.ltrim("raw"), F.lit("{")), F.col("raw")))
    return lines.withColumn("v", v).where("v IS NOT NULL").drop("raw")


def field(v: Column, *paths: str, kind: str = "string") -> Column:
    """The first of the paths that holds a value."""
    return F.coalesce(*[F.try_variant_get(v, p, kind) for p in paths])


def blocks_text(v: Column, path: str) -> Column:
    """Text at a path: a string as it is, the text of a list's blocks joined by newlines."""
    blocks = F.try_variant_get(v, path, "array<variant>")
    parts = F.filter(
        F.transform(
            blocks,
            lambda b: F.coalesce(F.try_variant_get(b, "$.text", "string"), F.when(F.schema_of_variant(b) == "STRING", F.try_variant_get(b, "$", "string"))),
        ),
        lambda x: x.isNotNull(),
    )
    return F.when(blocks.isNotNull(), F.array_join(parts, "\n")).otherwise(F.when(F.try_variant_get(v, path, "map<string,variant>").isNull(), F.try_variant_get(v, path, "string")))


@dataclass(frozen=True)
class Layout:
    """Columns of a layout over a record v: what marks it, the speaker's name, the text, the time."""

    marks: Callable[[Column], Column]
    speaker: Callable[[Column], Column]
    text: Callable[[Column], Column]
    time: tuple[str, ...] = ("$.timestamp",)


def _has(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind).isNotNull()


def _is(v: Column, path: str, values: tuple) -> Column:
    return F.coalesce(F.lower(F.try_variant_get(v, path, "string")).isin(*values), F.lit(False))


LAYOUTS: dict[str, Layout] = {
    "nested_message": Layout(lambda v: _has(v, "$.message", "map<string,variant>"), lambda v: field(v, "$.type", "$.message.role"), lambda v: F.coalesce(blocks_text(v, "$.message.content"), blocks_text(v, "$.message.parts"))),
    "nested_payload": Layout(lambda v: _has(v, "$.payload", "map<string,variant>"), lambda v: field(v, "$.payload.role"), lambda v: blocks_text(v, "$.payload.content")),
    "flat_role": Layout(lambda v: _is(v, "$.role", TOP_ROLES), lambda v: field(v, "$.role"), lambda v: F.coalesce(blocks_text(v, "$.content"), blocks_text(v, "$.displayContent")), ("$.timestamp", "$.ts")),
    "flat": Layout(lambda v: _is(v, "$.type", FLAT_TYPES), lambda v: field(v, "$.type"), lambda v: blocks_text(v, "$.content")),
    "history_display": Layout(lambda v: F.trim(F.coalesce(field(v, "$.display"), F.lit(""))) != "", lambda v: F.lit("user"), lambda v: field(v, "$.display")),
    "summary_card": Layout(lambda v: (field(v, "$.intent") != "") & (_has(v, "$.outcome") | _has(v, "$.actions")), lambda v: F.when(field(v, "$.intent") != "", "user").otherwise("assistant"), lambda v: F.coalesce(F.nullif(field(v, "$.intent"), F.lit("")), field(v, "$.outcome")), ("$.message_summary_time", "$.session_time")),
}

#: Declared dialects with fields of their own; the other declared ones have a layout of above.
DIALECTS: dict[str, Layout] = LAYOUTS | {
    "parts": Layout(lambda v: _has(v, "$.message.parts"), lambda v: field(v, "$.type", "$.message.role"), lambda v: blocks_text(v, "$.message.parts")),
    "wire": Layout(lambda v: _is(v, "$.type", ("turn.prompt",)), lambda v: F.when(_is(v, "$.type", ("turn.prompt",)), "user").when(_is(v, "$.event.type", ("content.part",)), "assistant"), lambda v: F.coalesce(blocks_text(v, "$.input"), blocks_text(v, "$.event.part.text")), ("$.time", "$.timestamp")),
    "events": Layout(lambda v: _is(v, "$.type", ("user/message", "assistant/message")), lambda v: F.split_part(field(v, "$.type"), F.lit("/"), F.lit(1)), lambda v: F.coalesce(blocks_text(v, "$.data.content"), blocks_text(v, "$.message.content")), ("$.time",)),
    "planner": Layout(lambda v: _is(v, "$.type", ("user_input", "planner_response")), lambda v: F.when(_is(v, "$.type", ("user_input",)), "user").when(_is(v, "$.type", ("planner_response",)), "assistant"), lambda v: field(v, "$.content"), ("$.created_at",)),
    "says": Layout(lambda v: _has(v, "$.say"), lambda v: F.when(_is(v, "$.say", ("task", "user_feedback")), "user").when(_is(v, "$.say", ("text",)), "assistant"), lambda v: field(v, "$.text"), ("$.ts",)),
}


def role(speaker: Column) -> Column:
    low = F.lower(speaker)
    return F.when(low.isin(*USER), "USER").when(low.isin(*ASSISTANT), "ASSISTANT")


def _messages(rows: DataFrame, layout: Column, layouts: dict[str, Layout]) -> DataFrame:
    """Messages of rows whose column `layout` names how they are read."""
    v = F.col("v")
    pick = lambda f: F.coalesce(*[F.when(layout == k, f(x)) for k, x in layouts.items()])
    m = rows.select("path", "line_no", role(pick(lambda x: x.speaker(v))).alias("role"), pick(lambda x: field(v, *x.time)).alias("time"), pick(lambda x: x.text(v)).alias("text"))
    return m.where(F.col("role").isNotNull() & (F.trim("text") != ""))


def read_dialect(lines: DataFrame, name: str) -> DataFrame:
    """(path, line_no, role, time, text) of a declared dialect."""
    return _messages(records(lines), F.lit(name), {name: DIALECTS[name]})


def join_parts(messages: DataFrame, turn: list[str]) -> DataFrame:
    """One message for each turn of a dialect that writes its text in parts."""
    parts = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    return messages.groupBy("path", *turn, "role").agg(F.min("line_no").alias("line_no"), F.min("time").alias("time"), F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))


def probe(lines: DataFrame, sample: int = 40) -> DataFrame:
    """(path, layout) of each file from its first records: the most specific layout that is marked and reads text."""
    v = F.col("v")
    r = records(lines.where(F.col("line_no") <= sample))
    seen = {f"m_{k}": F.bool_or(F.coalesce(x.marks(v), F.lit(False))) for k, x in LAYOUTS.items()}
    reads = {f"r_{k}": F.bool_or(F.coalesce(role(x.speaker(v)).isNotNull() & (F.trim(x.text(v)) != ""), F.lit(False))) for k, x in LAYOUTS.items()}
    g = r.groupBy("path").agg(*[c.alias(n) for n, c in (seen | reads).items()])
    m = lambda k: F.col(f"m_{k}")
    ok = lambda k: m(k) & F.col(f"r_{k}")
    first = F.when(ok("summary_card") & ~m("nested_message") & ~m("flat"), "summary_card").when(ok("history_display") & ~m("flat_role") & ~m("flat") & ~m("nested_message"), "history_display")
    for k in ("nested_message", "nested_payload", "flat_role", "flat", "history_display", "summary_card"):
        first = first.when(ok(k), k)
    return g.select("path", first.otherwise("unknown").alias("layout"))


def read_unknown(lines: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Messages of files of any layout that `probe` found."""
    return _messages(records(lines).join(verdicts, "path"), F.col("layout"), LAYOUTS)


def detect(lines: DataFrame, signs: dict[str, list[tuple[str, int]]], head: int = 20) -> DataFrame:
    """(path, format, score, confidence): weights of the patterns found in a file's first lines, the highest sum wins."""
    raw = F.coalesce("raw", F.lit(""))
    flags = [F.bool_or(raw.rlike(p)).cast("int").alias(f"s_{f}_{i}") for f, ps in signs.items() for i, (p, _) in enumerate(ps)]
    g = lines.where(F.col("line_no") <= head).groupBy("path").agg(*flags)
    sums = [F.struct(sum((F.col(f"s_{f}_{i}") * n for i, (_, n) in enumerate(ps)), F.lit(0)).alias("score"), F.lit(-k).alias("place"), F.lit(f).alias("format")) for k, (f, ps) in enumerate(signs.items())]
    best = F.array_max(F.array(*sums))
    confidence = F.when(best["score"] >= 6, "high").when(best["score"] >= 3, "medium").otherwise("low")
    return g.select("path", F.when(best["score"] > 0, best["format"]).otherwise("unknown").alias("format"), best["score"].alias("score"), confidence.alias("confidence"))


#: Signs of the layouts and their weights.
SIGNS = {
    "nested_message": [(r'"message"\s*:\s*\{', 4), (r'"type"\s*:\s*"(user|assistant)"', 2)],
    "nested_payload": [(r'"payload"\s*:\s*\{', 4), (r'"type"\s*:\s*"(session_meta|response_item|event_msg)"', 3)],
    "flat_role": [(r'^\{"role"\s*:', 3), (r'"content"\s*:', 1)],
    "flat": [(r'^\{"type"\s*:\s*"(user|assistant|system)"', 2), (r'"content"\s*:\s*"', 1)],
    "summary_card": [(r'"intent"\s*:', 3), (r'"(outcome|actions)"\s*:', 3)],
    "history_display": [(r'"display"\s*:', 3)],
}


def flatten_content(content: Column) -> Column:
    """Text of a message's JSON content: a string, or text, [THINKING] and [TOOL: name] lines of its blocks in order."""
    schema = "array<struct<type:string,text:string,thinking:string,name:string,input:map<string,string>>>"
    blocks = F.from_json(F.when(F.startswith(F.ltrim(content), F.lit("[")), content), schema)
    one = lambda b: F.when(b["type"] == "text", b["text"]).when(b["type"] == "thinking", F.concat(F.lit("[THINKING] "), b["thinking"])).when(b["type"] == "tool_use", F.rtrim(F.concat(F.lit("[TOOL: "), b["name"], F.lit("] "), tool_key(b["name"], b["input"]))))
    return (
        F.when(blocks.isNotNull(), F.array_join(F.filter(F.transform(blocks, one), lambda x: x.isNotNull()), "\n"))
        .otherwise(F.coalesce(F.get_json_object(F.concat(F.lit('{"a":'), content, F.lit("}")), "$.a"), content))
    )


def tool_key(name: Column, given: Column) -> Column:
    """The field of a tool's input that tells most."""
    get = lambda k: F.coalesce(F.element_at(given, F.lit(k)), F.lit(""))
    return (
        F.when(name.isin("Read", "Write", "Edit", "MultiEdit"), get("file_path"))
        .when(name == "Bash", F.substring(get("command"), 1, 80))
        .when(name.isin("Grep", "Glob"), get("pattern"))
        .when(name == "Task", get("description"))
        .when(name == "WebSearch", get("query"))
        .when(name == "WebFetch", get("url"))
        .otherwise("")
    )


def stored_sessions(sessions: DataFrame, messages: DataFrame, usage: DataFrame) -> DataFrame:
    """Sessions kept in tables: message rows hold JSON, usage a row for each request; both are added up before they meet."""
    v = F.try_parse_json("data")
    m = messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("messages"), F.count_if(F.lower(field(v, "$.role")) == "user").alias("user_messages"))
    u = usage.groupBy("session_id").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    return sessions.join(m, "session_id", "left").join(u, "session_id", "left").na.fill(0, ["messages", "user_messages", "input_tokens", "output_tokens"])


def write_tables(rows: DataFrame, folder: str, by: str | None = None, form: str = "parquet") -> None:
    """Rows as Parquet (by a column's folders), JSON lines or TSV; only the folders of `by` that rows name are replaced."""
    w = rows.write.mode("overwrite")
    if by:
        w = w.partitionBy(by).option("partitionOverwriteMode", "dynamic")
    if form == "tsv":
        w.option("sep", "\t").option("header", True).csv(folder)
    else:
        getattr(w, form)(folder)
