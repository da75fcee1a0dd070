"""Small operators on rows of sessions, messages, models, tools, commits and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import carried

# Error classes in the order in which they are tried, each with the phrases that tell it.
ERROR_CLASSES = {
    "COMMAND_NOT_FOUND": ("command not found", "not recognized as an internal or external command"),
    "PERMISSION_DENIED": ("permission denied", "eacces", "access denied", "operation not permitted", "eperm"),
    "TIMEOUT": ("timeout", "timed out", "deadline exceeded", "etimedout", "execution took longer"),
    "EISDIR": ("eisdir", "is a directory"),
    "FILE_NOT_FOUND": ("file does not exist", "file not found", "no such file or directory", "enoent", "string to replace not found"),
    "RATE_LIMIT": ("rate limit", "429", "too many requests", "throttl", "quota exceeded"),
}
# Model families, each with what its names hold and must not hold; the first that fits counts.
MODEL_FAMILIES = (
    ("LongCat-2.5-Preview", ("longcat", "2.5"), ()), ("LongCat-2.0", ("longcat-",), ()), ("LongCat", ("longcat",), ()), ("GLM-5.3-Flash", ("glm", "5.3", "flash"), ("flashx",)),
    ("DeepSeek-V3", ("deepseek", "v3"), ()), ("DeepSeek-V3", ("deepseek", "chat"), ()), ("DeepSeek-R1", ("deepseek", "r1"), ()), ("DeepSeek-R1", ("deepseek", "reasoner"), ()), ("DeepSeek-V4.1-Flash", ("deepseek", "4.1"), ()), ("DeepSeek-V4-Flash", ("deepseek", "v4"), ()), ("DeepSeek", ("deepseek",), ()),
    ("Gemini 3.8 Flash", ("gemini", "3.8"), ()), ("Gemini 4 Argon", ("gemini", "argon"), ()), ("Gemini 3", ("gemini", "3"), ()), ("Gemini", ("gemini",), ()),
    ("Claude 3.7 Sonnet", ("claude", "3-7"), ()), ("Claude 3.7 Sonnet", ("claude", "3.7"), ()), ("Claude 3.5 Sonnet", ("claude", "3-5-sonnet"), ()), ("Claude 3.5 Haiku", ("claude", "3-5-haiku"), ()), ("Claude Opus", ("claude", "opus"), ()), ("Claude", ("claude",), ()),
)
#: Kinds of chat messages by the number in the low bits of their type.
MESSAGE_KINDS = {1: "text", 3: "image", 34: "voice", 43: "video", 47: "sticker", 49: "link"}


def classify_error(text: Column, other: str = "UNKNOWN") -> Column:
    """The first of ERROR_CLASSES that a text names."""
    low, out = F.lower(text), F.lit(other)
    for name, phrases in reversed(ERROR_CLASSES.items()):
        hit = F.lit(False)
        for phrase in phrases:
            hit = hit | F.contains(low, F.lit(phrase))
        out = F.when(hit, name).otherwise(out)
    return out


def canon_model(name: Column, families: tuple = MODEL_FAMILIES) -> Column:
    """The family of a model's name; other names as they are, missing ones "unknown"."""
    low, out = F.lower(F.trim(name)), F.trim(name)
    for family, held, lacking in reversed(families):
        fits = F.lit(True)
        for word in held:
            fits = fits & F.contains(low, F.lit(word))
        for word in lacking:
            fits = fits & ~F.contains(low, F.lit(word))
        out = F.when(fits, family).otherwise(out)
    return F.when(F.coalesce(F.trim(name), F.lit("")) == "", "unknown").otherwise(out)


def naming_style(name: Column) -> Column:
    """snake_case, flatcase, PascalCase, camelCase or UPPER_SNAKE of a name of two characters or more; else null.

    Decided by the name's shape, in which a run of capitals is A, of small letters a, of underscores _ and of others 0;
    outer underscores do not count.
    """
    shape = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(name, "[^A-Za-z_]+", "0"), "[a-z]+", "a"), "[A-Z]+", "A"), F.lit("_"))
    capitals = F.length(F.regexp_replace(name, "[^A-Z]", ""))
    joined, small = F.contains(shape, F.lit("_")), F.contains(shape, F.lit("a"))
    style = F.when(joined & small & (capitals == 0), "snake_case").when(joined & ~small & (capitals > 0), "UPPER_SNAKE").when(shape == "a", "flatcase")
    style = style.when(F.startswith(shape, F.lit("a")) & (capitals > 0), "camelCase").when(F.startswith(shape, F.lit("A")) & ((capitals > 1) | (shape == "Aa")), "PascalCase")
    return F.when(F.length(name) >= 2, style)


def winsorize(value: Column, most: int) -> Column:
    """value within 0 and `most`, for display."""
    return F.when(value <= 0, 0).otherwise(F.least(value, F.lit(most))).cast("long")


def cost(input_tokens: Column, output_tokens: Column, input_price: float, output_price: float) -> Column:
    """Dollars at prices for a million tokens."""
    return F.round((input_tokens * input_price + output_tokens * output_price) / 1e6, 6)


def to_int_safe(text: Column) -> Column:
    """A number's whole part; 0 for what is no number."""
    return F.coalesce(text.try_cast("double").try_cast("bigint"), F.lit(0))


def message_kind(kind: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in MESSAGE_KINDS.items() for x in kv]), kind.cast("int")), F.lit("other"))


def only(rows: DataFrame, agent: str | None = None, project: str | None = None, model: str | None = None, since=None, until=None, at: str = "created") -> DataFrame:
    """Rows of an agent, of projects and models whose names hold a part, and from since on, before until."""
    if agent is not None:
        rows = rows.where(F.col("agent") == agent)
    if project is not None:
        rows = rows.where(F.contains("project", F.lit(project)))
    if model is not None:
        rows = rows.where(F.contains(F.lower("model"), F.lit(model.lower())))
    if since is not None:
        rows = rows.where(F.col(at) >= F.lit(since).cast("timestamp"))
    return rows if until is None else rows.where(F.col(at) < F.lit(until).cast("timestamp"))


def without(rows: DataFrame, column: str, names: tuple[str, ...], prefix: str | None = None) -> DataFrame:
    """Rows whose column is none of names and does not begin with prefix: noise types, tools of no interest."""
    rows = rows.where(~F.col(column).isin(*names))
    return rows if prefix is None else rows.where(~F.startswith(column, F.lit(prefix)))


def newest(rows: DataFrame, at: str, key: str, most: int) -> DataFrame:
    """The `most` newest rows, undated ones last, ties by key."""
    return rows.orderBy(F.col(at).desc_nulls_last(), key).limit(most)


def page_by(rows: DataFrame, text: str, word: str, order: list[str], skip: int, most: int) -> DataFrame:
    """A page of the rows whose text holds the word, letters of either case alike."""
    return rows.where(F.contains(F.lower(text), F.lit(word.lower()))).orderBy(*order).offset(skip).limit(most)


def first_listing(listings: list[DataFrame], key: str) -> DataFrame:
    """Each key of several listings once, with the number (from 1) of the first that has it."""
    every = None
    for i, rows in enumerate(listings):
        own = rows.select(key, F.lit(i + 1).alias("listing"))
        every = own if every is None else every.unionByName(own)
    return every.groupBy(key).agg(F.min("listing").alias("listing"))


def orphans(rows: DataFrame, alive: DataFrame, key: str) -> DataFrame:
    """Keys of rows that are no longer alive, for pruning."""
    return rows.join(alive.select(key).distinct(), key, "left_anti").select(key)


def freshness(rows: DataFrame, by: str, at: str, now: str, hours: int = 24) -> DataFrame:
    """The newest time of each group and whether it lies `hours` or more before now."""
    limit = F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(hours))
    return rows.groupBy(by).agg(F.max(at).alias("newest")).withColumn("stale", F.col("newest") <= limit)


def where_any(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among other's."""
    return rows.join(other.select(key).distinct(), key, "left_semi")


def changed_rows(now: DataFrame, seen: DataFrame, key: str, text: str) -> DataFrame:
    """key and hash of the rows that seen(key, hash) does not hold as they are: new ones and changed ones."""
    return now.select(key, F.md5(F.coalesce(text, F.lit(""))).alias("hash")).join(seen.select(key, "hash"), [key, "hash"], "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str, text: str) -> DataFrame:
    """old(key, hash) with new's rows by content: equal ones are skipped, changed ones replaced, others inserted."""
    fresh = new.select(key, F.md5(F.coalesce(text, F.lit(""))).alias("new"))
    both = old.select(key, "hash").join(fresh, key, "full")
    change = F.when(F.col("new").isNull(), "kept").when(F.col("hash").isNull(), "inserted").when(F.col("hash") == F.col("new"), "skipped").otherwise("replaced")
    return both.select(key, F.coalesce("new", "hash").alias("hash"), change.alias("change"))


def gap_fill(rich: DataFrame, archive: DataFrame) -> DataFrame:
    """rich's messages and those of the archive before the session's first one in rich, numbered by time (place, from 1).

    The rich layer is whole from its first message on, so later ones of the archive are the same messages or were
    dropped on purpose. A session without rich messages comes from the archive alone; undated messages of the archive
    of other sessions fall.
    """
    start = rich.groupBy("session_id").agg(F.min("ts").alias("start"))
    older = archive.join(start, "session_id", "left").where(F.col("start").isNull() | (F.col("ts") < F.col("start")))
    layer = lambda rows, name: rows.select("session_id", "seq", "ts", F.lit(name).alias("layer"))
    both = layer(rich, "rich").unionByName(layer(older, "archive")).withColumn("day", F.to_date("ts"))
    return carried(both, ["session_id"], "day", ["ts", "seq"], {"place": F.lit(1)}).drop("day")


def drop_tool_lines(text: Column, mark: str = "[TOOL: ") -> Column:
    """A text without the lines that begin with mark."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.startswith(x, F.lit(mark))), "\n")


def real_user_turns(messages: DataFrame) -> DataFrame:
    """Messages that a user wrote: no tool results or interruptions in brackets, reminders, summaries or commands."""
    text = F.ltrim("text")
    made = F.startswith(text, F.lit("[")) | F.contains("text", F.lit("<system-reminder>")) | F.startswith(text, F.lit("<command-")) | F.startswith(text, F.lit("<local-command")) | F.startswith(text, F.lit("Caveat: ")) | F.startswith(text, F.lit("This session is being continued"))
    return messages.where((F.col("role") == "USER") & ~made)


def since_seen(messages: DataFrame, seen: Column) -> DataFrame:
    """Sessions with a message after the last that was seen, or none seen, and their last time."""
    last = messages.groupBy("session_id").agg(F.max("ts").alias("last"), F.max(F.when(seen, F.col("ts"))).alias("seen"))
    return last.where("seen IS NULL OR last > seen").select("session_id", "last")


def most_active(messages: DataFrame, since: Column, most: int = 10) -> DataFrame:
    """The sessions with most messages after a time."""
    return messages.where(F.col("ts") > since).groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "session_id").limit(most)


def missing_pairs(rows: DataFrame, left: str, right: str, present: DataFrame, most: int = 10_000) -> DataFrame:
    """Each of rows' values of left with those expected names, rows' values of right, that present lacks for it.

    Names are expected of every left value, so the result is as long as both together; they are a short list by nature, and
    more than `most` of them are an error.
    """
    names = [r[0] for r in rows.select(right).where(F.col(right).isNotNull()).distinct().limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"{right} has more than {most} values")
    every = rows.select(left).distinct().withColumn(right, F.explode(F.array(*[F.lit(x) for x in sorted(names)]).cast("array<string>")))
    return every.join(present.select(left, right).distinct(), [left, right], "left_anti")


def latest_verdicts(feedback: DataFrame, targets: DataFrame, key: str = "target") -> DataFrame:
    """targets with the verdict of each one's newest feedback(key, verdict, ts, id); null without any."""
    last = feedback.groupBy(key).agg(F.max_by("verdict", F.struct("ts", "id")).alias("verdict"))
    return targets.join(last, key, "left")


def schema_report(rows: DataFrame, by: str, record: str, at: str) -> DataFrame:
    """Per type of record: number, field names in order, first and last time."""
    fields = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.json_object_keys(record))))), ",")
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), fields.alias("fields"), F.min(at).alias("first_ts"), F.max(at).alias("last_ts"))
