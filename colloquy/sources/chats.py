"""Chat exports: JSON, CSV, plain text and shard tables to canonical messages; feeds, notes, manifests, file lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .transcripts import field

# Fixed values.
ALIASES = {
    "id": ("$.id", "$.msg_id", "$.local_id"),
    "chat_id": ("$.chat_id", "$.chatId", "$.talker"),
    "chat_name": ("$.chat_name", "$.chatName"),
    "sender": ("$.sender", "$.from", "$.sender_username"),
    "nickname": ("$.nickname", "$.sender_name", "$.from"),
    "ts": ("$.ts", "$.timestamp", "$.createTime", "$.time"),
    "text": ("$.text", "$.content", "$.message"),
    "msg_type": ("$.type", "$.local_type", "$.msg_type"),
    "reply_to": ("$.reply_to", "$.replyTo"),
}
TYPES = {
    "1": "text", "3": "image", "34": "voice", "42": "card", "43": "video", "47": "sticker", "48": "location", "49": "link", "50": "call", "10000": "system", "10002": "revoke",
    "text": "text", "image": "image", "voice": "voice", "video": "video", "sticker": "sticker", "link": "link", "file": "file", "system": "system", "call": "call",
    "文本": "text", "图片": "image", "语音": "voice", "视频": "video", "表情": "sticker", "位置": "location", "链接/文件": "link", "链接": "link", "文件": "file", "通话": "call", "系统": "system", "撤回": "revoke", "名片": "card",
}
MEDIA = ("3", "34", "42", "43", "47", "48", "49")
HEADERS = {"sender": ("sender", "from", "name", "发送人", "发送者", "昵称"), "ts": ("ts", "time", "timestamp", "date", "时间", "日期"), "text": ("text", "content", "message", "内容", "消息")}
LINES = (
    r"^\[(\d{4}-\d{2}-\d{2}\s+\d{1,2}:\d{2}(?::\d{2})?)\]\s*([^:]+):\s*(.+)",
    r"^(\d{1,2}:\d{2}(?::\d{2})?)\s+([^\n:]+):\s*(.+)",
    r"^()([A-Za-z0-9_\x{4e00}-\x{9fff}]{1,20}):\s*(.+)",
)


def epoch(v: Column) -> Column:
    """Seconds: numbers beyond 10^10 are milliseconds, ISO texts are read as UTC."""
    n = v.try_cast("double")
    return F.coalesce(F.when(n > 1e10, n / 1000).otherwise(n).cast("long"), F.unix_seconds(F.try_to_timestamp(v)))


def clean(text: Column, kind: Column) -> Column:
    """Text without control and undecodable characters; where they are over a tenth, and few words are left, [kind]."""
    noise = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{FFFD}]"
    kept = F.trim(F.regexp_replace(F.regexp_replace(text, noise, " "), r"\s+", " "))
    bad = F.length(text) - F.length(F.regexp_replace(text, noise, ""))
    readable = F.size(F.regexp_extract_all(kept, F.lit(r"[A-Za-z]{3,}|[\x{4E00}-\x{9FFF}]{2}"), F.lit(0))) >= 3
    return F.when(bad == 0, F.trim(text)).when((bad / F.length(text) > 0.1) & ~readable, F.concat(F.lit("["), kind, F.lit("]"))).otherwise(kept)


def normalise(rows: DataFrame, v: str = "v", source: str = "unknown") -> DataFrame:
    """Canonical messages of variants with fields of several names; without an id one is made from the content."""
    f = {k: field(F.col(v), *paths) for k, paths in ALIASES.items()}
    names = F.create_map(*[F.lit(x) for p in TYPES.items() for x in p])
    kind = F.coalesce(names[F.coalesce(f["msg_type"], F.lit("1"))], F.lit("other"))
    r = rows.select(
        *[x.alias(k) for k, x in f.items() if k not in ("ts", "msg_type", "text")], epoch(f["ts"]).alias("ts"),
        kind.alias("msg_type"), clean(F.coalesce(f["text"], F.lit("")), kind).alias("text"),
    )
    made = F.md5(F.concat_ws(":", "chat_id", F.col("ts").cast("string"), "sender", "text"))
    return r.select(
        F.coalesce("id", made).alias("id"), "chat_id", "chat_name", F.coalesce("sender", "nickname").alias("sender"),
        F.coalesce("nickname", "sender").alias("nickname"),
        F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), "ts", "text",
        "msg_type", "reply_to", F.lit(source).alias("source"),
    )


def import_json(docs: DataFrame, raw: str = "raw") -> DataFrame:
    """Messages of exports that are a list or {"messages": [...]}; media messages fall."""
    v = F.try_parse_json(raw)
    items = F.coalesce(F.try_variant_get(v, "$.messages", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"))
    r = docs.select(F.explode(items).alias("v"))
    return normalise(r.where(~F.coalesce(field(F.col("v"), *ALIASES["msg_type"]).isin(*MEDIA), F.lit(False))), source="json")


def import_csv(rows: DataFrame) -> DataFrame:
    """Rows with a header: columns by their names, else the first three as sender, time and text."""
    low = {c.strip().lower(): c for c in rows.columns}
    found = {k: next((low[a] for a in names if a in low), None) for k, names in HEADERS.items()}
    at = dict(zip(HEADERS, rows.columns)) if not any(found.values()) else found
    return rows.select(*[(F.col(f"`{at[k]}`") if at.get(k) else F.lit(None).cast("string")).alias(k) for k in HEADERS])


def read_csv(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    return import_csv(spark.read.csv(paths, header=True, multiLine=True, escape='"'))


def import_text(lines: DataFrame, least: int = 3) -> DataFrame:
    """(path, line_no, time, sender, text): the first of the line patterns that a file has `least` lines of."""
    counts = lines.groupBy("path").agg(*[F.count_if(F.col("raw").rlike(p)).alias(f"n{i}") for i, p in enumerate(LINES)])
    pick = F.coalesce(*[F.when(F.col(f"n{i}") >= least, i) for i in range(len(LINES))])
    r = lines.join(counts.select("path", pick.alias("pattern")).where("pattern IS NOT NULL"), "path")
    part = lambda g: F.coalesce(*[F.when(F.col("pattern") == i, F.regexp_extract("raw", p, g)) for i, p in enumerate(LINES)])
    return r.select("path", "line_no", F.nullif(part(1), F.lit("")).alias("time"), F.trim(part(2)).alias("sender"), F.trim(part(3)).alias("text")).where(F.length("text") >= 2)


def resolve_shards(rows: DataFrame, chats: DataFrame, prefix: str = "Msg_") -> DataFrame:
    """Rows of shard tables named by the md5 of their chat, with the chat; unknown shards keep a null one."""
    known = chats.select("chat_id", F.concat(F.lit(prefix), F.md5(F.col("chat_id").cast("binary"))).alias("shard"))
    return rows.join(known, "shard", "left")


def resolve_columns(rows: DataFrame, candidates: dict[str, tuple[str, ...]]) -> DataFrame:
    """Columns by role, each the first of its candidate names that the table has."""
    low = {c.lower(): c for c in rows.columns}
    return rows.select(*[next((F.col(low[n.lower()]) for n in names if n.lower() in low), F.lit(None)).alias(k) for k, names in candidates.items()])


def union_shards(tables: dict[str, DataFrame], candidates: dict[str, tuple[str, ...]]) -> DataFrame:
    """All shard tables as one, with the shard's name."""
    out = None
    for name, t in tables.items():
        t = resolve_columns(t, candidates).withColumn("shard", F.lit(name))
        out = t if out is None else out.unionByName(t)
    return out


def feeds(rows: DataFrame, payload: str = "payload", author: str | None = None, keyword: str | None = None, start: int | None = None, limit: int = 0) -> DataFrame:
    """Posts of XML payloads by author, keyword and time, newest first; what is not XML falls."""
    p = F.from_xml(payload, "author STRING, createTime LONG, contentDesc STRING")
    # each payload is parsed once: conditions are not pushed through the generator, where each would parse it anew
    r = rows.select(F.explode(F.array(p)).alias("p")).select("p.author", F.col("p.createTime").alias("ts"), F.col("p.contentDesc").alias("text")).where("author IS NOT NULL AND ts IS NOT NULL")
    if author:
        r = r.where(F.col("author") == author)
    if keyword:
        r = r.where(F.contains("text", F.lit(keyword)))
    if start is not None:
        r = r.where(F.col("ts") >= start)
    r = r.orderBy(F.desc("ts"), "author")
    return r.limit(limit) if limit else r


def read_texts(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, content) of whole small files."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def memories(files: DataFrame) -> DataFrame:
    """Notes with their front matter; without one the body is the whole text and the type unknown. Archives fall.

    MEMORY.md is the index of a folder with other notes, and a note where it is alone.
    """
    head = F.regexp_extract("content", r"^---[ \t]*\n(?s:(.*?))\n---[ \t]*(\n|$)", 1)
    pairs = F.filter(F.split(head, "\n"), lambda x: x.rlike(r"^\s*[^:]+: "))
    fm = F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.trim(F.split_part(x, F.lit(": "), F.lit(1))).alias("k"), F.trim(F.substring(x, F.instr(x, ": ") + 2, F.length(x))).alias("v"))))
    folder = F.regexp_replace("path", "/[^/]*$", "")
    notes = files.where(~F.contains("path", F.lit("/archive/"))).withColumn("folder", folder).withColumn("is_index", F.endswith("path", F.lit("MEMORY.md")))
    many = F.count_if(~F.col("is_index")).over(Window.partitionBy("folder"))
    m = notes.withColumn("others", many).where(~F.col("is_index") | (F.col("others") == 0)).withColumn("fm", F.when(head != "", fm))
    body = F.regexp_replace("content", r"^---[ \t]*\n(?s:.*?)\n---[ \t]*(\n|$)", "")
    return m.select(
        "path", F.col("fm")["name"].alias("name"), F.col("fm")["description"].alias("description"),
        F.coalesce(F.col("fm")["type"], F.lit("unknown")).alias("type"),
        F.when(head != "", body).otherwise(F.col("content")).alias("content"),
    )


def file_list(files: DataFrame, excluded: tuple[str, ...] = ("node_modules", ".git", "__pycache__", "dist", "build", ".venv")) -> DataFrame:
    """Path, extension, size, lines, depth and folder of files that are in no excluded folder."""
    parts = F.split("path", "/")
    r = files.where(~F.arrays_overlap(parts, F.array(*[F.lit(x) for x in excluded])))
    text = F.coalesce("content", F.lit(""))
    return r.select(
        "path", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("extension"),
        F.octet_length(text).alias("size_bytes"),
        F.when(text == "", 0).otherwise(F.size(F.split(text, "\n"))).alias("lines"), (F.size(parts) - 1).alias("depth"),
        F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise("").alias("parent"),
    )


def manifests(files: DataFrame) -> DataFrame:
    """(path, name, version, kind, ecosystem) of the dependencies in package.json, requirements.txt, pyproject.toml, Cargo.toml and go.mod."""
    name = F.regexp_extract("path", "([^/]*)$", 1)
    dep = lambda n, v, k, e: F.struct(n.alias("name"), v.alias("version"), k.alias("kind"), F.lit(e).alias("ecosystem"))
    section = lambda key, kind: F.transform(F.map_entries(F.coalesce(F.from_json(F.get_json_object("content", f"$.{key}"), "map<string,string>"), F.create_map().cast("map<string,string>"))), lambda e: dep(e["key"], e["value"], F.lit(kind), "npm"))
    npm = F.concat(section("dependencies", "runtime"), section("devDependencies", "dev"), section("peerDependencies", "peer"), section("optionalDependencies", "optional"))
    bare = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    lines = F.transform(F.split("content", "\n"), bare)
    req = r"^([a-zA-Z0-9_-]+)\s*(?:[><=!~]+)?\s*([^;]*)"
    pip = F.transform(F.filter(lines, lambda x: x.rlike(req) & ~x.rlike("^[#-]")), lambda x: dep(F.regexp_extract(x, req, 1), F.trim(F.regexp_extract(x, req, 2)), F.lit("runtime"), "pip"))
    pair, headed = r"^([a-zA-Z0-9_-]+)\s*=\s*[\"']?([^\"'\s,]+)", lambda head: F.regexp_extract_all("content", F.lit(rf"(?ms)^\s*\[({head})\]\s*$(.*?)(?=^\s*\[|\z)"), F.lit(2))

    def toml(head: str, kind: str, eco: str) -> Column:
        own = F.flatten(F.transform(headed(head), lambda s: F.transform(F.split(s, "\n"), bare)))
        return F.transform(F.filter(own, lambda x: x.rlike(pair)), lambda x: dep(F.regexp_extract(x, pair, 1), F.regexp_extract(x, pair, 2), F.lit(kind), eco))

    go = r"^(?:require\s+)?([a-zA-Z0-9./_-]+)\s+(v[0-9.a-z-]+)"
    mods = F.transform(F.filter(lines, lambda x: x.rlike(go)), lambda x: dep(F.regexp_extract(x, go, 1), F.regexp_extract(x, go, 2), F.lit("runtime"), "go"))
    deps = (
        F.when(name == "package.json", npm)
        .when(name == "requirements.txt", pip)
        .when(name == "pyproject.toml", toml(r"project\.dependencies|tool\.poetry\.dependencies", "runtime", "pip"))
        .when(name == "Cargo.toml", F.concat(toml("dependencies", "runtime", "cargo"), toml("dev-dependencies", "dev", "cargo")))
        .when(name == "go.mod", mods)
    )
    return files.select("path", F.explode(deps).alias("d")).select("path", "d.*")
