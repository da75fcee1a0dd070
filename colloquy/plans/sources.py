"""Queries on transcripts and exports; their lines are derived from the given tables."""

from pyspark.sql import functions as F

from ..sources import chats as ch
from ..sources import transcripts as tr
from . import register

c = F.col


def _json(**fields):
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def _kind():
    return c("session_id").cast("long") % 6


def _lines(t):
    """Each conversation as a transcript in one of six layouts, with a blank and a broken line."""
    m = t.v_messages
    low, iso, text = F.lower("role"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), c("text")
    block = lambda kind: F.array(F.struct(F.lit(kind).alias("type"), text.alias("text")))
    nested = (
        F.when(
            c("role") == "ASSISTANT",
            F.to_json(F.struct(low.alias("type"), iso.alias("timestamp"), F.struct(low.alias("role"), block("text").alias("content")).alias("message"))),
        )
        .otherwise(F.to_json(F.struct(low.alias("type"), iso.alias("timestamp"), F.struct(low.alias("role"), text.alias("content")).alias("message"))))
    )
    payload = F.to_json(
        F.struct(
            F.lit("response_item").alias("type"), iso.alias("timestamp"),
            F.struct(F.lit("message").alias("type"), low.alias("role"), block("input_text").alias("content")).alias("payload"),
        ),
    )
    card = F.when(c("role") == "USER", _json(intent=text, actions=F.array().cast("array<string>"))).otherwise(_json(intent=F.lit(""), outcome=text))
    raw = (
        F.when(_kind() == 0, nested)
        .when(_kind() == 1, payload)
        .when(_kind() == 2, _json(role=low, content=text, timestamp=iso))
        .when(_kind() == 3, _json(type=low, content=text))
        .when(_kind() == 4, card)
        .otherwise(_json(display=text, timestamp=iso))
    )
    good = (
        m.where((_kind() < 4) | (c("role") == "USER") | ((_kind() == 4) & (c("role") == "ASSISTANT")))
        .select(c("session_id").alias("path"), (c("seq") + 1).cast("int").alias("line_no"), raw.alias("raw"))
    )
    bad = (
        m.groupBy("session_id")
        .agg((F.max("seq") + 2).cast("int").alias("n"))
        .select(c("session_id").alias("path"), "n")
        .select("path", F.posexplode(F.array(F.lit(" "), F.lit('{"broken": '))).alias("k", "raw"), "n")
        .select("path", (c("n") + c("k")).alias("line_no"), "raw")
    )
    return good.unionByName(bad)


_KEPT = "session_id::BIGINT % 6 < 4 OR role = 'USER' OR (session_id::BIGINT % 6 = 4 AND role = 'ASSISTANT')"
_NAMES = "CASE session_id::BIGINT % 6 WHEN 0 THEN 'nested_message' WHEN 1 THEN 'nested_payload' WHEN 2 THEN 'flat_role' WHEN 3 THEN 'flat' WHEN 4 THEN 'summary_card' ELSE 'history_display' END"
_READ = f"SELECT session_id AS path, (seq + 1)::INT AS line_no, role, text FROM v_messages WHERE ({_KEPT}) AND role IN ('USER', 'ASSISTANT')"
register(
    "a1_read_transcripts",
    lambda t: tr.records(_lines(t)).groupBy("path").agg(F.count(F.lit(1)).alias("records"), F.min("line_no").alias("first")),
    f"SELECT session_id AS path, count(*) AS records, (min(seq) + 1)::INT AS first FROM v_messages WHERE {_KEPT} GROUP BY session_id",
)
register(
    "a2_detect_format", lambda t: tr.detect(_lines(t), tr.SIGNS).select("path", "format"),
    f"SELECT DISTINCT session_id AS path, CASE WHEN count(*) FILTER ({_KEPT}) > 0 THEN {_NAMES} ELSE 'unknown' END AS format FROM "
    f"v_messages WHERE seq < 20 GROUP BY session_id",
)
register(
    "a4_probe_family", lambda t: tr.probe(_lines(t)),
    f"""
SELECT session_id AS path, CASE WHEN session_id::BIGINT % 6 = 4 AND count(*) FILTER (role = 'USER') = 0 THEN 'unknown' WHEN count(*) FILTER (role IN ('USER', 'ASSISTANT')) = 0 THEN 'unknown' ELSE {_NAMES} END AS layout
FROM v_messages WHERE seq < 40 AND ({_KEPT}) GROUP BY session_id""",
)
register(
    "a5_read_unknown",
    lambda t: tr.read_unknown(_lines(t), tr.probe(_lines(t))).select("path", "line_no", "role", "text"),
    f"{_READ} AND (session_id::BIGINT % 6 <> 4 OR session_id IN (SELECT session_id FROM v_messages WHERE seq < 40 AND role = 'USER'))",
)


def _dialects(t):
    """A wire dialect whose answers come in two parts, beside the declared layout of rollouts."""
    m, half = t.v_messages.where("role <> 'SYSTEM'"), F.floor(F.length("text") / 2).cast("int")
    cut = F.when(c("role") == "USER", F.array(c("text"))).otherwise(F.array(F.substring(c("text"), F.lit(1), half), F.substring(c("text"), half + 1, F.length("text"))))
    parts = m.select("session_id", "seq", "role", F.posexplode(cut).alias("k", "part"))
    raw = (
        F.when(c("role") == "USER", F.to_json(F.struct(F.lit("turn.prompt").alias("type"), F.array(F.struct(c("part").alias("text"))).alias("input"))))
        .otherwise(
            F.to_json(
                F.struct(
                    F.lit("context.append_loop_event").alias("type"),
                    F.struct(F.lit("content.part").alias("type"), F.struct(c("part").alias("text")).alias("part")).alias("event"),
                ),
            ),
        )
    )
    wire = parts.select(c("session_id").alias("path"), (c("seq") * 2 + c("k")).cast("int").alias("line_no"), raw.alias("raw"))
    read = tr.read_dialect(wire, "wire").withColumn("turn", F.floor(c("line_no") / 2))
    return tr.join_parts(read, ["turn"]).select("path", "turn", "role", "text")


register("a6_read_dialects", _dialects, "SELECT session_id AS path, seq AS turn, role, text FROM v_messages WHERE role <> 'SYSTEM' AND trim(text) <> ''")
register(
    "a7_read_relational_store",
    lambda t: (
        tr.stored_sessions(
            t.v_messages.select("session_id").distinct(),
            t.v_messages.select("session_id", _json(role=F.lower("role"), text=c("text")).alias("data")),
            t.v_usage.withColumn("session_id", c("session_id").cast("string")),
        )
    ),
    """
WITH u AS (SELECT session_id::VARCHAR AS session_id, sum(input_tokens)::BIGINT AS i, sum(output_tokens)::BIGINT AS o FROM v_usage GROUP BY 1)
SELECT m.session_id, count(*) AS messages, count(*) FILTER (role = 'USER') AS user_messages, coalesce(any_value(i), 0) AS input_tokens, coalesce(any_value(o), 0) AS output_tokens FROM v_messages m LEFT JOIN u USING (session_id) GROUP BY m.session_id""",
)


def _exports(t):
    item = F.struct(
        c("id"), c("chat_id").alias("talker"), c("sender").alias("from"),
        F.unix_seconds(c("ts").cast("timestamp")).alias("createTime"), c("text").alias("content"),
        F.when(c("id") % 5 == 0, 3).otherwise(1).alias("type"),
    )
    d = t.v_chat.groupBy("chat_id", F.to_date("ts").alias("day")).agg(F.collect_list(item).alias("messages"))
    return d.select(F.to_json(F.struct("messages")).alias("raw"))


register(
    "a8_import_chat_json",
    lambda t: (
        ch.import_json(_exports(t)).groupBy("chat_id").agg(F.count(F.lit(1)).alias("n"), F.sum("ts").alias("ts"), F.count_distinct("sender").alias("senders"))
    ),
    "SELECT chat_id, count(*) AS n, sum(epoch(ts))::BIGINT AS ts, count(DISTINCT sender) AS senders FROM v_chat WHERE id % 5 <> 0 GROUP BY chat_id",
)
register(
    "a9_import_chat_csv",
    lambda t: (
        ch.import_csv(
            t.v_chat.select(c("sender").alias("发送人"), c("ts").cast("string").alias("时间"), c("id").cast("string").alias("other"), c("text").alias("内容")),
        )
        .groupBy("sender")
        .agg(F.count(F.lit(1)).alias("n"), F.max("text").alias("last"))
    ),
    "SELECT sender, count(*) AS n, max(text) AS last FROM v_chat GROUP BY sender",
)


def _plain(t):
    kind = F.regexp_extract("chat_id", "([0-9]+)$", 1).cast("int") % 3
    at, say = c("ts"), F.concat(c("sender"), F.lit(": n"), c("id").cast("string"))
    raw = F.when(kind == 0, F.concat(F.lit("["), F.date_format(at, "yyyy-MM-dd HH:mm"), F.lit("] "), say)).when(kind == 1, F.concat(F.date_format(at, "HH:mm"), F.lit(" "), say)).otherwise(say)
    return t.v_chat.select(c("chat_id").alias("path"), c("id").alias("line_no"), raw.alias("raw"))


register(
    "a10_import_chat_text", lambda t: ch.import_text(_plain(t)),
    """
SELECT chat_id AS path, id AS line_no, CASE regexp_extract(chat_id, '([0-9]+)$', 1)::INT % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M') WHEN 1 THEN strftime(ts, '%H:%M') END AS time, sender, 'n' || id AS text
FROM v_chat WHERE chat_id IN (SELECT chat_id FROM v_chat GROUP BY chat_id HAVING count(*) >= 3)""",
)


def _mixed(t):
    s = F.unix_seconds(c("ts").cast("timestamp"))
    a = F.to_json(F.struct("id", "chat_id", "sender", s.alias("ts"), c("text"), F.lit("1").alias("type")))
    b = F.to_json(F.struct(c("id").alias("msg_id"), c("chat_id").alias("talker"), c("sender").alias("from"), (s * 1000).alias("createTime"), c("text").alias("content"), F.lit("语音").alias("type")))
    d = F.to_json(
        F.struct(
            c("id").alias("local_id"), c("chat_id").alias("chatId"), c("sender").alias("sender_username"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"), c("text").alias("message"),
            F.lit(77).alias("local_type"),
        ),
    )
    return t.v_chat.select(F.try_parse_json(F.when(c("id") % 3 == 0, a).when(c("id") % 3 == 1, b).otherwise(d)).alias("v"))


register(
    "a11_normalize_chat",
    lambda t: ch.normalise(_mixed(t)).select("id", "chat_id", "sender", "ts", "timestamp", "msg_type"),
    "SELECT id::VARCHAR AS id, chat_id, sender, epoch(ts)::BIGINT AS ts, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, CASE "
    "id % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'voice' ELSE 'other' END AS msg_type FROM v_chat",
)
register(
    "b6_clean_text",
    lambda t: (
        t.v_chat.select(
            "id",
            ch.clean(
                F.when(c("id") % 4 == 0, F.lit("\x01\x02q\x03\x04"))
                .when(c("id") % 4 == 1, F.concat(F.lit("a\x00"), F.lit("three plain words")))
                .otherwise(F.lit(" kept ")),
                F.lit("voice"),
            )
            .alias("text"),
        )
    ),
    "SELECT id, CASE id % 4 WHEN 0 THEN '[voice]' WHEN 1 THEN 'a three plain words' ELSE 'kept' END AS text FROM v_chat",
)


def _notes(t):
    k = c("doc_id")
    head = F.concat(F.lit("---\nname: note "), k.cast("string"), F.lit("\ndescription: from: "), c("source"), F.lit("\ntype: feedback\n---\n"))
    body = F.coalesce("text", F.lit(""))
    path = F.concat(c("source"), F.when(k % 7 == 0, F.lit("/archive/")).otherwise(F.lit("/")), F.when(k % 11 == 0, F.lit("MEMORY.md")).otherwise(F.concat(k.cast("string"), F.lit(".md"))))
    return t.documents.select(path.alias("path"), F.when(k % 3 == 0, F.concat(F.lit("plain "), body)).otherwise(F.concat(head, body)).alias("content"))


register(
    "a13_read_memories",
    lambda t: (
        ch.memories(_notes(t))
        .groupBy("type", "description")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars"), F.max("name").alias("name"))
    ),
    """
WITH d AS (SELECT doc_id, source, length(coalesce(text, '')) AS n FROM documents WHERE source IS NOT NULL AND doc_id % 7 <> 0), o AS (SELECT source, count(*) FILTER (doc_id % 11 <> 0) AS others FROM d GROUP BY source)
SELECT CASE WHEN doc_id % 3 = 0 THEN 'unknown' ELSE 'feedback' END AS type, CASE WHEN doc_id % 3 <> 0 THEN 'from: ' || source END AS description, count(*) AS n, sum(n + CASE WHEN doc_id % 3 = 0 THEN 6 ELSE 0 END)::BIGINT AS chars, max(CASE WHEN doc_id % 3 <> 0 THEN 'note ' || doc_id END) AS name
FROM d JOIN o USING (source) WHERE doc_id % 11 <> 0 OR others = 0 GROUP BY 1, 2""",
)


def _pages(t):
    k = c("page_id")
    return t.pages.select(
        F.concat(
            F.when(k % 9 == 0, "node_modules/").otherwise("src/"), F.lit("m"), (k % 7).cast("string"), F.lit("/p"),
            k.cast("string"), F.when(k % 2 == 0, ".html").otherwise(".TXT"),
        )
        .alias("path"),
        c("html").alias("content"),
    )


register(
    "a15_read_repo_snapshot", lambda t: ch.file_list(_pages(t)),
    r"""
SELECT 'src/m' || (page_id % 7) || '/p' || page_id || CASE WHEN page_id % 2 = 0 THEN '.html' ELSE '.TXT' END AS path, CASE WHEN page_id % 2 = 0 THEN '.html' ELSE '.txt' END AS extension, coalesce(strlen(html), 0)::INT AS size_bytes,
CASE WHEN coalesce(html, '') = '' THEN 0 ELSE len(string_split(html, chr(10))) END AS lines, 2 AS depth, 'm' || (page_id % 7) AS parent FROM pages WHERE page_id % 9 <> 0""",
)


def _manifests(t):
    g, k, s = F.floor(c("p_partkey") / 10), c("p_partkey").cast("string"), c("p_size").cast("string")
    kind = g % 4
    line = (
        F.when(kind == 0, F.concat(F.lit("pkg-"), k, F.lit(">="), s, F.lit(".0; python_version > '3'")))
        .when(kind == 1, F.concat(F.lit("pkg-"), k, F.lit(' = "'), s, F.lit('.0"')))
        .when(kind == 2, F.concat(F.lit("\texample.com/pkg-"), k, F.lit(" v1."), s))
        .otherwise(F.concat(F.lit('"pkg-'), k, F.lit('": "^'), s, F.lit('"')))
    )
    f = t.part.groupBy(g.alias("g")).agg(F.sort_array(F.collect_list(line)).alias("l"))  # ten parts a file
    kind = c("g") % 4
    body = (
        F.when(kind == 0, F.concat(F.lit("# wanted\n"), F.array_join("l", "\n")))
        .when(kind == 1, F.concat(F.lit("[package]\nname = \"x\"\n[dev-dependencies]\n"), F.array_join("l", "\n"), F.lit("\n[profile]\nopt = 3\n")))
        .when(kind == 2, F.concat(F.lit("module x\nrequire (\n"), F.array_join("l", "\n"), F.lit("\n)\n")))
        .otherwise(F.concat(F.lit('{"name": "x", "devDependencies": {'), F.array_join("l", ", "), F.lit("}}")))
    )
    name = F.when(kind == 0, "requirements.txt").when(kind == 1, "Cargo.toml").when(kind == 2, "go.mod").otherwise("package.json")
    return f.select(F.concat(c("g").cast("string"), F.lit("/"), name).alias("path"), body.alias("content"))


register(
    "a16_read_manifests", lambda t: ch.manifests(_manifests(t)),
    """
SELECT (p_partkey // 10) || '/' || CASE (p_partkey // 10) % 4 WHEN 0 THEN 'requirements.txt' WHEN 1 THEN 'Cargo.toml' WHEN 2 THEN 'go.mod' ELSE 'package.json' END AS path, CASE WHEN (p_partkey // 10) % 4 = 2 THEN 'example.com/' ELSE '' END || 'pkg-' || p_partkey AS name,
CASE (p_partkey // 10) % 4 WHEN 2 THEN 'v1.' || p_size WHEN 3 THEN '^' || p_size ELSE p_size || '.0' END AS version, CASE WHEN (p_partkey // 10) % 4 IN (1, 3) THEN 'dev' ELSE 'runtime' END AS kind, CASE (p_partkey // 10) % 4 WHEN 0 THEN 'pip' WHEN 1 THEN 'cargo' WHEN 2 THEN 'go' ELSE 'npm' END AS ecosystem FROM part""",
)


def _posts(t):
    safe = F.regexp_replace("text", r"[^A-Za-z0-9 ]", "")
    xml = F.concat(
        F.lit("<TimelineObject><author>"), c("sender"), F.lit("</author><createTime>"),
        F.unix_seconds(c("ts").cast("timestamp")).cast("string"), F.lit("</createTime><contentDesc>x"), safe,
        F.lit("</contentDesc></TimelineObject>"),
    )
    return t.v_chat.select(F.when(c("id") % 10 == 9, F.lit("no xml")).otherwise(xml).alias("payload"))


register(
    "a17_read_feeds",
    lambda t: ch.feeds(_posts(t), start=1704153600).groupBy("author").agg(F.count(F.lit(1)).alias("posts"), F.max("ts").alias("newest")),
    "SELECT sender AS author, count(*) AS posts, max(epoch(ts))::BIGINT AS newest FROM v_chat WHERE id % 10 <> 9 AND epoch(ts) "
    ">= 1704153600 GROUP BY sender",
)


def _shards(t):
    s = t.v_chat.withColumn("shard", F.concat(F.lit("Msg_"), F.md5(c("chat_id").cast("binary")))).withColumnsRenamed({"text": "message_content", "sender": "real_sender"})
    known = t.v_chat.select("chat_id").distinct().where("chat_id <> 'src1'")
    one = ch.union_shards(
        {"a": s.where("id % 2 = 0").select("shard", "message_content", "real_sender"), "b": s.where("id % 2 = 1").select("shard", c("message_content").alias("strContent"), "real_sender")},
        {"table": ("shard",), "text": ("message_content", "strContent"), "sender": ("real_sender",)},
    )
    return ch.resolve_shards(one.drop("shard").withColumnRenamed("table", "shard"), known).groupBy("chat_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


register("a20_resolve_shards", _shards, "SELECT CASE WHEN chat_id <> 'src1' THEN chat_id END AS chat_id, count(*) AS n, sum(length(text))::BIGINT AS chars FROM v_chat GROUP BY 1")


def _content():
    blocks = lambda *xs: F.concat(F.lit("["), F.concat_ws(",", *xs), F.lit("]"))
    text = _json(type=F.lit("text"), text=c("text"))
    tool = F.to_json(F.struct(F.lit("tool_use").alias("type"), F.lit("Grep").alias("name"), F.struct(c("session_id").alias("pattern")).alias("input")))
    return (
        F.when(c("role") == "ASSISTANT", blocks(_json(type=F.lit("thinking"), thinking=F.lit("hm")), text, tool))
        .otherwise(
            F.get_json_object(_json(a=F.array("text")), "$.a").substr(F.lit(2), F.length(F.get_json_object(_json(a=F.array("text")), "$.a")) - 2),
        )
    )


register(
    "b1_flatten_content",
    lambda t: t.v_messages.select("session_id", "seq", tr.flatten_content(_content()).alias("text")),
    "SELECT session_id, seq, CASE WHEN role = 'ASSISTANT' THEN '[THINKING] hm' || chr(10) || text || chr(10) || '[TOOL: Grep] "
    "' || session_id ELSE text END AS text FROM v_messages",
)
register(
    "b4_tool_key",
    lambda t: (
        t.events.select(
            "event_id",
            tr.tool_key(
                F.element_at(F.array(*map(F.lit, ("Read", "Bash", "Grep", "WebFetch", "Other"))), (c("event_id") % 5 + 1).cast("int")),
                F.create_map(F.lit("file_path"), c("event_type"), F.lit("command"), F.repeat(c("event_type"), 30), F.lit("pattern"), c("user_id").cast("string")),
            )
            .alias("key_input"),
        )
    ),
    "SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_type WHEN 1 THEN substring(repeat(event_type, 30), 1, 80) WHEN 2 THEN "
    "user_id::VARCHAR ELSE '' END AS key_input FROM events",
)
