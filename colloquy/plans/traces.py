"""Queries on transcript records that Spark makes from the messages: session facts, turns, tool traces, streamed answers."""

from pyspark.sql import functions as F

from ..operators import records as rec
from ..sources import traces as tr
from . import register

c = F.col


def _json(**fields):
    return F.to_json(F.struct(*[x.alias(n) for n, x in fields.items()]))


def _tool(kind, **fields):
    return F.struct(F.lit(kind).alias("type"), *[x.alias(n) for n, x in fields.items()])


def _made(t):
    """Messages with a number each, by which kinds of records are told apart."""
    return t.v_messages.withColumn("n", c("session_id").cast("long") * 7 + c("seq"))


def _records(t):
    """Lines of a transcript: users' and assistants' records with flags, blocks and usage, compactions, snapshots, summaries."""
    m, n = _made(t), c("n")
    text = (
        F.when(n % 17 == 0, "[Request interrupted by user]")
        .when(n % 7 == 0, F.concat(F.lit("<system-reminder>x</system-reminder>"), F.when(n % 2 == 0, F.concat(F.lit(" "), "text")).otherwise("")))
        .otherwise(c("text"))
    )
    said = F.array(_tool("text", text=text))
    results = F.array(_tool("tool_result", tool_use_id=F.concat(F.lit("t"), n - 1), content=text, is_error=n % 2 == 0))
    blocks = F.when(n % 5 == 0, F.to_json(results)).when(n % 3 == 0, F.to_json(said)).otherwise(F.to_json(F.array(text)))
    # a string stands for itself, not in a list
    content = F.when((n % 5 == 0) | (n % 3 == 0), blocks).otherwise(F.regexp_replace(blocks, r"(?s)^\[(.*)\]$", "$1"))
    common = lambda kind: F.concat(F.lit('{"type":"'), F.lit(kind), F.lit('","timestamp":"'), F.date_format(c("ts"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit('","gitBranch":'), F.when(n % 4 == 0, F.lit('""')).otherwise(F.concat(F.lit('"b'), n % 5, F.lit('"'))))
    user = F.concat(
        common("user"), F.lit(',"isMeta":'), (n % 11 == 0).cast("string"), F.lit(',"isCompactSummary":'),
        (n % 13 == 0).cast("string"), F.lit(',"message":{"role":"user","content":'), content, F.lit("}}"),
    )
    calls = (
        F.when(
            n % 2 == 0,
            F.array(
                F.to_json(_tool("text", text=c("text"))),
                F.to_json(_tool("tool_use", id=F.concat(F.lit("t"), n), name=F.concat(F.lit("tool"), n % 3), input=F.create_map(F.lit("k"), n))),
            ),
        )
        .otherwise(F.array(F.to_json(_tool("text", text=c("text")))))
    )
    usage = F.to_json(F.struct((n % 1000).alias("input_tokens"), (n % 100).alias("output_tokens"), (n % 50).alias("cache_read_input_tokens"), (n % 10).alias("cache_creation_input_tokens")))
    model = F.when(n % 19 == 0, "<synthetic>").otherwise(F.concat(F.lit("m"), n % 3))
    answer = F.concat(
        common("assistant"), F.lit(',"requestId":"r'), F.floor(c("seq") / 4),
        F.lit('","message":{"role":"assistant","model":"'), model, F.lit('","content":['), F.array_join(calls, ","),
        F.lit('],"usage":'), usage, F.lit("}}"),
    )
    backups = F.map_from_entries(F.transform(F.sequence(F.lit(1), n % 4 + 1), lambda i: F.struct(i.cast("string"), F.lit(1))))
    system = (
        F.when(n % 3 == 0, F.concat(common("system"), F.lit(',"subtype":"compact_boundary"}')))
        .when(n % 3 == 1, F.concat(common("summary"), F.lit(',"summary":"s'), n, F.lit('"}')))
        .otherwise(F.concat(F.lit('{"type":"file-history-snapshot","snapshot":{"trackedFileBackups":'), F.to_json(backups), F.lit("}}")))
    )
    raw = F.when(c("role") == "USER", user).when(c("role") == "ASSISTANT", answer).otherwise(system)
    return m.select(c("session_id").alias("path"), c("seq").cast("int").alias("line_no"), raw.alias("raw"))


_M = """
m AS (SELECT session_id AS path, seq, role, ts, session_id::BIGINT * 7 + seq AS n, text AS whole FROM v_messages),
x AS (SELECT *, CASE WHEN n % 17 = 0 THEN '[Request interrupted by user]' WHEN n % 7 = 0 THEN CASE WHEN n % 2 = 0 THEN whole ELSE '' END ELSE whole END AS said,
  CASE role WHEN 'USER' THEN CASE WHEN n % 11 = 0 THEN 'meta' WHEN n % 13 = 0 THEN 'summary' WHEN n % 5 = 0 THEN 'tool_result' WHEN n % 17 = 0 THEN 'interrupted' WHEN n % 7 = 0 AND n % 2 <> 0 THEN 'reminder' ELSE 'user' END
    WHEN 'ASSISTANT' THEN CASE WHEN n % 19 = 0 THEN 'synthetic' ELSE 'assistant' END END AS kind FROM m)"""

register(
    "d1_session_records", lambda t: rec.session_records(_records(t)),
    f"""WITH {_M},
q AS (SELECT path, seq // 4 AS request, arg_max(struct_pack(i := n % 1000, o := n % 100, r := n % 50, w := n % 10), seq) AS u FROM x WHERE kind = 'assistant' GROUP BY ALL),
u AS (SELECT path, sum(u.i) AS i, sum(u.o) AS o, sum(u.r) AS r, sum(u.w) AS w FROM q GROUP BY path),
s AS (SELECT path, count(*) FILTER (kind IN ('user', 'reminder', 'interrupted')) AS user_messages, count(*) FILTER (kind = 'assistant') AS assistant_messages, count(*) FILTER (kind = 'assistant' AND n % 2 = 0) AS tool_calls,
  count(*) FILTER (role = 'USER' AND n % 5 = 0 AND n % 2 = 0) AS errors, count(*) FILTER (role = 'SYSTEM' AND n % 3 = 0) AS compactions, coalesce(max(n % 4 + 1) FILTER (role = 'SYSTEM' AND n % 3 = 2), 0)::INT AS files_edited,
  arg_min('b' || (n % 5), seq) FILTER (n % 4 <> 0 AND NOT (role = 'SYSTEM' AND n % 3 = 2)) AS branch, NULL::VARCHAR AS slug, arg_min('m' || (n % 3), seq) FILTER (kind = 'assistant') AS model, arg_max('s' || n, seq) FILTER (role = 'SYSTEM' AND n % 3 = 1) AS summary,
  strftime(min(ts) FILTER (NOT (role = 'SYSTEM' AND n % 3 = 2)), '%Y-%m-%dT%H:%M:%S') AS started, strftime(max(ts) FILTER (NOT (role = 'SYSTEM' AND n % 3 = 2)), '%Y-%m-%dT%H:%M:%S') AS ended FROM x GROUP BY path)
SELECT s.*, coalesce(i, 0)::BIGINT AS input_tokens, coalesce(o, 0)::BIGINT AS output_tokens, coalesce(r, 0)::BIGINT AS cache_read_tokens, coalesce(w, 0)::BIGINT AS cache_create_tokens FROM s LEFT JOIN u USING (path)""",
)
register(
    "b2_record_turns", lambda t: rec.turns(_records(t)).select("path", "line_no", "role", "text"),
    f"WITH {_M} SELECT path, seq::INT AS line_no, role, trim(CASE WHEN role = 'USER' THEN said ELSE whole END) AS text FROM x "
    f"WHERE kind IN ('user', 'assistant')",
)
register(
    "b2_turn_kinds",
    lambda t: rec.records(_records(t)).groupBy(rec.turn_kind(c("v")).alias("kind")).agg(F.count(F.lit(1)).alias("n")),
    f"WITH {_M} SELECT kind, count(*) AS n FROM x GROUP BY kind",
)


def _call(t, form):
    """Lines of a dialect: each even assistant message calls a tool, the message after it may tell the result."""
    m, n = _made(t), c("n")
    key, name = F.concat(F.lit("t"), n), F.concat(F.lit("tool"), n % 3)
    back, bad = F.concat(F.lit("t"), n - 1), n % 4 == 1
    call, result = form(key, name, back, F.substring("text", 1, 30), bad)
    return (
        m.where((c("role") == "ASSISTANT") & (n % 2 == 0) | (n % 2 == 1) & (n % 3 > 0))
        .select(c("session_id").alias("path"), c("seq").cast("int").alias("line_no"), F.when(n % 2 == 0, call).otherwise(result).alias("raw"))
    )


def _rollout(key, name, back, text, bad):
    call = _json(type=F.lit("response_item"), payload=F.struct(F.lit("function_call").alias("type"), key.alias("call_id"), name.alias("name"), F.lit("{}").alias("arguments")))
    output = F.struct(text.alias("content"), (~bad).alias("success"))
    return call, _json(type=F.lit("response_item"), payload=F.struct(F.lit("function_call_output").alias("type"), back.alias("call_id"), output.alias("output")))


def _flat(key, name, back, text, bad):
    call = _json(type=F.lit("assistant"), tool_calls=F.array(F.struct(key.alias("id"), F.struct(name.alias("name"), F.lit("{}").alias("arguments")).alias("function"))))
    return call, _json(type=F.lit("tool_result"), tool_call_id=back, content=text, is_error=bad)


def _parts(key, name, back, text, bad):
    call = _json(type=F.lit("assistant"), message=F.struct(F.array(F.struct(F.struct(key.alias("id"), name.alias("name")).alias("functionCall"))).alias("parts")))
    response = F.struct(F.when(~bad, text).alias("output"), F.when(bad, text).alias("error"))
    return call, _json(type=F.lit("user"), message=F.struct(F.array(F.struct(F.struct(back.alias("id"), response.alias("response")).alias("functionResponse"))).alias("parts")))


def _blocks(key, name, back, text, bad):
    call = _json(role=F.lit("assistant"), content=F.array(_tool("tool_use", id=key, name=name)))
    return call, _json(role=F.lit("user"), content=F.array(_tool("tool_result", tool_use_id=back, content=text, is_error=bad)))


_TRACE = """
WITH m AS (SELECT session_id AS path, seq, role, session_id::BIGINT * 7 + seq AS n, substring(text, 1, 30) AS said FROM v_messages),
k AS (SELECT path, n, seq FROM m WHERE role = 'ASSISTANT' AND n % 2 = 0), r AS (SELECT path, n - 1 AS n, said, n % 4 = 1 AS bad FROM m WHERE n % 2 = 1 AND n % 3 > 0)
SELECT path, seq::INT AS line_no, 't' || n AS id, 'tool' || (n % 3) AS name, said AS output, coalesce(bad, false) AS failed, said IS NOT NULL AS answered FROM k LEFT JOIN r USING (path, n)"""
for _name, _form, _dialect in (("a6_rollout_trace", _rollout, "nested_payload"), ("a6_flat_trace", _flat, "flat"), ("a6_parts_trace", _parts, "parts"), ("a6_blocks_trace", _blocks, "nested_message")):
    register(_name, lambda t, form=_form, dialect=_dialect: tr.tool_trace(_call(t, form), dialect).drop("input"), _TRACE)

register(
    "a6_request_usage",
    lambda t: (
        tr.request_usage(_records(t).where(F.contains("raw", F.lit('"assistant"'))), "nested_message")
        .groupBy("path")
        .agg(F.count(F.lit(1)).alias("requests"), *[F.sum(x).alias(x) for x in ("input_tokens", "output_tokens", "cached_tokens")])
    ),
    """
WITH m AS (SELECT session_id AS path, seq, session_id::BIGINT * 7 + seq AS n FROM v_messages WHERE role = 'ASSISTANT'), q AS (SELECT path, seq // 4 AS request, max(seq) AS seq, arg_max(n, seq) AS n FROM m GROUP BY ALL)
SELECT path, count(*) AS requests, sum(n % 1000)::BIGINT AS input_tokens, sum(n % 100)::BIGINT AS output_tokens, sum(n % 50)::BIGINT AS cached_tokens FROM q GROUP BY path""",
)


def _pieces(t):
    """Each answer as a stream: a first block that starts, its words one by one, now and then a new start, then a tool's block."""
    m = _made(t).where("role = 'ASSISTANT'")
    cut = m.select("session_id", "seq", "n", F.posexplode(F.split("text", " ")).alias("k", "word"))
    again = (c("k") > 0) & (c("k") % 6 == 5) & (c("n") % 3 == 0)
    delta = lambda kind, index, text: _json(requestId=F.concat(F.lit("q"), "n"), event=F.struct(F.lit("content_block_delta").alias("type"), F.lit(index).alias("index"), F.struct(text.alias(kind)).alias("delta")))
    start = lambda index, kind, text: _json(requestId=F.concat(F.lit("q"), "n"), event=F.struct(F.lit("content_block_start").alias("type"), F.lit(index).alias("index"), F.struct(F.lit(kind).alias("type"), F.lit("tool").alias("name"), text.alias("text")).alias("content_block")))
    lines = F.array(
        F.when((c("k") == 0) | again, start(0, "text", c("word"))).otherwise(delta("text", 0, F.concat(F.lit(" "), "word"))),
        F.when(c("k") == 0, start(1, "tool_use", F.lit(""))).otherwise(delta("partial_json", 1, c("k").cast("string"))),
    )
    rows = cut.select("session_id", "seq", "k", F.posexplode(lines).alias("j", "raw"))
    return rows.select(c("session_id").alias("path"), ((c("seq") * 100_000 + c("k")) * 2 + c("j")).cast("int").alias("line_no"), "raw")


register("a6_streamed_answers", lambda t: tr.answers(tr.assembled(_pieces(t))).select("path", "request", "text", F.array_join("tools", ",").alias("tools")), """
WITH m AS (SELECT session_id AS path, session_id::BIGINT * 7 + seq AS n, string_split(text, ' ') AS w FROM v_messages WHERE role = 'ASSISTANT')
SELECT path, 'q' || n AS request, array_to_string(w[CASE WHEN n % 3 = 0 THEN greatest(1, len(w) // 6 * 6) ELSE 1 END :], ' ') AS text, 'tool' AS tools FROM m""")
