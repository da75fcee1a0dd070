"""Queries on conversations: keywords, profiles, topics, intents, tasks, knowledge."""

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import basics as ba
from ..operators import dialogue as op
from . import register
from .search import ERROR_SQL


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_WORDS = r"regexp_extract_all(lower(text), '[\x{4E00}-\x{9FFF}]|[a-zA-Z0-9]+')"
_TOKENS = r"regexp_extract_all(lower(text), '[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]|[A-Za-z0-9_]+')"
_STOP = ", ".join(map(_q, rules.STOP_WORDS))
_FAIL = r"(?i)permission denied|timed out|error|denied"


def _intent(name: str) -> str:
    weight, keys = rules.INTENTS[name]
    one = lambda k: f"CASE WHEN instr(l, {_q(k)}) > 0 THEN {len(k)} * {weight}::DOUBLE * (1 + 0.5::DOUBLE * ((instr(l, {_q(k)}) - 1) / greatest(length(l), 1))) ELSE 0 END"
    hits = " + ".join(f"contains(l, {_q(k)})::INT" for k in keys)
    return f"SELECT session_id, seq, '{name}' AS intent, {list(rules.INTENTS).index(name)} AS place, round({' + '.join(map(one, keys))}, 6) AS score, {hits} AS hits FROM m"


def _topic() -> tuple[str, str]:
    def points(ws, ts, code, sure):
        own = [f"2 * contains(lower(text), {_q(w)})::INT" for w in ws] + [f"3 * contains(tools, {_q(t)})::INT" for t in ts]
        if code:
            own.append(f"CASE WHEN NOT regexp_matches(lower(text), {_q(code)}) THEN 0 WHEN {' OR '.join(f'contains(lower(text), {_q(w)})' for w in sure)} THEN 3 ELSE 1 END")
        return " + ".join(own)

    sums = [(i, points(*rest)) for i, *rest in rules.TOPICS]
    return ", ".join(f"{p} AS p{i}" for i, p in sums), "CASE WHEN greatest(" + ", ".join(f"p{i}" for i, _ in sums) + ") = 0 THEN 0 " + " ".join(f"WHEN p{i} = greatest({', '.join(f'p{j}' for j, _ in sums)}) THEN {i}" for i, _ in sums) + " END"


_POINTS, _PICK = _topic()


def _topics(t):
    tool = F.concat(F.lit("tool_"), F.pmod(F.col("seq"), F.lit(7)).cast("string"))
    rows = t.v_messages.select("session_id", "seq", "ts", "text", tool.alias("tools"), F.ceil(F.length("text") / 4).alias("tokens"))
    return op.with_topics(rows).drop("text", "tools")


_TOPIC_SQL = (
    f"WITH p AS (SELECT session_id, seq, ts, ceil(length(text) / 4)::BIGINT AS tokens, {_POINTS} FROM (SELECT *, 'tool_' || (seq "
    f"% 7) AS tools FROM v_messages)), x AS (SELECT session_id, seq, ts, tokens, {_PICK} AS topic FROM p)"
)

register("g3_segment_keywords", lambda t: op.segment_keywords(t.v_messages, "session_id"), f"""
WITH c AS (SELECT session_id, term, count(*) AS n FROM (SELECT session_id, unnest({_WORDS}) AS term FROM v_messages) WHERE length(term) > 1 AND term NOT IN ({_STOP}) GROUP BY ALL)
SELECT session_id, term, n, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, term) AS rank FROM c QUALIFY rank <= 5""")
register(
    "g6_profiles", lambda t: op.profiles(t.v_chat),
    f"""
WITH b AS (SELECT sender, count(*) AS messages, avg(length(text)) AS mean, count(*) FILTER (regexp_matches(text, '[?？]')) AS asks FROM v_chat GROUP BY sender),
c AS (SELECT sender, term, count(*) AS n FROM (SELECT sender, unnest({_TOKENS}) AS term FROM v_chat) WHERE length(term) >= 2 GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY sender ORDER BY n DESC, term) AS r FROM c QUALIFY r <= 5), kt AS (SELECT sender, string_agg(term, '|' ORDER BY r) AS terms FROM k GROUP BY sender),
q AS (SELECT sender, text, row_number() OVER (PARTITION BY sender ORDER BY length(text) DESC, id) AS r FROM v_chat WHERE length(text) BETWEEN 6 AND 80 QUALIFY r <= 3), qt AS (SELECT sender, string_agg(text, '|' ORDER BY r) AS quotes FROM q GROUP BY sender)
SELECT sender, messages, round(mean, 4) AS mean_length, CASE WHEN mean > 40 THEN 'writer' WHEN asks > 0.3 * messages THEN 'asker' WHEN messages >= greatest(5, 0.2 * (SELECT count(*) FROM v_chat)) THEN 'core' ELSE 'active' END AS role, terms, quotes
FROM b LEFT JOIN kt USING (sender) LEFT JOIN qt USING (sender)""",
)
register("g9_topics", lambda t: op.topics(t.v_chat.withColumn("day", F.to_date("ts")), ["chat_id", "day"]), f"""
WITH c AS (SELECT chat_id, day, term, count(*) AS n FROM (SELECT chat_id, ts::DATE AS day, unnest({_TOKENS}) AS term FROM v_chat) WHERE length(term) >= 2 AND term NOT IN ({_STOP}) GROUP BY ALL),
s AS (SELECT count(*) AS segments FROM (SELECT DISTINCT chat_id, day FROM c)),
w AS (SELECT term, round(sum(n) * (ln((segments + 1) / (count(*) + 1)) + 1), 6) AS weight FROM c, s GROUP BY term, segments ORDER BY weight DESC, term LIMIT 24),
b AS (SELECT term, n FROM c JOIN w USING (term) QUALIFY row_number() OVER (PARTITION BY chat_id, day ORDER BY n DESC, weight DESC, term) = 1)
SELECT term AS topic, count(*) AS segments, sum(n)::BIGINT AS mentions FROM b GROUP BY term ORDER BY segments DESC, topic LIMIT 8""")
_ALIASES = "CASE " + " ".join(f"WHEN b = '{k}' THEN '{v}'" for k, v in rules.BRANDS.items()) + " END"
register(
    "g15_brand_periods", lambda t: op.brand_periods(t.v_chat, rules.BRANDS, "week"),
    f"""
WITH m AS (SELECT period, sender, {_ALIASES} AS brand FROM (SELECT date_trunc('week', ts)::DATE AS period, sender, unnest(list_distinct(regexp_extract_all(lower(text), '{"|".join(rules.BRANDS)}'))) AS b FROM v_chat)),
s AS (SELECT period, brand, count(*) AS mentions, count(DISTINCT sender) AS senders FROM m GROUP BY ALL)
SELECT period, brand, mentions, senders, row_number() OVER (PARTITION BY period ORDER BY mentions DESC, brand) = 1 AS is_primary, CASE WHEN senders >= 5 THEN 'high' WHEN senders >= 2 THEN 'medium' ELSE 'low' END AS confidence,
mentions > 2 AND coalesce(lag(mentions) OVER (PARTITION BY brand ORDER BY period), 0) < 0.2 * mentions AS emerging FROM s""",
)
register("u5_classify_topic", lambda t: _topics(t).select("session_id", "seq", "topic"), f"{_TOPIC_SQL} SELECT session_id, seq, topic FROM x")
register(
    "g20_topic_stats", lambda t: op.topic_stats(_topics(t)),
    f"{_TOPIC_SQL}, g AS (SELECT topic, count(*) AS messages, count(DISTINCT session_id) AS sessions, sum(tokens)::BIGINT AS tokens, "
    f"min(ts) AS first, max(ts) AS last FROM x GROUP BY topic) SELECT *, round(tokens * 3 / 1e6, 6) AS cost, round(tokens / sum(tokens) "
    f"OVER (), 4) AS share FROM g",
)


def _merged_profiles(t):
    half = F.col("ts") < F.lit("2024-01-03").cast("timestamp_ntz")
    p = op.merge_profiles(op.participants(t.v_chat.where(half)), op.participants(t.v_chat.where(~half)))
    hours = F.array_join(F.transform(F.array_sort(F.map_entries("hours")), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ",")
    return p.select("sender", "messages", hours.alias("hours"), F.array_join(F.transform("quotes", lambda q: q["id"].cast("string")), ",").alias("quotes"))


register(
    "g22_participant_profile", _merged_profiles,
    """
WITH h AS (SELECT sender, hour(ts) AS hour, count(*) AS n FROM v_chat GROUP BY ALL), q AS (SELECT sender, id, ts FROM v_chat QUALIFY row_number() OVER (PARTITION BY sender ORDER BY ts DESC, id DESC) <= 20)
SELECT sender, messages, hours, quotes FROM (SELECT sender, sum(n)::BIGINT AS messages, string_agg(hour || ':' || n, ',' ORDER BY hour) AS hours FROM h GROUP BY sender) JOIN (SELECT sender, string_agg(id::VARCHAR, ',' ORDER BY ts, id) AS quotes FROM q GROUP BY sender) USING (sender)""",
)
register(
    "g23_roundup", lambda t: op.roundup(t.v_chat),
    r"""
WITH m AS (SELECT id, ts, chat_id, text, nullif(regexp_extract(text, 'https?://[^\s\)"''>]+'), '') AS url, regexp_replace(lower(text), '[\s\pP]+', '', 'g') AS norm FROM v_chat WHERE trim(text) <> ''),
r AS (SELECT id, ts, chat_id, text, url IS NOT NULL AND row_number() OVER (PARTITION BY url ORDER BY ts, id) > 1 AS a, length(norm) >= 12 AND row_number() OVER (PARTITION BY norm ORDER BY ts, id) > 1 AS b FROM m)
SELECT ts::DATE AS day, chat_id, row_number() OVER (PARTITION BY chat_id, ts::DATE ORDER BY length(text) DESC, id) AS pick, id FROM r WHERE NOT a AND NOT b QUALIFY pick <= 6""",
)
register("g24_analysis_mode", lambda t: op.analyse(t.v_chat, "people")["participants"].select("sender", "messages"), "SELECT sender, count(*) AS messages FROM v_chat GROUP BY sender")


register(
    "u3_error_causes",
    lambda t: (
        t.v_messages.where(F.col("text").rlike(_FAIL))
        .groupBy("session_id", ba.classify_error(F.col("text")).alias("cause"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    ),
    f"SELECT session_id, {ERROR_SQL} AS cause, count(*) AS n, min(seq) AS first FROM v_messages WHERE regexp_matches(text, '{_FAIL}') GROUP BY ALL",
)
register(
    "u4_classify_intent",
    lambda t: op.intents(t.v_messages.where("role = 'USER'")).select("session_id", "seq", "intent", "confidence"),
    f"""
WITH m AS (SELECT session_id, seq, lower(text) AS l FROM v_messages WHERE role = 'USER'), s AS ({" UNION ALL ".join(map(_intent, rules.INTENTS))}),
r AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS second FROM s WINDOW w AS (PARTITION BY session_id, seq ORDER BY score DESC, place))
SELECT session_id, seq, CASE WHEN score > 0 THEN intent ELSE 'UNKNOWN' END AS intent, round(CASE WHEN score = 0 THEN 0 ELSE least(1.0::DOUBLE, score / (score + second) + CASE WHEN hits >= 3 THEN 0.1::DOUBLE ELSE 0 END) END, 4) AS confidence FROM r WHERE k = 1""",
)
_NAMES = {"tool_0": "Bash", "tool_1": "Edit", "tool_2": "WebSearch"}  # the tables' tools have no such names


def _tasks(t):
    name = F.create_map(*[F.lit(x) for p in _NAMES.items() for x in p])[F.col("name")]
    by = t.v_tool_calls.groupBy("session_id", name.alias("tool")).agg(F.count(F.lit(1)).alias("n"))
    s = by.groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("tool", "n"))).alias("usage"))
    first = t.v_messages.where("seq = 0").select("session_id", "text")
    s = s.withColumn("conv", F.regexp_extract("session_id", "^[0-9]+", 0)).join(first.withColumnRenamed("session_id", "conv"), "conv", "left")
    return s.select("session_id", op.task_of(F.coalesce("text", F.lit("")), F.col("usage")).alias("task"))


def _task_sql() -> str:
    col = {v: k for k, v in _NAMES.items()}
    rows = []
    for i, (task, tools) in enumerate(rules.TASK_TOOLS.items()):
        mine = " + ".join([col[x] for x in tools if x in col] or ["0"])
        vague = " + ".join([col[x] for x in tools if x in col and x in rules.AMBIGUOUS_TOOLS] or ["0"])
        boost = " + ".join(f"contains(text, {_q(k)})::INT" for k in rules.TASK_WORDS[task])
        share = f"(CASE WHEN {mine} > 0 THEN ({mine}) / (tool_0 + tool_1 + tool_2) * 6 * CASE WHEN ({vague}) / ({mine}) < 0.6 THEN 1 ELSE 0.5::DOUBLE END ELSE 0 END)"
        rows.append(f"SELECT session_id, {i} AS place, '{task}' AS task, round(CASE WHEN {share} > 0.1 THEN {share} ELSE 0 END + 0.5::DOUBLE * least({boost}, 3), 6) AS score FROM x")
    return "WITH c AS (SELECT session_id, regexp_extract(session_id, '^[0-9]+') AS conv, count(*) FILTER (name = 'tool_0') AS tool_0, count(*) FILTER (name = 'tool_1') AS tool_1, count(*) FILTER (name = 'tool_2') AS tool_2 FROM v_tool_calls GROUP BY session_id), x AS (SELECT c.*, coalesce(m.text, '') AS text FROM c LEFT JOIN (SELECT session_id AS conv, text FROM v_messages WHERE seq = 0) m USING (conv)), s AS (" + " UNION ALL ".join(rows) + ") SELECT session_id, CASE WHEN score = 0 THEN '综合协作' ELSE task END AS task FROM s QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY score DESC, place) = 1"


register("u7_classify_task", _tasks, _task_sql())


def _says(phrases: tuple[str, ...]) -> str:
    return f"regexp_matches(' ' || array_to_string(regexp_extract_all(lower(text), {_q(rules.PLAIN_WORD)}), ' ') || ' ', {_q(rules.spoken(phrases))})"


register(
    "u9_extract_knowledge", lambda t: op.knowledge(t.v_messages),
    f"""
WITH m AS (SELECT *, last_value(CASE WHEN role = 'ASSISTANT' THEN substring(text, 1, 500) END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS said FROM v_messages), u AS (SELECT * FROM m WHERE role = 'USER' AND length(text) >= 5),
i AS (SELECT session_id, seq, 'value' AS category, 0 AS place, substring(text, 1, 300) AS content FROM u WHERE {_says(rules.PREFERENCES)}
UNION ALL SELECT session_id, seq, 'correction', 1, substring(text, 1, 300) FROM u WHERE {_says(rules.REFUSALS)}
UNION ALL SELECT session_id, seq, 'pattern', 2, 'Approach approved: ' || substring(said, 1, 200) FROM u WHERE {_says(rules.PRAISES)} AND coalesce(said, '') <> ''
UNION ALL SELECT session_id, seq, 'reference', 3, 'URL mentioned: ' || unnest(list_distinct(regexp_extract_all(text, {_q(rules.URL)}))) FROM u)
SELECT session_id, category, seq, substring(content, 1, 80) AS opening FROM i QUALIFY row_number() OVER (PARTITION BY session_id, substring(content, 1, 80) ORDER BY place, seq) = 1""",
)
register(
    "w2_segment_session", lambda t: op.segment_sessions(t.v_messages),
    f"""
SELECT session_id, segment, start, messages FROM (WITH RECURSIVE n AS (SELECT session_id, (row_number() OVER w) - 1 AS i, {_WORDS} AS own, epoch(ts) - epoch(lag(ts) OVER w) AS since FROM v_messages WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
g AS (SELECT session_id, i, since, list_distinct(flatten(list(own) OVER (PARTITION BY session_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))) AS b, list_distinct(flatten(list(own) OVER (PARTITION BY session_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))) AS a FROM n),
c AS (SELECT session_id, i FROM g WHERE i > 0 AND (coalesce(since > 300, false) OR (i >= 3 AND len(b) > 0 AND len(a) > 0 AND len(list_intersect(a, b)) / len(b) < 0.1))),
k AS (SELECT session_id, count(*) AS total FROM n GROUP BY session_id),
r AS (SELECT session_id, 0::BIGINT AS start, 0 AS segment FROM k UNION ALL SELECT r.session_id, min(c.i), any_value(r.segment) + 1 FROM r JOIN c ON c.session_id = r.session_id AND c.i >= r.start + 5 JOIN k ON k.session_id = r.session_id AND k.total >= 3 WHERE r.segment < 19 GROUP BY r.session_id)
SELECT r.session_id, segment, start, coalesce(lead(start) OVER (PARTITION BY r.session_id ORDER BY segment), total) - start AS messages FROM r JOIN k USING (session_id))""",
)
register("w3_simhash_segments", lambda t: op.simhash_segments(t.v_chat.withColumn("day", F.to_date("ts")), ["chat_id", "day"]))
