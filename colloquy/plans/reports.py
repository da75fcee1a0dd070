"""Queries of the reports."""

from pyspark.sql import functions as F

from ..operators import reports as op
from . import register

c = F.col

register(
    "f12_insights", lambda t: op.usage_insights(t.v_usage.withColumn("tokens", c("input_tokens") + c("output_tokens"))),
    """
WITH u AS (SELECT session_id, model, strftime(ts, '%Y-%m') AS month, ts, input_tokens + output_tokens AS tokens FROM v_usage),
o AS (SELECT session_id, row_number() OVER (ORDER BY min(ts), session_id) AS place, count(*) OVER () AS total FROM u GROUP BY session_id),
h AS (SELECT u.*, CASE WHEN place <= total // 2 THEN 'first' ELSE 'second' END AS half FROM u JOIN o USING (session_id) WHERE total >= 6),
m AS (SELECT model AS name, count(DISTINCT session_id) AS sessions, sum(tokens)::BIGINT AS tokens FROM u GROUP BY model ORDER BY tokens DESC, name LIMIT 12),
t AS (SELECT 'month' AS of, month AS name, session_id, model, tokens FROM u UNION ALL SELECT 'half', half, session_id, model, tokens FROM h),
b AS (SELECT of, name, arg_max(model, (n, model)) AS detail FROM (SELECT of, name, model, sum(tokens) AS n FROM t GROUP BY ALL) GROUP BY of, name),
s AS (SELECT of, name, count(DISTINCT session_id) AS sessions, sum(tokens)::BIGINT AS tokens FROM t GROUP BY of, name)
SELECT 'model' AS of, name, sessions, tokens, NULL::VARCHAR AS detail FROM m UNION ALL SELECT of, name, sessions, tokens, detail FROM s JOIN b USING (of, name)""",
)


def _fields():
    return {"with_errors": c("errors") > 0, "with_calls": c("tool_calls") >= 5, "with_time": c("duration_seconds") > 0, "with_work": c("total_ms") > 3000}


register(
    "f13_profiles", lambda t: op.env_profiles(t.v_sessions, _fields()),
    """
WITH p AS (SELECT coalesce(agent, '_all') AS agent, count(*) AS sessions, round(avg((errors > 0)::INT), 4) AS with_errors, round(avg((tool_calls >= 5)::INT), 4) AS with_calls,
round(avg((duration_seconds > 0)::INT), 4) AS with_time, round(avg((total_ms > 3000)::INT), 4) AS with_work FROM v_sessions GROUP BY ROLLUP (agent)), g AS (SELECT *, greatest(with_errors, with_calls, with_time, with_work) AS top FROM p)
SELECT * EXCLUDE top, CASE top WHEN with_errors THEN 'with_errors' WHEN with_calls THEN 'with_calls' WHEN with_time THEN 'with_time' ELSE 'with_work' END AS "primary",
(with_errors >= 0.5)::INT + (with_calls >= 0.5)::INT + (with_time >= 0.5)::INT + (with_work >= 0.5)::INT AS layers FROM g""",
)


def _tools(t):
    agent = F.concat(F.lit("agent_"), (c("user_id") % 5).cast("string"))
    names = F.array(*[F.lit(x) for x in ("Bash", "Skill", "Plan", "Read", "Deploy", "Lint")])
    return t.v_tool_calls.select(agent.alias("agent"), F.element_at(names, ((c("k") + c("user_id") % 2) % 6 + 1).cast("int")).alias("name"))


register(
    "d22_agent_habits", lambda t: op.habits(t.v_sessions.withColumn("flagged", c("errors") * 4 > c("tool_calls")), _tools(t), top=2),
    """
WITH k AS (SELECT 'agent_' || (user_id % 5) AS agent, list_extract(['Bash', 'Skill', 'Plan', 'Read', 'Deploy', 'Lint'], ((k + user_id % 2) % 6 + 1)::INT) AS name, count(*) AS n FROM v_tool_calls GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY n DESC, name) AS place FROM k WHERE name NOT IN ('Bash', 'Read') QUALIFY place <= 2),
t AS (SELECT agent, string_agg(name || ':' || n, ',' ORDER BY place) AS tools FROM b GROUP BY agent), z AS (SELECT agent, sum(n) FILTER (name = 'Skill') AS skill_calls FROM k GROUP BY agent),
s AS (SELECT agent, round(sum(errors) / sum(tool_calls), 4) AS error_rate, round(avg((errors * 4 > tool_calls)::INT), 4) AS flag_share, round(avg(messages), 4) AS avg_messages FROM v_sessions GROUP BY agent)
SELECT s.*, coalesce(tools, '') AS tools, coalesce(skill_calls, 0)::BIGINT AS skill_calls, error_rate > 0.1 AS watch, flag_share > 0.3 AS flagged, avg_messages > 30 AS long FROM s LEFT JOIN t USING (agent) LEFT JOIN z USING (agent)""",
)


def _runs(t):
    return t.labels.select((c("doc_id") % 20).alias("case"), (c("doc_id") % 3 > 0).alias("helped"), (c("quality") == 1).alias("passed"), (c("doc_id") * 7 % 101).cast("long").alias("score"))


_ARMS = ", ".join(
    f"round(avg(CASE WHEN {t} THEN passed END), 4) AS rate_{n}, round(avg(score) FILTER ({t}), 4) AS mean_{n}, round(stddev_samp(score) FILTER ({t}), 4) AS stddev_{n}, min(score) FILTER ({t}) AS min_{n}, max(score) FILTER ({t}) AS max_{n}"
    for n, t in (("with", "helped"), ("without", "NOT helped"))
)
_DELTA = "avg(CASE WHEN helped THEN passed END) - avg(CASE WHEN NOT helped THEN passed END)"
register(
    "f22_benchmark_cases", lambda t: op.eval_benchmark(_runs(t)),
    f"""
WITH r AS (SELECT doc_id % 20 AS "case", doc_id % 3 > 0 AS helped, (quality = 1)::INT AS passed, doc_id * 7 % 101 AS score FROM labels),
k AS (SELECT "case", count(*) AS runs, {_ARMS}, coalesce({_DELTA} <> 0, false)::BIGINT AS apart, round({_DELTA}, 4) AS delta FROM r GROUP BY "case")
SELECT * FROM k UNION ALL SELECT NULL, count(*), {_ARMS}, (SELECT sum(apart)::BIGINT FROM k), round({_DELTA}, 4) FROM r""",
)


def _notes(t):
    text = F.concat("text", F.when(c("id") % 3 == 0, "\n# FIXME: check the Password here").when(c("id") % 5 == 0, "\n// HACK\n XXX token").otherwise(""))
    return op.marked_lines(t.v_chat.select("id", text.alias("text")))


_NOTES = r"""
WITH f AS (SELECT id, text || CASE WHEN id % 3 = 0 THEN chr(10) || '# FIXME: check the Password here' WHEN id % 5 = 0 THEN chr(10) || '// HACK' || chr(10) || ' XXX token' ELSE '' END AS text FROM v_chat),
l AS (SELECT id, unnest(string_split(text, chr(10))) AS code, generate_subscripts(string_split(text, chr(10)), 1)::INT - 1 AS line FROM f),
m AS (SELECT id, line, regexp_extract(code, '\b(TODO|FIXME|HACK|XXX)\b', 1) AS tag, regexp_extract(code, '\b(TODO|FIXME|HACK|XXX)\b[:\s]*(.*)$', 2) AS note FROM l WHERE regexp_matches(code, '\b(TODO|FIXME|HACK|XXX)\b')),
d AS (SELECT *, regexp_matches(lower(note), 'password|secret|token|credential|api_key') AS security FROM m)"""
register("h4_marked_lines", _notes, f"{_NOTES} SELECT * FROM d")
register("h4_debt_counts", lambda t: op.debt_counts(_notes(t)), f"{_NOTES} SELECT tag, count(*) AS n, count(*) FILTER (security) AS security, count(DISTINCT id) AS files FROM d GROUP BY tag")
