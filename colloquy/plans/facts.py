"""Queries over tool calls and sessions."""

from pyspark.sql import functions as F

from ..operators import basics as ba
from ..operators import facts as op
from . import register

register("d1_session_stats", lambda t: t.v_sessions, "SELECT * FROM v_sessions")

register(
    "d2_rich_stats",
    lambda t: (
        op.rich_stats(t.v_tool_calls)
        .select(
            "session_id",
            F.array_join(F.transform(F.map_entries("tool_usage"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",").alias("usage"),
            F.array_join(F.transform(F.map_entries("tool_errors"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",").alias("failed"),
            "calls", "errors", F.array_join("flags", ",").alias("flags"),
        )
    ),
    """
SELECT session_id, string_agg(name || ':' || n, ',' ORDER BY name) AS usage, coalesce(string_agg(name || ':' || bad, ',' ORDER BY name) FILTER (bad > 0), '') AS failed, sum(n)::BIGINT AS calls, sum(bad)::BIGINT AS errors,
       concat_ws(',', CASE WHEN sum(bad) / sum(n) > 0.25 THEN 'high_error_rate' END, CASE WHEN sum(n) > 40 THEN 'long_conversation' END, CASE WHEN max(n) > 15 THEN 'retry_loop' END) AS flags
FROM (SELECT session_id, name, count(*) AS n, count(*) FILTER (status = 'error') AS bad FROM v_tool_calls GROUP BY ALL) GROUP BY session_id""",
)

register(
    "d16_tool_perf", lambda t: op.tool_perf(t.v_tool_calls),
    """
SELECT name, count(*) AS calls, count(*) FILTER (status = 'error') AS errors, round(count(*) FILTER (status = 'error') / count(*), 4) AS error_rate, round(avg(duration_ms), 4) AS avg_ms,
       list_sort(list(duration_ms))[least(floor(count(*) * 50 / 100), count(*) - 1)::BIGINT + 1] AS p50_ms, list_sort(list(duration_ms))[least(floor(count(*) * 95 / 100), count(*) - 1)::BIGINT + 1] AS p95_ms, sum(duration_ms)::BIGINT AS total_ms
FROM v_tool_calls GROUP BY name""",
)

register("w4_retry_runs", lambda t: op.retry_runs(t.v_tool_calls), """
WITH c AS (SELECT *, name || '|' || status AS key, lag(name || '|' || status) OVER w AS before FROM v_tool_calls WINDOW w AS (PARTITION BY session_id ORDER BY ts, seq)),
r AS (SELECT *, sum(CASE WHEN before IS NOT DISTINCT FROM key THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY ts, seq) AS run FROM c)
SELECT session_id, name, count(*) AS n, min(ts) AS started, max(ts) AS ended FROM r WHERE status = 'error' GROUP BY session_id, run, name HAVING count(*) >= 3""")

register("w13_candidate_rules", lambda t: op.candidate_rules(op.retry_runs(t.v_tool_calls)), """
WITH c AS (SELECT *, name || '|' || status AS key, lag(name || '|' || status) OVER (PARTITION BY session_id ORDER BY ts, seq) AS before FROM v_tool_calls),
r AS (SELECT *, sum(CASE WHEN before IS NOT DISTINCT FROM key THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY ts, seq) AS run FROM c),
runs AS (SELECT name, count(*) AS n FROM r WHERE status = 'error' GROUP BY session_id, run, name HAVING count(*) >= 3)
SELECT name, count(*) AS runs, max(n) AS longest, 'check inputs before calling ' || name || ' again (' || count(*) || ' runs, longest ' || max(n) || ')' AS rule FROM runs GROUP BY name""")

register(
    "w14_cross_session_analysis",
    lambda t: (
        t.v_tool_calls.groupBy("session_id")
        .agg(F.count(F.lit(1)).alias("calls"), F.count_if(op.is_error()).alias("errors"))
        .join(op.retry_runs(t.v_tool_calls).groupBy("session_id").agg(F.count(F.lit(1)).alias("runs")), "session_id", "left")
        .agg(
            F.count(F.lit(1)).alias("sessions"), F.sum("calls").alias("calls"), F.sum("errors").alias("errors"),
            F.sum(F.coalesce("runs", F.lit(0))).alias("retry_runs"),
        )
    ),
    """
WITH c AS (SELECT *, lag(name || '|' || status) OVER (PARTITION BY session_id ORDER BY ts, seq) AS before FROM v_tool_calls),
r AS (SELECT *, sum(CASE WHEN before IS NOT DISTINCT FROM name || '|' || status THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY ts, seq) AS run FROM c),
runs AS (SELECT 1 FROM r WHERE status = 'error' GROUP BY session_id, run, name HAVING count(*) >= 3)
SELECT count(DISTINCT session_id) AS sessions, count(*) AS calls, count(*) FILTER (status = 'error') AS errors, (SELECT count(*) FROM runs) AS retry_runs FROM v_tool_calls""",
)

register(
    "c1_call_results",
    lambda t: (
        op.call_results(
            t.events.where("event_type <> 'error'").select("user_id", F.col("event_id").alias("call_id"), "event_type"),
            t.events.where("event_id % 4 <> 0")
            .select(
                "user_id", F.col("event_id").alias("call_id"),
                F.when(F.col("value") > 50, "error").otherwise("ok").alias("status"), F.col("props").alias("result"),
            ),
            ["user_id", "call_id"],
        )
    ),
    """
SELECT c.user_id, c.event_id AS call_id, c.event_type, CASE WHEN r.event_id IS NULL THEN 'ok' WHEN r.value > 50 THEN 'error' ELSE 'ok' END AS status, CASE WHEN r.event_id IS NULL THEN '(no result captured)' ELSE r.props END AS result
FROM events c LEFT JOIN (SELECT * FROM events WHERE event_id % 4 <> 0) r USING (user_id, event_id) WHERE c.event_type <> 'error'""",
)

register(
    "b19_active_minutes", lambda t: op.active_minutes(t.v_sessions).select("session_id", "minutes"),
    """
SELECT session_id, round(CASE WHEN duration_seconds / 60 > 90 AND 2.5 * messages + 0.8 * tool_calls < 0.2 * duration_seconds / 60 THEN 2.5 * messages + 0.8 * tool_calls ELSE duration_seconds / 60 END, 4) AS minutes FROM v_sessions""",
)

register(
    "w8_fair_merge", lambda t: op.fair_merge(t.v_sessions),
    """
SELECT turn, agent, session_id, created FROM (SELECT row_number() OVER (PARTITION BY agent ORDER BY created DESC NULLS LAST, session_id) AS turn, agent, session_id, created FROM v_sessions) ORDER BY turn, agent LIMIT 20""",
)

register("a3_schema_report", lambda t: ba.schema_report(t.events, "event_type", "props", "ts"), """
SELECT event_type, count(*) AS n, 'k' AS fields, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY event_type""")

register(
    "d17_turn_perf",
    lambda t: (
        t.v_tool_calls.groupBy("session_id", "dd")
        .agg(F.count(F.lit(1)).alias("tools"), F.count_if(op.is_error()).alias("bad"), F.sum("duration_ms").alias("ms"))
        .agg(
            F.count(F.lit(1)).alias("turns"), F.sum("tools").alias("tools"), F.round(F.avg("tools"), 4).alias("avg_tools"),
            F.count_if(F.col("bad") > 0).alias("error_turns"), F.round(F.avg("ms"), 4).alias("avg_ms"),
        )
    ),
    """
SELECT count(*) AS turns, sum(tools)::BIGINT AS tools, round(avg(tools), 4) AS avg_tools, count(*) FILTER (bad > 0) AS error_turns, round(avg(ms), 4) AS avg_ms
FROM (SELECT count(*) AS tools, count(*) FILTER (status = 'error') AS bad, sum(duration_ms) AS ms FROM v_tool_calls GROUP BY session_id, dd)""",
)

register(
    "d18_global_aggregates",
    lambda t: (
        t.v_sessions.groupBy(F.to_date("created").alias("day"), "agent")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("errors").alias("errors"))
        .rollup("agent")
        .agg(F.sum("n").alias("sessions"), F.sum("errors").alias("errors"))
    ),
    """
SELECT agent, count(*) AS sessions, sum(errors)::BIGINT AS errors FROM v_sessions GROUP BY ROLLUP (agent)""",
)

register(
    "d19_stats",
    lambda t: (
        t.v_sessions.rollup("agent")
        .agg(
            F.count(F.lit(1)).alias("sessions"), F.sum("messages").alias("messages"),
            F.sum("tool_calls").alias("tool_calls"), F.sum("errors").alias("errors"),
        )
    ),
    """
SELECT agent, count(*) AS sessions, sum(messages)::BIGINT AS messages, sum(tool_calls)::BIGINT AS tool_calls, sum(errors)::BIGINT AS errors FROM v_sessions GROUP BY ROLLUP (agent)""",
)

register(
    "d20_export_summary",
    lambda t: (
        t.v_sessions.join(op.rich_stats(t.v_tool_calls).select("session_id", "flags"), "session_id")
        .groupBy("agent")
        .agg(
            F.count(F.lit(1)).alias("sessions"), F.count_if(F.size("flags") > 0).alias("flagged"),
            op.rate(F.sum("errors"), F.sum("tool_calls")).alias("error_rate"),
        )
    ),
    """
WITH f AS (SELECT session_id, sum(bad) / sum(n) > 0.25 OR sum(n) > 40 OR max(n) > 15 AS flagged FROM (SELECT session_id, name, count(*) AS n, count(*) FILTER (status = 'error') AS bad FROM v_tool_calls GROUP BY ALL) GROUP BY session_id)
SELECT agent, count(*) AS sessions, count(*) FILTER (flagged) AS flagged, round(sum(errors) / sum(tool_calls), 4) AS error_rate FROM v_sessions JOIN f USING (session_id) GROUP BY agent""",
)

register("d21_by_project", lambda t: t.v_sessions.groupBy("project").agg(F.count(F.lit(1)).alias("sessions"), F.sum("errors").alias("errors")).orderBy(F.desc("sessions"), "project").limit(10), """
SELECT project, count(*) AS sessions, sum(errors)::BIGINT AS errors FROM v_sessions GROUP BY project ORDER BY sessions DESC, project LIMIT 10""")

register(
    "d22_habits",
    lambda t: (
        t.v_sessions.groupBy("agent")
        .agg(op.rate(F.sum("errors"), F.sum("tool_calls")).alias("error_rate"), F.round(F.avg("messages"), 4).alias("avg_messages"))
        .withColumn("watch", F.col("error_rate") > 0.1)
        .withColumn("long", F.col("avg_messages") > 30)
    ),
    """
SELECT agent, round(sum(errors) / sum(tool_calls), 4) AS error_rate, round(avg(messages), 4) AS avg_messages, round(sum(errors) / sum(tool_calls), 4) > 0.1 AS watch, round(avg(messages), 4) > 30 AS long FROM v_sessions GROUP BY agent""",
)

register(
    "b14_filters",
    lambda t: ba.only(t.v_sessions, agent="agent_1", project="_3").select("session_id", "agent", "project"),
    "SELECT session_id, agent, project FROM v_sessions WHERE agent = 'agent_1' AND project LIKE '%\\_3%' ESCAPE '\\'",
)
register("b13_time_window", lambda t: ba.only(t.v_sessions, since="2024-01-20").select("session_id", "created"), "SELECT session_id, created FROM v_sessions WHERE created >= TIMESTAMP '2024-01-20'")
register(
    "b3_drop_noise_types",
    lambda t: ba.without(t.events, "event_type", ("click", "view")).select("event_id", "event_type"),
    "SELECT event_id, event_type FROM events WHERE event_type NOT IN ('click', 'view')",
)
register(
    "b8_to_int_safe",
    lambda t: (
        t.events.select(
            "event_id", ba.to_int_safe(F.get_json_object("props", "$.k")).alias("k"),
            ba.to_int_safe(
                F.when(F.col("event_id") % 3 == 0, F.col("event_type"))
                .when(F.col("event_id") % 3 == 1, F.concat("user_id", F.lit(".75")))
                .otherwise(F.concat(F.lit(" -"), "event_id")),
            )
            .alias("part"),
        )
    ),
    """SELECT event_id, regexp_extract(props, '"k": *([0-9]+)', 1)::BIGINT AS k, coalesce(trunc(TRY_CAST(CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN user_id || '.75' ELSE ' -' || event_id END AS DOUBLE))::BIGINT, 0) AS part FROM events""",
)
register(
    "b7_normalize_ts",
    lambda t: (
        t.events.select(
            "event_id",
            F.coalesce(
                F.when(F.col("event_id") % 2 == 0, F.timestamp_millis(F.unix_millis(F.col("ts").cast("timestamp")))),
                F.try_to_timestamp(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")),
            )
            .cast("timestamp_ntz")
            .alias("at"),
        )
    ),
    "SELECT event_id, date_trunc('millisecond', ts) AS at FROM events",
)
register(
    "b24_relevant_tool",
    lambda t: ba.without(t.v_tool_calls, "name", ("tool_0",), "internal_").groupBy("name").agg(F.count(F.lit(1)).alias("n")),
    "SELECT name, count(*) AS n FROM v_tool_calls WHERE name <> 'tool_0' AND NOT starts_with(name, 'internal_') GROUP BY name",
)
register(
    "b21_label_msg_type",
    lambda t: (
        t.events.select(
            "event_id", F.shiftright("event_id", 3).alias("sub"),
            ba.message_kind(F.col("event_id").bitwiseAND(F.lit(0xFFFF)) % 50).alias("label"),
        )
    ),
    "SELECT event_id, event_id >> 3 AS sub, CASE (event_id & 65535) % 50 WHEN 1 THEN 'text' WHEN 3 THEN 'image' WHEN 34 THEN "
    "'voice' WHEN 43 THEN 'video' WHEN 47 THEN 'sticker' WHEN 49 THEN 'link' ELSE 'other' END AS label FROM events",
)
register(
    "s8_list_sessions",
    lambda t: ba.newest(t.v_sessions, "modified", "session_id", 20).select("session_id", "created", "modified", "messages"),
    "SELECT session_id, created, modified, messages FROM v_sessions ORDER BY modified DESC, session_id LIMIT 20",
)
register(
    "s18_dedup_by_path",
    lambda t: (
        ba.first_listing([t.v_sessions.where("errors > 2"), t.v_sessions.where("messages > 20"), t.v_sessions.where("agent <> 'agent_1'")], "session_id")
    ),
    "SELECT session_id, CASE WHEN errors > 2 THEN 1 WHEN messages > 20 THEN 2 ELSE 3 END AS listing FROM v_sessions WHERE errors "
    "> 2 OR messages > 20 OR agent <> 'agent_1'",
)
register(
    "p2_prune", lambda t: ba.orphans(t.v_sessions, t.v_tool_calls.where("dd <= 20"), "session_id"),
    "SELECT session_id FROM v_sessions WHERE session_id NOT IN (SELECT session_id FROM v_tool_calls WHERE dd <= 20)",
)
register(
    "p9_freshness", lambda t: ba.freshness(t.v_sessions, "agent", "modified", "2024-01-30"),
    "SELECT agent, max(modified) AS newest, max(modified) <= TIMESTAMP '2024-01-30' - INTERVAL 24 HOURS AS stale FROM v_sessions GROUP BY agent",
)
register(
    "p8_hourly_error_rate",
    lambda t: (
        t.v_tool_calls.groupBy(F.window("ts", "1 hour")["start"].alias("hour"), "name")
        .agg(F.count(F.lit(1)).alias("calls"), op.rate(F.count_if(op.is_error()), F.count(F.lit(1))).alias("error_rate"))
    ),
    "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, name, count(*) AS calls, round(count(*) FILTER (status = 'error') / count(*), "
    "4) AS error_rate FROM v_tool_calls GROUP BY ALL",
)
