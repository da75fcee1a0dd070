"""Queries on trends and diagnosis."""

from pyspark.sql import functions as F

from ..operators import facts, trends as op
from . import register

_PERIOD = "strftime({0}, '%G-W%V')"
_SUMMARY = (
    "count(*) AS sessions, sum(messages)::BIGINT AS turns, sum(tool_calls)::BIGINT AS tool_calls, round(sum(errors) / sum(tool_calls), "
    "3) AS error_rate, round(avg(CASE WHEN duration_seconds > 0 THEN duration_seconds END), 3) AS mean_seconds"
)

register(
    "f1_period_summary",
    lambda t: op.summary(t.v_sessions.withColumn("period", op.period(F.col("created"), "month")), ["period", "agent"]),
    f"SELECT strftime(created, '%Y-%m') AS period, agent, {_SUMMARY} FROM v_sessions GROUP BY ALL",
)
register("f2_period_over_period", lambda t: op.period_over_period(t.v_sessions), f"""
WITH s AS (SELECT strftime(created, '%G-W%V') AS period, {_SUMMARY} FROM v_sessions GROUP BY 1 ORDER BY 1 DESC LIMIT 8),
d AS (SELECT *, sessions - lag(sessions) OVER (ORDER BY period) AS d_sessions, round(error_rate - lag(error_rate) OVER (ORDER BY period), 3) AS d_error_rate FROM s)
SELECT *, CASE WHEN d_error_rate IS NULL THEN NULL WHEN -d_error_rate >= 0.01 THEN 'improving' WHEN -d_error_rate <= -0.01 THEN 'worsening' ELSE 'stable' END AS direction FROM d""")
register("f3_by_theme", lambda t: op.summary(t.v_sessions, ["project"]), f"SELECT project, {_SUMMARY} FROM v_sessions GROUP BY project")
register(
    "f4_regressions", lambda t: op.tool_changes(t.v_tool_calls),
    """
WITH r AS (SELECT name, strftime(ts, '%G-W%V') AS period, count(*) FILTER (status = 'error') / count(*) AS r FROM v_tool_calls GROUP BY ALL),
e AS (SELECT name, arg_min(r, period) AS a, arg_max(r, period) AS b FROM r GROUP BY name HAVING count(*) >= 2)
SELECT name, round(a, 4) AS first_rate, round(b, 4) AS last_rate, round(b - a, 4) AS change, CASE WHEN round(b - a, 4) >= 0.1 THEN 'regression' ELSE 'improvement' END AS kind FROM e WHERE abs(round(b - a, 4)) >= 0.1""",
)
register("f5_anomalies", lambda t: op.anomalies(t.v_sessions, t.v_tool_calls), """
(SELECT session_id, 'high_error_rate' AS kind, round(errors / tool_calls, 4) AS value FROM v_sessions WHERE errors / tool_calls >= 0.25 ORDER BY created DESC, session_id LIMIT 50)
UNION ALL (SELECT session_id, 'retry_loop', max(n)::DOUBLE FROM (SELECT session_id, name, count(*) AS n FROM v_tool_calls GROUP BY ALL HAVING count(*) >= 15) GROUP BY session_id)
UNION ALL (SELECT session_id, 'long_conversation', messages::DOUBLE FROM v_sessions WHERE messages >= 50 ORDER BY created DESC, session_id LIMIT 50)""")
register("f6_advantages", lambda t: op.advantages(t.v_sessions), """
(SELECT session_id, 'clean_efficient' AS kind FROM v_sessions WHERE errors = 0 AND tool_calls >= 3 ORDER BY tool_calls DESC, session_id LIMIT 10)
UNION ALL (SELECT session_id, 'fast_resolution' FROM v_sessions WHERE tool_calls >= 3 AND duration_seconds > 0 ORDER BY duration_seconds, session_id LIMIT 10)""")
register(
    "f7_flagged",
    lambda t: facts.rich_stats(t.v_tool_calls).where(F.size("flags") > 0).select("session_id", F.array_join("flags", ",").alias("flags")),
    """
SELECT * FROM (SELECT session_id, concat_ws(',', CASE WHEN sum(bad) / sum(n) > 0.25 THEN 'high_error_rate' END, CASE WHEN sum(n) > 40 THEN 'long_conversation' END, CASE WHEN max(n) > 15 THEN 'retry_loop' END) AS flags
FROM (SELECT session_id, name, count(*) AS n, count(*) FILTER (status = 'error') AS bad FROM v_tool_calls GROUP BY ALL) GROUP BY session_id) WHERE flags <> ''""",
)
register(
    "f8_recent_sessions",
    lambda t: op.recent_sessions(t.v_sessions, "2024-01-15", "agent_2").select("session_id", "messages"),
    "SELECT session_id, messages FROM v_sessions WHERE created >= TIMESTAMP '2024-01-15' AND messages >= 2 AND agent = 'agent_2' "
    "ORDER BY messages DESC, session_id LIMIT 20",
)
register("f9_tool_error_patterns", lambda t: op.tool_error_patterns(t.v_tool_calls), """
WITH b AS (SELECT name, session_id FROM v_tool_calls GROUP BY ALL HAVING count(*) FILTER (status = 'error') / count(*) >= 0.25)
SELECT name, count(*) AS sessions, array_to_string(list_sort(list(session_id))[1:10], ',') AS evidence FROM b GROUP BY name HAVING count(*) >= 3""")
register(
    "f10_recurring_flags",
    lambda t: (
        facts.rich_stats(t.v_tool_calls)
        .select("session_id", F.explode("flags").alias("flag"))
        .groupBy("flag")
        .agg(F.count(F.lit(1)).alias("sessions"))
        .where("sessions >= 2")
    ),
    """
WITH f AS (SELECT session_id, sum(bad) / sum(n) > 0.25 AS a, sum(n) > 40 AS b, max(n) > 15 AS c FROM (SELECT session_id, name, count(*) AS n, count(*) FILTER (status = 'error') AS bad FROM v_tool_calls GROUP BY ALL) GROUP BY session_id)
SELECT * FROM (SELECT 'high_error_rate' AS flag, count(*) FILTER (a) AS sessions FROM f UNION ALL SELECT 'long_conversation', count(*) FILTER (b) FROM f UNION ALL SELECT 'retry_loop', count(*) FILTER (c) FROM f) WHERE sessions >= 2""",
)
register("f11_project_outliers", lambda t: op.project_outliers(t.v_sessions), """
WITH p AS (SELECT project, count(*) AS sessions, sum(errors) / sum(tool_calls) AS r FROM v_sessions GROUP BY project), o AS (SELECT sum(errors) / sum(tool_calls) AS o FROM v_sessions)
SELECT project, sessions, round(r, 4) AS error_rate, round(o, 4) AS overall FROM p, o WHERE sessions >= 3 AND r >= o + 0.1 AND r > 0.15""")
register(
    "f13_env_profiles",
    lambda t: (
        t.v_sessions.rollup("agent")
        .agg(
            F.count(F.lit(1)).alias("sessions"), F.round(F.avg((F.col("errors") > 0).cast("int")), 4).alias("with_errors"),
            F.round(F.avg((F.col("duration_seconds") > 0).cast("int")), 4).alias("with_duration"),
        )
        .withColumn("agent", F.coalesce("agent", F.lit("_all")))
    ),
    "SELECT coalesce(agent, '_all') AS agent, count(*) AS sessions, round(avg((errors > 0)::INT), 4) AS with_errors, round(avg((duration_seconds "
    "> 0)::INT), 4) AS with_duration FROM v_sessions GROUP BY ROLLUP (agent)",
)
_HALF = "SELECT CASE WHEN row_number() OVER (ORDER BY created, session_id) <= count(*) OVER () // 2 THEN 'first' ELSE 'second' END AS half, * FROM v_sessions"
register(
    "f14_half_trend", lambda t: op.half_trend(t.v_sessions),
    f"SELECT half, count(*) AS sessions, round(avg(messages), 4) AS avg_messages, round(avg(errors), 4) AS errors_per_session, "
    f"round(sum(duration_seconds) / 60, 2) AS minutes FROM ({_HALF}) GROUP BY half",
)
register(
    "f17_insight_trends",
    lambda t: (
        op.half_trend(t.v_sessions)
        .agg(
            *[F.round((F.max(F.when(F.col("half") == "second", F.col(c))) - F.max(F.when(F.col("half") == "first", F.col(c)))) / F.nullif(F.max(F.when(F.col("half") == "first", F.col(c))), F.lit(0)), 4).alias(f"d_{c}") for c in ("avg_messages", "errors_per_session")],
        )
    ),
    f"""
WITH h AS (SELECT half, round(avg(messages), 4) AS m, round(avg(errors), 4) AS e FROM ({_HALF}) GROUP BY half)
SELECT round((b.m - a.m) / nullif(a.m, 0), 4) AS d_avg_messages, round((b.e - a.e) / nullif(a.e, 0), 4) AS d_errors_per_session FROM h a, h b WHERE a.half = 'first' AND b.half = 'second'""",
)
_HEALTH = """
WITH b AS (SELECT 'agent_' || (user_id % 5) AS family, name, count(*) AS n, count(*) FILTER (status = 'error') AS bad FROM v_tool_calls GROUP BY ALL),
f AS (SELECT family, sum(n)::BIGINT AS calls, sum(bad) AS errors, count(*) AS tools, max(bad) AS worst, arg_max(name, (bad, name)) AS worst_name FROM b GROUP BY family),
h AS (SELECT family, calls, tools, round(errors / calls, 4) AS error_rate, CASE WHEN worst >= 5 AND worst / errors >= 0.3 THEN worst_name END AS dominant_tool,
CASE WHEN calls < 10 THEN 'UNKNOWN' WHEN errors / calls >= 0.08 THEN 'CRITICAL' WHEN errors / calls >= 0.04 THEN 'WARNING' ELSE 'OK' END AS status FROM f)
"""
def _family():
    return F.concat(F.lit("agent_"), (F.col("user_id") % 5).cast("string"))


register("f15_env_health", lambda t: op.env_health(t.v_tool_calls, _family()), _HEALTH + "SELECT * FROM h")
register(
    "f16_comparisons",
    lambda t: (
        op.env_health(t.v_tool_calls, _family())
        .where("calls >= 10")
        .agg(
            F.min(F.struct("error_rate", "family"))["family"].alias("best"),
            F.max(F.struct("error_rate", "family"))["family"].alias("worst"),
            F.max(F.struct("calls", "family"))["family"].alias("busiest"),
        )
    ),
    _HEALTH + "SELECT arg_min(family, (error_rate, family)) AS best, arg_max(family, (error_rate, family)) AS worst, arg_max(family, (calls, family)) AS busiest FROM h WHERE calls >= 10",
)
register(
    "f18_findings",
    lambda t: (
        op.env_health(t.v_tool_calls, _family())
        .select(
            F.explode(
                F.array_compact(
                    F.array(
                        F.when(F.col("status") == "CRITICAL", F.struct(F.lit(0).alias("rank"), "family", F.lit("error rate").alias("finding"))),
                        F.when(F.col("dominant_tool").isNotNull(), F.struct(F.lit(1).alias("rank"), "family", F.concat(F.lit("mostly "), "dominant_tool").alias("finding"))),
                    ),
                ),
            )
            .alias("f"),
        )
        .select("f.*")
    ),
    _HEALTH + "SELECT 0 AS rank, family, 'error rate' AS finding FROM h WHERE status = 'CRITICAL' UNION ALL SELECT 1, family, 'mostly ' || dominant_tool FROM h WHERE dominant_tool IS NOT NULL",
)
register(
    "f19_load_report_rows",
    lambda t: (
        facts.active_minutes(t.v_sessions)
        .where("created >= timestamp_ntz'2024-01-08'")
        .select("session_id", F.to_date("created").alias("day"), F.hour("created").alias("hour"), F.weekday("created").alias("weekday"), "minutes")
    ),
    """
SELECT session_id, created::DATE AS day, hour(created)::INT AS hour, (isodow(created) - 1)::INT AS weekday,
round(CASE WHEN duration_seconds / 60 > 90 AND 2.5 * messages + 0.8 * tool_calls < 0.2 * duration_seconds / 60 THEN 2.5 * messages + 0.8 * tool_calls ELSE duration_seconds / 60 END, 4) AS minutes FROM v_sessions WHERE created >= TIMESTAMP '2024-01-08'""",
)
register(
    "f22_eval_benchmark",
    lambda t: (
        t.labels.groupBy(F.when(F.col("toxic") == 1, "with").otherwise("without").alias("arm"))
        .agg(
            F.count(F.lit(1)).alias("runs"), F.round(F.avg("quality"), 4).alias("pass_rate"),
            F.round(F.stddev_samp("quality"), 4).alias("stddev"), F.min("quality").alias("low"),
            F.max("quality").alias("high"),
        )
    ),
    "SELECT CASE WHEN toxic = 1 THEN 'with' ELSE 'without' END AS arm, count(*) AS runs, round(avg(quality), 4) AS pass_rate, "
    "round(stddev_samp(quality), 4) AS stddev, min(quality) AS low, max(quality) AS high FROM labels GROUP BY 1",
)
register(
    "f26_issue_score",
    lambda t: (
        op.issue_scores(
            t.v_tool_calls.where("status = 'error'")
            .select(
                (F.col("user_id") % 50).alias("entity"), F.floor((F.col("dd") - 1) / 10).alias("run"), "event_type",
                (F.col("k") % 3).alias("sev"), F.col("name").alias("dimension"),
            )
            .withColumn("severity", F.when(F.col("sev") == 0, "high").when(F.col("sev") == 1, "medium").otherwise("low")),
            {"high": 10.0, "medium": 4.0, "low": 1.0}, {"tool_0": 2.0, "tool_1": 1.0, "tool_2": 1.0},
        )
    ),
    """
WITH i AS (SELECT user_id % 50 AS entity, (dd - 1) // 10 AS run, name, CASE k % 3 WHEN 0 THEN 10.0 WHEN 1 THEN 4.0 ELSE 1.0 END AS cost FROM v_tool_calls WHERE status = 'error'),
b AS (SELECT entity, run, name, greatest(100 - sum(cost), 0)::DOUBLE AS s FROM i GROUP BY ALL),
w AS (SELECT entity, run, round((coalesce(max(s) FILTER (name = 'tool_0'), 100) * 2 + coalesce(max(s) FILTER (name = 'tool_1'), 100) + coalesce(max(s) FILTER (name = 'tool_2'), 100)) / 4, 4) AS score FROM b GROUP BY ALL)
SELECT entity, run, score, round(score - lag(score) OVER (PARTITION BY entity ORDER BY run), 4) AS change, CASE WHEN score >= 80 THEN 'good' WHEN score >= 60 THEN 'fair' ELSE 'poor' END AS band FROM w""",
)
