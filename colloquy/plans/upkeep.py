"""Queries on notes, versions, analyses and open items."""

from pyspark.sql import functions as F

from ..operators import search, upkeep as op
from . import register

_AT = "2026-01-01 00:00:07"
_CONFIRM = ["股票", "基金", "etf", "财报", "pe", "pb", "roe", "估值"]
_INCLUDE, _EXCLUDE = ["spark", "数据库"], ["红包", "优惠券"]
_KINDS, _TIERS, _LEVELS = ["project", "feedback", "user", "reference", "value", "other"], ["permanent", "periodic", "once"], ["confirmed", "high", "medium", "low"]


def _pick(values, at):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))


def _sql_pick(values, at):
    return f"list_extract([{', '.join(repr(v) for v in values)}], ({at} + 1)::INT)"


def _sql_any(words, text):
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _notes(t):
    return t.v_chat.select("id", F.col("chat_id").alias("project"), "ts", "text", _pick(_KINDS, F.col("id") % len(_KINDS)).alias("kind"))


_LIVES = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in op.HALF_LIVES.items()) + f" ELSE {op.HALF_LIVES['unknown']} END"
_NOTES = (
    f"n AS (SELECT id, chat_id AS project, ts, text, {_sql_pick(_KINDS, f'id % {len(_KINDS)}')} AS kind FROM v_chat), s AS (SELECT "
    f"*, least(greatest(floor(100 * (1 - exp(-((epoch_us(TIMESTAMP '{_AT}') - epoch_us(ts)) / 86400e6) * 0.6931471805599453::DOUBLE "
    f"/ {_LIVES})) + 1e-9), 0), 100)::INT AS score FROM n)"
)
register(
    "f25_staleness", lambda t: op.with_staleness(_notes(t), _AT).select("id", "kind", "score", "action"),
    f"WITH {_NOTES} SELECT id, kind, score, CASE WHEN score < 50 THEN 'keep' WHEN score < 75 THEN 'review' ELSE 'prune' END AS action FROM s",
)
register(
    "f24_memory_stats", lambda t: op.note_stats(_notes(t), _AT),
    f"""
WITH {_NOTES} SELECT project, count(*) AS files, sum(strlen(text))::BIGINT AS bytes, sum(length(text))::BIGINT // 4 AS tokens, count(*) FILTER (score < 25) AS fresh, count(*) FILTER (score >= 25 AND score < 50) AS aging,
count(*) FILTER (score >= 50 AND score < 75) AS review, count(*) FILTER (score >= 75) AS stale FROM s GROUP BY project""",
)


def _analyses(t):
    c = F.col
    ts = lambda days: c("ts") + F.make_dt_interval(days)
    return t.v_chat.select(
        c("id").alias("analysis_id"), c("sender").alias("session_id"), c("chat_id").alias("agent"),
        _pick(_TIERS, c("id") % 3).alias("tier"), ts(F.lit(1)).alias("analyzed"),
        ts((c("id") % 4).cast("int")).alias("modified"),
    )


_ANALYSES = (
    f"a AS (SELECT id AS analysis_id, sender AS session_id, chat_id AS agent, {_sql_pick(_TIERS, 'id % 3')} AS tier, ts + INTERVAL "
    f"1 DAY AS analyzed, ts + to_days((id % 4)::INT) AS modified FROM v_chat)"
)
register("c18_valid_analyses", lambda t: op.valid_analyses(_analyses(t), "2024-01-05"), f"""
WITH {_ANALYSES} SELECT session_id, arg_max(analysis_id, (analyzed, analysis_id)) AS analysis_id FROM a WHERE analyzed >= modified
AND (tier = 'permanent' OR (epoch_us(TIMESTAMP '2024-01-05') - epoch_us(analyzed)) / 3600e6 <= CASE tier WHEN 'periodic' THEN 168 ELSE 24 END) GROUP BY session_id""")
register(
    "d24_summary_archive", lambda t: op.archive(_analyses(t)),
    f"WITH {_ANALYSES} SELECT agent, tier, count(*) AS analyses, count(*) FILTER (analyzed < modified) AS outdated, max(analyzed) "
    f"AS last FROM a GROUP BY GROUPING SETS ((agent), (tier), ())",
)
_PARTS = r"[.\-+]"
_A, _B = "concat(p_size % 5, '.', p_partkey % 3, CASE WHEN p_partkey % 4 = 0 THEN '-rc' ELSE '' END)", "concat(CASE WHEN p_partkey % 7 = 0 THEN 'v' ELSE '' END, p_size % 4, '.', p_partkey % 2, '.', p_partkey % 3 % 2)"
_NUMBERS = "list_transform(CASE WHEN list_position({0}, '') > 0 THEN {0}[1:list_position({0}, '') - 1] ELSE {0} END, lambda x: x::BIGINT)"
register(
    "b23_compare_versions",
    lambda t: t.part.select("p_partkey", F.expr(_A).alias("a"), F.expr(_B).alias("b")).withColumn("sign", op.version_order(F.col("a"), F.col("b"))),
    f"""
WITH v AS (SELECT p_partkey, {_A} AS a, {_B} AS b FROM part), h AS (SELECT *, list_transform(regexp_split_to_array(a, '{_PARTS}'), lambda x: regexp_extract(x, '^[0-9]+')) AS ha, list_transform(regexp_split_to_array(b, '{_PARTS}'), lambda x: regexp_extract(x, '^[0-9]+')) AS hb FROM v),
n AS (SELECT *, {_NUMBERS.format('ha')} AS na, {_NUMBERS.format('hb')} AS nb FROM h), p AS (SELECT *, list_resize(na, greatest(len(na), len(nb)), 0) AS pa, list_resize(nb, greatest(len(na), len(nb)), 0) AS pb FROM n)
SELECT p_partkey, a, b, CASE WHEN len(na) = 0 OR len(nb) = 0 THEN (a > b)::INT - (a < b)::INT ELSE (pa > pb)::INT - (pa < pb)::INT END AS sign FROM p""",
)
register(
    "c6_resolve_chat",
    lambda t: op.best_matches(t.customer, "c_name", "Customer#00000001").select("c_custkey", "c_name", "level"),
    """
WITH l AS (SELECT c_custkey, c_name, CASE WHEN c_name = 'Customer#00000001' THEN 0 ELSE 1 END AS level FROM customer WHERE contains(lower(c_name), 'customer#00000001')) SELECT * FROM l WHERE level = (SELECT min(level) FROM l)""",
)
_HALVES = "WITH b AS (SELECT * FROM v_messages WHERE seq < 2), a AS (SELECT * FROM v_messages WHERE seq >= 2)"
register("c17_analysis_diff", lambda t: op.changes(t.v_messages.where("seq < 2"), t.v_messages.where("seq >= 2"), "session_id"), _HALVES + """
, k AS (SELECT session_id, bool_or(d < 0) AS o, bool_or(d > 0) AS n, sum(d)::BIGINT AS delta FROM (SELECT session_id, -1 AS d FROM b UNION ALL SELECT session_id, 1 FROM a) GROUP BY session_id)
SELECT session_id, CASE WHEN NOT o THEN 'new' WHEN NOT n THEN 'gone' ELSE 'kept' END AS change, delta FROM k""")
register(
    "c19_unused_skills",
    lambda t: (
        op.unused(
            t.part.select(F.explode(F.split("p_name", " ")).alias("skill")),
            t.v_messages.select(F.explode(search.tokens(F.col("text"))).alias("skill")), "skill",
        )
    ),
    """
SELECT DISTINCT skill FROM (SELECT unnest(string_split(p_name, ' ')) AS skill FROM part) WHERE skill NOT IN (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) FROM v_messages)""",
)
register(
    "s17_today_actions",
    lambda t: (
        op.today(
            t.events.select(
                F.col("event_id").alias("item_id"), F.when(F.col("event_id") % 3 > 0, "open").otherwise("done").alias("status"),
                F.to_date("ts").alias("follow_up"), (F.col("event_id") % 5).alias("priority"),
                _pick(_LEVELS, F.col("event_id") % 4).alias("confidence"), F.col("ts").alias("last_signal"),
            ),
            "2024-01-10",
        )
        .select("item_id", "due", "priority", "confidence")
    ),
    f"""
SELECT event_id AS item_id, ts::DATE <= DATE '2024-01-10' AS due, event_id % 5 AS priority, {_sql_pick(_LEVELS, 'event_id % 4')} AS confidence FROM events WHERE event_id % 3 > 0
ORDER BY due DESC, priority DESC, event_id % 4, ts DESC, item_id LIMIT 20""",
)
register(
    "u2_is_error_text", lambda t: t.v_chat.select("id", op.is_error_text(F.col("text")).alias("failed")),
    f"SELECT id, {_sql_any(op.FAILING, 'lower(text)')} AND NOT {_sql_any(op.PASSING, 'lower(text)')} AS failed FROM v_chat",
)
register(
    "u10_relevance",
    lambda t: (
        t.v_chat.select(
            "id",
            op.relevance(F.col("id") % 6, F.col("text"), F.when(F.col("chat_id") == "src3", 2).when(F.col("chat_id") == "src4", -2), _INCLUDE, _EXCLUDE)
            .alias("priority"),
        )
    ),
    f"""
SELECT id, CASE WHEN {_sql_any(_EXCLUDE, 'lower(text)')} THEN 0 ELSE least(greatest(id % 6 + CASE WHEN {_sql_any(_INCLUDE, 'lower(text)')} THEN 1 ELSE 0 END + CASE chat_id WHEN 'src3' THEN 2 WHEN 'src4' THEN -2 ELSE 0 END, 0), 5) END::INT AS priority FROM v_chat""",
)
_CODES = (
    f"c AS (SELECT chat_id, length(text) AS cost, unnest(list_distinct(list_filter(regexp_extract_all(text, '[0-9]+'), lambda "
    f"x: length(x) = 6 AND x[1] IN ('0', '3', '6')))) AS code FROM v_chat WHERE {_sql_any(_CONFIRM, 'lower(text)')})"
)


def _codes(t):
    return t.v_chat.select("chat_id", F.length("text").alias("cost"), F.explode(op.codes(F.col("text"), _CONFIRM)).alias("code"))


register("u6_extract_codes", lambda t: _codes(t).groupBy("code").agg(F.count(F.lit(1)).alias("n")), f"WITH {_CODES} SELECT code, count(*) AS n FROM c GROUP BY code")
register(
    "g21_repeated_subjects", lambda t: op.repeated_subjects(_codes(t), "chat_id", "code", "cost"),
    f"WITH {_CODES} SELECT code, count(DISTINCT chat_id) AS sessions, sum(cost)::BIGINT AS cost FROM c GROUP BY code HAVING count(DISTINCT chat_id) > 1",
)
register(
    "f20_analysis_pack",
    lambda t: op.pack_budget(t.v_chat, "chat_id", ["ts", "id"], 20, 2000).select("chat_id", "id", "place", "chars"),
    """
WITH r AS (SELECT *, row_number() OVER w AS place, sum(length(text)) OVER w AS chars FROM v_chat WINDOW w AS (PARTITION BY chat_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING)) SELECT chat_id, id, place, chars::BIGINT AS chars FROM r WHERE place <= 20 AND chars <= 2000""",
)
