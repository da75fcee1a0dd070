"""Queries on conversation messages."""

from pyspark.sql import functions as F

from ..operators import basics as ba
from ..operators import chat as op
from . import register

_TOK = "list_distinct(regexp_extract_all(lower(text), '[\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}]|[A-Za-z0-9_]+'))"
_DECISION = r"(?i)\b(decided|decision|agreed|conclusion|let''s go with|we will use)\b|结论|决定|确定"
register(
    "w1_topic_boundaries", lambda t: op.topic_boundaries(t.v_messages),
    f"""
WITH m AS (SELECT session_id, seq, ts, {_TOK} AS own FROM v_messages), l AS (SELECT *, lag(own) OVER w AS before, epoch(ts) - epoch(lag(ts) OVER w) AS since FROM m WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
s AS (SELECT session_id, seq, 0.4::DOUBLE * CASE WHEN since > 300 THEN least(since / 3600, 1.0) ELSE 0 END + 0.6::DOUBLE * CASE WHEN len(own) = 0 OR len(before) = 0 THEN 0.5 ELSE 1 - len(list_intersect(own, before)) / len(own) END AS score FROM l WHERE before IS NOT NULL)
SELECT session_id, seq, round(score, 4) AS score, row_number() OVER (PARTITION BY session_id ORDER BY seq)::INT AS label FROM s WHERE score > 0.5""",
)
register("w6_evidence_head", lambda t: op.evidence_head(t.v_messages), f"""
WITH u AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS k FROM v_messages WHERE role = 'USER' AND trim(text) <> '')
SELECT session_id, string_agg(substring(text, 1, 300), '|' ORDER BY k) AS evidence, count(*) FILTER (regexp_matches(text, '{_DECISION}')) AS decisions FROM u WHERE k <= 15 GROUP BY session_id""")
register(
    "w7_first_prompt", lambda t: op.first_prompt(t.v_messages),
    r"SELECT session_id, arg_min(text, seq) AS prompt FROM v_messages WHERE role = 'USER' AND NOT regexp_matches(lower(trim(text)), "
    r"'^(hi|hello|ok|thanks)\b|^<') GROUP BY session_id",
)
register(
    "w9_tail_state", lambda t: op.tail_state(t.v_messages),
    "SELECT session_id, arg_max(role, seq) AS role, CASE WHEN arg_max(role, seq) = 'USER' AND length(arg_max(text, seq)) > 12 "
    "THEN 'to_reply' ELSE 'waiting' END AS state FROM v_messages GROUP BY session_id",
)
register(
    "w12_corrections", lambda t: op.corrections(t.v_messages),
    "SELECT substring(text, 1, 50) AS opening, count(*) AS n, arg_min(session_id, (session_id, seq)) AS session_id FROM v_messages "
    "WHERE role = 'USER' AND length(text) >= 20 AND regexp_matches(lower(text), 'that''s wrong|should be|不对|错了') GROUP BY 1",
)
register(
    "g5_reciprocity", lambda t: op.reciprocity(t.v_messages),
    "WITH l AS (SELECT role, lag(role) OVER w AS from_role, epoch(ts) - epoch(lag(ts) OVER w) AS lag FROM v_messages WINDOW w "
    "AS (PARTITION BY session_id ORDER BY seq)) SELECT from_role, role, count(*) AS turns, round(avg(lag), 4) AS mean_lag FROM "
    "l WHERE from_role <> role GROUP BY ALL",
)
register(
    "g10_decisions",
    lambda t: (
        t.v_messages.where(F.col("text").rlike(op.DECISION))
        .select("session_id", "seq", F.when(F.length("text") > 200, "high").otherwise("medium").alias("confidence"))
    ),
    f"SELECT session_id, seq, CASE WHEN length(text) > 200 THEN 'high' ELSE 'medium' END AS confidence FROM v_messages WHERE regexp_matches(text, "
    f"'{_DECISION}')",
)
register(
    "u8_decision_flag",
    lambda t: t.v_messages.select("session_id", "seq", F.col("text").rlike(op.DECISION).alias("decision")),
    f"SELECT session_id, seq, regexp_matches(text, '{_DECISION}') AS decision FROM v_messages",
)
register(
    "b2_real_user_turn",
    lambda t: ba.real_user_turns(t.v_messages).groupBy("session_id").agg(F.count(F.lit(1)).alias("turns")),
    "SELECT session_id, count(*) AS turns FROM v_messages WHERE role = 'USER' AND NOT starts_with(ltrim(text), '[') AND NOT contains(text, "
    "'<system-reminder>') AND NOT starts_with(ltrim(text), '<command-') AND NOT starts_with(ltrim(text), '<local-command') AND "
    "NOT starts_with(ltrim(text), 'Caveat: ') AND NOT starts_with(ltrim(text), 'This session is being continued') GROUP BY session_id",
)
register(
    "b5_drop_tool_lines",
    lambda t: (
        t.v_messages.select("session_id", "seq", ba.drop_tool_lines(F.concat(F.lit("[TOOL: x] y\n"), "text", F.lit("\n[TOOL: z]\nend"))).alias("text"))
    ),
    "SELECT session_id, seq, array_to_string(list_filter(string_split('[TOOL: x] y' || chr(10) || text || chr(10) || '[TOOL: "
    "z]' || chr(10) || 'end', chr(10)), lambda l: NOT starts_with(l, '[TOOL: ')), chr(10)) AS text FROM v_messages",
)
register(
    "p4_new_messages", lambda t: ba.since_seen(t.v_messages, F.col("seq") < 3),
    "SELECT session_id, max(ts) AS last FROM v_messages GROUP BY session_id HAVING max(ts) FILTER (seq < 3) IS NULL OR max(ts) > max(ts) FILTER (seq < 3)",
)
register(
    "c9_gap_fill", lambda t: ba.gap_fill(t.v_messages.where("seq >= 2 AND seq <> 3 AND session_id NOT LIKE '%3'"), t.v_messages),
    "WITH r AS (SELECT * FROM v_messages WHERE seq >= 2 AND seq <> 3 AND session_id NOT LIKE '%3'), "
    "s AS (SELECT session_id, min(ts) AS start FROM r GROUP BY session_id), "
    "b AS (SELECT session_id, seq, ts, 'rich' AS layer FROM r "
    "UNION ALL SELECT session_id, seq, ts, 'archive' FROM v_messages m LEFT JOIN s USING (session_id) WHERE start IS NULL OR ts < start) "
    "SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, seq) AS place FROM b",
)
register(
    "p10_digest_since_last", lambda t: ba.most_active(t.v_messages, F.lit("2024-01-02").cast("timestamp_ntz")),
    "SELECT session_id, count(*) AS n FROM v_messages WHERE ts > TIMESTAMP '2024-01-02' GROUP BY session_id ORDER BY n DESC, session_id LIMIT 10",
)
