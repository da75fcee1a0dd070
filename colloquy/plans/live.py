"""Queries on follow-ups and incremental builds."""

import uuid

from pyspark.sql import functions as F

from ..operators import chat
from ..sources import store
from ..streaming import followups as fu
from ..streaming import incremental as inc
from ..streaming import stored
from . import register

c = F.col


def _lines(t, changed):
    text = F.concat(c("text"), F.when(changed, "!").otherwise(""))
    return t.v_messages.select(c("session_id").alias("path"), c("seq").alias("line_no"), text.alias("raw"))


def _plan(t):
    k = c("path").cast("long")
    stored = inc.fingerprints(_lines(t, c("session_id").cast("long") % 7 == 1).where(k % 10 != 0))
    return inc.plan_build(stored, inc.fingerprints(_lines(t, F.lit(False)).where(k % 13 != 5)))


register("p1_incremental_build", _plan, """
WITH s AS (SELECT DISTINCT session_id AS path, session_id::BIGINT AS k FROM v_messages)
SELECT path, CASE WHEN k % 13 = 5 THEN 'prune' WHEN k % 10 = 0 OR k % 7 = 1 THEN 'compute' ELSE 'skip' END AS action FROM s WHERE k % 10 <> 0 OR k % 13 <> 5""")


def _refresh(t):
    counts = lambda more: t.v_messages.groupBy(c("session_id").alias("path")).agg((F.count(F.lit(1)) + more).alias("messages"))
    k = c("path").cast("long")
    stored = counts(100).where(k % 10 != 0).withColumn("tag", F.concat(F.lit("t"), "path"))
    plan = _plan(t)
    todo = plan.where("action = 'compute'").select("path")
    computed = counts(0).join(todo, "path", "left_semi").where(k % 4 != 3)  # a quarter fails
    return inc.refresh(stored, plan, computed, ["tag"])


register(
    "p1_refresh", _refresh,
    """
WITH s AS (SELECT session_id AS path, session_id::BIGINT AS k, count(*) AS n FROM v_messages GROUP BY ALL), a AS (SELECT *, CASE WHEN k % 13 = 5 THEN 'prune' WHEN k % 10 = 0 OR k % 7 = 1 THEN 'compute' ELSE 'skip' END AS action FROM s)
SELECT path, CASE WHEN action = 'compute' AND k % 4 <> 3 THEN n ELSE n + 100 END AS messages, CASE WHEN k % 10 <> 0 THEN 't' || path END AS tag FROM a WHERE action <> 'prune' AND (k % 10 <> 0 OR k % 4 <> 3)""",
)


def _folder(t, name):
    return f"{store.shared_folder(t.spark)}/colloquy/{t.spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _rebuilt(t):
    """A stored table after two builds: of most sources, then of changed, new, failing and vanished ones."""
    k = c("path").cast("long")
    lines = lambda changed: _lines(t, changed).withColumn("agent", F.concat(F.lit("a"), k % 3))
    counts = lambda more: lambda rows: rows.groupBy("path").agg((F.count(F.lit(1)) + more).alias("messages"))
    table = stored.SessionTable(t.spark, _folder(t, "sessions"), "messages long", parts=16)
    table.build(lines(c("session_id").cast("long") % 7 == 1).where(k % 10 != 0), counts(100))
    table.build(lines(F.lit(False)).where(k % 13 != 5), lambda rows: counts(0)(rows).where(k % 4 != 3))  # a quarter fails
    return table.read().select("path", "agent", "messages")


register("p1_rebuild", _rebuilt, """
WITH s AS (SELECT session_id AS path, session_id::BIGINT AS k, count(*) AS n FROM v_messages GROUP BY ALL)
SELECT path, 'a' || (k % 3) AS agent, CASE WHEN (k % 10 = 0 OR k % 7 = 1) AND k % 4 <> 3 THEN n ELSE n + 100 END AS messages FROM s WHERE k % 13 <> 5 AND (k % 10 <> 0 OR k % 4 <> 3)""")


def _guarded(t):
    """A build of one agent, and one whose listing lost most of another agent's sources."""
    k = c("path").cast("long")
    lines = _lines(t, F.lit(False)).withColumn("agent", F.concat(F.lit("a"), k % 3))
    count = lambda rows: rows.groupBy("path").agg(F.count(F.lit(1)).alias("messages"))
    table = stored.SessionTable(t.spark, _folder(t, "sessions"), "messages long", parts=16)
    table.build(lines, count)
    table.build(lines.where((k % 3 != 0) | (k % 5 != 1)), count, agent="a0")
    table.build(lines.where(((k % 3 == 1) & (k % 5 == 1)) | ((k % 3 == 2) & (k % 5 != 2))), count)
    return table.read().select("path", "agent", "messages")


register("p2_guarded_rebuild", _guarded, """
WITH s AS (SELECT session_id AS path, session_id::BIGINT AS k, count(*) AS messages FROM v_messages GROUP BY ALL)
SELECT path, 'a' || (k % 3) AS agent, messages FROM s WHERE CASE k % 3 WHEN 0 THEN k % 5 <> 1 WHEN 2 THEN k % 5 <> 2 ELSE true END""")


def _told(t):
    """The second digest of the chats, after a first one of their older messages."""
    rows, told = t.v_chat.select("id", "chat_id", "sender", "ts"), []
    marks = stored.DigestMarks(t.spark, _folder(t, "marks"))
    marks.tell(rows.where("id < 120 AND (chat_id IS NULL OR chat_id <> 'src4')"), lambda digest: None)
    marks.tell(rows, told.append)
    return told[0]


register(
    "p10_stored_marks", _told,
    """
WITH m AS (SELECT chat_id, max(ts) AS mark FROM v_chat WHERE id < 120 AND (chat_id IS NULL OR chat_id <> 'src4') GROUP BY chat_id)
SELECT c.chat_id, count(*) AS messages, count(DISTINCT sender) AS senders, min(ts) AS first, max(ts) AS last FROM v_chat c LEFT JOIN m ON m.chat_id IS NOT DISTINCT FROM c.chat_id WHERE mark IS NULL OR ts > mark GROUP BY c.chat_id""",
)


def _sync(t):
    rows = t.v_chat.select("id", "chat_id", F.when(c("id") % 50 == 41, c("ts") - F.expr("INTERVAL '60' DAY")).otherwise(c("ts")).alias("ts"))
    return inc.append_above(rows.where("id < 200 AND chat_id <> 'src4'"), rows, "id", "chat_id", "ts")


register(
    "p3_high_water_sync", _sync,
    """
WITH r AS (SELECT id, chat_id, CASE WHEN id % 50 = 41 THEN ts - INTERVAL 60 DAY ELSE ts END AS ts FROM v_chat), m AS (SELECT chat_id, max(id) AS mark, max(ts) AS latest FROM r WHERE id < 200 AND chat_id <> 'src4' GROUP BY chat_id),
n AS (SELECT r.*, latest FROM r LEFT JOIN m ON r.chat_id IS NOT DISTINCT FROM m.chat_id AND m.chat_id IS NOT NULL WHERE mark IS NULL OR id > mark)
SELECT id, chat_id, ts, coalesce(ts >= greatest(latest, max(ts) OVER (PARTITION BY chat_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), true) AS in_order FROM n""",
)


def signal_events(t):
    """Signals of the chats, keyed by the opening of their texts, and decisions on some of them in the weeks after their first."""
    s = chat.signals(t.v_chat).join(t.v_chat.select("id", "text", F.unix_seconds(c("ts").cast("timestamp")).alias("ts")), "id")
    # a deal's hints are its deal words alone; a commitment has no others than its own
    own = F.filter(F.split("words", ","), lambda w: (c("kind") != "deal") | w.isin(*chat.DEAL))
    e = fu.events(s.withColumn("hints", F.size(own)), head=8)
    first = e.groupBy("key", "chat_id").agg(F.min("ts").alias("first"))
    number = F.regexp_extract("chat_id", "([0-9]+)$", 1).cast("int")
    names = F.array(*[F.lit(x) for x in _DECISIONS])
    n = F.explode(F.sequence(F.lit(1), number % 5)).alias("n")
    d = first.where("chat_id IS NOT NULL").where(number % 5 > 0).select("key", "first", number.alias("number"), n)
    made = d.select("key", (c("first") + c("n") * 200_000 + 1).alias("ts"), F.element_at(names, (((c("number") + c("n")) % len(_DECISIONS)) + 1).cast("int")).alias("decision"))
    return e.unionByName(fu.events(s.withColumn("hints", F.lit(0)).limit(0), made))


_DECISIONS = ("pursue", "lost", "wait", "bogus", "won", "ignore", "pause")
_AT = 1704067200 + 20 * 86400
_EVENTS = """
sig AS (SELECT DISTINCT chat_id, kind, chat_id || '|' || kind || '|' || substring(trim(text), 1, 8) AS key, substring(text, 1, 200) AS text, epoch(ts)::BIGINT AS ts, hints FROM (SELECT *, CASE WHEN d > 0 THEN 'deal' ELSE 'commitment' END AS kind, CASE WHEN d > 0 THEN d ELSE m END AS hints FROM (SELECT *, contains(lower(text), '预算')::INT + contains(lower(text), '报价')::INT + contains(lower(text), '合作')::INT + contains(lower(text), 'budget')::INT + contains(lower(text), 'quote')::INT + contains(lower(text), 'deal')::INT AS d,
contains(lower(text), '明天给你')::INT + contains(lower(text), '发你')::INT + contains(lower(text), 'will send')::INT + contains(lower(text), 'i''ll send')::INT AS m FROM v_chat) WHERE d + m > 0)),
fst AS (SELECT chat_id, kind, key, min(ts) AS first, regexp_extract(chat_id, '([0-9]+)$', 1)::INT AS number FROM sig WHERE chat_id IS NOT NULL GROUP BY ALL),
dec AS (SELECT chat_id, kind, key, first + n * 200000 + 1 AS ts, list_extract(""" + str(list(_DECISIONS)) + """, ((number + n) % 7 + 1)::INT) AS decision FROM (SELECT *, unnest(range(1, number % 5 + 1)) AS n FROM fst)),
ev AS (SELECT chat_id, kind, key, ts, hints, text, NULL AS decision FROM sig UNION ALL SELECT chat_id, kind, key, ts, 0, '', decision FROM dec WHERE decision <> 'bogus'),
o AS (SELECT *, count(*) FILTER (decision IS NULL) OVER w AS signals, coalesce(lag(decision) OVER w IN ('won', 'lost'), false) AS after_end, lag(ts) OVER w IS NULL AS none_before, last_value(decision IGNORE NULLS) OVER (PARTITION BY key ORDER BY ts, decision IS NOT NULL, text, decision ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS decided
  FROM ev WINDOW w AS (PARTITION BY key ORDER BY ts, decision IS NOT NULL, text, decision)),
b AS (SELECT *, (decision IS NULL AND (none_before OR after_end))::INT AS begins FROM o WHERE signals > 0),
r AS (SELECT *, sum(begins) OVER (PARTITION BY key ORDER BY ts, decision IS NOT NULL, text, decision) AS round, decision IS NULL AND (begins = 1 OR (row_number() OVER (PARTITION BY key, ts ORDER BY decision IS NOT NULL, text) = 1 AND coalesce(decided, '') <> 'ignore')) AS accepted FROM b),
i AS (SELECT key, chat_id, round, arg_max(decision, (ts, decision)) FILTER (decision IS NOT NULL) AS decision, max(hints) FILTER (accepted) AS hints, count(*) FILTER (accepted) AS n, max(ts) FILTER (accepted AND (decided IS NULL OR decided IN ('won', 'lost'))) + 1209600 AS expires FROM r GROUP BY ALL),
items AS (SELECT *, CASE decision WHEN 'pursue' THEN 'open' WHEN 'wait' THEN 'waiting' WHEN 'pause' THEN 'paused' WHEN 'ignore' THEN 'ignored' WHEN 'won' THEN 'won' WHEN 'lost' THEN 'lost' ELSE CASE WHEN expires <= """ + str(_AT) + """ THEN 'stale' ELSE 'new' END END AS status, CASE WHEN hints >= 2 THEN 'high' ELSE 'medium' END AS confidence, least(5, 2 + greatest(0, hints - 1)) AS priority FROM i)"""

register(
    "p5_followup_state",
    lambda t: (
        fu.follow_up(signal_events(t))
        .groupBy("chat_id", "round")
        .agg(F.count(F.lit(1)).alias("items"), F.sum("reinforcement").cast("long").alias("signals"), F.count_if(c("status") == "won").alias("won"))
    ),
    f"WITH {_EVENTS} SELECT chat_id, round, count(*) AS items, sum(n)::BIGINT AS signals, count(*) FILTER (status = 'won') AS "
    f"won FROM items GROUP BY chat_id, round",
)
register(
    "p6_expire_triage",
    lambda t: (
        fu.follow_up(signal_events(t), at=_AT)
        .groupBy("status", "confidence")
        .agg(F.count(F.lit(1)).alias("items"), F.max("priority").alias("priority"), F.sum("reinforcement").alias("signals"))
    ),
    f"WITH {_EVENTS} SELECT status, confidence, count(*) AS items, max(priority) AS priority, sum(n)::BIGINT AS signals FROM items "
    f"GROUP BY status, confidence",
)
register(
    "p6_feedback",
    lambda t: (
        fu.feedback(signal_events(t))
        .groupBy(F.split_part("target", F.lit(":"), F.lit(1)).alias("of"), "verdict", "note")
        .agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
    ),
    f"WITH {_EVENTS}, d AS (SELECT * FROM b WHERE decision IS NOT NULL) SELECT 'item' AS of, CASE decision WHEN 'ignore' THEN "
    f"'ignore' ELSE 'confirmed' END AS verdict, 'triage:' || decision AS note, count(*) AS n, max(ts) AS last FROM d WHERE decision "
    f"IN ('pursue', 'wait', 'won', 'ignore') GROUP BY decision UNION ALL SELECT 'chat', 'ignore', 'triage:ignore', count(*), max(ts) "
    f"FROM d WHERE decision = 'ignore' HAVING count(*) > 0",
)
register(
    "p6_purge",
    lambda t: (
        fu.purge(fu.follow_up(signal_events(t)), t.v_chat.where("sender = 's0'").select("chat_id")).groupBy("chat_id").agg(F.count(F.lit(1)).alias("items"))
    ),
    f"WITH {_EVENTS} SELECT chat_id, count(*) AS items FROM items WHERE chat_id IN (SELECT chat_id FROM v_chat WHERE sender = 's0') GROUP BY chat_id",
)
register(
    "p7_tier_ttl",
    lambda t: (
        fu.alive(
            t.documents.select(
                "doc_id", (F.lit(_AT) - c("doc_id") % 1000 * 1000).alias("ts"),
                F.element_at(F.array(F.lit("permanent"), F.lit("periodic"), F.lit("once"), F.lit(None)), (c("doc_id") % 4 + 1).cast("int")).alias("tier"),
            ),
            _AT,
        )
    ),
    f"SELECT * FROM (SELECT doc_id, {_AT} - doc_id % 1000 * 1000 AS ts, list_extract(['permanent', 'periodic', 'once', NULL], "
    f"(doc_id % 4 + 1)::INT) AS tier FROM documents) WHERE tier IS NULL OR tier = 'permanent' OR {_AT} - ts <= CASE tier WHEN "
    f"'periodic' THEN 604800 ELSE 86400 END",
)
