"""Queries on chats."""

from pyspark.sql import functions as F

from ..operators import basics as ba
from ..operators import chat as op, search
from . import register
from .search import _TOK


def _has(words, column="lower(text)"):
    return [f"contains({column}, '{w}')" for w in words]


register(
    "g1_speaker_ranking", lambda t: op.speaker_ranking(t.v_chat),
    "WITH b AS (SELECT sender, count(*) AS messages, sum(length(text))::BIGINT AS chars, round(avg(length(text)), 4) AS mean_length "
    "FROM v_chat GROUP BY sender) SELECT *, round(messages / sum(messages) OVER (), 4) AS share, row_number() OVER (ORDER BY "
    "messages DESC, sender)::INT AS rank FROM b",
)
register(
    "g2_keywords",
    lambda t: (
        t.v_chat.select(F.explode(search.tokens(F.col("text"))).alias("term"))
        .where((F.length("term") >= 2) & ~F.col("term").rlike("^[0-9]+$"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "term")
        .limit(30)
    ),
    "SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[A-Za-z0-9_]+')) AS term FROM v_chat) WHERE "
    "length(term) >= 2 AND NOT regexp_matches(term, '^[0-9]+$') GROUP BY term ORDER BY n DESC, term LIMIT 30",
)
register(
    "g4_heatmap", lambda t: op.heatmap(t.events, "ts"),
    "SELECT hour(ts)::INT AS hour, (isodow(ts) - 1)::INT AS weekday, count(*) AS n FROM events GROUP BY GROUPING SETS ((hour(ts)), (isodow(ts) - 1))",
)
register(
    "c10_mention_edges",
    lambda t: op.mention_edges(t.v_chat).groupBy("src", "dst").count().withColumnRenamed("count", "n"),
    "SELECT src, dst, count(*) AS n FROM (SELECT sender AS src, unnest(regexp_extract_all(text, '@([A-Za-z0-9_]+)', 1)) AS dst "
    "FROM v_chat) WHERE dst IN (SELECT sender FROM v_chat) GROUP BY ALL",
)
register(
    "c11_reply_edges",
    lambda t: op.reply_edges(t.v_chat).groupBy("src", "dst").count().withColumnRenamed("count", "n"),
    "SELECT a.sender AS src, b.sender AS dst, count(*) AS n FROM v_chat a JOIN v_chat b ON a.reply_to = b.id GROUP BY ALL",
)
_CO = (
    "(SELECT a.sender AS src, b.sender AS dst, 'co_occurrence' AS type FROM o a JOIN o b ON a.chat_id = b.chat_id AND b.k BETWEEN "
    "a.k + 1 AND a.k + 5 AND a.sender <> b.sender AND epoch(b.ts) - epoch(a.ts) <= 90000)"
)
_O = "o AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY ts, id) AS k FROM v_chat)"
register(
    "c12_cooccurrence_edges",
    lambda t: op.cooccurrence_edges(t.v_chat, within=90000).groupBy("src", "dst").count().withColumnRenamed("count", "n"),
    f"WITH {_O} SELECT src, dst, count(*) AS n FROM {_CO} GROUP BY ALL",
)
register(
    "g7_relation_graph", lambda t: op.relation_graph(t.v_chat, within=90000),
    f"WITH {_O}, e AS (SELECT src, dst, type FROM {_CO} UNION ALL SELECT a.sender, b.sender, 'reply' FROM v_chat a JOIN v_chat "
    f"b ON a.reply_to = b.id UNION ALL SELECT src, dst, 'mention' FROM (SELECT sender AS src, unnest(regexp_extract_all(text, "
    f"'@([A-Za-z0-9_]+)', 1)) AS dst FROM v_chat) WHERE dst IN (SELECT sender FROM v_chat)) SELECT src, dst, count(*) AS weight, "
    f"string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM e WHERE src <> dst GROUP BY ALL HAVING count(*) >= 2",
)
_SCORE = " + ".join(f"({h})::INT" for h in _has(op.POSITIVE)) + " - " + " - ".join(f"({h})::INT" for h in _has(op.NEGATIVE)) + " + " + " + ".join(f"(contains(lower(text), 'not {w}') OR contains(lower(text), 'don''t {w}'))::INT" for w in (*op.POSITIVE[:5], *op.NEGATIVE[:5]))
register(
    "g8_sentiment", lambda t: op.sentiment(t.v_chat),
    f"SELECT ts::DATE AS day, CASE WHEN s > 0 THEN 'positive' WHEN s < 0 THEN 'negative' ELSE 'neutral' END AS label, count(*) "
    f"AS n FROM (SELECT ts, {_SCORE} AS s FROM v_chat) GROUP BY ALL",
)
_D, _C = (", ".join(f"CASE WHEN {h} THEN '{w}' END" for h, w in zip(_has(ws), ws)) for ws in (op.DEAL, [w.replace("'", "''") for w in op.COMMIT]))
register(
    "g11_signals", lambda t: op.signals(t.v_chat),
    f"WITH s AS (SELECT id, chat_id, list_filter([{_D}], lambda x: x IS NOT NULL) AS d, list_filter([{_C}], lambda x: x IS NOT "
    f"NULL) AS c FROM v_chat) SELECT id, chat_id, CASE WHEN len(d) > 0 THEN 'deal' ELSE 'commitment' END AS kind, array_to_string(list_concat(d, "
    f"c), ',') AS words, CASE WHEN len(d) + len(c) >= 2 THEN 'high' ELSE 'medium' END AS confidence FROM s WHERE len(d) + len(c) "
    f"> 0",
)
register(
    "g12_trend_series", lambda t: op.trend_series(t.v_chat),
    f"""
WITH m AS (SELECT strftime(ts, '%Y-%m') AS month, sender, text, {_SCORE} AS s FROM v_chat),
c AS (SELECT month, term, count(*) AS n FROM (SELECT month, unnest({_TOK}) AS term FROM m) WHERE length(term) >= 2 GROUP BY ALL),
k AS (SELECT month, term, row_number() OVER (PARTITION BY month ORDER BY n DESC, term) AS k FROM c QUALIFY k <= 3),
t AS (SELECT month, string_agg(term, ',' ORDER BY k) AS terms FROM k GROUP BY month),
b AS (SELECT month, count(*) AS messages, count(DISTINCT sender) AS active, count(*) FILTER (s > 0) - count(*) FILTER (s < 0) AS net FROM m GROUP BY month)
SELECT * FROM b LEFT JOIN t USING (month)""",
)
register(
    "g14_chat_quality", lambda t: op.chat_quality(t.v_chat),
    r"""
WITH r AS (SELECT *, lower(regexp_replace(regexp_replace(text, 'https?://[^\s]+', '<url>', 'g'), '[0-9]+', '#', 'g')) AS norm, regexp_matches(text, 'https?://[^\s]+') AS link, regexp_matches(text, '[?？]') AS ask FROM v_chat),
x AS (SELECT norm FROM r GROUP BY norm HAVING count(DISTINCT chat_id) >= 3), top AS (SELECT chat_id, max(c) AS top FROM (SELECT chat_id, count(*) AS c FROM v_chat GROUP BY chat_id, sender) GROUP BY chat_id),
s AS (SELECT chat_id, any_value(chat_name) AS name, count(*) AS n, avg(link::INT) AS links, avg(ask::INT) AS asks, count(*) FILTER (norm IN (SELECT norm FROM x)) AS copied FROM r GROUP BY chat_id),
k AS (SELECT chat_id, n, links, CASE WHEN regexp_matches(name, '优惠|红包|福利|返利') THEN 30 ELSE 0 END + CASE WHEN top / n >= 0.8 THEN 20 ELSE 0 END + CASE WHEN links >= 0.5 THEN 20 ELSE 0 END + CASE WHEN copied / n >= 0.3 THEN 15 ELSE 0 END + CASE WHEN asks < 0.05 THEN 15 ELSE 0 END AS score FROM s JOIN top USING (chat_id))
SELECT chat_id, n, round(links, 4) AS links, score, CASE WHEN score >= 60 THEN 'noise' WHEN score >= 40 THEN 'low' ELSE 'normal' END AS level FROM k""",
)
register(
    "c8_exclude_noise",
    lambda t: (
        t.v_chat.join(op.chat_quality(t.v_chat).where("level <> 'normal'").select("chat_id"), "chat_id", "left_anti")
        .groupBy("chat_id")
        .count()
        .withColumnRenamed("count", "n")
    ),
    "SELECT chat_id, count(*) AS n FROM v_chat WHERE chat_id NOT IN ('src0', 'src1', 'src2') GROUP BY chat_id",
)
register(
    "g16_chat_stats",
    lambda t: op.chat_stats(t.v_chat.withColumn("kind", ba.message_kind(F.col("id").bitwiseAND(F.lit(0xFFFF)) % 50))),
    """
WITH m AS (SELECT CASE (id & 65535) % 50 WHEN 1 THEN 'text' WHEN 3 THEN 'image' WHEN 34 THEN 'voice' WHEN 43 THEN 'video' WHEN 47 THEN 'sticker' WHEN 49 THEN 'link' ELSE 'other' END AS kind, sender, hour(ts)::VARCHAR AS hour FROM v_chat),
s AS (SELECT sender, count(*) AS n FROM m GROUP BY sender ORDER BY n DESC, sender LIMIT 10)
SELECT 'all' AS of, NULL::VARCHAR AS name, count(*) AS n FROM m UNION ALL SELECT 'kind', kind, count(*) FROM m GROUP BY kind
UNION ALL SELECT 'hour', hour, count(*) FROM m GROUP BY hour UNION ALL SELECT 'sender', sender, n FROM s""",
)
register(
    "g17_digest_stats",
    lambda t: (
        t.v_chat.groupBy("sender").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last")).where("n >= 3").orderBy(F.desc("n"), "sender").limit(10)
    ),
    "SELECT sender, count(*) AS n, max(ts) AS last FROM v_chat GROUP BY sender HAVING count(*) >= 3 ORDER BY n DESC, sender LIMIT 10",
)


def _read(t):
    """Until when some chats were read."""
    return t.v_chat.where("id % 7 < 3 AND id < 300 AND chat_id <> 'src5'").select("chat_id", F.col("ts").alias("read_ts"))


def _listed(t):
    """Members of some chats, some of whom never spoke."""
    n = (F.col("id") + 1) % 12
    return t.v_chat.where("chat_id < 'src3'").select("chat_id", F.concat(F.lit("s"), n).alias("member"), (n == 4).alias("is_owner"))


_READ = "SELECT chat_id, max(ts) AS read_ts FROM v_chat WHERE id % 7 < 3 AND id < 300 AND chat_id <> 'src5' GROUP BY chat_id"
register(
    "g18_chat_list", lambda t: op.chat_list(t.v_chat, _read(t)),
    f"""
WITH r AS ({_READ})
SELECT c.chat_id, count(DISTINCT sender) AS senders, count(*) FILTER (read_ts IS NULL OR ts > read_ts) AS unread, max(ts) AS last, arg_max(sender, (ts, id)) AS sender, substring(arg_max(text, (ts, id)), 1, 40) AS opening
FROM v_chat c LEFT JOIN r USING (chat_id) GROUP BY c.chat_id""",
)
register(
    "g18_unread", lambda t: op.chat_list(t.v_chat.where("id < 320"), _read(t), only_unread=True).select("chat_id", "unread"),
    f"WITH r AS ({_READ}) SELECT chat_id, count(*) AS unread FROM v_chat LEFT JOIN r USING (chat_id) WHERE id < 320 AND (read_ts IS NULL OR ts > read_ts) GROUP BY chat_id",
)
_LISTED = "SELECT DISTINCT chat_id, 's' || ((id + 1) % 12) AS member, (id + 1) % 12 = 4 AS is_owner FROM v_chat WHERE chat_id < 'src3'"
register(
    "g18_members", lambda t: op.members(t.v_chat, _listed(t)),
    f"""
WITH l AS ({_LISTED}), s AS (SELECT chat_id, sender AS member, count(*) AS messages FROM v_chat GROUP BY ALL)
SELECT chat_id, member, is_owner, coalesce(messages, 0) AS messages FROM l LEFT JOIN s USING (chat_id, member)
UNION ALL SELECT chat_id, member, false, messages FROM s WHERE chat_id NOT IN (SELECT chat_id FROM l)""",
)
register(
    "w10_reactivations", lambda t: op.reactivations(t.v_chat, "2024-02-10", 20),
    "SELECT chat_id, max(ts) AS last, arg_max(sender, (ts, id)) AS sender, (DATE '2024-02-10' - max(ts)::DATE)::INT AS idle_days "
    "FROM v_chat GROUP BY chat_id HAVING (DATE '2024-02-10' - max(ts)::DATE) >= 20 ORDER BY idle_days DESC, chat_id LIMIT 20",
)
register(
    "w11_mine_context", lambda t: op.mine_context(t.v_chat, "s3"),
    "SELECT id, chat_id, sender = 's3' AS mine FROM (SELECT *, max((sender = 's3')::INT) OVER (PARTITION BY chat_id ORDER BY "
    "ts, id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM v_chat) WHERE near = 1",
)
register(
    "c5_name_lookup",
    lambda t: (
        t.v_chat.select("id", F.regexp_extract("sender", "[0-9]+", 0).cast("long").alias("key"), "sender")
        .join(F.broadcast(t.customer.where("c_custkey < 5").select(F.col("c_custkey").alias("key"), "c_name")), "key", "left")
        .select("id", F.coalesce("c_name", F.concat(F.lit("u:"), "sender")).alias("name"))
    ),
    "SELECT id, coalesce(c_name, 'u:' || sender) AS name FROM v_chat LEFT JOIN customer ON c_custkey < 5 AND c_custkey = regexp_extract(sender, "
    "'[0-9]+')::BIGINT",
)
register(
    "c15_latest_verdict",
    lambda t: (
        ba.latest_verdicts(
            t.events.select((F.col("user_id") % 40).alias("target"), F.col("event_type").alias("verdict"), "ts", F.col("event_id").alias("id")),
            t.nation.select((F.col("n_nationkey") * 2).cast("long").alias("target"), "n_name"),
        )
    ),
    "SELECT n_nationkey * 2 AS target, n_name, verdict FROM nation LEFT JOIN (SELECT user_id % 40 AS target, arg_max(event_type, "
    "(ts, event_id)) AS verdict FROM events GROUP BY 1) v ON v.target = n_nationkey * 2",
)
register(
    "a18_upsert_messages",
    lambda t: (
        ba.upsert(
            t.v_chat.where("id % 4 <> 0").select("id", F.md5(F.concat("text", F.when(F.col("id") % 6 == 1, "old").otherwise(""))).alias("hash")),
            t.v_chat.where("id % 5 <> 0"), "id", "text",
        )
    ),
    "WITH o AS (SELECT id, md5(text || CASE WHEN id % 6 = 1 THEN 'old' ELSE '' END) AS hash FROM v_chat WHERE id % 4 <> 0), n "
    "AS (SELECT id, md5(text) AS new FROM v_chat WHERE id % 5 <> 0) SELECT id, coalesce(new, hash) AS hash, CASE WHEN new IS "
    "NULL THEN 'kept' WHEN hash IS NULL THEN 'inserted' WHEN hash = new THEN 'skipped' ELSE 'replaced' END AS change FROM o FULL "
    "JOIN n USING (id)",
)
register(
    "a12_field_coverage",
    lambda t: (
        t.v_chat.select(
            F.explode(
                F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).isNotNull().cast("int").alias("there")) for c in ("id", "chat_id", "sender", "reply_to")]),
            )
            .alias("f"),
        )
        .groupBy("f.field")
        .agg(F.sum("f.there").alias("resolved"), F.round(1 - F.avg("f.there"), 4).alias("miss_rate"))
    ),
    " UNION ALL ".join(f"SELECT '{c}' AS field, count({c}) AS resolved, round(1 - count({c}) / count(*), 4) AS miss_rate FROM v_chat" for c in ("id", "chat_id", "sender", "reply_to")),
)
