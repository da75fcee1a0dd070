"""Search queries."""

from pyspark.sql import functions as F

from ..operators import basics as ba
from ..operators import search as op
from ..operators.index import PhraseIndex
from ..sources import store
from . import register

_TOK = "regexp_extract_all(lower(coalesce(text, '')), '[\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}]|[A-Za-z0-9_]+')"

ERROR_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{'|'.join(p)}') THEN '{k}'" for k, p in ba.ERROR_CLASSES.items()) + " ELSE 'UNKNOWN' END"


def _chat(t):
    return t.v_chat.select("id", "chat_id", "sender", "ts", "text")


def _index(t, rows, table: str, key: str, kept: dict[str, str], parts: int = 1):
    """The stored index of a view over a table, built when the table's files are new to this application; in `parts` batches."""
    where = f"{store.shared_folder(t.spark)}/colloquy/{t.spark.sparkContext.applicationId}/index-{table}-{key}-{parts}-{store.version_of(getattr(t, table))}"
    index = PhraseIndex(t.spark, where, key, kept)
    if index.batches().isEmpty():
        for i in range(parts - 1, -1, -1):  # each batch holds what the ones before left out
            index.append(rows.where(F.col(key) % parts >= i))
    return index


def _chat_index(t, parts: int = 1):
    return _index(t, t.v_chat, "documents", "id", {"chat_id": "string", "sender": "string"}, parts)


def turns(t):
    """Messages by one number each, with what a tool said told apart."""
    said = F.when(F.col("role") == "SYSTEM", "TOOL").otherwise(F.col("role"))
    return t.v_messages.select((F.col("session_id").cast("long") * 100_000 + F.col("seq")).alias("id"), "session_id", "seq", said.alias("role"), "text")


def turn_index(t):
    return _index(t, turns(t), "conversations", "id", {"session_id": "string", "role": "string"})


_TURNS = "m AS (SELECT session_id::BIGINT * 100000 + seq AS id, session_id, seq, CASE role WHEN 'SYSTEM' THEN 'TOOL' ELSE role END AS role, text FROM v_messages)"


def turn_hits(words: list[str]) -> str:
    test = " AND ".join(f"terms[i + {k}] = '{w}'" for k, w in enumerate(words))
    return (
        f"{_TURNS}, d AS (SELECT id, session_id, role, {_TOK} AS terms FROM m), h AS (SELECT id, session_id, role, len(terms) AS len, "
        f"tf FROM (SELECT *, len(list_filter(range(1, len(terms) - {len(words)} + 2), lambda i: {test})) AS tf FROM d) WHERE tf > "
        f"0)"
    )


_FIGURES = "s AS (SELECT count(*) AS N, avg(len(terms)) AS a FROM d)"


def _phrase(words: list[str]) -> str:
    """CTEs d (rows with tokens) and h (hits of the phrase)."""
    n = len(words)
    test = " AND ".join(f"terms[i + {k}] = '{w}'" for k, w in enumerate(words))
    return (
        f"d AS (SELECT id, chat_id, ts, {_TOK} AS terms FROM v_chat), h AS (SELECT id, chat_id, ts, len(terms) AS len, tf FROM (SELECT "
        f"*, len(list_filter(range(1, len(terms) - {n} + 2), lambda i: {test})) AS tf FROM d) WHERE tf > 0)"
    )


_BM25 = "greatest(ln((N - n + 0.5) / (n + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))"
_SCORE = _BM25.replace("(n + ", "(c.n + ").replace("N - n", "s.N - c.n")
register(
    "s2_tokenize",
    lambda t: _chat(t).select(F.explode(op.tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")),
    f"SELECT term, count(*) AS n FROM (SELECT unnest({_TOK}) AS term FROM v_chat) GROUP BY term",
)
register("s1_split_cjk", lambda t: _chat(t).select("id", op.split_cjk(F.col("text")).alias("spaced"), op.join_cjk(op.split_cjk(F.col("text"))).alias("shown")))
register(
    "s3_prepare_queries",
    lambda t: op.prepare_queries(t.benchmark.select("item_id", "text")).select("item_id", F.size("terms").alias("n_terms"), "reason", "prefix"),
    f"SELECT item_id, len(terms) AS n_terms, CASE WHEN len(terms) = 0 THEN 'no_terms' WHEN len(terms) > 12 THEN 'too_many_terms' "
    f"END AS reason, len(terms) = 1 AND regexp_matches(coalesce(terms[1], ''), '^[a-z0-9_]+$') AS prefix FROM (SELECT item_id, "
    f"{_TOK} AS terms FROM benchmark)",
)
register(
    "s4_fts_search", lambda t: _chat_index(t).search("数据库迁移", 20).select(F.col("key").alias("id"), "tf", "score"),
    f"WITH {_phrase(list('数据库迁移'))}, {_FIGURES}, c AS (SELECT count(*) AS n FROM h) SELECT id, tf, round({_SCORE}, 6) AS score "
    f"FROM h, s, c ORDER BY score DESC, id LIMIT 20",
)
register(
    "s4_appended",
    lambda t: _chat_index(t, 3).search("timed out", 0).select(F.col("key").alias("id"), "tf", "score"),
    f"WITH {_phrase(['timed', 'out'])}, {_FIGURES}, c AS (SELECT count(*) AS n FROM h) SELECT id, tf, round({_SCORE}, 6) AS score FROM h, s, c",
)
register(
    "s4_without_tools",
    lambda t: turn_index(t).search("use the", 20, "role <> 'TOOL'").select(F.col("key").alias("id"), "tf", "score"),
    f"WITH {turn_hits(['use', 'the'])}, {_FIGURES}, k AS (SELECT * FROM h WHERE role <> 'TOOL'), c AS (SELECT count(*) AS n FROM "
    f"k) SELECT id, tf, round({_SCORE}, 6) AS score FROM k, s, c ORDER BY score DESC, id LIMIT 20",
)
register(
    "s5_session_search", lambda t: _chat_index(t).groups("deadline exceeded", "chat_id").select("chat_id", "score"),
    f"WITH {_phrase(['deadline', 'exceeded'])}, {_FIGURES}, c AS (SELECT count(*) AS n FROM h) SELECT chat_id, round(max({_SCORE}), "
    f"6) AS score FROM h, s, c GROUP BY chat_id ORDER BY score DESC, chat_id LIMIT 10",
)
register(
    "s5_scoped",
    lambda t: _chat_index(t).groups("please fix", "chat_id", 5, "chat_id >= 'src12' AND sender IN ('s1', 's3', 's5')"),
    f"WITH {_phrase(['please', 'fix'])}, {_FIGURES}, k AS (SELECT h.* FROM h JOIN v_chat c ON c.id = h.id WHERE c.chat_id >= 'src12' "
    f"AND sender IN ('s1', 's3', 's5')), c AS (SELECT count(*) AS n FROM k) SELECT chat_id, round(max({_SCORE}), 6) AS score, "
    f"count(*) AS hits FROM k, s, c GROUP BY chat_id ORDER BY score DESC, chat_id LIMIT 5",
)
register("s9_deep_contains", lambda t: t.documents.where(op.holds(F.col("text"), "apache license")).select("doc_id"), "SELECT doc_id FROM documents WHERE contains(lower(text), 'apache license')")
register(
    "s10_collapse_identical", lambda t: op.collapse_identical(t.documents, "doc_id").select("doc_id", "copies"),
    "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY coalesce(text, '')",
)
register(
    "s11_chat_search",
    lambda t: op.page_with_total(_chat(t).where(F.contains("text", F.lit("timed out"))).select("id", "ts"), [F.desc("ts"), F.asc("id")], 10),
    "SELECT id, ts, total, total > 10 AS has_more FROM (SELECT id, ts, count(*) OVER () AS total FROM v_chat WHERE contains(text, "
    "'timed out')) ORDER BY ts DESC, id LIMIT 10",
)
register(
    "s12_group_hits", lambda t: op.group_hits(_chat(t).where(F.contains("text", F.lit("预算"))), "chat_id", "ts"),
    "SELECT chat_id, count(*) AS hits, min(ts) AS first, max(ts) AS last FROM v_chat WHERE contains(text, '预算') GROUP BY chat_id "
    "ORDER BY hits DESC, chat_id LIMIT 10",
)
register(
    "s13_suggestions", lambda t: _chat_index(t).completions("pre"),
    f"SELECT term, count(DISTINCT id) AS df FROM (SELECT id, unnest({_TOK}) AS term FROM v_chat) WHERE starts_with(term, 'pre') "
    f"GROUP BY term ORDER BY df DESC, term LIMIT 10",
)
register(
    "s14_recent",
    lambda t: op.newest(t.v_messages.select("session_id", "seq", "ts"), ["ts", "session_id", "seq"], 25),
    "SELECT session_id, seq, ts FROM v_messages ORDER BY ts DESC, session_id DESC, seq DESC LIMIT 25",
)
register(
    "s20_paged_search",
    lambda t: (
        op.newest(_chat(t).where(F.contains("text", F.lit("please")) & (F.col("chat_id") >= "src1")).select("id", "chat_id", "ts"), ["ts", "id"], 10, 5)
    ),
    "SELECT id, chat_id, ts FROM v_chat WHERE contains(text, 'please') AND chat_id >= 'src1' ORDER BY ts DESC, id DESC LIMIT 10 OFFSET 5",
)
register(
    "s19_inventory_match", lambda t: op.inventory_match(t.part, "small ring", "p_name"),
    "SELECT p_name, max(score) AS score FROM (SELECT p_name, round(CASE WHEN lower(p_name) = 'small ring' THEN 1.0 ELSE least(0.99, "
    "len(list_intersect(w, ['small', 'ring'])) / len(list_distinct(list_concat(w, ['small', 'ring']))) + CASE WHEN contains(lower(p_name), "
    "'small ring') THEN 0.3 ELSE 0 END) END, 4)::DOUBLE AS score FROM (SELECT p_name, list_distinct(regexp_extract_all(lower(p_name), "
    "'[a-z0-9_]+')) AS w FROM part)) WHERE score >= 0.28 GROUP BY p_name",
)
register(
    "c2_hit_sessions",
    lambda t: (
        _chat_index(t).hits("rate limit")
        .join(t.v_chat.select(F.col("id").alias("key"), "chat_name"), "key", "left")
        .select(F.col("key").alias("id"), "chat_id", "chat_name", "sender", "tf")
    ),
    f"WITH {_phrase(['rate', 'limit'])} SELECT h.id, h.chat_id, chat_name, sender, tf FROM h JOIN v_chat c ON c.id = h.id",
)
register("c3_facet_counts", lambda t: _chat_index(t).facets("https", "chat_id"), f"WITH {_phrase(['https'])} SELECT chat_id, count(*) AS hits FROM h GROUP BY chat_id")
register("c3_roles", lambda t: turn_index(t).facets("parquet", "role"), f"WITH {turn_hits(['parquet'])} SELECT role, count(*) AS hits FROM h GROUP BY role")
register(
    "c7_exists_filter",
    lambda t: (
        ba.where_any(_chat(t).where(F.contains("text", F.lit("ok"))), _chat(t).where("sender = 's3'"), "chat_id")
        .groupBy()
        .agg(F.count(F.lit(1)).alias("hits"))
    ),
    "SELECT count(*) AS hits FROM v_chat WHERE contains(text, 'ok') AND chat_id IN (SELECT chat_id FROM v_chat WHERE sender = 's3')",
)
register(
    "c21_changed_rows",
    lambda t: (
        ba.changed_rows(
            t.documents,
            t.documents.where("doc_id % 3 <> 0")
            .select("doc_id", F.md5(F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 5 == 0, "old").otherwise(""))).alias("hash")),
            "doc_id", "text",
        )
    ),
    "WITH seen AS (SELECT doc_id, md5(coalesce(text, '') || CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE '' END) AS hash FROM documents "
    "WHERE doc_id % 3 <> 0) SELECT doc_id, md5(coalesce(text, '')) AS hash FROM documents d WHERE NOT EXISTS (SELECT 1 FROM seen "
    "WHERE seen.doc_id = d.doc_id AND seen.hash = md5(coalesce(d.text, '')))",
)
register(
    "u1_classify_error",
    lambda t: _chat(t).groupBy(ba.classify_error(F.col("text")).alias("kind")).agg(F.count(F.lit(1)).alias("n")),
    f"SELECT {ERROR_SQL} AS kind, count(*) AS n FROM v_chat GROUP BY 1",
)
register(
    "h4_tech_debt",
    lambda t: (
        _chat(t).select("id", F.posexplode(F.split("text", "\n")).alias("line", "code"))
        .select("id", "line", F.regexp_extract("code", r"\b(TODO|FIXME|HACK|XXX)\b", 1).alias("tag"))
        .where("tag <> ''")
    ),
    "SELECT id, line - 1 AS line, regexp_extract(code, '\\b(TODO|FIXME|HACK|XXX)\\b', 1) AS tag FROM (SELECT id, unnest(string_split(text, "
    "chr(10))) AS code, generate_subscripts(string_split(text, chr(10)), 1)::INT AS line FROM v_chat) WHERE regexp_matches(code, "
    "'\\b(TODO|FIXME|HACK|XXX)\\b')",
)
register(
    "f21_retrieval_metrics", lambda t: op.passage_recall(t.benchmark, t.documents),
    "WITH q AS (SELECT item_id, array_to_string(regexp_extract_all(text, '[^ \t\n]+')[1:8], ' ') AS passage FROM benchmark), "
    "d AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n]+') AS w FROM documents), x AS (SELECT doc_id, unnest(list_transform(range(1, "
    "len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS passage FROM d), f AS (SELECT DISTINCT item_id, doc_id FROM "
    "q JOIN x USING (passage)) SELECT (SELECT count(*) FROM benchmark) AS queries, count(DISTINCT item_id) AS found, count(DISTINCT "
    "doc_id) AS docs, round(count(DISTINCT item_id) / (SELECT count(*) FROM benchmark), 4) AS recall FROM f",
)
