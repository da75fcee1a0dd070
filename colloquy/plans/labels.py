"""Queries on labels and matches."""

from pyspark.sql import functions as F

from ..operators import basics as ba
from ..operators import labels as op
from ..operators import search
from ..operators.chat import DECISION
from ..sources import chats as ch
from . import register
from . import search as plans_search
from .sources import _pages

c = F.col


def _of(key: str, *values: str):
    return F.element_at(F.array(*map(F.lit, values)), (c(key) % len(values) + 1).cast("int"))


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_MODELS = ("openrouter/LongCat-2.0:free", "longcat 2.5 preview", "mimo-v2.6-pro", "glm 5.2[1m]", "claude", "{'modelId': 'gpt-5.5'}", "0a1b2c3d-1111-2222", "deepseek v4 flash", "http://x/y", "mimo")
_NAMES = ("LongCat-2.0", "LongCat-2.5-Preview", "MiMo-v2.6-Pro", "GLM-5.2", "", "gpt-5.5", "", "deepseek-v4-flash", "http://x/y", "mimo")
register(
    "b9_normalize_model",
    lambda t: t.lineitem.groupBy(op.model_name(_of("l_orderkey", *_MODELS)).alias("model")).agg(F.count(F.lit(1)).alias("n")),
    f"SELECT nullif(list_extract({_list(_NAMES)}, (l_orderkey % 10 + 1)::INT), '') AS model, count(*) AS n FROM lineitem GROUP BY 1",
)
_PATHS = ("/p/x.jsonl", "/p/subagents/x.jsonl", "/k/agents/main/wire.jsonl", "/k/agents/agent-0/wire.jsonl", "/other")
register("b11_classify_role", lambda t: t.v_tree.select("id", op.session_role(_of("id", "claude", "kimi"), c("id").cast("string"), _of("id", *_PATHS), c("parent")).alias("role")), f"""
SELECT id, CASE WHEN parent IS NOT NULL OR id % 5 IN (1, 3) THEN 'subagent' WHEN id % 5 = 2 OR (id % 5 = 0 AND id % 2 = 0) THEN 'main' ELSE 'unknown' END AS role FROM v_tree""")
_PROJ = ("/home/me/foo/a", "/x/-home-me-foo/b", "/x/-home-me-foo-baz/b", "/y/%2Fhome%2Fme%2Ffoo", "/y/%2Fhome%2Fme%2Ffoobar", "https://h/home/me/foo/a", "/z/foo/q", "/home/me/foo")
register(
    "b12_in_project",
    lambda t: (
        t.pages.select(
            "page_id", op.in_project(_of("page_id", *_PROJ), "/home/me/foo").alias("inside"),
            op.in_project(_of("page_id", *_PROJ), "/home/me/src").alias("general"),
        )
    ),
    "SELECT page_id, page_id % 8 IN (0, 1, 3, 6, 7) AS inside, false AS general FROM pages",
)
register(
    "b15_redact",
    lambda t: (
        t.pages.select(
            "page_id",
            op.redact_path(F.concat(_of("page_id", "/Users/ann/", "/x/-Users-ann-doc/", "/x/%2Fhome%2Fann%2F", "/opt/"), c("page_id").cast("string")))
            .alias("path"),
        )
    ),
    "SELECT page_id, list_extract(['/Users/<user>/', '/x/-Users-<user>-doc/', '/x/%2Fhome%2F<user>%2F', '/opt/'], (page_id % "
    "4 + 1)::INT) || page_id AS path FROM pages",
)
_SEPS = ("。", "？", "！", "；", "? ", "! ", "; ", ". ", "，", ", ")
_CUTS = ", ".join(f"CASE WHEN instr(s, '{x}') - 1 BETWEEN 6 AND 42 THEN substring(s, 1, instr(s, '{x}') - 1) END" for x in _SEPS)
register(
    "b16_headline", lambda t: t.v_chat.select("id", op.headline(F.col("text")).alias("label")),
    rf"""
WITH a AS (SELECT id, trim(regexp_replace(regexp_replace(text, 'https?://\S+', '', 'g'), '\s+', ' ', 'g')) AS s FROM v_chat), b AS (SELECT id, regexp_replace(regexp_replace(s, '^#{{1,6}}\s*', ''), '^[-*0-9]+[.)]\s*', '') AS s FROM a),
l AS (SELECT id, CASE WHEN length(s) <= 42 THEN s ELSE coalesce({_CUTS}, substring(s, 1, 42) || '…') END AS label FROM b)
SELECT id, CASE WHEN length(label) >= 4 AND regexp_matches(label, '[A-Za-z]{{3,}}|[\x{{4E00}}-\x{{9FFF}}]{{2,}}') THEN label END AS label FROM l""",
)
register(
    "b17_family_and_kind",
    lambda t: (
        t.events.groupBy(
            op.agent_family(_of("user_id", "kimi_code", "DIM", "qoder", "Codex")).alias("family"),
            op.chat_kind(_of("event_id", "a@chatroom", "gh_1", "b@openim", "wxid_wi_2", "wxid_3")).alias("kind"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    ),
    "SELECT list_extract(['kimi', 'dim', 'other', 'codex'], (user_id % 4 + 1)::INT) AS family, list_extract(['group', 'official', "
    "'openim', 'wework', 'single'], (event_id % 5 + 1)::INT) AS kind, count(*) AS n FROM events GROUP BY ALL",
)
register(
    "c20_best_skill",
    lambda t: (
        op.best_skills(
            t.part.select(c("p_partkey").alias("pattern_id"), F.split(F.lower("p_name"), "[^a-z0-9]+").alias("keywords")),
            t.part.select(c("p_type").alias("name"), F.lit("goldenrod tool").alias("description"))
            .distinct()
            .unionByName(t.part.groupBy(c("p_brand").alias("name")).agg(F.min("p_name").alias("description"))),
        )
    ),
    """
WITH p AS (SELECT p_partkey, unnest(list_distinct(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'))) AS word FROM part), k AS (SELECT DISTINCT p_type AS name, p_type || ' goldenrod tool' AS t FROM part UNION SELECT p_brand, p_brand || ' ' || min(p_name) FROM part GROUP BY p_brand),
s AS (SELECT DISTINCT name AS skill, word FROM (SELECT name, t, unnest(regexp_split_to_array(lower(t), '[^a-z0-9]+')) AS word FROM k)), n AS (SELECT p_partkey, skill, count(*) AS score FROM p JOIN s USING (word) GROUP BY ALL)
SELECT p_partkey AS pattern_id, skill, score FROM n QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, skill) = 1""",
)
register(
    "d23_files_changed",
    lambda t: (
        op.files_changed(
            t.lineitem.groupBy(c("l_orderkey").alias("session_id"), c("l_shipdate").alias("seq"))
            .agg(
                F.map_from_entries(
                    F.array_agg(
                        F.struct(
                            F.concat_ws("/", c("l_partkey").cast("string"), c("l_linenumber").cast("string")).alias("path"),
                            c("l_quantity").cast("long").alias("version"),
                        ),
                    ),
                )
                .alias("files"),
            ),
        )
    ),
    "SELECT l_orderkey AS session_id, l_partkey || '/' || l_linenumber AS path, l_quantity::BIGINT AS version FROM lineitem QUALIFY "
    "l_shipdate = max(l_shipdate) OVER (PARTITION BY l_orderkey)",
)
register(
    "f23_trigger_eval",
    lambda t: (
        op.confusion(
            t.labels.join(t.documents.select("doc_id", "text"), "doc_id")
            .select((c("quality") == 1).alias("expected"), "text", F.array(F.lit("the"), F.lit("and"), F.lit("of")).alias("concepts")),
        )
    ),
    "SELECT quality = 1 AS expected, (contains(lower(coalesce(text, '')), 'the')::INT + contains(lower(coalesce(text, '')), 'and')::INT "
    "+ contains(lower(coalesce(text, '')), 'of')::INT) / 3 >= 0.5 AS predicted, count(*) AS n FROM labels JOIN documents USING "
    "(doc_id) GROUP BY ALL",
)
register(
    "h5_conventions", lambda t: op.conventions(t.pages.select(c("html").alias("content"))),
    r"""
WITH x AS (SELECT html AS h, string_split(html, chr(10)) AS l, len(regexp_extract_all(html, '''[^''\n]*''')) AS s, len(regexp_extract_all(html, '"[^"\n]*"')) AS d FROM pages WHERE html IS NOT NULL),
y AS (SELECT *, list_sum([0] || list_transform(l, lambda z: regexp_matches(z, '^\t')::INT)) AS tabs, list_sum([0] || list_transform(l, lambda z: regexp_matches(z, '^  ')::INT)) AS spaces, list_sum([0] || list_transform(l, lambda z: regexp_matches(z, '^\s*(#|//)')::INT)) AS c, list_sum([0] || list_transform(l, lambda z: regexp_matches(z, '^\s*(import|from|require)\b')::INT)) AS i FROM x),
z AS (SELECT unnest([CASE WHEN tabs > spaces THEN 'indent:tab' WHEN spaces > 0 THEN 'indent:space' END, CASE WHEN s > d THEN 'quotes:single' WHEN d > 0 THEN 'quotes:double' END, CASE WHEN c > 0 THEN 'comments' END, CASE WHEN regexp_matches(h, '\b(try|except|catch)\b') THEN 'errors:exceptions' END, CASE WHEN i > 0 THEN 'imports' END]) AS habit FROM y)
SELECT habit, count(*) AS files FROM z WHERE habit IS NOT NULL GROUP BY habit""",
)


def _tree(t):
    k = c("page_id")
    sub = F.when(k % 3 == 0, F.concat(F.lit("/sub"), (k % 2).cast("string"))).otherwise("")
    file = F.when(k % 5 == 0, "package.json").otherwise(F.concat(F.lit("f"), k.cast("string"), F.when(k % 4 == 0, ".js").otherwise(".py")))
    return t.pages.select(F.concat(F.lit("m"), (k % 7).cast("string"), sub, F.lit("/"), file).alias("path"))


register(
    "h7_modules", lambda t: op.modules(_tree(t)),
    """
WITH f AS (SELECT 'm' || (page_id % 7) || CASE WHEN page_id % 3 = 0 THEN '/sub' || (page_id % 2) ELSE '' END AS folder, page_id % 5 = 0 AS marked, CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 4 = 0 THEN 'javascript' ELSE 'python' END AS lang FROM pages),
g AS (SELECT folder, count(*) AS files, count(*) FILTER (lang = 'javascript') AS js, count(*) FILTER (lang = 'python') AS py FROM f GROUP BY folder HAVING bool_or(marked))
SELECT folder AS path, files, CASE WHEN js + py = 0 THEN 'unknown' WHEN js >= py THEN 'javascript' ELSE 'python' END AS main_language, NOT EXISTS (SELECT 1 FROM g x WHERE starts_with(x.folder, g.folder || '/')) AS is_leaf FROM g""",
)
register(
    "h10_structure", lambda t: op.structure(ch.file_list(_pages(t))),
    "SELECT CASE WHEN page_id % 2 = 0 THEN '.html' ELSE '.txt' END AS extension, count(*) AS files, sum(CASE WHEN coalesce(html, "
    "'') = '' THEN 0 ELSE len(string_split(html, chr(10))) END)::BIGINT AS lines, 0 AS entries FROM pages WHERE page_id % 9 <> "
    "0 GROUP BY 1",
)


def _evidence(t):
    """Sessions that name a word, found in the stored index, with what their users said and what their tools failed in."""
    turns = plans_search.turns(t)
    hits = plans_search.turn_index(t).facets("parquet", "session_id").orderBy(F.desc("hits"), "session_id").limit(20)
    failed = turns.where((c("role") == "TOOL") & (ba.classify_error(c("text")) != "UNKNOWN"))
    return op.hit_evidence(hits, turns.groupBy("session_id").agg(F.count(F.lit(1)).alias("messages")), turns, DECISION, errors=failed)


register(
    "s6_search_evidence", _evidence,
    rf"""
WITH {plans_search.turn_hits(["parquet"])}, k AS (SELECT session_id, count(*) AS hits FROM h GROUP BY session_id ORDER BY hits DESC, session_id LIMIT 20), n AS (SELECT session_id, count(*) AS messages FROM m GROUP BY session_id),
u AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS k FROM m WHERE role = 'USER'),
e AS (SELECT session_id, count(*) FILTER (regexp_matches(text, '(?i)\b(decided|decision|agreed|conclusion|let''s go with|we will use)\b|结论|决定|确定')) AS decisions, coalesce(string_agg(substring(text, 1, 40), '|' ORDER BY k) FILTER (k <= 8), '') AS said, substring(arg_min(text, k), 1, 150) AS summary FROM u GROUP BY session_id),
f AS (SELECT session_id, text, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS k FROM m WHERE role = 'TOOL' AND ({plans_search.ERROR_SQL}) <> 'UNKNOWN'),
x AS (SELECT session_id, count(*) AS errors, string_agg(substring(text, 1, 60), '|' ORDER BY k) FILTER (k <= 5) AS failed FROM f GROUP BY session_id)
SELECT * FROM k LEFT JOIN n USING (session_id) LEFT JOIN e USING (session_id) LEFT JOIN x USING (session_id)""",
)
register(
    "s7_empty_facts",
    lambda t: op.empty_facts(search.prepare_queries(t.spark.range(1).select(F.lit("Timed out").alias("text"))), t.v_messages, "role"),
    "SELECT role, count(*) FILTER (contains(lower(text), 'timed out')) AS hits, NULL::VARCHAR AS reason FROM v_messages GROUP BY role",
)
