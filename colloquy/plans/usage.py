"""Queries on token usage, commits and snapshots."""

from pyspark.sql import functions as F

from ..operators import basics as ba
from ..operators import usage as op
from . import register

_RATE = "round(CASE WHEN {b} > 0 THEN least(greatest({r} / {b}, 0), 1) + 1e-9 END, 4)"


def _rate(r: str, i: str) -> str:
    return _RATE.format(r=r, b=f"(CASE WHEN {r} <= {i} THEN {i} ELSE {i} + {r} END)")


_LEGS = "sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(cache_read_tokens)::BIGINT AS cache_read_tokens"
register(
    "d6_model_usage", lambda t: op.by_model(t.v_usage),
    f"WITH s AS (SELECT model, count(*) AS requests, {_LEGS} FROM v_usage GROUP BY model) SELECT *, input_tokens + output_tokens "
    f"AS total_tokens, {_rate('cache_read_tokens', 'input_tokens')} AS rate FROM s",
)
register("d3_primary_model", lambda t: op.primary_model(t.v_usage), """
WITH v AS (SELECT session_id, model, count(*) * 3 AS votes, min(request_seq) AS seq FROM v_usage GROUP BY ALL)
SELECT session_id, CASE WHEN arg_min(model, (seq, model)) <> 'NO' THEN arg_min(model, (seq, model)) ELSE arg_max(model, (votes, -seq, model)) END AS model FROM v GROUP BY session_id""")
register(
    "d4_cumulative_max", lambda t: op.cumulative_max(t.v_usage),
    "SELECT session_id, max(input_tokens) AS input_tokens, max(output_tokens) AS output_tokens, max(cache_read_tokens) AS cache_read_tokens "
    "FROM v_usage GROUP BY session_id",
)
register(
    "d5_run_reset",
    lambda t: op.run_reset(t.v_usage.groupBy("session_id", "request_seq").agg(F.max("calls").alias("calls"), *[F.max(c).alias(c) for c in op.LEGS])),
    """
WITH u AS (SELECT session_id, request_seq, max(calls) AS calls, max(input_tokens) AS input_tokens, max(output_tokens) AS output_tokens, max(cache_read_tokens) AS cache_read_tokens FROM v_usage GROUP BY ALL),
c AS (SELECT *, CASE WHEN calls < lag(calls) OVER w THEN 1 ELSE 0 END AS reset FROM u WINDOW w AS (PARTITION BY session_id ORDER BY request_seq)),
r AS (SELECT *, sum(reset) OVER (PARTITION BY session_id ORDER BY request_seq) AS run FROM c),
l AS (SELECT session_id, run, arg_max(input_tokens, request_seq) AS i, arg_max(output_tokens, request_seq) AS o, arg_max(cache_read_tokens, request_seq) AS c FROM r GROUP BY ALL)
SELECT session_id, count(*) AS runs, sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens, sum(c)::BIGINT AS cache_read_tokens FROM l GROUP BY session_id""",
)
register(
    "c4_family",
    lambda t: (
        op.rooted(t.v_usage, t.v_tree).groupBy("root").agg(F.count_distinct("session_id").alias("members"), F.sum("input_tokens").alias("input_tokens"))
    ),
    "SELECT coalesce(parent, session_id) AS root, count(DISTINCT session_id) AS members, sum(input_tokens)::BIGINT AS input_tokens "
    "FROM v_usage LEFT JOIN v_tree ON id = session_id GROUP BY 1",
)
register(
    "d7_usage_by_mode", lambda t: op.by_mode(t.v_usage, t.v_tree),
    f"""
WITH r AS (SELECT u.*, coalesce(parent, session_id) AS root, parent IS NOT NULL AS child FROM v_usage u LEFT JOIN v_tree ON id = session_id)
SELECT 'raw' AS mode, model, count(DISTINCT session_id) AS units, {_LEGS} FROM r GROUP BY model UNION ALL SELECT 'family', model, count(DISTINCT root), {_LEGS} FROM r GROUP BY model UNION ALL SELECT 'session', model, count(DISTINCT session_id), {_LEGS} FROM r WHERE NOT child GROUP BY model""",
)
register(
    "d8_family_report", lambda t: op.family_report(t.v_usage, t.v_tree),
    """
WITH r AS (SELECT u.*, coalesce(parent, session_id) AS root, parent IS NOT NULL AS child FROM v_usage u LEFT JOIN v_tree ON id = session_id),
b AS (SELECT root, model, sum(CASE WHEN NOT child THEN input_tokens ELSE 0 END)::BIGINT AS own, sum(CASE WHEN child THEN input_tokens ELSE 0 END)::BIGINT AS below, bool_or(child) AS child FROM r GROUP BY ALL),
s AS (SELECT root, bool_or(child) AS child, bool_or(below > own) AS over, sum(own)::BIGINT AS own, sum(below)::BIGINT AS below, sum(greatest(own - below, 0))::BIGINT AS net FROM b GROUP BY root),
k AS (SELECT *, CASE WHEN NOT child THEN 'standalone' WHEN over THEN 'separate' ELSE 'rollup' END AS accounting FROM s)
SELECT root, accounting, CASE WHEN accounting = 'rollup' THEN net ELSE own END AS parent_input, below AS children_input FROM k""",
)
_S = f"s AS (SELECT session_id, max(model) AS model, {_LEGS} FROM v_usage GROUP BY session_id), r AS (SELECT *, {_rate('cache_read_tokens', 'input_tokens')} AS rate FROM s)"
_PARTS = "CASE WHEN rate > 0 AND rate <= 1 THEN round(rate * 10000)::BIGINT END"
_MEAN = f"CASE WHEN count({_PARTS}) > 0 THEN ((2 * sum({_PARTS}) + count({_PARTS})) // (2 * count({_PARTS}))) / 10000 END"
register("d9_cache_hit_rate", lambda t: op.session_rates(t.v_usage).select("session_id", "rate"), f"WITH {_S} SELECT session_id, rate FROM r")
register(
    "d10_mean_rate",
    lambda t: op.session_rates(t.v_usage).groupBy("model").agg(op.mean_rate(F.col("rate")).alias("mean_rate")),
    f"WITH {_S} SELECT model, {_MEAN} AS mean_rate FROM r GROUP BY model",
)
register("d11_cache_tables", lambda t: op.cache_tables(op.session_rates(t.v_usage), F.col("session_id") % 7), f"""
WITH {_S} SELECT session_id % 7 AS grp, model, count(*) FILTER (rate > 0) AS eligible, count(*) FILTER (rate = 0) AS zero, count(*) FILTER (rate IS NULL) AS no_rate, {_MEAN} AS mean_rate
FROM r GROUP BY GROUPING SETS ((session_id % 7), (session_id % 7, model), ()) HAVING count(*) FILTER (rate > 0) >= 3""")
register(
    "d12_cache_audit", lambda t: op.cache_audit(op.session_rates(t.v_usage)),
    f"""
WITH {_S}, a AS (SELECT model, count(*) AS sessions, {_MEAN} AS mean_rate, {_RATE.format(r='sum(cache_read_tokens)', b='sum(input_tokens)')} AS weighted_rate, count(*) FILTER (rate = 0) AS zero, count(*) FILTER (rate IS NULL) AS missing FROM r GROUP BY model)
SELECT *, CASE WHEN weighted_rate >= 0.8 THEN 'A' WHEN weighted_rate >= 0.5 THEN 'B' WHEN weighted_rate >= 0.2 THEN 'C' ELSE 'D' END AS grade FROM a""",
)
register(
    "d13_filter_cache_models",
    lambda t: (
        op.session_rates(t.v_usage)
        .groupBy("model")
        .agg(F.count(F.lit(1)).alias("sessions"), F.sum("cache_read_tokens").alias("cached"))
        .where("sessions >= 3 AND cached > 0")
    ),
    f"WITH {_S} SELECT model, count(*) AS sessions, sum(cache_read_tokens)::BIGINT AS cached FROM r GROUP BY model HAVING count(*) "
    f">= 3 AND sum(cache_read_tokens) > 0",
)
register(
    "d14_rate_by_session",
    lambda t: (
        t.v_usage.withColumn("rate", op.cache_rate(F.col("cache_read_tokens"), F.col("input_tokens")))
        .groupBy("session_id")
        .agg(F.round(F.avg("rate") + 1e-9, 4).alias("mean_rate"), F.count(F.lit(1)).alias("calls"))
    ),
    f"SELECT session_id, round(avg({_rate('cache_read_tokens', 'input_tokens')}) + 1e-9, 4) AS mean_rate, count(*) AS calls FROM "
    f"v_usage GROUP BY session_id",
)
register(
    "d15_cache_by_date",
    lambda t: (
        t.v_usage.rollup(F.to_date("ts").alias("day"))
        .agg(F.count(F.lit(1)).alias("requests"), F.sum("input_tokens").alias("prompt"), F.sum("cache_read_tokens").alias("cached"))
    ),
    "SELECT ts::DATE AS day, count(*) AS requests, sum(input_tokens)::BIGINT AS prompt, sum(cache_read_tokens)::BIGINT AS cached "
    "FROM v_usage GROUP BY ROLLUP (ts::DATE)",
)
register(
    "f12_usage_insights",
    lambda t: (
        t.v_usage.groupBy(F.date_format("ts", "yyyy-MM").alias("month"), "model")
        .agg(F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"))
        .groupBy("month")
        .agg(F.sum("tokens").alias("tokens"), F.max(F.struct("tokens", "model"))["model"].alias("top_model"))
    ),
    """
WITH m AS (SELECT strftime(ts, '%Y-%m') AS month, model, sum(input_tokens + output_tokens)::BIGINT AS tokens FROM v_usage GROUP BY ALL) SELECT month, sum(tokens)::BIGINT AS tokens, arg_max(model, (tokens, model)) AS top_model FROM m GROUP BY month""",
)
register(
    "b18_winsorize",
    lambda t: t.v_usage.groupBy("session_id").agg(F.sum("input_tokens").alias("n")).select("session_id", ba.winsorize(F.col("n"), 20000).alias("shown")),
    "SELECT session_id, CASE WHEN sum(input_tokens) <= 0 THEN 0 ELSE least(sum(input_tokens), 20000) END::BIGINT AS shown FROM "
    "v_usage GROUP BY session_id",
)
register(
    "b20_estimate_cost",
    lambda t: t.v_usage.groupBy("session_id").agg(ba.cost(F.sum("input_tokens"), F.sum("output_tokens"), 3, 15).alias("usd")),
    "SELECT session_id, round((sum(input_tokens) * 3 + sum(output_tokens) * 15) / 1e6, 6) AS usd FROM v_usage GROUP BY session_id",
)
_RAW_MODELS = (
    "LongCat-2.5-x",
    "longcat",
    "route/longcat-2.0",
    "GLM-5.3-Flash",
    "glm-5.3-flashx",
    "deepseek-chat",
    "deepseek-reasoner",
    "DeepSeek-V4",
    "deepseek-4.1",
    "gemini-3.8",
    "gemini-argon",
    "gemini-pro",
    "claude-3-7-sonnet",
    "claude-3-5-haiku",
    "claude-opus-4",
    "claude-x",
    "other-1",
    "",
)
_FAMILY_ROWS = ", ".join(f"({i}, '{family}', {list(held)}, {list(lacking)}::VARCHAR[])" for i, (family, held, lacking) in enumerate(ba.MODEL_FAMILIES))
register(
    "b10_canon_model",
    lambda t: (
        t.v_usage.groupBy(
            ba.canon_model(
                F.concat(
                    F.element_at(F.array(*[F.lit(x) for x in _RAW_MODELS]), (F.col("session_id") % 18 + 1).cast("int")),
                    F.when(F.col("request_seq") % 3 == 0, F.concat(F.lit("-"), F.lower("model"))).otherwise(""),
                ),
            )
            .alias("family"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    ),
    f"""
WITH f(place, family, held, lacking) AS (VALUES {_FAMILY_ROWS}),
names AS (SELECT trim(list_extract({list(_RAW_MODELS)}, (session_id % 18 + 1)::INT) || CASE WHEN request_seq % 3 = 0 THEN '-' || lower(model) ELSE '' END) AS name, count(*) AS n FROM v_usage GROUP BY 1),
fits AS (SELECT name, arg_min(family, place) AS family FROM names, f WHERE list_bool_and(list_transform(held, lambda w: contains(lower(name), w))) AND NOT coalesce(list_bool_or(list_transform(lacking, lambda w: contains(lower(name), w))), false) GROUP BY name)
SELECT CASE WHEN name = '' THEN 'unknown' ELSE coalesce(family, name) END AS family, sum(n)::BIGINT AS n FROM names LEFT JOIN fits USING (name) GROUP BY 1""",
)
register(
    "h1_hotspots", lambda t: op.hotspots(t.v_commits, t.v_commit_files),
    "SELECT path, count(*) AS commits, count(DISTINCT author) AS authors, min(ts) AS first, max(ts) AS last FROM (SELECT DISTINCT "
    "hash, path FROM v_commit_files) JOIN v_commits USING (hash) GROUP BY path ORDER BY commits DESC, path LIMIT 20",
)
register(
    "h2_commit_frequency", lambda t: op.commit_frequency(t.v_commits, t.v_commit_files),
    "SELECT strftime(ts, '%Y-%W') AS week, count(*) AS commits, sum(coalesce(files, 0))::BIGINT AS changes, count(DISTINCT author) "
    "AS authors FROM v_commits LEFT JOIN (SELECT hash, count(DISTINCT path) AS files FROM v_commit_files GROUP BY hash) USING "
    "(hash) GROUP BY 1",
)
register(
    "h3_author_distribution",
    lambda t: (
        t.v_commits.groupBy("author")
        .agg(
            F.count_distinct(F.concat(F.year("ts").cast("string"), F.lit("-"), F.lpad(op.sunday_week(F.col("ts")).cast("string"), 2, "0"))).alias("weeks"),
            F.count(F.lit(1)).alias("commits"),
        )
    ),
    "SELECT author, count(DISTINCT strftime(ts, '%Y-%W')) AS weeks, count(*) AS commits FROM v_commits GROUP BY author",
)
register(
    "h11_recent_commits",
    lambda t: (
        t.v_commits.join(t.v_commit_files.groupBy("hash").agg(F.count_distinct("path").alias("files")), "hash", "left")
        .orderBy(F.desc("ts"), "hash")
        .limit(20)
        .select("hash", "author", "ts", "files")
    ),
    "SELECT hash, author, ts, files FROM v_commits LEFT JOIN (SELECT hash, count(DISTINCT path) AS files FROM v_commit_files "
    "GROUP BY hash) USING (hash) ORDER BY ts DESC, hash LIMIT 20",
)
register(
    "w5_git_work_sessions", lambda t: op.work_sessions(t.v_commits, gap=30 * 86400),
    """
WITH c AS (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) <= 2592000 THEN 0 ELSE 1 END AS new FROM v_commits WINDOW w AS (PARTITION BY author ORDER BY ts, hash)),
r AS (SELECT *, sum(new) OVER (PARTITION BY author ORDER BY ts, hash)::BIGINT AS cluster FROM c) SELECT author, cluster, count(*) AS commits, min(ts) AS started, max(ts) AS ended FROM r GROUP BY ALL""",
)
register(
    "c14_session_commits",
    lambda t: (
        op.session_commit_counts(
            t.v_sessions.select("session_id", "created", "modified"),
            t.v_commits.select("hash", (F.col("ts") + F.make_dt_interval(F.lit(9862))).alias("ts")),
        )
    ),
    "SELECT session_id, count(*) AS commits FROM v_sessions JOIN (SELECT hash, ts + INTERVAL 9862 DAY AS committed FROM v_commits) "
    "ON committed BETWEEN created AND modified GROUP BY session_id",
)
register(
    "c16_snapshot_diff",
    lambda t: op.snapshot_diff(t.v_snapshots.where("snapshot_id = 1"), t.v_snapshots.where("snapshot_id = 2"), "p_partkey", "p_size"),
    """
WITH a AS (SELECT p_partkey, p_size AS old FROM v_snapshots WHERE snapshot_id = 1), b AS (SELECT p_partkey, p_size AS new FROM v_snapshots WHERE snapshot_id = 2)
SELECT p_partkey, old, new, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b USING (p_partkey) WHERE old IS NULL OR new IS NULL OR old <> new""",
)
register(
    "c13_evolution_files",
    lambda t: (
        t.v_commit_files.groupBy("path").count().join(t.part, F.col("path") == F.col("p_partkey")).groupBy("p_type").agg(F.sum("count").alias("changes"))
    ),
    "SELECT p_type, count(*) AS changes FROM v_commit_files JOIN part ON path = p_partkey GROUP BY p_type",
)
register("g19_coverage", lambda t: op.coverage(t.v_commits, 150), """
WITH m AS (SELECT date_trunc('month', ts)::TIMESTAMP AS month, count(*) AS n FROM v_commits GROUP BY 1), a AS (SELECT unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS month FROM m)
SELECT month, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'empty' WHEN n < 150 THEN 'thin' ELSE 'full' END AS state FROM a LEFT JOIN m USING (month)""")
register(
    "g13_compare_periods", lambda t: op.month_forecast(t.v_commits),
    """
WITH m AS (SELECT strftime(ts, '%Y-%m') AS month, count(*)::DOUBLE AS y FROM v_commits GROUP BY 1), x AS (SELECT *, row_number() OVER (ORDER BY month)::DOUBLE AS x FROM m),
s AS (SELECT month, y, x, count(*) OVER w AS n, regr_slope(y, x) OVER w AS slope, regr_intercept(y, x) OVER w AS cut, sum(y) OVER w AS sy, sum(x * y) OVER w AS sxy, sum(y * y) OVER w AS syy FROM x WINDOW w AS (ORDER BY month ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)),
z AS (SELECT *, sqrt(greatest(syy - cut * sy - slope * sxy, 0) / n) AS sigma, y - (cut + slope * x) AS off FROM s WHERE n = 6)
SELECT month, y::BIGINT AS n, round(slope, 3) AS slope, CASE WHEN sigma > 1e-9 THEN abs(off / sigma) > 2 ELSE abs(off) >= 1 END AS anomaly FROM z""",
)
register(
    "h6_overview",
    lambda t: t.part.groupBy("p_type").agg(F.count(F.lit(1)).alias("files"), F.sum("p_size").alias("size")).orderBy(F.desc("files"), "p_type").limit(10),
    "SELECT p_type, count(*) AS files, sum(p_size)::BIGINT AS size FROM part GROUP BY p_type ORDER BY files DESC, p_type LIMIT 10",
)
register(
    "h8_missing_configs", lambda t: ba.missing_pairs(t.part, "p_brand", "p_type", t.part.where("p_partkey % 3 = 0")),
    "SELECT a.p_brand, b.p_type FROM (SELECT DISTINCT p_brand FROM part) a, (SELECT DISTINCT p_type FROM part) b WHERE NOT EXISTS "
    "(SELECT 1 FROM part p WHERE p_partkey % 3 = 0 AND p.p_brand = a.p_brand AND p.p_type = b.p_type)",
)
register(
    "h9_repo_search",
    lambda t: ba.page_by(t.part, "p_name", "ring", ["p_name", "p_partkey"], 5, 20).select("p_partkey", "p_name"),
    "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') ORDER BY p_name, p_partkey LIMIT 20 OFFSET 5",
)

def _styled():
    """A part's name in one style after the other."""
    words, k = F.lower("p_name"), F.col("p_partkey") % 7
    pascal = F.regexp_replace(F.initcap(words), " ", "")
    camel = F.concat(F.lower(F.substring(pascal, 1, 1)), F.expr("substring(replace(initcap(lower(p_name)), ' ', ''), 2)"))
    snake = F.regexp_replace(words, " ", "_")
    return (
        F.when(k == 0, F.concat(F.lit("_x_"), snake))
        .when(k == 1, F.regexp_replace(words, "[^a-z]", ""))
        .when(k == 2, pascal)
        .when(k == 3, camel)
        .when(k == 4, F.upper(F.concat(F.lit("x_"), snake)))
        .when(k == 5, F.initcap(F.regexp_replace(words, "[^a-z]", "")))
        .otherwise("1")
    )


_NAMED = """
WITH w AS (SELECT p_partkey, p_partkey % 7 AS k, lower(p_name) AS l, regexp_replace(lower(p_name), '[^a-z]', '', 'g') AS flat, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda x: upper(x[1]) || x[2:]), '') AS pascal FROM part),
n AS (SELECT p_partkey, CASE k WHEN 0 THEN '_x_' || replace(l, ' ', '_') WHEN 1 THEN flat WHEN 2 THEN pascal WHEN 3 THEN lower(pascal[1]) || pascal[2:] WHEN 4 THEN upper('x_' || replace(l, ' ', '_')) WHEN 5 THEN upper(flat[1]) || flat[2:] ELSE '1' END AS name FROM w),
s AS (SELECT p_partkey, name, trim(name, '_') AS core, len(regexp_replace(name, '[^A-Z]', '', 'g')) AS capitals, len(regexp_replace(name, '[^a-z]', '', 'g')) AS smalls FROM n)"""
register(
    "b22_naming_style", lambda t: t.part.select("p_partkey", ba.naming_style(_styled()).alias("style")),
    f"""{_NAMED}
SELECT p_partkey, CASE WHEN len(name) < 2 THEN NULL WHEN contains(core, '_') AND capitals = 0 AND smalls > 0 THEN 'snake_case' WHEN contains(core, '_') AND smalls = 0 AND capitals > 0 THEN 'UPPER_SNAKE' WHEN smalls = len(core) AND smalls > 0 THEN 'flatcase'
WHEN core[1] BETWEEN 'a' AND 'z' AND capitals > 0 THEN 'camelCase' WHEN core[1] BETWEEN 'A' AND 'Z' AND (capitals > 1 OR (capitals = 1 AND smalls > 0 AND smalls + 1 = len(core))) THEN 'PascalCase' END AS style FROM s""",
)
register(
    "a14_read_git_log",
    lambda t: (
        t.v_commits.join(t.v_commit_files, "hash").groupBy("author").agg(F.count_distinct("hash").alias("commits"), F.count_distinct("path").alias("files"))
    ),
    "SELECT author, count(DISTINCT hash) AS commits, count(DISTINCT path) AS files FROM v_commits JOIN v_commit_files USING (hash) GROUP BY author",
)
register(
    "s15_merged_limit",
    lambda t: (
        ba.newest(
            t.orders.where("o_orderkey % 2 = 0")
            .select("o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderdate")).alias("ts"))
            .unionByName(t.orders.where("o_orderkey % 2 = 1").select("o_orderkey", F.col("o_orderdate").alias("ts"))),
            "ts", "o_orderkey", 25,
        )
    ),
    "SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate END AS ts FROM orders ORDER BY ts DESC NULLS LAST, o_orderkey LIMIT 25",
)
