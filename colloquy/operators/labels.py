"""Labels and matches: models, roles, projects, headlines, skills, conventions, modules, evidence of hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
MODEL_ALIASES = {
    "deepseek v4 flash": "deepseek-v4-flash", "deepseek v4 pro": "deepseek-v4-pro",
    "longcat": "LongCat", "longcat-2.0": "LongCat-2.0", "longcat-2": "LongCat-2", "longcat-2.0-preview": "LongCat-2.0-Preview", "longcat-2.5": "LongCat-2.5", "longcat-2.5-preview": "LongCat-2.5-Preview",
    "mimo-v2.5": "MiMo-v2.5", "mimo-v2.5-pro": "MiMo-v2.5-Pro", "mimo-v2.6-flash": "MiMo-v2.6-Flash",
    "glm-5.2": "GLM-5.2", "glm 5.2": "GLM-5.2", "glm-5.3-flash": "GLM-5.3-Flash", "glm 5.3 flash": "GLM-5.3-Flash", "zai_glm-5.3-flash": "GLM-5.3-Flash", "kimi-for-coding": "kimi-for-coding",
}
NOT_MODELS = ("claude", "codex", "kimi", "zcode", "dimcode", "grok", "workbuddy", "dim", "reasonix", "trae_cn", "universal", "unknown", "grok-build")
GENERIC_FOLDERS = ("src", "app", "code", "project", "projects", "repo", "repos", "workspace", "home", "users", "documents", "tmp")
MARKERS = ("package.json", "pyproject.toml", "Cargo.toml", "go.mod", "pom.xml", "__init__.py")
ENTRIES = ("main.py", "app.py", "__main__.py", "index.js", "index.ts", "main.go", "main.rs", "Main.java")
LANGUAGES = {".py": "python", ".js": "javascript", ".ts": "typescript", ".go": "go", ".rs": "rust", ".java": "java", ".c": "c", ".cpp": "cpp"}


#: Vendors whose versions are written in one way, by the name before the version.
VENDORS = {"longcat": "LongCat-", "mimo": "MiMo-v"}
_VERSION = r"[-_ ]?v?([0-9]+(?:\.[0-9]+)?)[-_ ]?(preview|pro|flash|)$"


def model_name(name: Column, aliases: dict[str, str] = MODEL_ALIASES, vendors: dict[str, str] = VENDORS, others: tuple[str, ...] = NOT_MODELS) -> Column:
    """A model's name without the route to it; null for the names of agents (others) and for UUIDs.

    A record tells its modelId. Folders before the name, and ports and notes behind it, are the route; addresses stay
    whole. Aliases replace names, vendors' versions are written alike.
    """
    told = F.from_json(name, "modelId string", {"allowSingleQuotes": "true", "mode": "PERMISSIVE"})["modelId"]
    plain = F.regexp_replace(F.when(F.startswith(F.ltrim(name), F.lit("{")) & (told != ""), told).otherwise(F.trim(name)), r"^(?!http).*/|:(?!//).*$|\[.*$", "")
    plain = F.trim(plain)
    key = F.lower(plain)
    known = F.element_at(F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]), key)
    version = F.regexp_extract(key, "^(?:" + "|".join(vendors) + ")" + _VERSION, 1)
    kind = F.regexp_extract(key, "^(?:" + "|".join(vendors) + ")" + _VERSION, 2)
    title = F.element_at(F.create_map(*[F.lit(x) for pair in vendors.items() for x in pair]), F.regexp_extract(key, "^(" + "|".join(vendors) + ")", 1))
    versioned = F.when(version != "", F.concat(title, version, F.when(kind != "", F.concat(F.lit("-"), F.initcap(kind))).otherwise("")))
    named = (plain != "") & ~key.isin(*others) & ~key.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-")
    return F.coalesce(known, versioned, F.when(named, plain))


def session_role(agent: Column, session: Column, path: Column, parent: Column) -> Column:
    """subagent by a parent, a path's folder or an id's mark; main where the agent's own files say so; else unknown."""
    a, sid, p = F.lower(F.coalesce(agent, F.lit(""))), F.lower(F.coalesce(session, F.lit(""))), F.coalesce(path, F.lit(""))
    own = F.contains(p, F.lit("/subagents/")) | (F.contains(p, F.lit("/agents/")) & ~F.contains(p, F.lit("/agents/main/")) & F.endswith(p, F.lit("wire.jsonl")))
    main = ((a == "claude") & F.endswith(p, F.lit(".jsonl"))) | ((a == "grok") & F.endswith(p, F.lit("chat_history.jsonl"))) | F.contains(p, F.lit("/agents/main/"))
    return F.when(parent.isNotNull() | own | F.contains(sid, F.lit("subagent")), "subagent").when(main, "main").otherwise("unknown")


def in_project(path: Column, folder: str) -> Column:
    """The path belongs to the folder: as it is, dash-encoded or URL-encoded, up to a segment's end; a general name never matches."""
    folder = folder.rstrip("/")
    name = folder.split("/")[-1]
    if not name or name.lower() in GENERIC_FOLDERS:
        return F.lit(False)
    ends = lambda mark, more: F.contains(F.concat(path, F.lit("/")), F.lit(mark + "/")) | (F.contains(path, F.lit(mark + ".")) if more else F.lit(False))
    coded = folder.replace("/", "%2F")
    local = ~F.contains(path, F.lit("://")) | F.startswith(path, F.lit("file://"))
    named = F.contains(path, F.lit(f"/{name}/")) | F.contains(path, F.lit(f"%2F{name}%2F")) | F.contains(path, F.lit(f"%2F{name}/"))
    return F.coalesce(local & (ends(folder, False) | ends(folder.replace("/", "-"), True) | ends(coded, True) | named), F.lit(False))


def redact_path(path: Column) -> Column:
    """User names in plain, dash-encoded and URL-encoded home paths become <user>."""
    p = F.regexp_replace(path, r"(^|/)(Users|home)/[^/]+", "$1$2/<user>")
    p = F.regexp_replace(p, r"-(Users|home)-[^-/]+", "-$1-<user>")
    return F.regexp_replace(p, r"(?i)%2F(Users|home)%2F[^%/]+", "%2F$1%2F<user>")


def headline(summary: Column, most: int = 42) -> Column:
    """One label from a summary: its first clause of 6 to `most` characters, else a cut one; null for links and noise."""
    s = F.trim(F.regexp_replace(F.regexp_replace(summary, r"https?://\S+", ""), r"\s+", " "))
    s = F.regexp_replace(F.regexp_replace(s, r"^#{1,6}\s*", ""), r"^[-*0-9]+[.)]\s*", "")
    at = lambda sep: F.instr(s, sep) - 1
    places = [F.when((at(x) >= 6) & (at(x) <= most), at(x)) for x in ("。", "？", "！", "；", "? ", "! ", "; ", ". ", "，", ", ")]
    label = F.when(F.length(s) <= most, s).otherwise(F.coalesce(*[F.substring(s, F.lit(1), p) for p in places], F.concat(F.substring(s, 1, most), F.lit("…"))))
    return F.when((F.length(label) >= 4) & label.rlike(r"[A-Za-z]{3,}|[\x{4E00}-\x{9FFF}]{2,}"), label)


def agent_family(agent: Column) -> Column:
    a = F.lower(F.coalesce(agent, F.lit("")))
    return F.when(a.isin("kimi_code", "kimi"), "kimi").when(a.isin("dimcode", "dim"), "dim").when(a.isin("universal", "qoder", ""), "other").otherwise(a)


def chat_kind(user: Column) -> Column:
    return (
        F.when(F.endswith(user, F.lit("@chatroom")), "group")
        .when(F.startswith(user, F.lit("gh_")), "official")
        .when(F.endswith(user, F.lit("@openim")), "openim")
        .when(F.startswith(user, F.lit("wxid_wi_")), "wework")
        .otherwise("single")
    )


def best_skills(patterns: DataFrame, skills: DataFrame, key: str = "pattern_id") -> DataFrame:
    """(pattern_id, skill, score): the skill whose words hold most of a pattern's keywords; ties to the first name.

    Keywords meet skills by equal words, so no pattern is compared with every skill. Patterns are dealt to tasks before they
    grow into pairs with skills, as a small file that one task reads makes many pairs.
    """
    parts = int(patterns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p = patterns.repartition(parts, key).select(key, F.explode(F.array_distinct("keywords")).alias("word"))
    s = skills.select(F.col("name").alias("skill"), F.explode(F.array_distinct(F.split(F.lower(F.concat_ws(" ", "name", "description")), "[^a-z0-9]+"))).alias("word"))
    n = p.withColumn("word", F.lower("word")).join(s, "word").groupBy(key, "skill").agg(F.count(F.lit(1)).alias("score"))
    best = n.groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("score"), "skill")).alias("m"))
    return best.select(key, F.col("m.skill").alias("skill"), (-F.col("m.score")).alias("score"))


def files_changed(snapshots: DataFrame) -> DataFrame:
    """Files of each session's last snapshot with their versions."""
    last = snapshots.groupBy("session_id").agg(F.max_by("files", "seq").alias("files"))
    return last.select("session_id", F.explode("files").alias("path", "version"))


def confusion(cases: DataFrame, cut: float = 0.5) -> DataFrame:
    """Cases by expected and predicted outcome; predicted where enough of the concepts are in the text."""
    low = F.lower(F.coalesce("text", F.lit("")))
    share = F.size(F.filter("concepts", lambda x: F.contains(low, F.lower(x)))) / F.greatest(F.size("concepts"), F.lit(1))
    return cases.withColumn("predicted", share >= cut).groupBy("expected", "predicted").agg(F.count(F.lit(1)).alias("n"))


def conventions(files: DataFrame) -> DataFrame:
    """How many files keep each habit: indent, quotes, comments, error handling, imports; counted in one pass."""
    lines = F.split("content", "\n")
    count = lambda p: F.regexp_count("content", F.lit(p))
    like = lambda p: F.size(F.filter(lines, lambda x: x.rlike(p)))
    single, double, tabs, spaces = count("'[^'\n]*'"), count('"[^"\n]*"'), like("^\t"), like("^  ")
    habits = F.array_compact(F.array(
        F.when(tabs > spaces, "indent:tab").when(spaces > 0, "indent:space"), F.when(single > double, "quotes:single").when(double > 0, "quotes:double"),
        F.when(like(r"^\s*(#|//)") > 0, "comments"), F.when(count(r"\b(try|except|catch)\b") > 0, "errors:exceptions"), F.when(like(r"^\s*(import|from|require)\b") > 0, "imports"),
    ))
    return files.where("content IS NOT NULL").select(F.explode(habits).alias("habit")).groupBy("habit").agg(F.count(F.lit(1)).alias("files"))


def modules(files: DataFrame) -> DataFrame:
    """(path, files, main_language, is_leaf) of folders that hold a marker file.

    Each module names the folders above it, so nesting is an equal join and not a comparison of all pairs.
    """
    f = files.select(F.regexp_replace("path", "/?[^/]*$", "").alias("folder"), F.regexp_extract("path", "([^/]*)$", 1).alias("file"))
    lang = F.create_map(*[F.lit(x) for p in LANGUAGES.items() for x in p])[F.regexp_extract("file", r"(\.[^.]+)$", 1)]
    by = f.withColumn("lang", lang).groupBy("folder", "lang").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("file").isin(*MARKERS)).alias("marked"))
    m = (
        by.groupBy("folder")
        .agg(
            F.sum("n").alias("files"), F.bool_or("marked").alias("marked"),
            F.min(F.when(F.col("lang").isNotNull(), F.struct((-F.col("n")).alias("n"), "lang"))).alias("top"),
        )
        .where("marked")
    )
    parts = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    outer = m.where(F.contains("folder", F.lit("/"))).select(F.explode(above).alias("folder")).distinct().withColumn("outer", F.lit(True))
    return m.join(outer, "folder", "left").select(F.col("folder").alias("path"), "files", F.coalesce("top.lang", F.lit("unknown")).alias("main_language"), F.col("outer").isNull().alias("is_leaf"))


def structure(files: DataFrame, depth: int = 2) -> DataFrame:
    """Extensions of the files down to a depth: how many, their lines, and how many are entry files."""
    name = F.regexp_extract("path", "([^/]*)$", 1)
    return files.where(F.col("depth") <= depth).groupBy("extension").agg(F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines"), F.count_if(name.isin(*ENTRIES)).alias("entries"))


def hit_evidence(hits: DataFrame, sessions: DataFrame, messages: DataFrame, decision: str, n: int = 8, errors: DataFrame | None = None, most_errors: int = 5) -> DataFrame:
    """The sessions of a bounded table of hits, with their first user messages, decisions and summaries (150 characters of the
    first user message), and the first tool errors of errors(session_id, seq, text).

    Messages and errors are reduced to those sessions before anything is gathered.
    """
    keys = F.broadcast(hits.select("session_id"))  # at most the hits' limit
    first = lambda k, length: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= k, F.struct("k", F.substring("text", 1, length).alias("text"))))), lambda x: x["text"]), "|")
    numbered = lambda rows: rows.join(keys, "session_id", "left_semi").withColumn("k", F.row_number().over(Window.partitionBy("session_id").orderBy("seq")))
    e = numbered(messages.where("role = 'USER'")).groupBy("session_id").agg(
        F.count_if(F.col("text").rlike(decision)).alias("decisions"), first(n, 40).alias("said"), F.substring(F.min_by("text", "k"), 1, 150).alias("summary")
    )
    out = hits.join(sessions.join(keys, "session_id", "left_semi"), "session_id", "left").join(e, "session_id", "left")
    if errors is None:
        return out
    return out.join(numbered(errors).groupBy("session_id").agg(F.count(F.lit(1)).alias("errors"), first(most_errors, 60).alias("failed")), "session_id", "left")


def empty_facts(prepared: DataFrame, rows: DataFrame, by: str, text: str = "text") -> DataFrame:
    """Of a keyword (one row of prepare_queries) that found nothing: its rejection, and the hits by facet without filters."""
    low = F.array_join("terms", " ")
    q = F.broadcast(prepared.select(low.alias("phrase"), "reason"))  # one row
    hit = F.contains(F.lower(F.coalesce(text, F.lit(""))), F.col("phrase")) & F.col("reason").isNull()
    return rows.crossJoin(q).groupBy(by).agg(F.count_if(hit).alias("hits"), F.any_value("reason").alias("reason"))
