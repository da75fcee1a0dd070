"""Search: tokens with CJK characters of their own, postings with positions, phrase match, BM25."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CJK = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}"
TOKEN = rf"[{CJK}]|[A-Za-z0-9_]+"


def split_cjk(text: Column) -> Column:
    """Spaces between CJK characters, and between them and others."""
    spaced = F.regexp_replace(text, rf"(?<=[{CJK}])(?=\S)|(?<=\S)(?=[{CJK}])", " ")
    return F.trim(F.regexp_replace(spaced, r"\s+", " "))


def join_cjk(text: Column) -> Column:
    """For display: no spaces between CJK characters."""
    return F.regexp_replace(text, rf"(?<=[{CJK}]) (?=[{CJK}])", "")


def tokens(text: Column, most: int | None = None) -> Column:
    """The terms of a text in order; `most` keeps to its first characters."""
    return F.regexp_extract_all(F.lower(text if most is None else F.substring(text, 1, most)), F.lit(TOKEN), F.lit(0))


def holds(text: Column, word: str) -> Column:
    """The word stands anywhere in the text, letters of either case alike."""
    return F.contains(F.lower(text), F.lit(word.lower()))


def prepare_queries(queries: DataFrame, text: str = "text", most: int = 12) -> DataFrame:
    """Each row's keyword as one phrase of terms, or the reason why it cannot be one; a lone ASCII word is a prefix."""
    terms = F.col("terms")
    reason = F.when(F.size(terms) == 0, "no_terms").when(F.size(terms) > most, "too_many_terms")
    return (
        queries.withColumn("terms", tokens(F.col(text)))
        .withColumn("reason", reason)
        .withColumn("prefix", (F.size(terms) == 1) & F.element_at(F.concat(terms, F.array(F.lit(""))), 1).rlike("^[a-z0-9_]+$"))
    )


def page_with_total(rows: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """A page beside the total of all rows, counted in an aggregation of its own rather than in one window over all rows."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    page = rows.orderBy(*order).offset(offset).limit(limit)
    return page.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + limit)


def collapse_identical(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The first row of each text, by key, and how many it stands for."""
    h = F.sha1(F.coalesce(F.col(text), F.lit("")))
    return rows.groupBy(h.alias("hash")).agg(F.min(key).alias(key), F.count(F.lit(1)).alias("copies"))


def group_hits(hits: DataFrame, chat: str, ts: str, top: int = 10) -> DataFrame:
    g = hits.groupBy(chat).agg(F.count(F.lit(1)).alias("hits"), F.min(ts).alias("first"), F.max(ts).alias("last"))
    return g.orderBy(F.desc("hits"), chat).limit(top)


def newest(rows: DataFrame, order: list[str], n: int, offset: int = 0) -> DataFrame:
    """The newest n rows, oldest first."""
    page = rows.orderBy(*[F.desc(c) for c in order]).offset(offset)
    return (page.limit(n) if n > 0 else page).orderBy(*order)


def inventory_match(items: DataFrame, query: str, name: str, cut: float = 0.28) -> DataFrame:
    """Rows whose name tokens overlap a query: exact 1, Jaccard with a bonus for containment."""
    q = F.array_distinct(tokens(F.lit(query)))
    mine = F.array_distinct(tokens(F.col(name)))
    jaccard = F.size(F.array_intersect(mine, q)) / F.size(F.array_union(mine, q))
    score = F.when(F.lower(name) == query.lower(), 1.0).otherwise(F.least(F.lit(0.99), jaccard + F.when(F.contains(F.lower(name), F.lit(query.lower())), 0.3).otherwise(0.0)))
    return items.select(name, F.round(score, 4).alias("score")).where(F.col("score") >= cut).groupBy(name).agg(F.max("score").alias("score"))


def passage_recall(items: DataFrame, docs: DataFrame, words: int = 8) -> DataFrame:
    """How many items' first words stand somewhere in the documents, which are cut into all windows of as many words."""
    cut = lambda c: F.regexp_extract_all(c, F.lit(r"[^ \t\n]+"), F.lit(0))
    q = items.select("item_id", F.array_join(F.slice(cut(F.col("text")), 1, words), " ").alias("passage"))
    d = docs.select("doc_id", cut(F.col("text")).alias("w")).where(F.size("w") >= words)
    windows = F.transform(F.sequence(F.lit(1), F.size("w") - (words - 1)), lambda i: F.array_join(F.slice("w", i, words), " "))
    found = d.select("doc_id", F.explode(windows).alias("passage")).join(q, "passage")
    total = items.agg(F.count(F.lit(1)).alias("queries"))
    out = found.agg(F.count_distinct("item_id").alias("found"), F.count_distinct("doc_id").alias("docs")).crossJoin(total)
    return out.select("queries", "found", "docs", F.round(F.col("found") / F.col("queries"), 4).alias("recall"))
