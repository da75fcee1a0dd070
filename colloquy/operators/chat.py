"""Conversation analytics: speakers, edges, sequences, signals, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import saved
from .facts import seconds_between
from .ordered import bordered, carried, ranked
from .search import tokens

# Fixed values.
DECISION = r"(?i)\b(decided|decision|agreed|conclusion|let's go with|we will use)\b|结论|决定|确定"
DEAL = ("预算", "报价", "合作", "budget", "quote", "deal")
COMMIT = ("明天给你", "发你", "will send", "i'll send")
POSITIVE = ("perfect", "good", "great", "thanks", "keep", "棒", "谢谢")
NEGATIVE = ("wrong", "bad", "error", "denied", "failed", "失败", "烦", "不好")
URL = r"https?://[^\s]+"


def speaker_ranking(chat: DataFrame) -> DataFrame:
    by = chat.groupBy("sender").agg(F.count(F.lit(1)).alias("messages"), F.sum(F.length("text")).alias("chars"), F.round(F.avg(F.length("text")), 4).alias("mean_length"))
    total = by.agg(F.sum("messages").alias("total"))  # one row
    shared = by.crossJoin(F.broadcast(total)).withColumn("share", F.round(F.col("messages") / F.col("total"), 4)).drop("total")
    return ranked(shared, [F.desc("messages"), F.asc("sender")])


def heatmap(rows: DataFrame, ts: str) -> DataFrame:
    r = rows.select(F.hour(ts).alias("hour"), F.weekday(ts).alias("weekday"))
    return r.groupingSets([["hour"], ["weekday"]], "hour", "weekday").agg(F.count(F.lit(1)).alias("n"))


def reply_edges(chat: DataFrame) -> DataFrame:
    """Sender of a reply to sender of the message it answers."""
    to = chat.select(F.col("id").alias("reply_to"), F.col("sender").alias("dst"))
    return chat.select(F.col("sender").alias("src"), "reply_to").join(to, "reply_to").select("src", "dst", F.lit("reply").alias("type"))


def mention_edges(chat: DataFrame) -> DataFrame:
    """@names that are known speakers."""
    named = chat.select(F.col("sender").alias("src"), F.explode(F.regexp_extract_all("text", F.lit(r"@([A-Za-z0-9_]+)"), F.lit(1))).alias("dst"))
    return named.join(chat.select(F.col("sender").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst", F.lit("mention").alias("type"))


def cooccurrence_edges(chat: DataFrame, ahead: int = 5, within: int = 300) -> DataFrame:
    """Different speakers among the next messages of a chat, up to `ahead` of them and `within` seconds.

    Windows go over a stretch of time of a chat with the messages that its last ones look at.
    """
    w = Window.partitionBy("chat_id", "bucket").orderBy("ts", "id").rowsBetween(1, ahead)
    timed = chat.select("chat_id", "id", "sender", "ts", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    r = bordered(timed, "at", 0, within + 1).withColumn("next", F.collect_list(F.struct("sender", "ts")).over(w)).where("own")
    near = F.filter("next", lambda n: (n["sender"] != F.col("sender")) & (seconds_between(F.col("ts"), n["ts"]) <= within))
    return r.select(F.col("sender").alias("src"), F.explode(near).alias("n")).select("src", F.col("n.sender").alias("dst"), F.lit("co_occurrence").alias("type"))


def relation_graph(chat: DataFrame, least: int = 2, within: int = 300) -> DataFrame:
    e = reply_edges(chat).unionByName(mention_edges(chat)).unionByName(cooccurrence_edges(chat, within=within)).where("src <> dst")
    return e.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"), F.array_join(F.sort_array(F.collect_set("type")), ",").alias("types")).where(F.col("weight") >= least)


def _any(text: Column, words: tuple) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def mood(text: Column) -> Column:
    """positive, negative or neutral by lexicon; a word behind not or don't counts the other way."""
    low = F.lower(text)
    hits = lambda words: sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))
    negated = lambda w: F.contains(low, F.lit(f"not {w}")) | F.contains(low, F.lit(f"don't {w}"))
    flipped = sum((negated(w).cast("int") for w in (*POSITIVE[:5], *NEGATIVE[:5])), F.lit(0))
    score = hits(POSITIVE) - hits(NEGATIVE) + flipped
    return F.when(score > 0, "positive").when(score < 0, "negative").otherwise("neutral")


def sentiment(chat: DataFrame) -> DataFrame:
    """Daily counts of messages by mood."""
    return chat.groupBy(F.to_date("ts").alias("day"), mood(F.col("text")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def trend_series(chat: DataFrame, top: int = 3, shortest: int = 2) -> DataFrame:
    """Each month's messages, senders, positive less negative messages, and most frequent terms (ties by term).

    Terms are counted by month before they are ranked, so a month's messages never meet in one task.
    """
    m = chat.withColumn("month", F.date_format("ts", "yyyy-MM")).withColumn("mood", mood(F.col("text")))
    net = F.count_if(F.col("mood") == "positive") - F.count_if(F.col("mood") == "negative")
    by = m.groupBy("month").agg(F.count(F.lit(1)).alias("messages"), F.count_distinct("sender").alias("active"), net.alias("net"))
    terms = m.select("month", F.explode(tokens(F.col("text"))).alias("term")).where(F.length("term") >= shortest)
    counts = terms.groupBy("month", "term").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("month").orderBy(F.desc("n"), "term")
    best = counts.withColumn("k", F.row_number().over(w)).where(F.col("k") <= top)
    listed = best.groupBy("month").agg(F.array_sort(F.collect_list(F.struct("k", "term"))).alias("t"))
    return by.join(listed.select("month", F.array_join(F.col("t")["term"], ",").alias("terms")), "month", "left")


def chat_stats(chat: DataFrame, kind: str = "kind", top: int = 10) -> DataFrame:
    """(of, name, n): all messages, those of each kind and hour, and of the `top` senders (ties by name), in one reading."""
    keys = {"kind": F.col(kind).cast("string"), "sender": F.col("sender"), "hour": F.hour("ts").cast("string")}
    each = chat.select(*[c.alias(k) for k, c in keys.items()])
    g = each.groupingSets([[k] for k in keys] + [[]], *keys).agg(F.count(F.lit(1)).alias("n"), *[F.grouping(k).alias(f"__{k}") for k in keys])
    of = F.coalesce(*[F.when(F.col(f"__{k}") == 0, k) for k in keys], F.lit("all"))
    g = saved(g.select(of.alias("of"), F.coalesce(*keys).alias("name"), "n"), "chat-stats")
    senders = g.where("of = 'sender'").orderBy(F.desc("n"), "name").limit(top)
    return g.where("of <> 'sender'").unionByName(senders)


def chat_list(chat: DataFrame, read: DataFrame, only_unread: bool = False) -> DataFrame:
    """Each chat's last message, its number of senders, and its unread messages: those after read(chat_id, read_ts), or all
    where nothing was read; with only_unread the chats that have any."""
    marks = read.groupBy("chat_id").agg(F.max("read_ts").alias("read_ts"))
    late = F.col("read_ts").isNull() | (F.col("ts") > F.col("read_ts"))
    # a chat of very many messages meets its one mark in a large partition, which Spark splits
    out = chat.join(marks, "chat_id", "left").groupBy("chat_id").agg(
        F.count_distinct("sender").alias("senders"), F.count_if(late).alias("unread"), F.max(F.struct("ts", "id", "sender", F.substring("text", 1, 40).alias("text"))).alias("m")
    )
    out = out.select("chat_id", "senders", "unread", F.col("m.ts").alias("last"), F.col("m.sender").alias("sender"), F.col("m.text").alias("opening"))
    return out.where("unread > 0") if only_unread else out


def members(chat: DataFrame, listed: DataFrame) -> DataFrame:
    """(chat_id, member, is_owner, messages): the members that listed(chat_id, member, is_owner) names, with the messages they
    sent; of chats that it does not know, their senders."""
    sent = chat.groupBy("chat_id", F.col("sender").alias("member")).agg(F.count(F.lit(1)).alias("messages"))
    named = listed.groupBy("chat_id", "member").agg(F.bool_or("is_owner").alias("is_owner")).join(sent, ["chat_id", "member"], "left")
    others = sent.join(listed.select("chat_id").distinct(), "chat_id", "left_anti").withColumn("is_owner", F.lit(False))
    return named.withColumn("messages", F.coalesce("messages", F.lit(0))).unionByName(others.select("chat_id", "member", "is_owner", "messages"))


def signals(chat: DataFrame) -> DataFrame:
    found = lambda words: F.filter(F.array(*[F.when(F.contains(F.lower("text"), F.lit(w)), F.lit(w)) for w in words]), lambda x: x.isNotNull())
    s = chat.select("id", "chat_id", found(DEAL).alias("deal"), found(COMMIT).alias("commit"))
    s = s.withColumn("kind", F.when(F.size("deal") > 0, "deal").when(F.size("commit") > 0, "commitment")).where("kind IS NOT NULL")
    words = F.concat("deal", "commit")
    return s.select("id", "chat_id", "kind", F.array_join(words, ",").alias("words"), F.when(F.size(words) >= 2, "high").otherwise("medium").alias("confidence"))


def chat_quality(chat: DataFrame) -> DataFrame:
    """Noise score of each chat from name, top sender's share, templated texts, links, cross-chat copies and questions."""
    norm = F.lower(F.regexp_replace(F.regexp_replace("text", URL, "<url>"), r"[0-9]+", "#"))
    flag = lambda name, pattern: F.count_if(F.col("text").rlike(pattern)).alias(name)
    # counted by template and chat first, so a template that very many messages copy has one row for each chat
    r = (
        chat.groupBy("chat_id", F.md5(norm).alias("norm"))
        .agg(F.min("chat_name").alias("chat_name"), F.count(F.lit(1)).alias("n"), F.count("text").alias("texts"), flag("links", URL), flag("asks", "[?？]"))
    )
    across = r.groupBy("norm").agg(F.count("chat_id").alias("chats")).where("chats >= 3").select("norm", F.lit(1).alias("copied"))
    s = (
        r.join(across, "norm", "left")
        .groupBy("chat_id")
        .agg(
            F.min("chat_name").alias("chat_name"), F.sum("n").alias("n"), (F.sum("links") / F.sum("texts")).alias("links"),
            (F.sum("asks") / F.sum("texts")).alias("asks"),
            F.sum(F.when(F.col("copied") == 1, F.col("n")).otherwise(0)).alias("copied"),
        )
    )
    top = chat.groupBy("chat_id", "sender").count().groupBy("chat_id").agg(F.max("count").alias("top"))
    s = s.join(top, "chat_id")
    score = F.when(F.col("chat_name").rlike("优惠|红包|福利|返利"), 30).otherwise(0) + F.when(F.col("top") / F.col("n") >= 0.8, 20).otherwise(0) + F.when(F.col("links") >= 0.5, 20).otherwise(0) + F.when(F.col("copied") / F.col("n") >= 0.3, 15).otherwise(0) + F.when(F.col("asks") < 0.05, 15).otherwise(0)
    return s.select("chat_id", "n", F.round("links", 4).alias("links"), score.alias("score"), F.when(score >= 60, "noise").when(score >= 40, "low").otherwise("normal").alias("level"))


def topic_boundaries(messages: DataFrame, gap: int = 300, threshold: float = 0.5) -> DataFrame:
    """Adjacent messages where a new topic begins: 0.4 for a long gap, 0.6 for words that do not recur."""
    w = Window.partitionBy("session_id").orderBy("seq")
    m = messages.withColumn("own", F.array_distinct(tokens(F.col("text"))))
    m = m.withColumn("before", F.lag("own").over(w)).withColumn("since", seconds_between(F.lag("ts").over(w), F.col("ts"))).where("before IS NOT NULL")
    content = F.when((F.size("own") == 0) | (F.size("before") == 0), 0.5).otherwise(1 - F.size(F.array_intersect("own", "before")) / F.size("own"))
    score = 0.4 * F.when(F.col("since") > gap, F.least(F.col("since") / 3600, F.lit(1.0))).otherwise(0.0) + 0.6 * content
    out = m.withColumn("score", score).where(F.col("score") > threshold)
    return out.select("session_id", "seq", F.round("score", 4).alias("score"), F.row_number().over(w).alias("label"))


def evidence_head(messages: DataFrame, most: int = 15) -> DataFrame:
    """The first user messages of each session, 300 characters each, and how many hold a decision."""
    w = Window.partitionBy("session_id").orderBy("seq")
    u = messages.where((F.col("role") == "USER") & (F.trim("text") != "")).withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
    head = F.array_sort(F.collect_list(F.struct("k", F.substring("text", 1, 300).alias("text"))))
    return u.groupBy("session_id").agg(F.array_join(F.transform(head, lambda e: e["text"]), "|").alias("evidence"), F.count_if(F.col("text").rlike(DECISION)).alias("decisions"))


def first_prompt(messages: DataFrame) -> DataFrame:
    wrapper = F.lower(F.trim("text")).rlike(r"^(hi|hello|ok|thanks)\b|^<")
    return messages.where((F.col("role") == "USER") & ~wrapper).groupBy("session_id").agg(F.min_by("text", "seq").alias("prompt"))


def tail_state(messages: DataFrame, short: int = 12) -> DataFrame:
    """to_reply if the last word is the user's and more than an acknowledgement, else waiting."""
    last = messages.groupBy("session_id").agg(F.max_by(F.struct("role", "text"), "seq").alias("m"))
    reply = (F.col("m.role") == "USER") & (F.length("m.text") > short)
    return last.select("session_id", F.col("m.role").alias("role"), F.when(reply, "to_reply").otherwise("waiting").alias("state"))


def reactivations(chat: DataFrame, now: str, days: int, top: int = 20) -> DataFrame:
    last = chat.groupBy("chat_id").agg(F.max(F.struct("ts", "id", "sender")).alias("m"))
    idle = F.datediff(F.lit(now).cast("date"), F.to_date("m.ts"))
    return (
        last.select("chat_id", F.col("m.ts").alias("last"), F.col("m.sender").alias("sender"), idle.alias("idle_days"))
        .where(F.col("idle_days") >= days)
        .orderBy(F.desc("idle_days"), "chat_id")
        .limit(top)
    )


def mine_context(chat: DataFrame, me: str, around: int = 2) -> DataFrame:
    """My messages with those around them, each shown once.

    Messages are numbered within their chat by running counts; windows go over a stretch of numbers and its neighbours.
    """
    numbered = chat.select("chat_id", "id", "sender", "ts", F.to_date("ts").alias("day"))
    numbered = carried(numbered, ["chat_id"], "day", ["ts", "id"], {"place": F.lit(1)})
    w = Window.partitionBy("chat_id", "bucket").orderBy("place").rowsBetween(-around, around)
    mine = (F.col("sender") == me).cast("int")
    return bordered(numbered, "place", around, around, 10_000).withColumn("near", F.max(mine).over(w)).where("own AND near = 1").select("id", "chat_id", (F.col("sender") == me).alias("mine"))


def corrections(messages: DataFrame, least: int = 20) -> DataFrame:
    """User texts that correct, one for each opening of 50 characters."""
    hit = F.lower("text").rlike(r"that's wrong|should be|不对|错了") & (F.length("text") >= least)
    u = messages.where((F.col("role") == "USER") & hit).withColumn("opening", F.substring("text", 1, 50))
    return u.groupBy("opening").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("session_id", "seq"))["session_id"].alias("session_id"))


def reciprocity(messages: DataFrame) -> DataFrame:
    """Mean lag of answers from one role to another."""
    w = Window.partitionBy("session_id").orderBy("seq")
    m = messages.withColumn("from_role", F.lag("role").over(w)).withColumn("lag", seconds_between(F.lag("ts").over(w), F.col("ts"))).where("from_role IS NOT NULL AND from_role <> role")
    return m.groupBy("from_role", "role").agg(F.count(F.lit(1)).alias("turns"), F.round(F.avg("lag"), 4).alias("mean_lag"))
