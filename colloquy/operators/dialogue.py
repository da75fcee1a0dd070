"""Conversation classifiers and aggregates: keywords, profiles, topics, segments, intents, tasks, knowledge."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import rules
from .facts import seconds_between
from .ordered import carried
from .search import tokens


def words(text: Column) -> Column:
    """CJK characters and runs of letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\x{4E00}-\x{9FFF}]|[a-zA-Z0-9]+"), F.lit(0))


def _top(counts: DataFrame, by: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("n"), "term")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def segment_keywords(rows: DataFrame, by: str, top: int = 5) -> DataFrame:
    """The most frequent words of each segment, longer than a character and no stop word; ties by word."""
    t = rows.select(by, F.explode(words(F.col("text"))).alias("term"))
    counts = t.where((F.length("term") > 1) & ~F.col("term").isin(*rules.STOP_WORDS)).groupBy(by, "term").agg(F.count(F.lit(1)).alias("n"))
    return _top(counts, [by], top)


def profiles(chat: DataFrame, terms: int = 5, quotes: int = 3) -> DataFrame:
    """Each speaker's messages, mean length, role, most frequent terms and longest quotes of 6 to 80 characters."""
    size = F.length("text")
    by = chat.groupBy("sender").agg(F.count(F.lit(1)).alias("messages"), F.avg(size).alias("mean"), F.count_if(F.col("text").rlike("[?？]")).alias("asks"))
    total = chat.agg(F.count(F.lit(1)).alias("total"))  # one row
    role = (
        F.when(F.col("mean") > 40, "writer")
        .when(F.col("asks") > 0.3 * F.col("messages"), "asker")
        .when(F.col("messages") >= F.greatest(F.lit(5.0), 0.2 * F.col("total")), "core")
        .otherwise("active")
    )
    counts = chat.select("sender", F.explode(tokens(F.col("text"))).alias("term")).where(F.length("term") >= 2).groupBy("sender", "term").agg(F.count(F.lit(1)).alias("n"))
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", c))), lambda e: e[c]), "|")
    top = _top(counts, ["sender"], terms).groupBy("sender").agg(listed("term").alias("terms"))
    longest = Window.partitionBy("sender").orderBy(F.desc(size), "id")
    said = chat.where(size.between(6, 80)).withColumn("rank", F.row_number().over(longest)).where(F.col("rank") <= quotes).groupBy("sender").agg(listed("text").alias("quotes"))
    out = by.crossJoin(F.broadcast(total)).join(top, "sender", "left").join(said, "sender", "left")
    return out.select("sender", "messages", F.round("mean", 4).alias("mean_length"), role.alias("role"), "terms", "quotes")


def topics(segments: DataFrame, by: list[str], most: int = 8) -> DataFrame:
    """Clusters of segments around the terms of most weight: n * (ln((segments + 1) / (df + 1)) + 1), summed.

    A segment goes to that of the 3 * most seed terms which it has most of (ties to the heavier); the largest
    clusters stay. Seeds are a bounded table, so the segments are joined with a broadcast one.
    """
    t = segments.select(*by, F.explode(tokens(F.col("text"))).alias("term")).where((F.length("term") >= 2) & ~F.col("term").isin(*rules.STOP_WORDS))
    counts = t.groupBy(*by, "term").agg(F.count(F.lit(1)).alias("n"))
    n = counts.select(*by).distinct().agg(F.count(F.lit(1)).alias("segments"))
    weights = counts.groupBy("term").agg(F.sum("n").alias("tf"), F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n))
    score = F.round(F.col("tf") * (F.log((F.col("segments") + 1) / (F.col("df") + 1)) + 1), 6)
    seeds = weights.select("term", score.alias("weight")).orderBy(F.desc("weight"), "term").limit(3 * most)
    best = counts.join(F.broadcast(seeds), "term").groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("n"), (-F.col("weight")).alias("weight"), "term")).alias("m"))
    return (
        best.select(F.col("m.term").alias("topic"), (-F.col("m.n")).alias("n"))
        .groupBy("topic")
        .agg(F.count(F.lit(1)).alias("segments"), F.sum("n").alias("mentions"))
        .orderBy(F.desc("segments"), "topic")
        .limit(most)
    )


def brand_periods(chat: DataFrame, brands: dict[str, str], unit: str = "month") -> DataFrame:
    """Mentions of brands and who made them by period; primary is the most named, emerging one that rose fivefold."""
    names = F.create_map(*[F.lit(x) for pair in brands.items() for x in pair])
    pattern = "(" + "|".join(brands) + ")"
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(1)))
    m = chat.select(F.to_date(F.date_trunc(unit, "ts")).alias("period"), "sender", F.explode(F.transform(found, lambda x: names[x])).alias("brand"))
    s = m.groupBy("period", "brand").agg(F.count(F.lit(1)).alias("mentions"), F.count_distinct("sender").alias("senders"))
    before = F.coalesce(F.lag("mentions").over(Window.partitionBy("brand").orderBy("period")), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("period").orderBy(F.desc("mentions"), "brand"))
    confidence = F.when(F.col("senders") >= 5, "high").when(F.col("senders") >= 2, "medium").otherwise("low")
    return s.select(
        "period", "brand", "mentions", "senders", (rank == 1).alias("is_primary"), confidence.alias("confidence"),
        ((F.col("mentions") > 2) & (before < 0.2 * F.col("mentions"))).alias("emerging"),
    )


def with_topics(rows: DataFrame, table: tuple = rules.TOPICS, text: str = "text", tools: str = "tools", name: str = "topic") -> DataFrame:
    """rows with the id of the topic of most points, 0 for none; the first in the table wins ties.

    A topic is (id, words, tools, code, confirming words): 2 points for each word that the text holds, 3 for each tool that
    `tools` holds, and where the pattern `code` stands in the text 3 with a confirming word in it and 1 without; letters of
    either case alike. One automaton finds the words of all topics in one reading of a text, so a long table costs no more;
    null texts hold nothing.
    """
    table = [(i, [w.lower() for w in ws], [x.lower() for x in ts], code, [w.lower() for w in sure]) for i, ws, ts, code, sure in table]
    schema = StructType([*rows.schema, StructField(name, IntegerType())])
    at, at_tools = rows.columns.index(text), rows.columns.index(tools)

    def classified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        finder = ahocorasick.Automaton()
        for w in {w for _, ws, ts, _, sure in table for w in (*ws, *ts, *sure)}:
            finder.add_word(w, w)
        finder.make_automaton()
        codes = [code and re.compile(code) for *_, code, _ in table]
        held = lambda x: {w for _, w in finder.iter(x)} if len(finder) and x else set()

        def best(said: str, used: str) -> int:
            words, own, top, found = held(said), held(used), 0, 0
            for (i, ws, ts, _, sure), code in zip(table, codes):
                points = 2 * sum(w in words for w in ws) + 3 * sum(x in own for x in ts)
                if code and code.search(said):
                    points += 3 if any(w in words for w in sure) else 1
                if points > top:
                    top, found = points, i
            return found

        for batch in batches:
            low = [[(x or "").lower() for x in batch.column(k).to_pylist()] for k in (at, at_tools)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(best, *low), pa.int32())], names=[*batch.schema.names, name])

    return rows.mapInArrow(classified, schema)


def topic_stats(rows: DataFrame) -> DataFrame:
    """Rows, sessions, tokens, cost at $3 a million tokens, share of cost and span by topic."""
    g = (
        rows.groupBy("topic")
        .agg(
            F.count(F.lit(1)).alias("messages"), F.count_distinct("session_id").alias("sessions"),
            F.sum("tokens").alias("tokens"), F.min("ts").alias("first"), F.max("ts").alias("last"),
        )
    )
    return g.withColumn("cost", F.round(F.col("tokens") * 3 / 1e6, 6)).withColumn("share", F.round(F.col("tokens") / F.sum("tokens").over(Window.partitionBy()), 4))  # one row a topic


def participants(chat: DataFrame, quotes: int = 20) -> DataFrame:
    """Messages, hour histogram and newest quotes of each sender, as a profile that merge_profiles adds up."""
    hours = (
        chat.groupBy("sender", F.hour("ts").alias("hour"))
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("sender")
        .agg(F.sum("n").alias("messages"), F.map_from_entries(F.collect_list(F.struct("hour", "n"))).alias("hours"))
    )
    newest = Window.partitionBy("sender").orderBy(F.desc("ts"), F.desc("id"))
    said = (
        chat.withColumn("k", F.row_number().over(newest))
        .where(F.col("k") <= quotes)
        .groupBy("sender")
        .agg(F.array_sort(F.collect_list(F.struct("ts", "id", F.substring("text", 1, 60).alias("text")))).alias("quotes"))
    )
    return hours.join(said, "sender")


def merge_profiles(old: DataFrame, new: DataFrame, quotes: int = 20) -> DataFrame:
    """Profiles of both, added; the newest quotes stay, so merging is associative."""
    o, n = old.select("sender", F.struct("messages", "hours", "quotes").alias("o")), new.select("sender", F.struct("messages", "hours", "quotes").alias("n"))
    both = o.join(n, "sender", "full_outer")
    zero = F.lit(0).cast("long")
    hours = (
        F.when(F.col("o").isNull(), F.col("n.hours"))
        .when(F.col("n").isNull(), F.col("o.hours"))
        .otherwise(F.map_zip_with("o.hours", "n.hours", lambda k, a, b: F.coalesce(a, zero) + F.coalesce(b, zero)))
    )
    every = F.array_sort(F.concat(F.coalesce("o.quotes", F.slice("n.quotes", 1, 0)), F.coalesce("n.quotes", F.slice("o.quotes", 1, 0))))
    kept = F.slice(every, F.greatest(F.size(every) - quotes + 1, F.lit(1)), quotes)
    return both.select("sender", (F.coalesce("o.messages", zero) + F.coalesce("n.messages", zero)).alias("messages"), hours.alias("hours"), kept.alias("quotes"))


def roundup(chat: DataFrame, picks: int = 6) -> DataFrame:
    """The longest messages of each chat and day, without those whose first URL or normalised text came earlier."""
    url = F.regexp_extract("text", rules.URL, 0)
    norm = F.regexp_replace(F.lower(F.col("text")), r"[\s\pP]+", "")
    m = chat.where(F.trim("text") != "").withColumn("at", F.struct("ts", "id")).withColumn("url", F.when(url != "", url)).withColumn("norm", F.when(F.length(norm) >= 12, F.md5(norm)))
    # first of each key by aggregation: a key of very many messages is combined before it is shuffled
    keys = m.select(F.explode(F.array_compact(F.array("url", "norm"))).alias("key"), "at").groupBy("key").agg(F.min("at").alias("first"))
    repeats = m.select("id", "at", F.explode(F.array_compact(F.array("url", "norm"))).alias("key")).join(keys, "key").where("at > first").select("id").distinct()
    w = Window.partitionBy("chat_id", "day").orderBy(F.desc(F.length("text")), "id")
    kept = m.join(repeats, "id", "left_anti").withColumn("day", F.to_date("ts"))
    return kept.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= picks).select("day", "chat_id", "pick", "id")


def intents(rows: DataFrame, text: str = "text") -> DataFrame:
    """The intent of each text: length * weight * (1 + position / (2 * length of the text)) over its keywords."""
    low = F.lower(F.col(text))
    whole = F.greatest(F.length(low), F.lit(1))

    def score(weight: float, keys: tuple) -> Column:
        table = F.transform(F.array(*[F.lit(k) for k in keys]), lambda k: F.struct(F.length(k).alias("size"), F.instr(low, k).alias("at")))
        return F.aggregate(F.filter(table, lambda x: x["at"] > 0), F.lit(0.0), lambda acc, x: acc + x["size"] * F.lit(weight) * (1 + 0.5 * ((x["at"] - 1) / whole)))

    def hits(keys: tuple) -> Column:
        return F.size(F.filter(F.array(*[F.lit(k) for k in keys]), lambda k: F.contains(low, k)))

    ranked = F.reverse(
        F.array_sort(
            F.array(
                *[F.struct(F.round(score(w, ks), 6).alias("score"), F.lit(-i).alias("place"), F.lit(name).alias("intent"), hits(ks).alias("hits")) for i, (name, (w, ks)) in enumerate(rules.INTENTS.items())],
            ),
        ),
    )
    r = rows.withColumn("ranked", ranked)
    best, second = F.col("ranked")[0], F.col("ranked")[1]
    sure = best["score"] / (best["score"] + second["score"])
    confidence = F.when(best["score"] == 0, 0.0).otherwise(F.least(F.lit(1.0), sure + F.when(best["hits"] >= 3, 0.1).otherwise(0.0)))
    return r.withColumn("intent", F.when(best["score"] > 0, best["intent"]).otherwise("UNKNOWN")).withColumn("confidence", F.round(confidence, 4)).drop("ranked")


def task_of(text: Column, usage: Column) -> Column:
    """Task of a session from its tool counts (a map) and its text; the first of the categories wins ties."""
    counts = F.map_values(usage)
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    of = lambda ts: sum((F.coalesce(F.element_at(usage, F.lit(t)), F.lit(0).cast("long")) for t in ts), F.lit(0).cast("long"))
    scored = []
    for i, (name, tools) in enumerate(rules.TASK_TOOLS.items()):
        mine, vague = of(tools), of([t for t in tools if t in rules.AMBIGUOUS_TOOLS])
        share = F.when(mine > 0, mine / total * 6 * F.when(vague / mine < 0.6, 1.0).otherwise(0.5)).otherwise(0.0)
        boost = sum((F.contains(text, F.lit(k)).cast("int") for k in rules.TASK_WORDS[name]), F.lit(0))
        scored.append(F.struct(F.round(F.when(share > 0.1, share).otherwise(0.0) + 0.5 * F.least(boost, F.lit(3)), 6).alias("score"), F.lit(-i).alias("place"), F.lit(name).alias("task")))
    best = F.array_max(F.array(*scored))
    return F.when(F.coalesce(total, F.lit(0)) == 0, "闲聊/纯对话").when(best["score"] == 0, "综合协作").otherwise(best["task"])


def says(text: Column, phrases: tuple[str, ...]) -> Column:
    """Whether a text's plain words hold one of the phrases."""
    plain = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower(text), F.lit(rules.PLAIN_WORD), F.lit(0)), " "), F.lit(" "))
    return plain.rlike(rules.spoken(phrases))


def knowledge(messages: DataFrame) -> DataFrame:
    """Values, corrections, approved approaches and references in user messages; one of each opening of 80 characters."""
    w = Window.partitionBy("session_id").orderBy("seq")
    said = F.last(F.when(F.col("role") == "ASSISTANT", F.substring("text", 1, 500)), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    u = messages.withColumn("said", said).where((F.col("role") == "USER") & (F.length("text") >= 5))
    text = F.col("text")
    item = lambda kind, place, content: F.struct(F.lit(kind).alias("category"), F.lit(place).alias("place"), content.alias("content"))
    fixed = F.array_compact(F.array(
        F.when(says(text, rules.PREFERENCES), item("value", 0, F.substring(text, 1, 300))),
        F.when(says(text, rules.REFUSALS), item("correction", 1, F.substring(text, 1, 300))),
        F.when(says(text, rules.PRAISES) & (F.coalesce("said", F.lit("")) != ""), item("pattern", 2, F.concat(F.lit("Approach approved: "), F.substring("said", 1, 200)))),
    ))
    links = F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(rules.URL), F.lit(0))), lambda x: item("reference", 3, F.concat(F.lit("URL mentioned: "), x)))
    rows = u.select("session_id", "seq", F.explode(F.concat(fixed, links)).alias("i")).select("session_id", "seq", "i.*")
    first = rows.groupBy("session_id", F.substring("content", 1, 80).alias("opening")).agg(F.min(F.struct("place", "seq", "category")).alias("m"))
    return first.select("session_id", F.col("m.category").alias("category"), F.col("m.seq").alias("seq"), "opening")


def segment_sessions(messages: DataFrame, gap: int = 300, overlap: float = 0.1, apart: int = 5, most: int = 20) -> DataFrame:
    """(session_id, segment, start, messages): cuts at gaps and where three messages share few words with the three before.

    Cuts closer than `apart` messages to the last one kept fall; that is a fold over a session's own cuts.
    """
    w = Window.partitionBy("session_id").orderBy("seq")
    m = messages.withColumn("i", F.row_number().over(w) - 1).withColumn("own", F.array_distinct(words(F.col("text")))).withColumn("since", seconds_between(F.lag("ts").over(w), F.col("ts")))
    gather = lambda lo, hi: F.array_distinct(F.flatten(F.collect_list("own").over(w.rowsBetween(lo, hi))))
    m = m.withColumn("before", gather(-3, -1)).withColumn("now", gather(0, 2))
    soft = (F.col("i") >= 3) & (F.size("before") > 0) & (F.size("now") > 0) & (F.size(F.array_intersect("before", "now")) / F.size("before") < overlap)
    cut = (F.col("i") > 0) & (F.coalesce(F.col("since") > gap, F.lit(False)) | soft)
    none = F.array().cast("array<int>")
    s = m.groupBy("session_id").agg(F.count(F.lit(1)).cast("int").alias("messages"), F.array_sort(F.collect_list(F.when(cut, F.col("i")))).alias("cuts"))
    fold = F.aggregate("cuts", F.array(F.lit(0)), lambda kept, c: F.when((c - F.element_at(kept, -1) >= apart) & (F.size(kept) < most), F.concat(kept, F.array(c))).otherwise(kept))
    starts = s.withColumn("starts", F.when(F.col("messages") >= 3, fold).otherwise(F.concat(none, F.array(F.lit(0)))))
    rows = starts.select("session_id", F.col("messages").alias("total"), "starts", F.posexplode("starts").alias("segment", "start"))
    end = F.coalesce(F.get("starts", F.col("segment") + 1), F.col("total"))
    return rows.select("session_id", "segment", "start", (end - F.col("start")).alias("messages"))


def simhash(terms: Column) -> Column:
    """64-bit SimHash of an array of terms; 0 for none."""
    hashes = F.transform(terms, lambda t: F.xxhash64(t))

    def bit(i: Column) -> Column:
        ones = F.aggregate(hashes, F.lit(0), lambda n, h: n + F.call_function("getbit", h, i).cast("int"))
        return F.when(2 * ones > F.size(terms), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), bit), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def simhashes(rows: DataFrame, keys: list[str], terms: str = "terms") -> DataFrame:
    """keys and h, the 64-bit SimHash of the terms of all rows of equal keys, each bit a sum over them; 0 for none."""
    h = F.col("__h")
    bits = [F.sum(F.shiftright(h, i).bitwiseAND(F.lit(1).cast("long"))).alias(f"__{i}") for i in range(64)]
    counted = rows.select(*keys, F.explode_outer(terms).alias("__t")).withColumn("__h", F.when(F.col("__t").isNotNull(), F.xxhash64("__t"))).groupBy(*keys).agg(F.count(h).alias("__n"), *bits)
    value = F.lit(0).cast("long")
    for i in range(64):
        value = value.bitwiseOR(F.when(2 * F.col(f"__{i}") > F.col("__n"), F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return counted.select(*keys, value.alias("h"))


def simhash_segments(chat: DataFrame, by: list[str], threshold: int = 22, gap: int = 7200) -> DataFrame:
    """(by, segment, first_id, messages): a new segment where the rolling hash is far or the pause is long.

    A pause over `gap` seconds cuts whatever the hash is, so the messages between two pauses are a run of their own. The
    hash rolls on within a run: its messages go through a task in order, which holds one hash and one count.
    """
    timed = chat.select(*by, "id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), tokens(F.col("text")).alias("terms"))
    m = simhashes(timed, [*by, "id", "at"])
    m = carried(m.withColumn("hour", F.floor(F.col("at") / 3_600_000_000)), by, "hour", ["at", "id"], {}, {"before": F.col("at")})
    pause = F.coalesce(F.col("at") - F.col("before") > gap * 1_000_000, F.lit(True))
    m = carried(m.withColumn("pause", pause.cast("int")), by, "hour", ["at", "id"], {"run": F.col("pause")}).drop("before", "hour", "pause")
    schema = m.select(*by, "run", F.col("id").alias("first_id"), F.col("at").alias("first_at"), F.lit(0).alias("messages")).schema
    arrow, low32, mask = to_arrow_schema(schema), (1 << 32) - 1, (1 << 64) - 1

    def told(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [[]] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rolling, begun, n = None, 0, (), 0
        for batch in batches:
            out = []
            for *key, number, at, h in zip(*(c.to_pylist() for c in batch.columns)):
                h &= mask
                if key != own or (rolling ^ h).bit_count() > threshold:
                    if n:
                        out.append((*own, *begun, n))
                    own, rolling, begun, n = key, h, (number, at), 1
                else:
                    rolling, n = (rolling & h) | ((rolling | h) & low32), n + 1
            yield told(out)
        if n:
            yield told([(*own, *begun, n)])

    ordered = m.repartition(*by, "run").sortWithinPartitions(*by, "run", "at", "id").select(*by, "run", "id", "at", "h")
    segments = ordered.mapInArrow(fold, schema).withColumn("hour", F.floor(F.col("first_at") / 3_600_000_000))
    numbered = carried(segments, by, "hour", ["first_at", "first_id"], {"place": F.lit(1)})
    return numbered.select(*by, (F.col("place") - 1).cast("int").alias("segment"), "first_id", "messages")


#: Named sets of blocks, each a function of the chat's messages.
BLOCKS = {"profiles": profiles, "participants": participants, "segments": lambda c: simhash_segments(c.withColumn("day", F.to_date("ts")), ["chat_id", "day"]), "roundup": roundup, "brands": lambda c: brand_periods(c, rules.BRANDS)}
MODES = {"quick": ("profiles",), "people": ("profiles", "participants"), "topics": ("segments", "brands"), "full": tuple(BLOCKS)}


def analyse(chat: DataFrame, mode: str) -> dict[str, DataFrame]:
    """The blocks of a mode; those it does not name are not planned."""
    return {b: BLOCKS[b](chat) for b in MODES[mode]}
