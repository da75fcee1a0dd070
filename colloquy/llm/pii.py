"""Personal data: base patterns, and identifiers found by bootstrapped contexts; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import attach, materialise

# The base patterns, written so that a scan never tries the same run twice, in the order of the kinds.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = (*BASE, "context")
#: An identifier's form: five characters or more without white space, a digit among them, letters or digits at both ends.
IDENTIFIER = r"(?:(?<![A-Za-z0-9_@.+:/-])|(?<=(?<![A-Za-z0-9_@.+:/-]):))(?=[A-Za-z_@.+:/-]*+[0-9])[A-Za-z0-9][A-Za-z0-9_@.+:/-]{3,}[A-Za-z0-9]"
LABELS = r"(?:token|secret|passwd|password|passphrase|api[_ -]?key|access[_ -]?key|private[_ -]?key|ssn|passport|iban)"
#: Labels that make the value behind them a seed.
LABEL = LABELS + r"[\"']?\s*[:=]\s*[\"']?$"
#: Words before a colon without a space, which belong to the context; groups of an address in hexadecimal do not.
LEAD = r"^(?:(?![0-9A-Fa-f]{1,4}:)[A-Za-z_.-]++:(?!/)|(?i:[A-Za-z0-9_@.+/-]*?" + LABELS + r":(?!/)))++"
#: The context before an identifier: the last word, what separates it, and an opening quote.
BEFORE = r"(?:[^\s:=\"'(<\[]{1,32}[\"']?\s{0,2}[:=]?\s{0,2}[\"'(<\[]?)$"

SPAN = "struct<start:int,kind:int,end:int>"
CANDIDATE = "struct<start:int,end:int,pattern:string,instance:string>"


def _luhn(match: Column) -> Column:
    digits = F.reverse(F.split(F.regexp_replace(match, "[^0-9]", ""), ""))
    numbers = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(numbers, F.lit(0), lambda s, d: s + d) % 10 == 0


def _fits(kind: str, match: Column) -> Column:
    n = F.length(F.regexp_replace(match, "[^0-9]", ""))
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.substring(F.regexp_replace(p, "^0+(?=.)", ""), 1, 4).cast("int") <= 255))
    if kind == "card":
        return n.between(14, 19) & F.when(n.between(14, 19), _luhn(match)).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(numbers: Column, of: Callable[[Column, Column], Column]) -> Column:
    """of(first, ..., n-th) at each place n of a non-empty array<int> of numbers from 0 on; of is a sum or a maximum.

    The array is cut into about as many blocks as each has numbers, so long texts take n * sqrt(n) steps.
    """
    zero = F.lit(0)
    fold = lambda xs: F.aggregate(xs, zero, of)

    def with_heads(s: Column) -> Column:
        heads = F.transform(s["sums"], lambda _, k: fold(F.slice(s["sums"], 1, k)))
        within = lambda i: F.slice(s["n"], i - i % s["w"] + 1, i % s["w"] + 1)
        place = lambda i: F.floor(i / s["w"]).cast("int") + 1
        return _let(heads, lambda h: F.transform(s["n"], lambda _, i: of(F.element_at(h, place(i)), fold(within(i)))))

    def in_blocks(s: Column) -> Column:
        blocks = F.sequence(zero, F.ceil(F.size(s["n"]) / s["w"]).cast("int") - 1)
        sums = F.transform(blocks, lambda k: fold(F.slice(s["n"], k * s["w"] + 1, s["w"])))
        return _let(F.struct(s["n"].alias("n"), s["w"].alias("w"), sums.alias("sums")), with_heads)

    return _let(numbers, lambda n: _let(F.struct(n.alias("n"), F.ceil(F.sqrt(F.size(n))).cast("int").alias("w")), in_blocks))


def _places(text: Column, pattern: str) -> Column:
    """array<struct(start, end, match, before)>, in code points: the pieces between matches give the places."""
    none = F.array().cast("array<struct<start:int,end:int,match:string,before:string>>")

    def placed(s: Column) -> Column:
        pairs = F.zip_with(
            F.slice(s["pieces"], 1, F.size(s["matches"])), s["matches"],
            lambda p, m: F.struct(F.length(p).alias("skip"), F.length(m).alias("n"), m.alias("match"), F.right(p, F.lit(72)).alias("before")),
        )
        ends = lambda x: _running(F.transform(x, lambda y: y["skip"] + y["n"]), lambda a, b: a + b)
        told = lambda y, end: F.struct((end - y["n"]).alias("start"), end.alias("end"), y["match"].alias("match"), y["before"].alias("before"))
        return F.when(F.size(s["matches"]) > 0, _let(pairs, lambda x: F.zip_with(x, ends(x), told))).otherwise(none)

    return _let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"), F.split(text, pattern, -1).alias("pieces")), placed)


def _spans_of(text: Column, number: int, kind: str, pattern: str) -> Column:
    fitting = F.filter(_places(text, pattern), lambda m: _fits(kind, m["match"]))
    return F.transform(fitting, lambda m: F.struct(m["start"].alias("start"), F.lit(number).alias("kind"), m["end"].alias("end")))


def _count(number: int) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == number)).cast("long")


def base_spans(text: Column) -> Column:
    """array<struct(start, kind, end)> of the base kinds, by start and kind."""
    has_digit = text.rlike("[0-9]")
    found = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        ready = F.instr(text, "@") > 0 if kind == "email" else has_digit & (F.instr(text, "+") > 0) if kind == "phone" else has_digit & (F.instr(text, ".") > 0) if kind == "ip" else has_digit
        spans = _spans_of(text, k, kind, pattern)
        found.append(F.when(ready, spans).otherwise(F.array().cast(f"array<{SPAN}>")))
    return F.array_sort(F.concat(*found))


def candidates(text: Column) -> Column:
    """array<struct(start, end, pattern, instance)>: identifiers with the lexical pattern before them and their form."""

    def shaped(m: Column) -> Column:
        label = F.regexp_extract(m["match"], LEAD, 0)
        value = F.substr(m["match"], F.length(label) + 1)
        before = F.right(F.concat(m["before"], label), F.lit(72))
        lead = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract(before, BEFORE, 0), r"\s+", " "), "[0-9]+", "#"))
        form = F.when(value.rlike("^[0-9]+$"), F.concat(F.lit("d"), F.length(value))).when(value.rlike("^[0-9a-fA-F]+$"), F.concat(F.lit("x"), F.length(value))).otherwise(F.lit("w"))
        start = m["start"] + F.length(label)
        return F.struct(start.alias("start"), m["end"].alias("end"), F.concat(lead, F.lit(" "), form).alias("pattern"), F.md5(value).alias("instance"), F.lower(before).rlike(LABEL).alias("seed"))

    long_enough = lambda c: c["end"] - c["start"] >= 5
    return (
        F.when(text.rlike("[0-9]"), F.filter(F.transform(_places(text, IDENTIFIER), shaped), long_enough))
        .otherwise(F.array().cast("array<struct<start:int,end:int,pattern:string,instance:string,seed:boolean>>"))
    )


def discover(found: DataFrame, confidence: float = 0.5, z: float = 1.2816) -> DataFrame:
    """Patterns worth trusting, with their confidence, from found(pattern, instance, seed).

    An instance that is a seed anywhere has score 1. A pattern's confidence is the lower bound (Wilson, one-sided at 90% by `z`) of the share of
    its different instances that are known, each counted by its score; it is trusted from `confidence` on. For a
    pattern, an instance's score is 1 less the product of what its other trusted patterns leave in doubt, so no
    pattern backs itself. Confidences are cut to hundredths and never fall from round to round, so the rounds on
    the graph of patterns and instances end, when a round changes nothing.
    """
    seeds = found.where("seed").select(F.col("instance").alias("__instance")).distinct().withColumn("seed", F.lit(1.0))
    edges = found.select("pattern", "instance").distinct()
    edges = edges.join(seeds, edges["instance"] == seeds["__instance"], "left").select("pattern", "instance", F.coalesce("seed", F.lit(0.0)).alias("seed"))
    edges = materialise(edges, "pattern-edges")
    now, mark = edges.withColumn("score", F.col("seed")), None
    while True:
        means = now.groupBy("pattern").agg((F.sum("score") / F.count(F.lit(1))).alias("share"), F.count(F.lit(1)).alias("n"))
        share, n, zz = F.col("share"), F.col("n"), z * z
        bound = (share + zz / (2 * n) - z * F.sqrt(share * (1 - share) / n + zz / (4 * n * n))) / (1 + zz / n)
        trusted = materialise(means.select("pattern", (F.floor(bound * 100 + 1e-6) / 100).alias("confidence")).where(F.col("confidence") >= confidence), "patterns")
        told = trusted.agg(F.count(F.lit(1)), F.sum(F.round(F.col("confidence") * 100).cast("long"))).first()
        if told == mark:
            return trusted
        mark = told
        scored = attach(edges, trusted, ["pattern"], F.col("instance")).withColumn("doubt", F.log(F.greatest(F.lit(1.0) - F.coalesce("confidence", F.lit(0.0)), F.lit(1e-6))))
        total = scored.groupBy("instance").agg(F.sum("doubt").alias("total")).where("total < 0").withColumnRenamed("instance", "__instance")
        others = F.lit(1.0) - F.exp(F.least(F.coalesce("total", F.lit(0.0)) - F.col("doubt"), F.lit(0.0)))
        joined = scored.join(total, scored["instance"] == total["__instance"], "left")
        now = joined.select("pattern", "instance", F.greatest("seed", F.round(others, 9)).alias("score"))


def _events() -> Column:
    """Base spans at their starts, candidates at their ends and, where both meet, first."""
    base = lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("is_base"), b["start"].alias("start"), b["end"].alias("end"), F.lit(None).cast("string").alias("pattern"), F.lit(None).cast("string").alias("instance"), F.lit(False).alias("seed"))
    own = lambda c: F.struct(c["end"].alias("at"), F.lit(0).alias("is_base"), c["start"].alias("start"), c["end"].alias("end"), c["pattern"].alias("pattern"), c["instance"].alias("instance"), c["seed"].alias("seed"))
    return F.concat(F.transform("base", base), F.transform("found", own))


def find(docs: DataFrame, **params) -> DataFrame:
    """doc_id, __key (hash of the text) and spans array<struct(start, kind, end)> of base kinds and contexts.

    kind counts in KINDS; base spans always stay, context spans (behind a label, or of a trusted pattern) are added
    where no base span overlaps.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("__key"), text.alias("__text"))
    rows = rows.select("doc_id", "__key", base_spans(F.col("__text")).alias("base"), candidates(F.col("__text")).alias("found"))
    rows = materialise(rows, "spans")
    events = rows.where(F.size("found") > 0).select("doc_id", "__key", F.monotonically_increasing_id().alias("row"), F.explode(_events()).alias("e")).select("doc_id", "__key", "row", "e.*")
    # of the base spans that start before a candidate ends, the one that ends last overlaps it or none does
    before = Window.partitionBy("row").orderBy("at", "is_base").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max(F.when(F.col("is_base") == 1, F.col("end"))).over(before)
    marked = materialise(events.withColumn("known", F.coalesce(reach > F.col("start"), F.lit(False))).where("is_base = 0").drop("row", "at", "is_base"), "candidates")
    trusted = discover(marked.select("pattern", "instance", (F.col("known") | F.col("seed")).alias("seed")), **params)
    new = attach(marked.where("NOT known"), trusted, ["pattern"], F.xxhash64("doc_id", "start")).where(F.col("seed") | F.col("confidence").isNotNull())
    new = new.groupBy("doc_id", "__key").agg(F.sort_array(F.collect_set(F.struct("start", F.lit(len(BASE)).alias("kind"), "end"))).alias("new"))
    new = new.select(F.col("doc_id").alias("__id"), F.col("__key").alias("__new_key"), "new")
    joined = rows.join(new, rows["doc_id"].eqNullSafe(new["__id"]) & (rows["__key"] == new["__new_key"]), "left")
    spans = F.array_sort(F.concat("base", F.coalesce("new", F.array().cast(f"array<{SPAN}>"))))
    return joined.select("doc_id", "__key", "base", spans.alias("spans"))


def _told(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, **params) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of every document.

    Null and empty texts have no spans. Places are code points, ends exclusive. Repeated rows, and copies, are
    told each. A null doc_id stays null. An empty table gives no rows. Other columns are ignored.
    """
    counts = [_count(k).alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    return find(docs, **params).select("doc_id", *counts, F.sha2(_told(F.col("base")), 256).alias("base_sha256"), _told(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, **params) -> DataFrame:
    """docs with every span replaced by its kind in angle brackets; overlapping spans become one."""
    found = find(docs, **params).where(F.size("spans") > 0).select(F.col("doc_id").alias("__id"), "__key", F.col("spans").alias("__spans")).dropDuplicates(["__id", "__key"])
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.withColumn("__text_key", key)
    joined = rows.join(found, rows["doc_id"].eqNullSafe(found["__id"]) & (F.col("__text_key") == F.col("__key")), "left")
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def pieces(between: Callable[[Column, Column], Column]) -> Column:
        """What stands before each span and the span's kind, or what an overlapping span adds: nothing."""

        def piece(x: Column, at: Column) -> Column:
            return F.concat(F.when(x["start"] > at, between(at, x["start"])).otherwise(""), F.when(x["start"] >= at, F.element_at(names, x["kind"] + 1)).otherwise(""))

        reached = _running(F.transform("__spans", lambda x: x["end"]), lambda a, b: F.greatest(a, b))
        cut = lambda ends: F.zip_with("__spans", F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.size(ends) - 1)), piece)
        return _let(reached, lambda ends: F.concat(F.array_join(cut(ends), ""), between(F.element_at(ends, -1), F.lit(2**31 - 1))))

    few = pieces(lambda a, b: F.substring("text", a + 1, b - a))
    # substring counts from the text's beginning, so for many spans its characters are taken apart once
    chars = F.regexp_extract_all(F.col("text"), F.lit("(?s)."), F.lit(0))
    many = _let(chars, lambda c: pieces(lambda a, b: F.array_join(F.slice(c, a + 1, F.least(b, F.size(c)) - a), "")))
    masked = F.when(F.size("__spans") <= 64, few).otherwise(many)
    out = joined.withColumn("__text", F.when(F.col("__spans").isNotNull(), masked).otherwise(F.col("text")))
    length = F.coalesce(F.length("__text"), F.lit(0)).cast(dict(docs.dtypes).get("n_chars", "bigint"))
    return out.select(*[F.col("__text").alias("text") if c == "text" else F.when(F.col("__spans").isNull(), F.col(c)).otherwise(length).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])
