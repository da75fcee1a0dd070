"""Quality rules: robust multivariate outliers by the minimum covariance determinant."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import text_stats
from .tables import attach, materialise

#: Transformed statistics, and the least spread of each: a spread below it, as of a statistic that is constant in a
#: group, counts as this. Words and lines are few in a text, so their shares move in larger steps than characters'.
VECTOR = ("word_length", "symbols", "repeats", "dup_lines", "capitals", "marks")
FLOOR = (0.10, 0.05, 0.125, 0.125, 0.05, 0.05)
#: Estimates are made for all documents (level 0), each language (1), and each language and source (2).
GROUP = ["level", "lang", "source"]
BASE = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
PAIRS = [(i, j) for i in range(len(VECTOR)) for j in range(i, len(VECTOR))]


def vector() -> list[Column]:
    """log2 of the mean word length, and square roots of shares, which steady their variance."""

    def share(part: str | Column, whole: str) -> Column:
        return F.sqrt(F.when(F.col(whole) > 0, (F.col(part) if isinstance(part, str) else part) / F.col(whole)).otherwise(0.0))

    length = F.log2(F.when(F.col("n_words") > 0, F.col("word_chars") / F.col("n_words")).otherwise(1.0))
    letters = "n_letters"
    return [
        length.alias("x0"),
        share("n_symbols", "n_chars").alias("x1"),
        share("n_repeat_words", "n_words").alias("x2"),
        share("n_dup_lines", "n_all_lines").alias("x3"),
        share("n_upper", letters).alias("x4"),
        share(F.col("n_marks") + F.col("n_bang"), "n_chars").alias("x5"),
    ]


def chi2_quantile(p: int, q: float) -> float:
    """Wilson and Hilferty's approximation."""
    return p * (1 - 2 / (9 * p) + NormalDist().inv_cdf(q) * math.sqrt(2 / (9 * p))) ** 3


def consistency(share: np.ndarray) -> np.ndarray:
    """What the covariance of the nearest `share` of normal rows must be multiplied by to be that of all of them."""
    p, grid = len(VECTOR), np.linspace(0.02, 0.98, 97)
    inside = [NormalDist().cdf(((chi2_quantile(p, a) / (p + 2)) ** (1 / 3) - (1 - 2 / (9 * (p + 2)))) / math.sqrt(2 / (9 * (p + 2)))) for a in grid]
    return np.interp(share, [*grid, 1.0], [*(grid / inside), 1.0])


def _inverse(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inverses and log determinants of covariances whose spreads are raised to FLOOR."""
    p = len(VECTOR)
    low = np.maximum(np.square(FLOOR) - cov[:, range(p), range(p)], 0)
    cov = cov.copy()
    cov[:, range(p), range(p)] += low
    return np.linalg.inv(cov), np.linalg.slogdet(cov)[1]


_MOMENTS = [*(f"m{i}" for i in range(len(VECTOR))), *(f"c{i}_{j}" for i, j in PAIRS)]
_WEIGHTS = [f"w{i}_{j}" for i, j in PAIRS]


def _solved(df: DataFrame, keys: list[str], moments: Callable[[dict[str, np.ndarray]], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """keys, rows, and from moments(columns) -> means, covariances: _MOMENTS, the weights of the distance, logdet."""
    p, numbers = len(VECTOR), [c for c in df.columns if c not in keys]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {name: np.asarray(batch.column(batch.schema.get_field_index(name)), float) for name in numbers}
            mean, cov = moments(c)
            w, logdet = _inverse(cov)
            values = [c["rows"], *mean.T, *(cov[:, i, j] for i, j in PAIRS), *(w[:, i, j] * (1 if i == j else 2) for i, j in PAIRS), logdet]
            held = [batch.column(batch.schema.get_field_index(k)) for k in keys]
            yield pa.RecordBatch.from_arrays([*held, *(pa.array(v) for v in values)], names=[*keys, "rows", *_MOMENTS, *_WEIGHTS, "logdet"])

    types = dict(df.dtypes)
    return df.mapInArrow(solve, ", ".join([*(f"{k} {types[k]}" for k in keys), *(f"{c} double" for c in ("rows", *_MOMENTS, *_WEIGHTS, "logdet"))]))


def _from_sums(c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Means and covariances of the rows that a concentration step took, corrected for the share taken."""
    p, n = len(VECTOR), np.maximum(c["n"], 1)
    mean = np.stack([c[f"s{i}"] for i in range(p)], axis=1) / n[:, None]
    cov = np.zeros((len(n), p, p))
    for i, j in PAIRS:
        cov[:, i, j] = cov[:, j, i] = c[f"s{i}_{j}"] / n - mean[:, i] * mean[:, j]
    return mean, cov * consistency(c["n"] / np.maximum(c["rows"], 1))[:, None, None]


def _shrunk(prior: float) -> Callable[[dict[str, np.ndarray]], tuple[np.ndarray, np.ndarray]]:
    """A group's moments and those of the group above it (u_...), weighed by its rows and by `prior` rows."""

    def moments(c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        p, own = len(VECTOR), c["rows"] / (c["rows"] + prior)
        mean = np.stack([own * c[f"m{i}"] + (1 - own) * c[f"u_m{i}"] for i in range(p)], axis=1)
        cov = np.zeros((len(own), p, p))
        for i, j in PAIRS:
            cov[:, i, j] = cov[:, j, i] = own * c[f"c{i}_{j}"] + (1 - own) * c[f"u_c{i}_{j}"]
        return mean, cov

    return moments


def _distance() -> Column:
    terms = [F.col(f"w{i}_{j}") * (F.col(f"x{i}") - F.col(f"m{i}")) * (F.col(f"x{j}") - F.col(f"m{j}")) for i, j in PAIRS]
    return F.greatest(sum(terms[1:], terms[0]), F.lit(0.0))


def _medians(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Medians m_i and spreads d_i (the median distance from the median, in normal units) of x_i by keys, from bins."""
    p, fine = len(VECTOR), 256.0

    def median_of(long: DataFrame) -> DataFrame:
        binned = long.groupBy(*keys, "i", F.floor(F.col("x") * fine).cast("long").alias("bin")).count()
        every = Window.partitionBy(*keys, "i")
        run = F.sum("count").over(every.orderBy("bin"))
        middle = binned.withColumn("run", run).withColumn("all", F.sum("count").over(every)).where(F.col("run") * 2 >= F.col("all"))
        return middle.groupBy(*keys, "i").agg(((F.min("bin") + 0.5) / fine).alias("middle"))

    long = rows.select(*keys, F.posexplode(F.array(*[f"x{i}" for i in range(p)])).alias("i", "x"))
    centre = materialise(median_of(long), "medians")
    off = attach(long, centre, [*keys, "i"], F.col("x")).select(*keys, "i", F.abs(F.col("x") - F.col("middle")).alias("x"))
    spread = median_of(off).select(*[F.col(k).alias(f"r_{k}") for k in keys], F.col("i").alias("r_i"), (1.4826 * F.col("middle")).alias("spread"))
    on = F.col("i") == F.col("r_i")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"r_{k}"))
    both = centre.join(spread, on)
    return (
        both.groupBy(*keys)
        .agg(
            *[F.max(F.when(F.col("i") == i, F.col("middle"))).alias(f"m{i}") for i in range(p)],
            *[F.max(F.when(F.col("i") == i, F.col("spread"))).alias(f"d{i}") for i in range(p)],
        )
    )


def mcd(rows: DataFrame, share: float = 0.75, steps: int = 4) -> DataFrame:
    """Minimum-covariance-determinant estimates of rows(level, lang, source, x_i) by GROUP: rows, _MOMENTS and more.

    Two starts, the group's own medians and its language's, each take `steps` concentration steps: distances by
    the current estimate, then mean and covariance of the nearest `share` of the group. A step is one aggregation
    of sums by group and bin of the distance's logarithm; whole bins up to the share are taken, so no group is
    sorted or gathered. The start with the smaller determinant stays.
    """
    p = len(VECTOR)
    own = materialise(_medians(rows, GROUP), "medians")
    language = own.where("level = 1").drop("level", "source").withColumnRenamed("lang", "__lang")
    groups = own.where("level = 2").select(*GROUP)
    pooled = groups.join(language, groups["lang"].eqNullSafe(language["__lang"])).drop("__lang").withColumn("start", F.lit(1))
    first = own.withColumn("start", F.lit(0)).unionByName(pooled)
    weights = [(F.lit(1.0) / F.greatest(F.col(f"d{i}") * F.col(f"d{i}"), F.lit(FLOOR[i] ** 2)) if i == j else F.lit(0.0)).alias(f"w{i}_{j}") for i, j in PAIRS]
    now = materialise(first.select(*GROUP, "start", *[f"m{i}" for i in range(p)], *weights), "estimates")
    starts = F.when(F.col("level") == 2, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    many = rows.withColumn("start", F.explode(starts))
    for _ in range(steps):
        held = now.select(*GROUP, "start", *[f"m{i}" for i in range(p)], *_WEIGHTS)
        near = attach(many, held, [*GROUP, "start"], F.col("x0")).withColumn("bin", F.floor(F.log2(_distance() + 1e-6) * 8).cast("int"))
        products = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i, j in PAIRS]
        sums = near.groupBy(*GROUP, "start", "bin").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(p)], *products)
        every = Window.partitionBy(*GROUP, "start")
        before = F.coalesce(F.sum("n").over(every.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        taken = sums.withColumn("before", before).withColumn("rows", F.sum("n").over(every)).where(F.col("before") < F.col("rows") * share)
        parts = [F.sum(c).alias(c) for c in ("n", *(f"s{i}" for i in range(p)), *(f"s{i}_{j}" for i, j in PAIRS))]
        whole = taken.groupBy(*GROUP, "start").agg(F.max("rows").alias("rows"), *parts)
        now = materialise(_solved(whole, [*GROUP, "start"], _from_sums), "estimates")
    best = Window.partitionBy(*GROUP).orderBy("logdet", "start")
    return now.withColumn("rank", F.row_number().over(best)).where("rank = 1").drop("rank", "start", "logdet")


def estimates(rows: DataFrame, prior: float, **params) -> DataFrame:
    """lang, source, means m_i and weights w_ij for every language and source of rows(lang, source, x_i).

    Each group's own estimate counts with its rows, that of the group above it (its language, for a language all
    documents) with `prior` rows. So small groups are judged nearly as their language, large ones by themselves,
    and nothing changes at any size in between.
    """
    null = F.lit(None).cast("string")
    level = lambda n, lang, source: F.struct(F.lit(n).alias("level"), lang.alias("lang"), source.alias("source"))
    groups = F.array(level(0, null, null), level(1, F.col("lang"), null), level(2, F.col("lang"), F.col("source")))
    numbers = [f"x{i}" for i in range(len(VECTOR))]
    found = materialise(mcd(rows.select(F.explode(groups).alias("g"), *numbers).select("g.*", *numbers), **params), "estimates")
    above = found.where("level = 0").select(*[F.col(c).alias(f"u_{c}") for c in _MOMENTS])
    own = found.where("level = 1").select("lang", "rows", *_MOMENTS)
    languages = materialise(_solved(own.join(F.broadcast(above)), ["lang"], _shrunk(prior)), "languages")
    above = languages.select("lang", *[F.col(c).alias(f"u_{c}") for c in _MOMENTS])
    own = found.where("level = 2").select("lang", "source", "rows", *_MOMENTS)
    return _solved(attach(own, above, ["lang"], F.col("source")), ["lang", "source"], _shrunk(prior)).drop("rows", "logdet", *[c for c in _MOMENTS if c[0] == "c"])


def _verdicts(docs: DataFrame, quantile: float = 0.9999, prior: float = 60.0, **params) -> DataFrame:
    """Base counts, kept and distance of every row, with its lang, source and text_key (hash of the text)."""
    keep = {"doc_id": "long", "lang": "string", "source": "string", "text_key": "long"}
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_key")
    own = docs.select(*[F.col(c).cast(t).alias(c) for c, t in keep.items() if c != "text_key"], key, F.col("text").cast("string").alias("text"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = text_stats(own, keep).withColumn("base_failed", failed).withColumn("n_letters", F.col("n_lower") + F.col("n_upper")).withColumn("n_all_lines", F.col("n_lines") + 1)
    rows = materialise(stats.select(*BASE, "lang", "source", "text_key", *vector()), "statistics")
    found = materialise(estimates(rows.where("NOT base_failed"), prior, **params), "estimates")
    judged = attach(rows, found, ["lang", "source"], F.col("text_key"))
    distance = F.when(~F.col("base_failed"), _distance())
    fine = ~F.col("base_failed") & (F.coalesce(distance, F.lit(0.0)) <= chi2_quantile(len(VECTOR), quantile))
    return judged.select(*BASE, "lang", "source", "text_key", fine.alias("kept"), distance.alias("distance"))


def judge(docs: DataFrame, **params) -> DataFrame:
    """Base counts and the verdict `kept` of every document.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and distance
    (squared, null if base_failed). Estimates are made for each language and source over the documents that pass
    the base rule, and lean on the language's as far as a source is small (`prior`). A document is rejected over
    the `quantile` of the chi-squared law.

    Null and empty texts have no words and fail the base rule. Null languages and sources are groups of their own.
    Copies and repeated rows are judged alike, each for itself. An empty table gives no rows. Other columns are
    ignored.
    """
    return _verdicts(docs, **params).select(*BASE, "kept", "distance")


def keep_good(docs: DataFrame, **params) -> DataFrame:
    """The rows that judge() keeps, with all their columns; each by its own doc_id, language, source and text."""
    kept = _verdicts(docs, **params).where("kept").select(*[F.col(c).alias(f"__{c}") for c in ("doc_id", "lang", "source", "text_key")])
    keyed = docs.withColumn("__key", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    same = keyed["__key"] == kept["__text_key"]
    for c in ("doc_id", "lang", "source"):
        same = same & keyed[c].eqNullSafe(kept[f"__{c}"])
    return keyed.join(kept, same, "left_semi").drop("__key")
