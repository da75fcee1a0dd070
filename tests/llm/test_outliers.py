"""The verdict of the quality rules against exact concentration steps, planted junk, and rows that share an id."""

import collections
import math
import re

import numpy as np

from colloquy.llm import outliers

WORD = re.compile(r"[^\x20\x09-\x0D]+")
P = len(outliers.VECTOR)


def statistics(t):
    t = t or ""
    w = WORD.findall(t)
    where = collections.defaultdict(list)
    for k in range(len(w) - 2):
        where[tuple(w[k : k + 3])].append(k)
    again = len({k + j for v in where.values() if len(v) > 1 for k in v for j in range(3)})
    lines = [x for x in t.split("\n") if WORD.search(x)]
    upper, lower = (sum(a <= c <= b for c in t) for a, b in ("AZ", "az"))
    share = lambda a, b: math.sqrt(a / b) if b else 0.0
    x = [
        math.log2(sum(map(len, w)) / len(w)) if w else 0.0,
        share(sum(c in "#*$%&|<>" for c in t), len(t)),
        share(again, len(w)),
        share(len(lines) - len(set(lines)), t.count("\n") + 1),
        share(upper, upper + lower),
        share(sum(c in ",;:'\"()-!?" for c in t), len(t)),
    ]
    return x, len(w) < 50 or 100 * again > 50 * len(w)


def exact_verdicts(rows, prior=60.0, share=0.75, limit=outliers.chi2_quantile(P, 0.9999)):
    """kept of every (lang, source, text), the nearest rows taken by sorting instead of bins."""
    found = [statistics(t) for _, _, t in rows]
    x, failed = np.asarray([f[0] for f in found]), np.asarray([f[1] for f in found])
    factor = lambda a: float(outliers.consistency(np.asarray([a]))[0])

    def floored(c):
        return c + np.diag(np.maximum(np.square(outliers.FLOOR) - np.diag(c), 0))

    def distance(z, m, c):
        return np.einsum("ij,jk,ik->i", z - m, np.linalg.inv(floored(c)), z - m)

    def start(z):
        m = np.median(z, axis=0)
        return m, np.diag((1.4826 * np.median(abs(z - m), axis=0)) ** 2)

    def estimate(z, starts):
        best = []
        for m, c in starts:
            for _ in range(4):
                near = z[np.argsort(distance(z, m, c), kind="stable")[: max(1, math.ceil(share * len(z)))]]
                m, c = near.mean(axis=0), np.cov(near.T, bias=True) * factor(len(near) / len(z)) if len(near) > 1 else np.zeros((P, P))
            best.append((np.linalg.slogdet(floored(c))[1], len(best), m, c))
        return min(best, key=lambda b: b[:2])[2:]

    def leaning(z, own, above):
        return [(len(z) * a + prior * b) / (len(z) + prior) for a, b in zip(own, above)]

    groups = collections.defaultdict(list)
    for i, (lang, source, _) in enumerate(rows):
        if not failed[i]:
            for g in ((), (lang,), (lang, source)):
                groups[g].append(i)
    kept = ~failed
    every = estimate(x[groups[()]], [start(x[groups[()]])])
    language = {g: leaning(x[i], estimate(x[i], [start(x[i])]), every) for g, i in groups.items() if len(g) == 1}
    for g, i in groups.items():
        if len(g) == 2:
            own = leaning(x[i], estimate(x[i], [start(x[i]), start(x[groups[g[:1]]])]), language[g[:1]])
            kept[i] = distance(x[i], *own) <= limit
    return kept


def test_verdict_equals_exact_steps(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "source", "text")
    rows = sorted(tuple(r) for r in docs.collect())
    want = exact_verdicts([r[1:] for r in rows])
    got = {r.doc_id: r.kept for r in outliers.judge(docs).collect()}
    # whole distance bins are taken in place of the nearest rows alone
    assert sum(got[r[0]] != w for r, w in zip(rows, want)) <= len(rows) // 200
    # 80 groups of about 12 rows beside one group of 4,000
    more = docs.unionByName(docs.where("source = 'src3'").withColumn("source", docs["lang"]).crossJoin(spark.range(90)).drop("id"))
    big = [r[1:] for r in rows] + [(r[1], r[1], r[3]) for r in rows if r[2] == "src3" for _ in range(90)]
    assert abs(outliers.judge(more).where("kept").count() - exact_verdicts(big).sum()) <= len(big) // 200


def test_planted_junk(spark):
    rng = np.random.default_rng(5)
    word = lambda n=6: "".join(rng.choice(list("abcdefghijklmnop"), int(rng.integers(2, n + 3))))
    line = lambda n=12: " ".join(word() for _ in range(n)).capitalize() + ", ok."
    clean = ["\n".join(line() for _ in range(20)) for _ in range(300)]
    plain = lambda n: [line() for _ in range(n)]
    junk = {
        "dup_lines": "\n".join(plain(8) + ["a line", "b line", "c line", "d line"] * 4), "symbols": "\n".join(f"{x} ###$$ %%%" for x in plain(20)), "capitals": "\n".join(plain(20)).upper(),
        "marks": "\n".join(x.replace(" ", "!!!; ") for x in plain(20)), "word_length": " ".join(word() * 6 for _ in range(100)), "repeats": "\n".join(plain(8) + ["one two three four five six seven eight nine ten " + str(i) for i in range(9)]),
    }
    rows = [(i, "en", f"s{i % 3}", t) for i, t in enumerate(clean)] + [(1000 + i, "en", "s1", t) for i, t in enumerate(junk.values())] + [(2000, "en", "alone", clean[0]), (2001, None, None, clean[1]), (2002, "xx", "yy", junk["symbols"])]
    got = {r.doc_id: r for r in outliers.judge(spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")).collect()}
    assert all(got[i].kept for i in range(300)) and got[2000].kept and got[2001].kept
    assert [k for i, k in enumerate(junk) if got[1000 + i].kept] == []
    assert not got[2002].kept  # a single row of its language leans on all documents


def test_keep_good_by_row(spark):
    rng = np.random.default_rng(6)
    text = lambda: " ".join("".join(rng.choice(list("abcdefg"), 5)) for _ in range(80))
    good, junk = [text() for _ in range(40)], "###$$$ %%% " * 3 + " ".join(f"x{i}$$$$$$$" for i in range(80))
    rows = [(None if i % 3 == 0 else 7, "en", None, t, i) for i, t in enumerate(good)]
    rows += [(None, "en", None, junk, -1), (7, "en", None, junk, -2), (7, "en", None, "short", -3), (8, None, "s", None, -4), (7, "en", None, good[1], 100)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string, distance int")
    kept = outliers.keep_good(df)
    assert kept.columns == df.columns
    assert sorted(r.distance for r in kept.collect()) == [*range(40), 100]
    assert outliers.keep_good(df.where("false")).count() == 0
