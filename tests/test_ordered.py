"""Running values, borders, ranks and interval joins against plain loops, with rows of one key in one and in many buckets."""

import datetime
import random
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from colloquy.operators import basics, chat, dialogue, ordered, usage

START = datetime.datetime(2024, 1, 1)


def rows(seed, n=300):
    rng = random.Random(seed)
    return [(i, rng.choice(["a", "a", "a", "b", None]), rng.randrange(5000), rng.choice([None, "x", "y"]), rng.randrange(4)) for i in range(n)]


@pytest.mark.parametrize("bucket", [1, 70, 10_000])
def test_carried(spark, bucket):
    data = rows(1)
    df = spark.createDataFrame(data, "id long, k string, at long, v string, n int").withColumn("bucket", F.floor(F.col("at") / bucket))
    got = {r.id: (r.total, r.last) for r in ordered.carried(df, ["k"], "bucket", ["at", "id"], {"total": F.col("n")}, {"last": F.col("v")}).collect()}
    want = {}
    for k in {r[1] for r in data}:
        total, last = 0, None
        for i, _, at, v, n in sorted((r for r in data if r[1] == k), key=lambda r: (r[2], r[0])):
            total += n
            want[i] = (total, last)
            last = v or last
    assert got == want
    assert ordered.carried(df.limit(0), ["k"], "bucket", ["at", "id"], {"total": F.col("n")}).count() == 0


@pytest.mark.parametrize("before, after, width", [(3, 0, 1), (0, 40, 50), (25, 25, 10_000)])
def test_bordered(spark, before, after, width):
    data = rows(2)
    df = spark.createDataFrame(data, "id long, k string, at long, v string, n int")
    w = Window.partitionBy("k", "bucket").orderBy("at").rangeBetween(-before, after)
    got = ordered.bordered(df, "at", before, after, width).withColumn("s", F.sum("n").over(w)).where("own")
    want = {r[0]: sum(x[4] for x in data if x[1] == r[1] and -before <= x[2] - r[2] <= after) for r in data}
    assert sorted((r.id, r.s) for r in got.collect()) == sorted(want.items())


def test_ranked(spark):
    data = rows(3) + [(1000, None, None, None, None)]
    df = spark.createDataFrame(data, "id long, k string, at long, v string, n int").repartition(7)
    got = sorted((r["rank"], r.id) for r in ordered.ranked(df, [F.desc("n"), F.asc("id")]).collect())
    want = sorted(data, key=lambda r: (r[4] is None, -(r[4] or 0), r[0]))
    assert got == [(i + 1, r[0]) for i, r in enumerate(want)]
    assert ordered.ranked(df.limit(0), [F.asc("id")]).count() == 0


def test_one_chat_over_many_tasks(spark):
    """A chat that holds all rows: its edges and contexts equal a loop, and its windows lie in many tasks."""
    rng = random.Random(4)
    data = [(i, "c", f"s{rng.randrange(9)}", START + datetime.timedelta(seconds=rng.randrange(200_000)), "x") for i in range(1500)]
    df = spark.createDataFrame(data, "id long, chat_id string, sender string, ts timestamp_ntz, text string")
    line = sorted(data, key=lambda r: (r[3], r[0]))
    want = sorted((a[2], b[2]) for i, a in enumerate(line) for b in line[i + 1 : i + 6] if a[2] != b[2] and (b[3] - a[3]).total_seconds() <= 300)
    edges = chat.cooccurrence_edges(df)
    assert sorted((r.src, r.dst) for r in edges.collect()) == want and len(want) > 500
    near = sorted(r[0] for i, r in enumerate(line) if any(x[2] == "s3" for x in line[max(0, i - 2) : i + 3]))
    assert sorted(r.id for r in chat.mine_context(df, "s3").collect()) == near
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("Window")[1]


def test_session_commits(spark):
    rng = random.Random(5)
    at = lambda s: START + datetime.timedelta(seconds=s)
    spans = [(a, a + rng.choice([0, 0, 30, 5000, 10**6, 10**8])) for a in (rng.randrange(10**7) for _ in range(60))] + [(5, 4)]
    sessions = [(i, "pq"[i % 2], at(a), at(b)) for i, (a, b) in enumerate(spans)]
    commits = [(i, "pq"[i % 2], at(rng.randrange(10**7))) for i in range(200)] + [(300 + i, p, s[2]) for i, (s, p) in enumerate(zip(sessions, "pqpqpq"))]
    s = spark.createDataFrame(sessions, "session_id long, project string, created timestamp_ntz, modified timestamp_ntz")
    c = spark.createDataFrame(commits, "hash long, project string, ts timestamp_ntz")
    for by in ([], ["project"]):
        got = sorted((r.session_id, r.hash) for r in usage.session_commits(s, c.drop(*({"project"} - set(by))), by).collect())
        assert got == sorted((x[0], y[0]) for x in sessions for y in commits if x[2] <= y[2] <= x[3] and (not by or x[1] == y[1]))
        assert len(got) > 200
    assert usage.session_commits(s.limit(0), c.drop("project")).count() == 0


def test_session_commit_counts(spark):
    rng = random.Random(6)
    at = lambda s: START + datetime.timedelta(seconds=s)
    spans = [(a, a + rng.choice([-1, 0, 30, 5000, 10**6])) for a in (rng.randrange(10**6) for _ in range(80))]
    sessions = [(f"s{i % 70}", "pq"[i % 2], at(a), at(b)) for i, (a, b) in enumerate(spans)] + [("n", None, at(0), at(10**7)), (None, "p", at(0), at(9))]
    commits = [(i, rng.choice(["p", "q", None]), at(rng.randrange(10**6) // 100 * 100)) for i in range(300)] + [(300 + i, s[1], t) for i, s in enumerate(sessions) for t in s[2:]] + [(900, "p", None)]
    s = spark.createDataFrame(sessions, "session_id string, project string, created timestamp_ntz, modified timestamp_ntz")
    c = spark.createDataFrame(commits, "hash long, project string, ts timestamp_ntz")
    for by in ([], ["project"]):
        counts = usage.session_commit_counts(s, c.drop(*({"project"} - set(by))), by)
        pairs = usage.session_commits(s, c.drop(*({"project"} - set(by))), by)
        want = Counter(r.session_id for r in pairs.collect())
        assert {r.session_id: r.commits for r in counts.collect()} == want and len(want) > 50
        plan = counts._jdf.queryExecution().optimizedPlan().toString()  # what is joined are summaries of buckets, no commits
        assert plan.count("Join") == 1 and "__upto" in plan
    assert usage.session_commit_counts(s.limit(0), c, []).count() == 0
    assert usage.session_commit_counts(s, c.limit(0), []).count() == 0


def test_missing_pairs(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", None), ("b", "x"), (None, "z")], "l string, r string")
    got = {tuple(r) for r in basics.missing_pairs(df, "l", "r", df.where("r <> 'z'")).collect()}
    assert got == {("a", "z"), ("b", "y"), ("b", "z"), (None, "x"), (None, "y"), (None, "z")}
    with pytest.raises(ValueError):
        basics.missing_pairs(df, "l", "r", df, most=2)


def test_simhashes(spark):
    data = [(i, [f"t{random.Random(i).randrange(50)}" for _ in range(i)]) for i in range(30)] + [(99, None)]
    df = spark.createDataFrame(data, "id long, terms array<string>")
    got = {r.id: r.h for r in dialogue.simhashes(df, ["id"]).collect()}
    assert got == {r.id: r.h or 0 for r in df.select("id", dialogue.simhash(F.col("terms")).alias("h")).collect()} and len(set(got.values())) > 20


def test_segments_of_long_chats(spark):
    """Runs between pauses, many messages and equal times, against a loop over the same hashes."""
    rng = random.Random(6)
    clock, data = 0, []
    for i in range(4000):
        clock += rng.choice([0, 1, 1, 60, 60, 8000 if i % 50 == 0 else 60])
        topic = i // 40 % 3
        data.append((i, "ab"[i % 7 == 0], START + datetime.timedelta(seconds=clock), " ".join(f"w{topic}{rng.randrange(6)}" for _ in range(5))))
    df = spark.createDataFrame(data, "id long, chat_id string, ts timestamp_ntz, text string")
    h = {r.id: r.h & (1 << 64) - 1 for r in df.select("id", dialogue.simhash(dialogue.tokens(F.col("text"))).alias("h")).collect()}
    want = set()
    for k in "ab":
        segment, rolling, last, first, n = -1, 0, None, None, 0
        for i, _, ts, _ in sorted((r for r in data if r[1] == k), key=lambda r: (r[2], r[0])):
            if last is None or (ts - last).total_seconds() > 7200 or (rolling ^ h[i]).bit_count() > 22:
                want |= {(k, segment, first, n)} if n else set()
                segment, rolling, first, n = segment + 1, h[i], i, 1
            else:
                rolling, n = (rolling & h[i]) | ((rolling | h[i]) & (1 << 32) - 1), n + 1
            last = ts
        want.add((k, segment, first, n))
    assert {tuple(r) for r in dialogue.simhash_segments(df, ["chat_id"]).collect()} == want and len(want) > 100


def test_topics(spark):
    """Overlapping words, either case, codes with and without a confirming word, ties, nulls and clashing columns."""
    table = ((7, ("skill", "skills", "Kill"), (), None, ()), (3, ("库",), ("Read",), "[0-9]{4}", ("CODE",)), (9, (), ("read", "write"), None, ()))
    rows = [("Skills", None), ("skill", "x"), ("数据库 1234", ""), ("1234", "READ"), ("1234 code", None), (None, "Write"), (None, None), ("", ""), ("12345", "rewrite"), ("库", "write")]
    df = spark.createDataFrame([(i, *r, 1) for i, r in enumerate(rows)], "id int, text string, tools string, points int")
    got = {r.id: r.topic for r in dialogue.with_topics(df, table).collect()}
    assert got == {0: 7, 1: 7, 2: 3, 3: 3, 4: 3, 5: 9, 6: 0, 7: 0, 8: 9, 9: 9} and dialogue.with_topics(df, ()).where("topic <> 0").count() == 0
    assert dialogue.with_topics(df, table).columns == ["id", "text", "tools", "points", "topic"]


def test_best_skills_deals_patterns_first(spark):
    """Patterns of one partition are dealt to tasks before they meet the skills, and pairs need no exchange of their own."""
    from colloquy.operators import labels

    words = ["red", "green", "blue", "dark"]
    patterns = spark.createDataFrame([(i, [words[i % 4], words[i % 3], words[i % 4]]) for i in range(40)] + [(99, ["none"])], "pattern_id long, keywords array<string>").coalesce(1)
    skills = spark.createDataFrame([("b", "red green"), ("a", "Green, blue"), ("c", "dark red")], "name string, description string")
    held = {"b": {"b", "red", "green"}, "a": {"a", "green", "blue"}, "c": {"c", "dark", "red"}}
    want = {}
    for i in range(40):
        n = {k: len({words[i % 4], words[i % 3]} & v) for k, v in held.items()}
        best = min(n, key=lambda k: (-n[k], k))
        want[i] = (best, n[best])
    out = labels.best_skills(patterns, skills)
    assert {r.pattern_id: (r.skill, r.score) for r in out.collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "hashpartitioning(pattern_id#" in plan
