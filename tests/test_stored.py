"""Tables kept in place: builds that skip, compute, keep, prune and fail, versions, marks of digests."""

import datetime

import pytest
from pyspark.sql import functions as F

from colloquy.sources.store import exists
from colloquy.streaming.stored import DigestMarks, SessionTable

LINES = "path string, agent string, line_no int, raw string"
AT = datetime.datetime(2024, 1, 1)


def count(lines):
    """A path that holds the word broken fails."""
    return lines.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.contains("raw", F.lit("broken"))).alias("bad")).where("NOT bad").select("path", "n")


def state(table):
    return {r.path: (r.agent, r.n, r.tag) for r in table.read().collect()}


@pytest.fixture
def table(spark, tmp_path):
    return SessionTable(spark, str(tmp_path / "t"), "n long, tag string", ["tag"], parts=4)


def lines(spark, sources):
    return spark.createDataFrame([(p, a, i, x) for (p, a), xs in sources.items() for i, x in enumerate(xs)], LINES)


def test_builds(spark, table):
    src = {(f"p{i}", "ab"[i % 2]): ["x"] * (i + 1) for i in range(12)}
    assert table.build(lines(spark, src), count) == {"compute": 12}
    first = {p: (a, len(x), None) for (p, a), x in src.items()}
    assert state(table) == first and table.build(lines(spark, src), count) == {"skip": 12}
    versions = table.versions()
    # one changes, one is new, one fails, one vanishes
    src[("p3", "b")] = ["x", "y"]
    src[("new", "a")] = ["z"]
    src[("p4", "a")] = ["broken"]
    del src[("p5", "b")]
    assert table.build(lines(spark, src), count) == {"skip": 9, "compute": 3, "prune": 1}
    want = first | {"p3": ("b", 2, None), "new": ("a", 1, None)}
    del want["p5"]
    assert state(table) == want
    assert any(table.versions()[p] == v for p, v in versions.items()) or len(set(table.versions().values())) == 1
    # the failed one is tried again, and mends
    src[("p4", "a")] = ["fine"]
    assert table.build(lines(spark, src), count)["compute"] == 1 and state(table)["p4"] == ("a", 1, None)


def test_guards(spark, table):
    src = {(f"p{i}", "ab"[i % 2]): ["x"] for i in range(12)}
    table.build(lines(spark, src), count)
    few = {k: v for k, v in src.items() if k[1] == "a" or k[0] == "p1"}  # most of b's paths are not listed
    assert table.build(lines(spark, few), count) == {"skip": 7, "kept": 5} and len(state(table)) == 12
    gone = {k: v for k, v in src.items() if k[0] not in ("p0", "p1")}
    assert table.build(lines(spark, gone), count, full=False) == {"skip": 10, "kept": 2} and len(state(table)) == 12
    assert table.build(lines(spark, gone), count, agent="a") == {"skip": 5, "prune": 1}
    assert set(state(table)) == {f"p{i}" for i in range(1, 12)}
    assert table.build(lines(spark, {}), count) == {"kept": 11} and len(state(table)) == 11
    assert table.build(lines(spark, gone), count, epoch=2) == {"compute": 10, "prune": 1}


def test_carried_and_emptied_parts(spark, table):
    src = {("p0", "a"): ["x"], ("p1", "a"): ["x"], ("p2", "a"): ["x"]}
    tagged = lambda l: count(l).withColumn("tag", F.lit("t"))
    own = SessionTable(spark, table.path, table.columns, [], parts=4)
    own.build(lines(spark, src), tagged)
    src[("p0", "a")] = ["x", "y"]
    del src[("p1", "a")]
    table.build(lines(spark, src), count)
    assert state(table) == {"p0": ("a", 2, "t"), "p2": ("a", 1, "t")}


def test_failed_build_is_not_seen(spark, table):
    src = {("p0", "a"): ["x"]}
    table.build(lines(spark, src), count)

    def fails(rows):
        raise RuntimeError("no")

    src[("p0", "a")] = ["x", "y"]
    with pytest.raises(RuntimeError):
        table.build(lines(spark, src), fails)
    spark.createDataFrame([("p0", "a", 1, 99, None)], table.schema).write.parquet(f"{table.path}/rows/version=2/part=0")
    assert state(table) == {"p0": ("a", 1, None)}
    assert table.build(lines(spark, src), count) == {"compute": 1} and state(table) == {"p0": ("a", 2, None)}


def test_marks(spark, tmp_path):
    row = lambda c, h, s="u": (c, s, AT + datetime.timedelta(hours=h))
    schema = "chat_id string, sender string, ts timestamp_ntz"
    marks, seen = DigestMarks(spark, str(tmp_path / "m")), []
    note = lambda d: seen.append(sorted((r.chat_id or "", r.messages, r.senders) for r in d.collect()))
    rows = [row("a", 1), row("a", 2, "v"), row("b", 1), row(None, 5)]
    assert marks.tell(spark.createDataFrame(rows, schema), note) == 3 and seen.pop() == [("", 1, 1), ("a", 2, 2), ("b", 1, 1)]
    assert marks.tell(spark.createDataFrame(rows, schema), note) == 0 and seen.pop() == []
    rows += [row("a", 3), row("c", 0), row("b", 0)]

    def fails(d):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        marks.tell(spark.createDataFrame(rows, schema), fails)
    assert marks.tell(spark.createDataFrame(rows, schema), note) == 2 and seen.pop() == [("a", 1, 1), ("c", 1, 1)]
    # a stream over the same rows and newer ones tells the newer ones
    spark.createDataFrame([*rows, row("c", 9)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        q = marks.tell_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), note, str(tmp_path / "c"))
        assert q.awaitTermination(120) and q.exception() is None
    assert [x for x in seen if x] == [[("c", 1, 1)]] and exists(spark, str(tmp_path / "m"))
