"""Follow-ups and roll-ups: streams give what tables give, and tables what a plain loop gives."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from colloquy.streaming import followups as fu
from colloquy.streaming import incremental as inc

DAY = 86_400
EVENTS = "key string, chat_id string, kind string, ts long, hints int, text string, decision string"


def loop(rows, at=None):
    """The items of all rows, one event after the other."""
    out = {}
    for key in {r[0] for r in rows}:
        past, item = [], None
        own = sorted({r for r in rows if r[0] == key}, key=lambda r: (r[3], r[6] is not None, r[5], r[6] or ""))
        seen = set()
        for _, chat, kind, ts, hints, text, decision in own:
            if (ts, text, decision) in seen:
                continue
            seen.add((ts, text, decision))
            if item and item["status"] == "new" and item["expires"] <= ts:
                item["status"] = "stale"
            if decision is not None:
                if item and decision in fu.DECISIONS:
                    item["status"] = fu.DECISIONS[decision]
                continue
            high, priority = hints >= 2, min(5, 2 + max(0, hints - 1))
            if item is None or item["status"] in fu.CLOSED:
                past += [item] if item else []
                item = {"round": len(past) + 1, "status": "new", "high": high, "priority": priority, "n": 1, "first": ts, "last": ts, "expires": ts + 14 * DAY, "texts": [text]}
            elif ts > item["last"] and item["status"] != "ignored":
                item |= {"last": ts, "n": item["n"] + 1, "priority": max(priority, item["priority"]), "high": high or item["high"], "texts": [*item["texts"], text][-5:]}
                if item["status"] in ("new", "stale"):
                    item |= {"status": "new", "expires": ts + 14 * DAY}
        for i in [*past, item] if item else past:
            if at is not None and i["status"] == "new" and i["expires"] <= at:
                i["status"] = "stale"
            out[(key, i["round"])] = (i["status"], "high" if i["high"] else "medium", i["priority"], i["n"], i["first"], i["last"], i["expires"], "\n".join(i["texts"]))
    return out


def told(rows):
    return {(r["key"], r["round"]): (r["status"], r["confidence"], r["priority"], r["reinforcement"], r["first_seen"], r["last_signal"], r["expires"], r["evidence"]) for r in rows}


def many(seed, n=600):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        k = rng.choice(["k0", "k0", "k0", "k1", "k2", "k3"])
        decision = rng.choice([*fu.DECISIONS, "bogus"]) if rng.random() < 0.3 else None
        hints = rng.randrange(5) if decision is None else 0
        out.append((k, "c" + k, "deal", rng.randrange(400) * DAY // 4, hints, "" if decision else rng.choice("abcdefg"), decision))
    seen, kept = set(), []
    for r in out:  # one number of hints for each signal
        if (r[0], *r[3:4], *r[5:]) not in seen:
            seen.add((r[0], *r[3:4], *r[5:]))
            kept.append(r)
    return kept + kept[:20]


def test_items_of_one_key(spark):
    rows = [("k", "c", "deal", t, h, x, d) for t, h, x, d in [(0, 1, "a", None), (0, 1, "a", None), (DAY, 3, "b", None), (40 * DAY, 1, "c", None), (41 * DAY, 0, "", "won"), (42 * DAY, 1, "d", None), (43 * DAY, 0, "", "pursue")]]
    got = [r.asDict() for r in fu.follow_up(spark.createDataFrame(rows, EVENTS), at=400 * DAY).orderBy("round").collect()]
    assert [(g["round"], g["status"], g["confidence"], g["priority"], g["reinforcement"], g["evidence"]) for g in got] == [(1, "won", "high", 4, 3, "a\nb\nc"), (2, "open", "medium", 2, 1, "d")]
    only = fu.follow_up(spark.createDataFrame([("k", "c", "deal", 0, 1, "a", None), ("n", "c", "deal", 5, 0, "", "won")], EVENTS), at=14 * DAY).collect()
    assert [(r["status"], r["expires"]) for r in only] == [("stale", 14 * DAY)]


@pytest.mark.parametrize("seed, bucket", [(1, DAY), (2, 3600), (3, 1000 * DAY), (4, 5 * DAY)])
def test_items_equal_a_loop(spark, seed, bucket):
    """All decisions, unknown ones, ignored and closed items, equal times, keys in one bucket and in very many."""
    rows = many(seed)
    got = told(fu.follow_up(spark.createDataFrame(rows, EVENTS), at=95 * DAY, bucket=bucket).collect())
    want = loop(rows, at=95 * DAY)
    assert got == want and len(want) > 20 and len({v[0] for v in want.values()}) > 4


def test_feedback_and_purge(spark):
    rows = [("a|deal|1", "a", "deal", t, 1, x, d) for t, x, d in [(0, "", "won"), (5, "s", None), (6, "", "pursue"), (7, "", "ignore"), (8, "", "pause"), (9, "", "bogus"), (9, "", "lost")]]
    df = spark.createDataFrame(rows, EVENTS)
    got = {(r.target, r.verdict, r.note, r.ts) for r in fu.feedback(df).collect()}
    assert got == {("item:a|deal|1", "confirmed", "triage:pursue", 6), ("item:a|deal|1", "ignore", "triage:ignore", 7), ("chat:a", "ignore", "triage:ignore", 7)}
    items = fu.follow_up(df.union(spark.createDataFrame([("b|deal|1", "b", "deal", 3, 1, "x", None)], EVENTS)))
    out = spark.createDataFrame([("a",), ("a",), ("z",)], "chat_id string")
    assert [r.key for r in fu.purge(items, out).collect()] == ["a|deal|1"] and [r.key for r in fu.purge(items, out, False).collect()] == ["b|deal|1"]
    assert fu.follow_up(df.limit(0)).count() == 0 and fu.feedback(df.limit(0)).count() == 0


def test_hints_are_of_the_kind_alone(spark):
    """Words of a commitment in a deal's text do not count among the deal's hints."""
    from types import SimpleNamespace

    from colloquy.plans import live

    texts = ["deal, will send", "budget and quote, i'll send", "will send, i'll send", "nothing"]
    chats = [(i, None, f"m{i}", datetime.datetime(2024, 1, 1), x) for i, x in enumerate(texts)]
    t = SimpleNamespace(v_chat=spark.createDataFrame(chats, "id long, chat_id string, sender string, ts timestamp_ntz, text string"))
    got = {r.text: (r.kind, r.hints) for r in live.signal_events(t).where("decision IS NULL").collect()}
    assert got == {texts[0]: ("deal", 1), texts[1]: ("deal", 2), texts[2]: ("commitment", 2)}


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run(spark, tmp_path, build, batches, schema):
    for n, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows = []
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = build(stream).writeStream.outputMode("update").foreachBatch(lambda b, n: rows.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(240) and q.exception() is None
    return rows


def test_stream_equals_table(spark, rocks, tmp_path):
    """Batches in time order: the last row of each item is the table's; the watermark makes new items stale."""
    rows = [(*r[:3], r[3] + 10 * DAY, *r[4:]) for r in sorted(set(many(7, 200)), key=lambda r: r[3]) if r[3] <= 50 * DAY]
    rows = sorted([*rows, ("quiet", "c", "deal", 15 * DAY, 1, "q", None)], key=lambda r: r[3])
    last = [("late", "c", "deal", 90 * DAY, 1, "x", None)]
    cut = [rows[: len(rows) // 2], rows[len(rows) // 2 :], last]
    while cut[0][-1][3] == cut[1][0][3]:  # events of one time come together
        cut[0].append(cut[1].pop(0))
    seen = {}
    for r in run(spark, tmp_path, lambda s: fu.follow_up_stream(s), cut, EVENTS):
        seen |= told([r])
    want = loop(rows + last, at=89 * DAY)
    assert {k: (seen.get(k), want.get(k)) for k in {*seen, *want} if seen.get(k) != want.get(k)} == {}
    assert any(v[0] == "stale" for v in seen.values())


def test_tiers(spark, rocks, tmp_path):
    rows = [("a", 0, "once", "1"), ("b", 0, "periodic", "2"), ("c", 0, "permanent", "3"), ("d", 0, None, "4"), ("e", 0, "once", "5"), ("e", 3600, "periodic", "6")]
    schema = "key string, ts long, tier string, value string"
    df = spark.createDataFrame(rows, schema)
    names = lambda now: sorted(r.value for r in fu.alive(df, now).collect())
    assert names(DAY) == list("123456") and names(DAY + 1) == list("2346") and names(7 * DAY + 3600) == list("346") and names(900 * DAY) == list("34")
    got = run(spark, tmp_path, lambda s: fu.alive_stream(s), [[(k, t + DAY, *x) for k, t, *x in rows], [("z", 4 * DAY, "permanent", "7")], [("z", 31 * DAY, "permanent", "8")]], schema)
    assert next(r.key for r in got if not r.alive) == "a"
    assert {(r.key, r.value) for r in got if not r.alive} == {("a", "1"), ("b", "2"), ("e", "6")} and sum(r.alive for r in got) == 7


def test_rollup_of_batches(spark, tmp_path):
    rows = spark.createDataFrame([(f"s{i % 3}", i) for i in range(30)], "session_id string, n long")
    rows.where("n < 10").coalesce(1).write.parquet(str(tmp_path / "in"))
    rows.where("n >= 10").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    read = lambda b: b.groupBy("session_id").agg(F.count(F.lit(1)).alias("calls"), F.max("n").alias("last"))
    inc.keep_rollup(stream, read, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    got = inc.merged(spark.read.parquet(str(tmp_path / "out")), ["session_id"], ["calls"], most=["last"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, read(rows).collect()))
