"""Files of several kinds read and written; the rolling SimHash against a plain loop."""

import json

from pyspark.sql import functions as F

from colloquy.operators import dialogue
from colloquy.operators.search import tokens
from colloquy.sources import chats, transcripts


def test_lines_of_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b'{"role":"user","content":"hi"}\n\n{"broken\n{"role":"assistant","content":[{"type":"text","text":"one"},"two"]}\n{"role":"user","content":"bad \xff byte"}\n')
    (tmp_path / "b.jsonl").write_text("not json\n")
    (tmp_path / "c.jsonl").write_text("")
    lines = transcripts.read_lines(spark, str(tmp_path / "*.jsonl"))
    verdict = {r["path"][-7:]: r["layout"] for r in transcripts.probe(lines).collect()}
    assert verdict == {"a.jsonl": "flat_role"}
    got = transcripts.read_unknown(lines, transcripts.probe(lines)).orderBy("line_no").collect()
    assert [(r["line_no"], r["role"], r["text"]) for r in got] == [(1, "USER", "hi"), (4, "ASSISTANT", "one\ntwo"), (5, "USER", "bad � byte")]


def test_csv_by_names_and_by_place(spark, tmp_path):
    (tmp_path / "n.csv").write_text('时间,内容,发送人\n2024,"a ""b""\nc",s1\n')
    (tmp_path / "p.csv").write_text("x,y,z\ns2,2025,d\n")
    assert [tuple(r) for r in chats.read_csv(spark, str(tmp_path / "n.csv")).collect()] == [("s1", "2024", 'a "b"\nc')]
    assert [tuple(r) for r in chats.read_csv(spark, str(tmp_path / "p.csv")).collect()] == [("s2", "2025", "d")]


def test_notes(spark, tmp_path):
    (tmp_path / "MEMORY.md").write_text("index")
    (tmp_path / "x.md").write_text("---\nname: a: b\ntype: user\n---\nbody\n")
    (tmp_path / "y.md").write_text("---\nname: open\nno end")
    got = sorted(map(tuple, chats.memories(chats.read_texts(spark, str(tmp_path / "*.md"))).select("name", "type", "content").collect()), key=str)
    assert got == sorted([("a: b", "user", "body\n"), (None, "unknown", "---\nname: open\nno end")], key=str)


def test_manifests(spark):
    files = spark.createDataFrame([("a/package.json", '{"dependencies":{"x":"1"},"devDependencies":{"y":"2"}}'), ("b/package.json", "{broken"), ("pyproject.toml", '[project.dependencies]\nz = ">=3"\n[tool]\nq = "4"\n'), ("go.mod", "require a.b/c v1.2.3\n"), ("requirements.txt", "")], "path string, content string")
    got = sorted((r["name"], r["version"], r["kind"], r["ecosystem"]) for r in chats.manifests(files).collect())
    assert got == [("a.b/c", "v1.2.3", "runtime", "go"), ("x", "1", "runtime", "npm"), ("y", "2", "dev", "npm"), ("z", ">=3", "runtime", "pip")]


def test_written_tables(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "agent string, n int")
    transcripts.write_tables(rows, str(tmp_path / "t"), "agent")
    transcripts.write_tables(spark.createDataFrame([("b", 3)], "agent string, n int"), str(tmp_path / "t"), "agent")
    assert sorted((r["agent"], r["n"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [("a", 1), ("b", 3)]
    transcripts.write_tables(rows, str(tmp_path / "v"), form="tsv")
    assert spark.read.csv(str(tmp_path / "v"), sep="\t", header=True).count() == 2
    transcripts.write_tables(rows, str(tmp_path / "j"), form="json")
    assert json.loads(spark.read.text(str(tmp_path / "j")).orderBy("value").first()[0]) == {"agent": "a", "n": 1}


def test_simhash_segments(spark):
    base = [("c", i, 1_700_000_000 + t, x) for i, (t, x) in enumerate([(0, "alpha beta gamma"), (10, "alpha beta gamma"), (20, "alpha beta delta"), (30, "x y z w v u"), (9000, "x y z w v u"), (9010, ""), (9020, "")])]
    chat = spark.createDataFrame(base, "chat_id string, id long, at long, text string").withColumn("ts", F.timestamp_seconds("at"))
    hashed = chat.select("id", "at", dialogue.simhash(tokens(F.col("text"))).alias("h"), F.transform(tokens(F.col("text")), lambda t: F.xxhash64(t)).alias("hs")).orderBy("id").collect()
    mask = (1 << 64) - 1
    want, state = [], None
    for r in hashed:
        bits = [sum((h & mask) >> i & 1 for h in r["hs"]) * 2 > len(r["hs"]) for i in range(64)]
        h = sum(1 << i for i, b in enumerate(bits) if b)
        assert h == r["h"] & mask
        if state and bin(state[0] ^ h).count("1") <= 22 and r["at"] - state[1] <= 7200:
            want[-1] = (want[-1][0], want[-1][1] + 1)
            state = ((state[0] & h) | ((state[0] | h) & 0xFFFFFFFF), r["at"])
        else:
            want.append((r["id"], 1))
            state = (h, r["at"])
    got = dialogue.simhash_segments(chat, ["chat_id"]).orderBy("segment").collect()
    assert [(r["first_id"], r["messages"]) for r in got] == want


def test_modes(spark):
    chat = spark.createDataFrame([("c", 1, "s", "hello there")], "chat_id string, id long, sender string, text string").withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    assert set(dialogue.analyse(chat, "topics")) == {"segments", "brands"}
    assert all(df.count() >= 0 for df in dialogue.analyse(chat, "full").values())


def test_feeds_parse_each_payload_once(spark):
    from colloquy.sources import chats

    post = "<T><author>{}</author><createTime>{}</createTime><contentDesc>{}</contentDesc></T>"
    rows = [(post.format("a", 5, "one"),), (post.format("b", 9, "two"),), (post.format("a", 1, "one"),), ("no xml",), (None,)]
    out = chats.feeds(spark.createDataFrame(rows, "payload string"), author="a", keyword="one", start=3)
    assert [tuple(r) for r in out.collect()] == [("a", 5, "one")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("from_xml") + out._jdf.queryExecution().optimizedPlan().toString().count("xmltostructs") == 1
