"""The stored index against a plain reading of the rows: phrases, conditions, appended batches, odd rows, read folders."""

import math
import re

import numpy as np
import pytest

from colloquy.operators.index import PhraseIndex

TOKEN = re.compile(r"[㐀-䶿一-鿿豈-﫿]|[A-Za-z0-9_]+")


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    words = ["error", "Error", "the", "rate", "limit", "看", "看看", "数据库", "x_1", "a-b", "429"]
    out = [(i, " ".join(rng.choice(words, int(rng.integers(1, 40)))), f"c{i % 4}", ["USER", "TOOL", None][i % 3]) for i in range(200)]
    return out + [(200, None, "c1", "USER"), (201, "", None, None), (202, "the " * 20_000 + "rate limit", "c1", "TOOL"), (None, "rate limit", "c1", "USER"), out[3], out[3]]


SCHEMA = "key long, text string, chat string, role string"


def plain(rows, phrase, ok=lambda r: True):
    """key to (tf, len)."""
    want, out = [w.lower() for w in TOKEN.findall(phrase)], {}
    for r in rows:
        w = [x.lower() for x in TOKEN.findall(r[1] or "")]
        tf = sum(w[i : i + len(want)] == want for i in range(len(w) - len(want) + 1)) if want else 0
        if r[0] is not None and tf and ok(r):
            out[r[0]] = (tf, len(w))
    return out


@pytest.fixture(scope="module", params=[1, 3])
def index(request, spark, rows, tmp_path_factory):
    """Built at once, and in three batches that overlap."""
    out = PhraseIndex(spark, str(tmp_path_factory.mktemp("index") / "i"), "key", {"chat": "string", "role": "string"}, buckets=5)
    parts = [rows] if request.param == 1 else [rows[:90], rows[60:150], rows]
    added = [out.append(spark.createDataFrame(p, SCHEMA)) for p in parts]
    assert sum(added) == 203 and out.append(spark.createDataFrame(rows, SCHEMA)) == 0
    return out


@pytest.mark.parametrize("phrase", ["error", "rate limit", "看看", "看 看", "the the", "数据库 the", "x_1 a b 429", "nothing here", "", "。。"])
def test_phrases(index, rows, phrase):
    assert {r.key: (r.tf, r.len) for r in index.hits(phrase).collect()} == plain(rows, phrase)


def test_conditions(index, rows):
    got = {r.key: (r.tf, r.len) for r in index.hits("error", "role <> 'TOOL'").collect()}
    assert got == plain(rows, "error", lambda r: r[3] not in ("TOOL", None))
    facets = {r.chat: r.hits for r in index.facets("the", "chat").collect()}
    want = plain(rows, "the")
    by = {r[0]: r[2] for r in rows}
    assert facets == {c: sum(1 for k in want if by[k] == c) for c in {by[k] for k in want}}


def test_scores(index, rows):
    keyed = {r[0]: r for r in rows if r[0] is not None}
    lens = [len(TOKEN.findall(r[1] or "")) for r in keyed.values()]
    hits = plain(rows, "rate limit")
    idf = max(math.log((len(lens) - len(hits) + 0.5) / (len(hits) + 0.5)), 1e-6)
    score = {k: round(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / (sum(lens) / len(lens)))), 6) for k, (tf, n) in hits.items()}
    best = sorted(score.items(), key=lambda x: (-x[1], x[0]))
    assert [(r.key, r.score) for r in index.search("rate limit", 5).collect()] == best[:5]
    assert len(index.search("rate limit", 0).collect()) == len(best)
    top = {}
    for k, s in best:
        top.setdefault(keyed[k][2], s)
    assert {r.chat: r.score for r in index.groups("rate limit", "chat").collect()} == top


def test_completions(index, rows):
    got = {r.term: r.df for r in index.completions("e").collect()}
    assert got == {"error": len(plain(rows, "error"))}


def test_reads_few_buckets(index):
    """A query opens the folders of its terms' buckets, in every batch, and no others."""
    hits = index.of_terms("postings", "term string, key long, positions array<int>, batch int, bucket int", ["rate"])
    folders = {f.split("bucket=")[1].split("/")[0] for f in hits.inputFiles()}
    assert len(folders) > 1  # all that exist
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and f"bucket#" in plan.split("PartitionFilters")[1].split("PushedFilters")[0] and "EqualTo(term,rate)" in plan
    read = {r[0] for r in hits.selectExpr("input_file_name()").distinct().collect()}
    assert read and all(f"bucket={index.bucket('rate')}/" in f for f in read)


def test_unfinished_batch(spark, tmp_path):
    """What a failed append wrote is not seen, and the next append writes it anew."""
    own = PhraseIndex(spark, str(tmp_path / "i"), "key", {"chat": "string", "role": "string"}, buckets=3)
    assert own.hits("a").count() == 0 and own.search("a").count() == 0 and own.completions("a").count() == 0
    assert own.append(spark.createDataFrame([(1, "one two", "c", None)], SCHEMA)) == 1
    for name in ("rows", "postings"):
        spark.read.parquet(f"{own.path}/{name}/batch=1").write.parquet(f"{own.path}/{name}/batch=2")
    assert own.hits("one two").count() == 1
    assert own.append(spark.createDataFrame([(2, "one two", "c", None)], SCHEMA)) == 1
    assert {r.key for r in own.hits("one two").collect()} == {1, 2}
    assert own.append(spark.createDataFrame([], SCHEMA)) == 0


def test_positions_are_gathered_before_the_exchange(spark, tmp_path):
    """One row of a term and a text is shuffled, however often the term stands there; texts of unique keys are not."""
    def shuffled():
        sc = spark.sparkContext
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jvm.scala.jdk.javaapi.CollectionConverters.asJava(sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None))
        return sum(s.shuffleWriteRecords() for s in stages)

    docs = spark.createDataFrame([(i, " ".join(["alpha", "beta"] * 2000)) for i in range(30)] + [(30, None), (31, "")], "id long, text string")
    before = shuffled()
    index = PhraseIndex(spark, f"{tmp_path}/index", "id", {})
    assert index.append(docs) == 32
    assert shuffled() - before < 1000
    assert {(r.key, r.tf) for r in index.hits("beta alpha").collect()} == {(i, 1999) for i in range(30)}
    assert index.append(docs.union(spark.createDataFrame([(40, "alpha"), (40, "alpha")], docs.schema))) == 1
    assert {(r.term, r.df) for r in index.completions("alp").collect()} == {("alpha", 31)}
