"""The stages on the smallest documents: each decision holds and the columns stay."""

import collections

import corpus_pipeline
from colloquy.llm import outliers
from colloquy.llm.tables import materialise

SF = "/root/testdata/sf0.001"


def test_near_duplicates_found(spark):
    """The near-duplicate stage against all pairs of sf0.01 that share 0.8 of their five-word shingles; prints its recall."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: shingles(r.text, 5) for r in docs.collect()}
    size = sorted((len(x), i) for i, x in rows.items())
    pairs = []
    for k, (n, i) in enumerate(size):
        for m, j in size[k + 1 :]:
            if n < 0.8 * m:
                break
            if len(rows[i] & rows[j]) >= 0.8 * len(rows[i] | rows[j]):
                pairs.append((i, j))
    name = {i: i for i in rows}
    for _ in range(20):
        for i, j in pairs:
            name[i] = name[j] = min(name[i], name[j])
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    gone, should = set(rows) - kept, set(rows) - set(name.values())
    print(f"near-duplicates found: {len(gone & should)} of {len(should)}, others dropped: {len(gone - should)}")
    assert len(gone & should) >= 0.95 * len(should) and not gone - should


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


ROWS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, fp string, text_key int, size string"


def test_stages_on_odd_rows(spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing columns, and no rows at all."""
    word = lambda n: "".join(chr(97 + n // 26**k % 26) for k in range(5))
    long = " ".join(word(i * 7919 % 104729) for i in range(60_000))
    plain = [" ".join(word((i * 50 + j) * 7919 % 11881376) for j in range(1, 80 + i)) for i in range(30)]
    rows = [(i, t, ["en", None][i % 2], ["a", None, "b"][i % 3], None, None, None, i, None) for i, t in enumerate(plain)]
    rows += [(None, None, None, None, None, None, None, None, None), (None, plain[3], "en", "a", 5, True, "x", 1, "y"), (50, "", "en", "a", 0, None, "", 2, ""), (51, long, "en", "b", len(long), False, "z", 3, "s"), (0, plain[1], "en", "a", 1, None, "", 4, ""), rows[2], rows[2]]
    for data in (rows, []):
        docs = spark.createDataFrame(data, ROWS)
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = materialise(stage(spark, docs, SF), name)
            assert name == "pack_sequences" or docs.columns == columns
            texts = [r.text for r in docs.collect()] if name != "pack_sequences" else []
            if data and name in ("quality_rules", "simhash_near_dedup", "redact_personal_data"):
                assert long in texts and None not in texts and "" not in texts
            if data and name == "simhash_near_dedup":
                assert len(texts) == len(set(texts))
        assert bool(data) == bool(docs.count())


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialise(stage(spark, docs, SF), name)
        seen[name] = docs.count()
        if name == "quality_rules":
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in outliers.judge(before).where("kept").collect()}
        if name == "simhash_near_dedup":
            # five words and 0.8, as for every stage on word shingles; the query of operator 8 has four words and bits
            rows = sorted((r.doc_id, shingles(r.text, 5)) for r in before.collect())
            name = {i: i for i, _ in rows}
            near = [(i, j) for i, a in rows for j, b in rows if i < j and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b)]
            for _ in range(20):
                for i, j in near:
                    name[i] = name[j] = min(name[i], name[j])
            sets, want = dict(rows), set(name.values())
            assert {r.doc_id for r in docs.collect()} == want and len(want) < len(sets)
        if name != "pack_sequences":
            assert docs.columns == columns
    tokens = collections.Counter()
    for r in docs.collect():
        tokens[r.sequence_id] += r.length
    assert tokens and max(tokens.values()) <= 2048 and all(seen.values())
