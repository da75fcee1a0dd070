"""Further cases of earlier operators: the ranking against a plain fit, rows without ids and repeated rows."""

import collections
import zlib

import numpy as np
import public_tokenizers
import pytest

from colloquy.llm import bradley_terry, packing, simhash
from colloquy.llm.stats import COUNTS, counts

WORDS = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]


@pytest.fixture(scope="module")
def labelled():
    """Prose and shouting with marks, half of them labelled, some without an id."""
    rng = np.random.default_rng(11)
    rows, marks = [], []
    for i in range(240):
        good = i % 3 > 0
        w = [str(x) for x in rng.choice(WORDS, int(rng.integers(20, 200)))]
        text = " ".join(w) + "." if good else " ".join(x.upper() + "!" * int(rng.integers(0, 4)) for x in w)
        rows.append((i, text, "en", f"s{i % 4}"))
        marks += [(i, int(good))] if i % 2 else []
    rows += [(None, rows[1][1], None, None), (None, None, None, None), (500, "", "en", "s1"), (501, " ".join(WORDS * 400), "de", "s2"), rows[3], rows[3]]
    return rows, marks


def plain_scores(rows, marks, pairs=60_000, penalty=1e-3, seed=5):
    """The same loss by many small steps of gradient descent, on the pairs that the seed draws."""
    draw = {}
    for i, q in marks:
        if zlib.crc32(str(i).encode()) % 5:
            draw[i] = q
    stat = {k: v for k, v in counts([(t or "").encode() for _, t, *_ in rows]).items()}
    x = bradley_terry.features({c: stat[c] for c in COUNTS})
    train = [k for k, r in enumerate(rows) if r[0] in draw]
    return x, train, [draw[rows[k][0]] for k in train]


def test_ranking_equals_a_plain_fit(labelled):
    rows, marks = labelled
    x, train, quality = plain_scores(rows, marks)
    x, good = x[train], np.array(quality) == 1
    model = bradley_terry.fit(x, good, 4000, 1e-2, 5)
    z = (x - x.mean(axis=0)) / np.maximum(x.std(axis=0), 1e-6)
    rng = np.random.default_rng(5)
    a, b = np.flatnonzero(good), np.flatnonzero(~good)
    d = z[rng.choice(a, 4000)] - z[rng.choice(b, 4000)]
    loss = lambda w: float(np.log1p(np.exp(-np.clip(d @ w, -500, 500))).mean() + 0.5e-2 * w @ w)
    w = np.zeros(x.shape[1])
    for _ in range(4000):
        w += 0.02 * ((d.T @ (1 / (1 + np.exp(np.clip(d @ w, -500, 500))))) / len(d) - 1e-2 * w)
    assert loss(model["w"]) <= loss(w) + 1e-6 and np.abs((z @ model["w"]) - (z @ w)).max() < 0.05
    assert model["threshold"] == pytest.approx(np.quantile(z @ model["w"], (~good).mean()))


def test_scores_depend_on_texts_alone(spark, labelled):
    rows, marks = labelled
    labels = spark.createDataFrame(marks + [(None, 1), (9999, 0)], "doc_id long, quality int")
    schema = "doc_id long, text string, lang string, source string"
    one = bradley_terry.score(spark.createDataFrame(rows, schema), labels).collect()
    assert collections.Counter(r.doc_id for r in one) == collections.Counter(r[0] for r in rows)
    by_text = {}
    ids = {}
    for r in one:
        ids.setdefault(r.doc_id, []).append(r.score)
    for i, t, *_ in rows:
        if i is not None:
            by_text.setdefault(t or "", set()).update(ids[i])
    assert all(len(v) == 1 for v in by_text.values()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in one)
    assert sorted(ids[None]) == sorted([*by_text[rows[1][1]], *by_text[""]])
    moved = [(i, t, "xx", None) for i, t, *_ in rows]
    again = bradley_terry.score(spark.createDataFrame(moved, schema), labels).collect()
    assert sorted((r.doc_id or -1, r.score) for r in one) == sorted((r.doc_id or -1, r.score) for r in again)
    far = [r for r in one if r.held_out and r.doc_id is not None and r.doc_id < 240]
    assert len(far) > 20 and sum(r.predicted == (r.doc_id % 3 > 0) for r in far) >= 0.95 * len(far)


@pytest.mark.parametrize("block, rare, piece", [(128, 16, 1024), (8, 3, 5)])
def test_learning_takes_all_labels(spark, labelled, monkeypatch, block, rare, piece):
    """Counts and the threshold equal those over all labelled rows, and the weights those of all pairs of each block."""
    for name, v in {"BLOCK": block, "RARE": rare, "PIECE": piece, "RANGES": 4}.items():
        monkeypatch.setattr(bradley_terry, name, v)
    rows, marks = labelled
    x, train, quality = plain_scores(rows, marks)
    x, good = x[train], np.array(quality) == 1
    stat = counts([(rows[k][1] or "").encode() for k in train])
    known = [(k, int(rows[k][0]), *(int(stat[c][i]) for c in COUNTS), int(good[i])) for i, k in enumerate(train)]
    df = spark.createDataFrame(known, "draw long, doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", quality int").repartition(3)
    model = bradley_terry.learned(df, 1e-2)
    assert np.allclose(model["centre"], x.mean(axis=0)) and np.allclose(model["spread"], np.maximum(x.std(axis=0), 1e-6))
    z = (x - model["centre"]) / model["spread"]
    assert model["threshold"] == pytest.approx(np.quantile(z @ model["w"], (~good).mean()))
    blocks = bradley_terry.compared(df, int(good.sum()), int((~good).sum()), model["centre"], model["spread"]).collect()
    pairs = [[np.frombuffer(v).reshape(-1, x.shape[1]) for v in (r.good, r.bad)] for r in blocks]
    held = {row.tobytes() for p in pairs for side in p for row in np.round(side, 9)}
    assert held == {row.tobytes() for row in np.round(z, 9)}
    d = np.concatenate([(a[:, None] - b).reshape(-1, x.shape[1]) for a, b in pairs])
    p = 1 / (1 + np.exp(-(d @ model["w"])))
    assert np.abs(d.T @ (1 - p) / len(d) - 1e-2 * model["w"]).max() < 1e-6


def test_order_statistics(spark):
    values = sorted([-5.0, -5.0, 0.1, 0.1, 0.1, 1e9, 3.0, 2.5, 2.5000001, -1e-12] * 3 + [7.0])
    df = spark.createDataFrame([(v,) for v in values], "s double").repartition(3)
    for k in (0, 1, 5, 6, 14, 20, 29, 30):
        assert bradley_terry.order_statistics(df, k) == (values[k], values[min(k + 1, 30)])


def test_fingerprints_without_ids(spark):
    rows = [(None, "a b c d e f"), (None, "A b c d e f"), (7, "a b c d e f"), (7, "q r s t u v w x y"), (9, None), (None, ""), (4, "z y x w v u t s"), (4, "z y x w v u t s"), (None, "only here 1 2 3 4 5 6")]
    got = collections.Counter((r.doc_id, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == collections.Counter([(None, 7), (None, 7), (7, 7), (7, 7), (9, 9), (None, 9), (4, 4), (4, 4), (None, None)])


def test_packing_without_ids(spark):
    """Every row's ids lie in pieces once, whatever its id; sequences have no gaps."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["alpha beta", "alpha beta", None, "", " ".join(WORDS * 12), "gamma " * 700]
    rows = [(None, t) for t in texts] + [(5, t) for t in texts] + [(5, texts[0])]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), path).collect()
    sizes = collections.Counter((i, len(packing.encoder(path).encode(t or "")) // 4 + 1) for i, t in rows)
    assert sum(r.length for r in got) == sum(n * k for (_, n), k in sizes.items())
    assert collections.Counter((r.doc_id, r.doc_tokens) for r in got if r.start == 0) == sizes
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048
