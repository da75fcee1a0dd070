"""Phrases, spelling variants and token counts against brute force, with odd rows, ties, repeats and clashing columns."""

import collections
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from colloquy.llm import bloom, phrases, terms, token_counts, variants

SCHEMA = "doc_id long, text string, lang string, source string, size int, phrase string, n long, word string, part int, place long"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def frame(spark, rows):
    """rows of (doc_id, text, lang) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "s", 3, "p", 4, "w", 5, 6) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    words = ["alpha", "Beta", "gamma", "delta", "of", "the", "new", "york", "city", "ünder", "x-y"]
    mark = [" ", "  ", "\t", ". ", ", ", "\n", "; ", "\r", " "]
    text = lambda k: "".join(words[int(i)] + mark[int(j)] for i, j in zip(rng.zipf(1.4, k) % len(words), rng.integers(0, len(mark), k)))
    out = [(i, text(int(rng.integers(1, 120))) + "new york city " * int(rng.integers(0, 4)), ["en", "de", None, "und"][i % 4]) for i in range(80)]
    out += [(80, None, "en"), (81, "", None), (82, " \t\n.,;", "fr"), (None, out[5][1], "en"), (None, "new york city " * 4000, "en"), out[6], out[6]]
    return out


def collocations(rows, most=3, least=10, top=2000):
    f, total = collections.Counter(), collections.Counter()
    for _, t, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1))
    found = [p for p, a in f.items() if len(p) > 2 and a >= least]
    gone = {(p[0], *p[i:j]) for p in found for i in range(1, len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) - 1 and 100 * f[p] >= 50 * f[(p[0], *p[i:j])]}
    out = []
    for p in set(found) - gone:
        a = f[p]
        score, _, l, r = min((1000000 * a * a // (f[p[:k]] * f[(p[0], *p[k:])]), k, f[p[:k]], f[(p[0], *p[k:])]) for k in range(2, len(p)))
        out.append((p[0], " ".join(p[1:]), a, l, r, total[p[0]], score))
    out.sort(key=lambda x: (x[0], -x[6], -x[2], x[1].encode()))
    rank = collections.Counter()
    for x in out:
        rank[x[0]] += 1
        if rank[x[0]] <= top:
            yield (x[0], rank[x[0]], *x[1:])


@pytest.mark.parametrize("sample, count, slice_bytes, most, filter_bytes", [(1 / 16, 2, 1 << 22, 3, 1 << 20), (1.0, 1, 500, 3, 64), (0.3, 5, 2000, 3, 128), (0.2, 2, 1 << 22, 5, 64)])
def test_phrases(spark, rows, sample, count, slice_bytes, most, filter_bytes):
    """Whatever the sample proposes, however texts are cut and whatever filters let through, the counts are those of all texts."""
    mining = {"sample": sample, "sample_count": count, "slice_bytes": slice_bytes, "filter_bytes": filter_bytes}
    got = phrases.collocations(frame(spark, rows).repartition(3), most=most, **mining).collect()
    want = list(collocations(rows, most))
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 20
    assert got[0].asDict().keys() == {"lang", "rank", "phrase", "a", "l", "r", "n", "score"}


def test_phrases_first_of_each_lang(spark, rows):
    got = phrases.collocations(frame(spark, rows), top=3).collect()
    assert sorted(map(tuple, got)) == sorted(collocations(rows, top=3))
    assert phrases.collocations(frame(spark, [])).count() == 0
    assert phrases.collocations(frame(spark, [(1, None, None), (2, "", "en")])).count() == 0


def test_border_failures(spark, rows):
    """A sample that proposes nothing leaves all to border failures; one that proposes all leaves none."""
    own = frame(spark, rows)
    for sample, count in ((0.0, 2), (1.0, 1)):
        found = phrases.frequent(own, 3, 10, sample=sample, sample_count=count)
        got = {(r.lang, r.phrase): r.n for r in found.where("size > 0").collect()}
        f = collections.Counter()
        for _, t, lang in rows:
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").replace("Beta", "beta")):
                w = re.findall(r"[^\x20\x09]+", piece)
                f.update((lang or "und", " ".join(w[i : i + k])) for k in range(1, 4) for i in range(len(w) - k + 1))
        assert got == {p: n for p, n in f.items() if n >= 10} and found.where("size > 0").count() == len(got)


def test_last_pass_counts_phrases(spark, rows):
    """Filters that let all phrases through, as if all hashes were shared, leave the counts as they are."""
    every = {k: phrases.All() for k in (1, 2, 3)}
    own = frame(spark, rows).selectExpr("coalesce(lang, 'und') AS lang", "text")
    found = [tuple(r) for r in phrases.spelled(own, every, 3, 10, 700).collect()]
    want = [tuple(r) for r in phrases.frequent(frame(spark, rows), 3, 10).collect()]
    assert sorted(found) == sorted(want) and len(want) > 50


@pytest.mark.parametrize("sample, count", [(0.0, 2), (0.2, 2), (1.0, 1)])
def test_texts_are_read_by_two_full_passes(spark, rows, monkeypatch, sample, count):
    """Beside the sample's, however many words a phrase has and however much the sample missed."""
    read = []
    for name in ("count", "spelled"):
        monkeypatch.setattr(phrases, name, lambda *a, own=getattr(phrases, name), **b: read.append(1) or own(*a, **b))
    got = phrases.collocations(frame(spark, rows), most=5, sample=sample, sample_count=count).collect()
    assert sorted(map(tuple, got)) == sorted(collocations(rows, 5)) and len(read) == 3


def test_phrases_of_many_buckets_and_odd_langs(spark, rows, monkeypatch):
    """Tasks that deal out what they hold again and again, to more buckets than there are words; langs with line ends and
    spaces, and one that is empty."""
    monkeypatch.setattr(phrases, "HELD", 50)
    monkeypatch.setattr(phrases, "HELD_BYTES", 400)
    langs = {"en": "e\nn", "de": "new york", "und": "", "fr": "\n", None: None}
    odd = [(i, t, langs[lang]) for i, t, lang in rows] + [(90, "new york " * 30, "\ne\n")]
    got = [tuple(r) for r in phrases.collocations(frame(spark, odd), slice_bytes=300, bucket_bytes=100).collect()]
    want = [tuple(x) for x in collocations([(i, t, "EMPTY" if lang == "" else lang) for i, t, lang in odd])]
    assert sorted(got) == sorted(("" if x[0] == "EMPTY" else x[0], *x[1:]) for x in want) and len(want) > 20
    assert {"e\nn", "new york", "", "\ne\n"} <= {x[0] for x in got}


def words_of(rows, shortest=7, least=2):
    n = collections.Counter()
    for i, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= shortest and k >= least}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spellings(n):
    out = set()
    form = {}
    about = {w: [v for v in n if abs(len(v) - len(w)) < 2 and near(w, v)] for w in n}
    for w, others in about.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(about[w]), n[form[w]] if form[w] else None))
    return out


@pytest.fixture(scope="module")
def spelled():
    rng = np.random.default_rng(9)
    base = ["".join(rng.choice(list("abcdeéÿÀ"), int(rng.integers(6, 11)))) for _ in range(60)] + ["aaaaaaaa", "aaaaaaa", "Straßenbahn", "x" * 5000]
    out = []
    for i in range(150):
        w = [base[int(k) % len(base)] for k in rng.zipf(1.3, 60)]
        for k in rng.integers(0, len(w), 12).tolist():
            at, c = int(rng.integers(0, len(w[k]))), str(rng.choice(list("abcdeéÿÀZ")))
            w[k] = [w[k][:at] + w[k][at + 1 :], w[k][:at] + c + w[k][at + 1 :], w[k][:at] + c + w[k][at:]][int(rng.integers(0, 3))]
        out.append((i, "-".join(w[:30]) + " 1 " + "\n".join(w[30:]), "en"))
    chain = [("chainword", 3000), ("chainwore", 250), ("chainwoie", 22), ("chanwoie", 2)]
    out += [(200 + k, f"{w} " * c, "en") for k, (w, c) in enumerate(chain)]
    out += [(300, None, None), (301, "", "en"), (None, out[0][1], "en"), (None, "×÷ÆØÅæøå ×÷ÆØÅæøå ×÷ÆØÅæøa", "en"), out[1], out[1]]
    return out


@pytest.mark.parametrize("most", [bloom.MOST_BYTES, 64])
def test_spellings(spark, spelled, most):
    """With filters that hold all and with filters so full that nearly everything passes."""
    n = words_of(spelled)
    got = variants.spellings(frame(spark, spelled).repartition(3), most=most).collect()
    want = spellings(n)
    assert len(got) == len(want) and {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want
    assert sum(1 for x in want if x[2] != x[0] and x[1] != x[2]) > 1 and len(want) > 200


def test_spellings_of_nothing(spark):
    assert variants.spellings(frame(spark, [])).count() == 0
    assert variants.spellings(frame(spark, [(1, None, None), (None, "", None), (3, "short words only", "en")])).count() == 0


def test_edits_pass_once():
    """Every deletion and later replacement that is a word comes out, once, and each is one edit away."""
    words = ["aabbcc", "abbcc", "aabcc", "aabbc", "zabbcc", "aabbccd", "ÿabbcc"]
    held = {}
    for k in {len(w) for w in words}:
        f = bloom.Blocked(np.zeros(8, np.uint64))
        h = variants.word_hashes([w for w in words if len(w) == k])
        first = bloom._block(h, 1) * np.uint64(8)
        for bit in bloom._places(h):
            np.bitwise_or.at(f.bits, first + (bit >> np.uint64(6)), np.uint64(1) << (bit & np.uint64(63)))
        held[k] = f
    found = [(words[i], x) for i, x in variants.edits(words, held) if x in words]
    assert len(found) == len(set(found)) and all(near(a, b) for a, b in found)
    assert {frozenset(p) for p in found} == {frozenset((a, b)) for a in words for b in words if near(a, b)}


def test_bloom(spark):
    keys = [(i % 3, i) for i in range(3000)]

    def hashed(batch: pa.RecordBatch):
        return np.asarray(batch.column(0)), terms.hashes(pa.array([str(x).encode() for x in batch.column(1).to_pylist()]))

    own = {p: terms.hashes(pa.array([str(i).encode() for q, i in keys if q == p])) for p in range(3)}
    other = terms.hashes(pa.array([f"x{i}".encode() for i in range(20000)]))
    for most, shard in ((bloom.MOST_BYTES, 4096), (bloom.MOST_BYTES, 7), (256, 1)):
        got = bloom.build(spark.createDataFrame(keys, "part int, i int"), hashed, most, shard)
        assert all(got[p].test(own[p]).all() for p in range(3))
        assert sum(f.bits.nbytes for f in got.values()) <= max(most, 3 * 64)
        if most > 256:
            assert all(got[p].test(other).mean() < 0.02 for p in range(3))
    assert bloom.build(spark.createDataFrame([], "part int, i int"), hashed) == {}


TEXTS = [
    None, "", " \n\t ", "It's we'll  THEY'D don't ''s 1,234.5 ٣", "a<|endoftext|>b <|startoftext|> <|EndOfText|>", "Straße Été é ́x ΣΣ İI  　", "中文字符 日本語テキスト 한국어 \U0001f600\U0001f469‍\U0001f52c",
    "x" * 30000, "=" * 100 + " " + "-" * 70, " ".join(f"w{i}q" for i in range(30000)), "tab\x1c\x1d\x85x\x00y\x7f", "the the the The THE " * 500,
]


@pytest.mark.parametrize("head_bytes, slice_bytes", [(token_counts.HEAD_BYTES, 2 << 20), (400, 300), (0, 2 << 20)])
def test_token_counts(spark, head_bytes, slice_bytes):
    """Against the library's own count of whole texts, with all, few and none of the pre-tokens held by the tasks."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    rows = [(i, x, "en") for i, x in enumerate(TEXTS)] + [(None, TEXTS[3], None), (None, TEXTS[5], None), (3, TEXTS[3], "en"), (3, TEXTS[4], "en")]
    got = token_counts.count_tokens(frame(spark, rows).repartition(3), TOKENIZER, head_bytes=head_bytes, slice_bytes=slice_bytes).collect()
    want = [(i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x, _ in rows]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(((*r, r[2] > 2048) for r in want), key=key)
    assert token_counts.count_tokens(frame(spark, []), TOKENIZER).count() == 0


def test_token_counts_of_random_words():
    """The library's count of any string is the sum over its words' pre-tokens, also as tasks split them."""
    rng = np.random.default_rng(1)
    p = token_counts.Pieces(TOKENIZER)
    assert p.plain
    chars = [
        *"abzAZ019'.,<>|-_ \n",
        "é",
        "É",
        "ß",
        "÷",
        "×",
        "ÿ",
        "Þ",
        "\u0301",
        "ſ",
        "Σ",
        "İ",
        "中",
        "한",
        "ᄀ",
        "ᅡ",
        "\u200b",
        "\u00a0",
        "\x85",
        "\x1c",
        "ﬁ",
        "\U0001f469",
        "\u200d",
        "ª",
        "µ",
        "²",
        "<|endoftext|>",
    ]
    texts = ["".join(rng.choice(chars, int(rng.integers(1, 25)))) for _ in range(4000)]
    want = [len(p.tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    assert [p.total(t) for t in texts] == want
    for plain in (True, False):
        names, doc, number, n = token_counts.frequencies([t.encode() for t in texts], p.remembered, plain)
        got = np.zeros(len(texts), int)
        np.add.at(got, doc, n * np.array([p.count(x) for x in names.to_pylist()])[number])
        assert [(t, a, b) for t, a, b in zip(texts, got.tolist(), want) if a != b] == []
