"""Base spans and masks against Python's re on whole documents and random texts; many matches in one text."""

import hashlib
import re
import time

import numpy as np

from colloquy.llm import pii

KINDS = ["email", "ip", "card", "phone"]
PATTERNS = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(int(x) for x in reversed(digits))) % 10 == 0


def fits(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {"email": True, "ip": all(int(p) <= 255 for p in match.split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]


def spans(text):
    found = [(m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in p.finditer(text or "") if fits(KINDS[k], m[0])]
    return sorted(found)


def told(found):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def test_base_spans(spark):
    rng = np.random.default_rng(7)
    bits = [
        "a.b@c.de",
        "é",
        "1.2.3.4",
        "999.1.1.1",
        "4111 1111 1111 1111",
        "+1 (788) 555-2942",
        " ",
        "\n",
        "-",
        ".",
        "@",
        "+",
        "0",
        "12",
        "x_y",
        "😀",
        "4111111111111111",
        "@q.r",
        "...",
        "token: ",
        "ab12cd34",
    ]
    rows = [(i, "".join(rng.choice(bits, int(rng.integers(1, 40))))) for i in range(600)]
    rows += [(1000 + r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    masked = {r.doc_id: r.text for r in pii.redact(df).collect()}
    for r in pii.report(df).collect():
        text = dict(rows)[r.doc_id]
        want = spans(text)
        assert r.base_sha256 == hashlib.sha256(told(want).encode()).hexdigest(), text
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in want) for j in range(4)]
        every = [x.split(":") for x in r.spans.split(",") if x]
        assert [x for x in every if x[0] != "context"] == [x.split(":") for x in told(want).split(",") if x]
        out, at = [], 0
        for kind, a, b in every:
            a, b = int(a), int(b)
            out.append((text or "")[at:a] + f"<{kind.upper()}>" if a >= at else "")
            at = max(at, b)
        assert masked[r.doc_id] == ("".join(out) + text[at:] if text else text)


def test_many_matches(spark):
    text = lambda n: " ".join(f"10.0.{i % 256}.{i // 256 % 256} é token: k{i:07d}" for i in range(n))
    rows = [(1, text(40)), (2, text(30_000)), (None, text(200)), (None, text(200)), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.time()
    got = pii.report(df).collect()
    assert time.time() - began < 60  # a text of over 900 KB with 60,000 spans
    by_n = sorted((r.n_ip, len(re.findall("context", r.spans))) for r in got)
    assert by_n == [(0, 0), (40, 40), (200, 200), (200, 200), (30_000, 30_000)]
    masked = sorted((r.text or "" for r in pii.redact(df).collect()), key=len)
    assert masked == sorted((" ".join(["<IP> é token: <CONTEXT>"] * n) for n in (0, 40, 200, 200, 30_000)), key=len)
