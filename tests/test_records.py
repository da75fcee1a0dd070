"""Facts and turns of mixed records, traces of four dialects, answers put together from pieces."""

import json
import random

import pytest

from colloquy.operators import records as rec
from colloquy.sources import traces

LINES = "path string, line_no int, raw string"


def frame(spark, records, path="p"):
    return spark.createDataFrame([(path, i + 1, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records)], LINES).repartition(3)


def user(content, **more):
    return {"type": "user", "timestamp": f"2024-01-0{more.pop('day', 1)}T00:00:00Z", "message": {"role": "user", "content": content}} | more


def answer(blocks, request=None, usage=(0, 0, 0, 0), model="m1", **more):
    keys = ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")
    return {"type": "assistant", "requestId": request, "timestamp": "2024-01-02T00:00:00Z", "message": {"role": "assistant", "model": model, "content": blocks, "usage": dict(zip(keys, usage)) if usage else None}} | more


TEXT = {"type": "text", "text": "done"}
CALL = {"type": "tool_use", "id": "t1", "name": "Read", "input": {"file_path": "/a"}}
SESSION = [
    user("start here", gitBranch="", slug="s-1"), answer([TEXT, CALL], "r1", (10, 1, 2, 3), gitBranch="main"), answer([CALL | {"id": "t2"}], "r1", (11, 5, 2, 3)),
    user([{"type": "tool_result", "tool_use_id": "t1", "content": "x", "is_error": True}, {"type": "tool_result", "tool_use_id": "t2", "content": "y", "is_error": True}]),
    user([{"type": "text", "text": "go on"}]), answer("no blocks", None, (100, 0, 0, 0), "m2"), answer([TEXT], None, (7, 7, 7, 7), "<synthetic>"), user("<system-reminder a='b'>x</system-reminder>"),
    user("<system-reminder>x</system-reminder> but do this", day=9), user("meta", isMeta=True), user("old", isCompactSummary=True), user("[Request interrupted by user]"), user("  "), user("<system-reminder>open"),
    {"type": "system", "subtype": "compact_boundary"}, {"type": "system", "subtype": "microcompact_boundary"}, {"type": "system", "subtype": "other"},
    {"type": "file-history-snapshot", "snapshot": {"trackedFileBackups": {"a": {}, "b": {}, "c": {}}}}, {"type": "file-history-snapshot", "snapshot": {"trackedFileBackups": {"a": {}}}},
    {"type": "summary", "summary": "first"}, {"type": "summary", "summary": "last"}, {"type": "progress", "isError": True}, "broken {", "", "[1]", answer([TEXT], "r9", None),
]


def test_session_records(spark):
    df = frame(spark, SESSION).union(frame(spark, [user("alone")], "q"))
    got = {r.path: r for r in rec.session_records(df).collect()}
    p = got["p"]
    assert (p.user_messages, p.assistant_messages, p.tool_calls, p.errors, p.compactions, p.files_edited) == (6, 4, 2, 2, 2, 3)
    assert (p.input_tokens, p.output_tokens, p.cache_read_tokens, p.cache_create_tokens) == (111, 5, 2, 3)
    assert (p.branch, p.slug, p.model, p.summary, p.started, p.ended) == ("main", "s-1", "m1", "last", "2024-01-01T00:00:00Z", "2024-01-09T00:00:00Z")
    assert (got["q"].user_messages, got["q"].input_tokens, got["q"].summary, got["q"].files_edited) == (1, 0, None, 0)
    assert rec.session_records(df.limit(0)).count() == 0


def test_turns(spark):
    got = [(r.line_no, r.role, r.text) for r in rec.turns(frame(spark, SESSION)).orderBy("line_no").collect()]
    assert got == [(1, "USER", "start here"), (2, "ASSISTANT", "done"), (5, "USER", "go on"), (6, "ASSISTANT", "no blocks"), (9, "USER", "but do this"), (26, "ASSISTANT", "done")]


def traced(spark, dialect, records):
    return {r.id: (r.name, r.output, r.failed, r.answered) for r in traces.tool_trace(frame(spark, records), dialect).collect()}


WANT = {"a": ("Read", "text", False, True), "b": ("Bash", "bad", True, True), "c": ("Grep", None, False, False)}
DIALECTS = {
    "nested_message": [
        {"message": {"content": [{"type": "tool_use", "id": "a", "name": "Read", "input": {}}, {"type": "tool_use", "id": "b", "name": "Old", "input": {}}]}}, {"content": [{"type": "tool_use", "id": "b", "name": "Bash", "input": {}}, {"type": "tool_use", "id": "c", "name": "Grep"}]},
        {"message": {"content": [{"type": "tool_result", "tool_use_id": "a", "content": [{"type": "text", "text": "text"}]}, {"type": "tool_result", "tool_use_id": "b", "content": "bad", "is_error": True}]}}, {"message": {"content": "plain"}},
    ],
    "nested_payload": [
        *({"type": "response_item", "payload": {"type": "function_call", "call_id": i, "name": n, "arguments": "{}"}} for i, n in (("a", "Read"), ("b", "Bash"), ("c", "Grep"))),
        {"payload": {"type": "function_call_output", "call_id": "a", "output": "early"}}, {"payload": {"type": "function_call_output", "call_id": "a", "output": "text"}}, {"payload": {"type": "function_call_output", "call_id": "b", "output": {"content": "bad", "success": False}}}, {"payload": {"type": "message"}},
    ],
    "flat": [
        {"type": "assistant", "tool_calls": [{"id": "a", "function": {"name": "Read", "arguments": "{}"}}, {"id": "b", "name": "Bash"}]}, {"type": "assistant", "tool_calls": [{"id": "c", "name": "Grep"}]}, {"type": "assistant", "content": "x"},
        {"type": "tool_result", "tool_call_id": "a", "content": "text"}, {"type": "tool_result", "tool_call_id": "b", "content": "bad", "is_error": True},
    ],
    "parts": [
        {"type": "assistant", "message": {"parts": [{"text": "x"}, *({"functionCall": {"id": i, "name": n, "args": {}}} for i, n in (("a", "Read"), ("b", "Bash"), ("c", "Grep")))]}},
        {"type": "user", "message": {"parts": [{"functionResponse": {"id": "a", "response": {"output": "text"}}}, {"functionResponse": {"id": "b", "response": {"error": "bad"}}}]}},
    ],
}


@pytest.mark.parametrize("dialect", DIALECTS)
def test_tool_trace(spark, dialect):
    assert traced(spark, dialect, DIALECTS[dialect]) == WANT
    assert traces.tool_trace(frame(spark, ["", "{}", "no"]), dialect).count() == 0


def test_calls_without_ids(spark):
    got = traces.tool_trace(frame(spark, [{"tool_calls": [{"name": "A"}, {"name": "B"}]}, {"tool_calls": [{"name": "A"}]}]), "flat").collect()
    assert sorted(r.name for r in got) == ["A", "A", "B"] and not any(r.answered for r in got)


def test_request_usage(spark):
    u = lambda i, o: {"message": {"usage": {"input_tokens": i, "output_tokens": o}}}
    got = {(r.request, r.input_tokens, r.output_tokens, r.cached_tokens) for r in traces.request_usage(frame(spark, [u(1, 1) | {"requestId": "r"}, u(2, 5) | {"requestId": "r"}, u(3, 3), {"message": {}}]), "nested_message").collect()}
    assert got == {("r", 2, 5, 0), ("line 3", 3, 3, 0)}
    flat = [{"params": {"update": {"usage": {"inputTokens": n, "outputTokens": 1, "cachedReadTokens": 2}}}} for n in (5, 9)]
    assert sorted((r.line_no, r.input_tokens) for r in traces.request_usage(frame(spark, flat), "flat").collect()) == [(1, 5), (2, 9)]


def test_assembled(spark):
    """Pieces of several requests, interleaved, with restarts and whole blocks, against a plain loop."""
    rng = random.Random(3)
    lines, want = [], {}
    for _ in range(400):
        r, i = f"r{rng.randrange(4)}", rng.randrange(3)
        if rng.random() < 0.1 or (r, i) not in want and rng.random() < 0.5:
            kind, text = rng.choice([("text", ""), ("text", "T"), ("thinking", "H"), ("tool_use", "")])
            lines.append({"requestId": r, "event": {"type": "content_block_start", "index": i, "content_block": {"type": kind, "name": "N" if kind == "tool_use" else None, kind: text}}})
            want[(r, i)] = [kind, text]
        else:
            word = rng.choice("abc")
            lines.append({"requestId": r, "event": {"type": "content_block_delta", "index": i, "delta": {rng.choice(["text", "partial_json"]): word}}})
            want.setdefault((r, i), ["text", ""])[1] += word
        if rng.random() < 0.2:
            lines.append({"requestId": r, "event": {"type": "ping"}})
    blocks = traces.assembled(frame(spark, lines))
    assert {(x.request, x["index"]): [x.kind, x.text] for x in blocks.collect()} == want
    got = {x.request: (x.text, x.tools) for x in traces.answers(blocks).collect()}
    assert got == {r: ("\n".join(want[k][1] for k in sorted(want) if k[0] == r and want[k][0] == "text"), ["N"] * sum(k[0] == r and x[0] == "tool_use" for k, x in want.items())) for r in {k[0] for k in want}}
