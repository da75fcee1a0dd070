"""Traces of tools from transcripts: calls paired with their results, usage of requests, answers put together from pieces."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .transcripts import blocks_text, field, records

_CALLS, _RESULTS = "array<struct<id:string,name:string,input:string>>", "array<struct<id:string,output:string,failed:boolean>>"


def _get(b: Column, *paths: str, kind: str = "string") -> Column:
    return F.coalesce(*[F.try_variant_get(b, p, kind) for p in paths])


def _list(v: Column, *paths: str) -> Column:
    return F.coalesce(*[F.try_variant_get(v, p, "array<variant>") for p in paths], F.array().cast("array<variant>"))


def _call(b: Column, name: tuple[str, ...], given: tuple[str, ...], key: tuple[str, ...] = ("$.id",)) -> Column:
    return F.struct(_get(b, *key).alias("id"), _get(b, *name).alias("name"), _get(b, *given).alias("input"))


def _result(b: Column, key: tuple[str, ...], output: Column, failed: Column) -> Column:
    return F.struct(_get(b, *key).alias("id"), output.alias("output"), F.coalesce(failed, F.lit(False)).alias("failed"))


def _typed(blocks: Column, kind: str) -> Column:
    return F.filter(blocks, lambda b: F.coalesce(_get(b, "$.type") == kind, F.lit(False)))


def _one(fits: Column, value: Column, kind: str) -> Column:
    return F.when(fits, F.array(value)).otherwise(F.array().cast(kind))


@dataclass(frozen=True)
class Trace:
    """How a dialect's record v tells tool calls, results and usage (input, output, cached tokens so far or of a request)."""

    calls: Callable[[Column], Column]
    results: Callable[[Column], Column]
    usage: tuple[str, str, str]
    request: tuple[str, ...] = ("$.requestId", "$.id")


def _payload(v: Column, kind: str) -> Column:
    return F.coalesce(_get(v, "$.payload.type") == kind, F.lit(False))


TRACES: dict[str, Trace] = {
    # blocks of messages; also the request log of the `says` dialect, whose answers are such blocks
    "nested_message": Trace(
        lambda v: F.transform(_typed(_list(v, "$.message.content", "$.content"), "tool_use"), lambda b: _call(b, ("$.name",), ("$.input",))),
        lambda v: F.transform(_typed(_list(v, "$.message.content", "$.content"), "tool_result"), lambda b: _result(b, ("$.tool_use_id",), blocks_text(b, "$.content"), _get(b, "$.is_error", kind="boolean"))),
        ("$.message.usage.input_tokens", "$.message.usage.output_tokens", "$.message.usage.cache_read_input_tokens"),
    ),
    # rollouts: a record for each call and each output, and counts of all tokens so far
    "nested_payload": Trace(
        lambda v: _one(_payload(v, "function_call"), _call(v, ("$.payload.name",), ("$.payload.arguments",), ("$.payload.call_id",)), _CALLS),
        lambda v: _one(_payload(v, "function_call_output"), _result(v, ("$.payload.call_id",), _get(v, "$.payload.output.content", "$.payload.output"), ~_get(v, "$.payload.output.success", kind="boolean")), _RESULTS),
        ("$.payload.info.total_token_usage.input_tokens", "$.payload.info.total_token_usage.output_tokens", "$.payload.info.total_token_usage.cached_input_tokens"),
        (),
    ),
    # flat lines with lists of calls, results of their own, usage beside them that counts up over a run
    "flat": Trace(
        lambda v: F.transform(_list(v, "$.tool_calls"), lambda b: _call(b, ("$.function.name", "$.name"), ("$.function.arguments", "$.arguments"))),
        lambda v: _one(F.coalesce(_get(v, "$.type") == "tool_result", F.lit(False)), _result(v, ("$.tool_call_id",), blocks_text(v, "$.content"), _get(v, "$.is_error", kind="boolean")), _RESULTS),
        ("$.params.update.usage.inputTokens", "$.params.update.usage.outputTokens", "$.params.update.usage.cachedReadTokens"),
        (),
    ),
    # parts that are texts, calls or responses
    "parts": Trace(
        lambda v: F.transform(F.filter(_list(v, "$.message.parts"), lambda b: _get(b, "$.functionCall.name").isNotNull()), lambda b: _call(b, ("$.functionCall.name",), ("$.functionCall.args",), ("$.functionCall.id",))),
        lambda v: F.transform(F.filter(_list(v, "$.message.parts"), lambda b: _get(b, "$.functionResponse.id").isNotNull()), lambda b: _result(b, ("$.functionResponse.id",), _get(b, "$.functionResponse.response.output", "$.functionResponse.response.error"), _get(b, "$.functionResponse.response.error").isNotNull())),
        ("$.usageMetadata.promptTokenCount", "$.usageMetadata.candidatesTokenCount", "$.usageMetadata.cachedContentTokenCount"),
        ("$.uuid",),
    ),
}


def tool_trace(lines: DataFrame, dialect: str) -> DataFrame:
    """(path, line_no, id, name, input, output, failed, answered) of each tool call of a dialect.

    Of calls with one id in a file the last written counts, and of its results as well; calls without an id stay apart and
    unanswered. Both sides are reduced to one row for each id before they meet.
    """
    own = TRACES[dialect]
    r = records(lines)
    calls = r.select("path", "line_no", F.posexplode(own.calls(F.col("v"))).alias("place", "c")).select("path", "line_no", "place", "c.*")
    key = F.coalesce("id", F.concat_ws(" ", F.lit("line"), F.col("line_no").cast("string"), F.col("place").cast("string")))
    last = calls.groupBy("path", key.alias("key")).agg(F.max_by(F.struct("line_no", "id", "name", "input"), F.struct("line_no", "place")).alias("c")).select("path", "key", "c.*")
    results = r.select("path", "line_no", F.explode(own.results(F.col("v"))).alias("r")).select("path", "line_no", "r.*").where("id IS NOT NULL")
    answer = results.groupBy("path", F.col("id").alias("key")).agg(F.max_by(F.struct("output", "failed"), "line_no").alias("r"))
    both = last.join(answer, ["path", "key"], "left")
    return both.select("path", "line_no", "id", "name", "input", "r.output", F.coalesce("r.failed", F.lit(False)).alias("failed"), F.col("r").isNotNull().alias("answered"))


def request_usage(lines: DataFrame, dialect: str) -> DataFrame:
    """(path, request, line_no, input_tokens, output_tokens, cached_tokens): the last usage that a dialect tells of each
    request; where it names no requests every record with usage is one, to be read as counts so far (run_reset)."""
    own = TRACES[dialect]
    v = F.col("v")
    legs = [F.try_variant_get(v, p, "bigint") for p in own.usage]
    names = ("input_tokens", "output_tokens", "cached_tokens")
    line = F.concat(F.lit("line "), F.col("line_no").cast("string"))
    request = F.coalesce(*[field(v, p) for p in own.request], line) if own.request else line
    u = (
        records(lines).select(
            "path", "line_no", request.alias("request"), *[F.coalesce(c, F.lit(0)).alias(n) for c, n in zip(legs, names)],
            (legs[0].isNotNull() | legs[1].isNotNull()).alias("told"),
        )
        .where("told")
    )
    return u.groupBy("path", "request").agg(F.max(F.struct("line_no", *names)).alias("u")).select("path", "request", "u.*")


def assembled(lines: DataFrame) -> DataFrame:
    """(path, request, index, kind, name, id, text) of answers that are written in pieces while they stream.

    A piece names its request, the index of the block it belongs to, and adds to the block or states it whole; a later
    whole piece takes the place of all before it, and a block that starts again begins anew. Texts and the inputs of
    tool calls are put together alike. A block's pieces are as many as its answer is long, and meet by its own key.
    """
    v = F.col("v")
    kind = field(v, "$.event.type", "$.type")
    number = F.coalesce(F.try_variant_get(v, "$.event.index", "int"), F.try_variant_get(v, "$.index", "int"))
    add = field(v, "$.event.delta.text", "$.event.delta.thinking", "$.event.delta.partial_json", "$.delta.text", "$.delta.thinking", "$.delta.partial_json")
    whole = field(v, "$.event.content_block.text", "$.event.content_block.thinking", "$.content_block.text", "$.content_block.thinking")
    starts = F.coalesce(kind == "content_block_start", F.lit(False))
    p = records(lines).select(
        "path", "line_no", field(v, "$.requestId", "$.request", "$.message.id").alias("request"), number.alias("index"), starts.alias("starts"),
        F.when(starts, F.struct(field(v, "$.event.content_block.type", "$.content_block.type").alias("kind"), field(v, "$.event.content_block.name", "$.content_block.name").alias("name"), field(v, "$.event.content_block.id", "$.content_block.id").alias("id"))).alias("block"),
        F.when(starts, F.coalesce(whole, F.lit(""))).otherwise(add).alias("text"),
    ).where("request IS NOT NULL AND index IS NOT NULL AND text IS NOT NULL")
    g = p.groupBy("path", "request", "index").agg(
        F.max(F.when(F.col("starts"), F.col("line_no"))).alias("first"), F.max_by("block", F.when(F.col("starts"), F.col("line_no"))).alias("block"), F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("pieces")
    )
    kept = F.filter("pieces", lambda x: F.col("first").isNull() | (x["line_no"] >= F.col("first")))
    return g.select("path", "request", "index", F.coalesce("block.kind", F.lit("text")).alias("kind"), "block.name", "block.id", F.array_join(kept["text"], "").alias("text"))


def answers(blocks: DataFrame) -> DataFrame:
    """(path, request, text, tools) of assembled blocks: their texts by index, joined by newlines, and the names of the tools."""
    parts = F.array_sort(F.collect_list(F.when(F.col("kind") == "text", F.struct("index", "text"))))
    tools = F.array_sort(F.collect_list(F.when(F.col("kind") == "tool_use", F.struct("index", "name"))))
    return blocks.groupBy("path", "request").agg(F.array_join(parts["text"], "\n").alias("text"), tools["name"].alias("tools"))
