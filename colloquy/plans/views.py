"""The canonical views over the given tables, in Spark and in SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.phrases import P, Q


def _pick(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in values]), (at + 1).cast("int"))


def _start_plus(seconds: Column) -> Column:
    return F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


class Tables:
    """Tables of a folder by name, and the views of this module as v_<name>."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("__"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def v_tool_calls(self) -> DataFrame:
        e = self.events.withColumn("k", F.get_json_object("props", "$.k").cast("int")).withColumn("dd", F.dayofmonth("ts"))
        u, k, dd = F.col("user_id"), F.col("k"), F.col("dd")
        user = u.cast("string")
        session = (
            F.when(u % 3 == 0, F.concat(user, F.lit("-m")))
            .when(u % 3 == 1, F.concat(user, F.lit("-w"), F.floor((dd - 1) / 7).cast("string")))
            .otherwise(F.concat(user, F.lit("-d"), dd.cast("string")))
        )
        failed = (F.col("event_type") == "error") | ((u % 11 == 3) & (k % 2 == 0)) | ((k % 3 == 1) & (dd >= 22) & (k % 5 == 0)) | ((k % 3 == 2) & (dd <= 7) & (k % 5 == 1))
        return e.select(
            session.alias("session_id"), F.col("event_id").alias("seq"),
            F.concat(F.lit("tool_"), (k % 3).cast("string")).alias("name"), "ts",
            F.when(failed, "error").otherwise("ok").alias("status"),
            F.floor(F.col("value") * 10).cast("long").alias("duration_ms"), "user_id", "event_type", "k", "dd",
        )

    @property
    def v_sessions(self) -> DataFrame:
        from ..operators.facts import sessions

        user = F.col("user_id")  # the tables name no agents and projects
        agent, project = F.concat(F.lit("agent_"), (user % 5).cast("string")), F.concat(F.lit("proj_"), (user % 11).cast("string"))
        return sessions(self.v_tool_calls.withColumn("agent", agent).withColumn("project", project))

    @property
    def v_messages(self) -> DataFrame:
        c = F.col
        shift = c("conv_id") * 3600 + c("turn") * 120 + F.floor(c("turn") / 3) * 900
        text = F.concat(_pick(P, F.pmod(c("conv_id") * 3 + c("turn"), F.lit(len(P)))), F.lit(" "), F.coalesce("text", F.lit("")))
        return self.conversations.select(c("conv_id").cast("string").alias("session_id"), c("turn").alias("seq"), F.upper("role").alias("role"), _start_plus(shift).alias("ts"), text.alias("text"))

    @property
    def v_chat(self) -> DataFrame:
        d, c = self.documents, F.col
        ad = c("source").isin("src0", "src1", "src2")
        phrase = F.when(ad, _pick(Q, F.pmod("doc_id", F.lit(2)))).otherwise(_pick(P, F.pmod(c("doc_id") + F.floor(c("doc_id") / 20), F.lit(len(P)))))
        return d.select(
            c("doc_id").alias("id"), c("source").alias("chat_id"), F.when(ad, F.concat(F.lit("优惠券福利群"), c("source"))).otherwise(F.concat(F.lit("chat "), c("source"))).alias("chat_name"),
            F.when(ad, F.lit("s0")).otherwise(F.concat(F.lit("s"), F.pmod("doc_id", F.lit(9)).cast("string"))).alias("sender"), _start_plus(c("doc_id") * 1800).alias("ts"),
            (c("doc_id") - 20).alias("reply_to"), F.concat(phrase, F.lit(" "), F.coalesce("text", F.lit(""))).alias("text"),
        )

    @property
    def v_usage(self) -> DataFrame:
        c = F.col
        tokens = F.when(c("l_tax") == 0, 0.0).otherwise(c("l_quantity") * 100)
        return self.lineitem.select(
            c("l_orderkey").alias("session_id"), c("l_linenumber").alias("request_seq"),
            F.concat("l_returnflag", "l_linestatus").alias("model"), F.round(tokens).cast("long").alias("input_tokens"),
            F.round(tokens * F.round(c("l_discount") * 100) * 5 / 100).cast("long").alias("cache_read_tokens"),
            F.round(c("l_tax") * 1000).cast("long").alias("output_tokens"), c("l_quantity").cast("long").alias("calls"),
            c("l_shipdate").alias("ts"), c("l_suppkey").alias("supp"),
        )

    @property
    def v_tree(self) -> DataFrame:
        return self.orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 1, F.col("o_orderkey") - 1).alias("parent"))

    @property
    def v_commits(self) -> DataFrame:
        return self.orders.select(F.col("o_orderkey").alias("hash"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("subject"))

    @property
    def v_commit_files(self) -> DataFrame:
        return self.lineitem.select(F.col("l_orderkey").alias("hash"), F.col("l_partkey").alias("path"))

    @property
    def v_snapshots(self) -> DataFrame:
        p = self.part.select("p_partkey", "p_name", "p_type", "p_size")
        first = p.where("p_partkey % 7 <> 0").withColumn("snapshot_id", F.lit(1))
        second = p.where("p_partkey % 7 <> 1").withColumn("p_size", F.when(F.col("p_partkey") % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))).withColumn("snapshot_id", F.lit(2))
        return first.unionByName(second)


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


SQL = {
    "v_tool_calls": """
  SELECT CASE user_id % 3 WHEN 0 THEN user_id || '-m' WHEN 1 THEN user_id || '-w' || ((dd - 1) // 7) ELSE user_id || '-d' || dd END AS session_id,
         event_id AS seq, 'tool_' || (k % 3) AS name, ts,
         CASE WHEN event_type = 'error' OR (user_id % 11 = 3 AND k % 2 = 0) OR (k % 3 = 1 AND dd >= 22 AND k % 5 = 0) OR (k % 3 = 2 AND dd <= 7 AND k % 5 = 1) THEN 'error' ELSE 'ok' END AS status,
         floor(value * 10)::BIGINT AS duration_ms, user_id, event_type, k, dd
  FROM (SELECT *, regexp_extract(props, '"k": *([0-9]+)', 1)::INT AS k, day(ts) AS dd FROM events)""",
    "v_sessions": """
  SELECT session_id, 'agent_' || (any_value(user_id) % 5) AS agent, 'proj_' || (any_value(user_id) % 11) AS project, min(ts) AS created, max(ts) AS modified,
         count(*) AS messages, count(*) AS tool_calls, count(*) FILTER (status = 'error') AS errors, sum(duration_ms)::BIGINT AS total_ms,
         (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS duration_seconds
  FROM v_tool_calls GROUP BY session_id""",
    "v_messages": f"""
  SELECT conv_id::VARCHAR AS session_id, turn AS seq, upper(role) AS role, make_timestamp((1704067200 + conv_id * 3600 + turn * 120 + (turn // 3) * 900) * 1000000) AS ts,
         list_extract({_list(P)}, ((conv_id * 3 + turn) % {len(P)} + 1)::INT) || ' ' || coalesce(text, '') AS text FROM conversations""",
    "v_chat": f"""
  SELECT doc_id AS id, source AS chat_id, CASE WHEN source IN ('src0', 'src1', 'src2') THEN '优惠券福利群' || source ELSE 'chat ' || source END AS chat_name,
         CASE WHEN source IN ('src0', 'src1', 'src2') THEN 's0' ELSE 's' || (doc_id % 9) END AS sender, make_timestamp((1704067200 + doc_id * 1800) * 1000000) AS ts, doc_id - 20 AS reply_to,
         CASE WHEN source IN ('src0', 'src1', 'src2') THEN list_extract({_list(Q)}, (doc_id % 2 + 1)::INT) ELSE list_extract({_list(P)}, ((doc_id + doc_id // 20) % {len(P)} + 1)::INT) END || ' ' || coalesce(text, '') AS text
  FROM documents""",
    "v_usage": """
  SELECT l_orderkey AS session_id, l_linenumber AS request_seq, l_returnflag || l_linestatus AS model, round(CASE WHEN l_tax = 0 THEN 0 ELSE l_quantity * 100 END)::BIGINT AS input_tokens,
         round(CASE WHEN l_tax = 0 THEN 0 ELSE l_quantity * 100 END * round(l_discount * 100) * 5 / 100)::BIGINT AS cache_read_tokens, round(l_tax * 1000)::BIGINT AS output_tokens, l_quantity::BIGINT AS calls, l_shipdate AS ts, l_suppkey AS supp
  FROM lineitem""",
    "v_tree": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 1 THEN o_orderkey - 1 END AS parent FROM orders",
    "v_commits": "SELECT o_orderkey AS hash, o_custkey AS author, o_orderdate AS ts, o_orderpriority AS subject FROM orders",
    "v_commit_files": "SELECT l_orderkey AS hash, l_partkey AS path FROM lineitem",
    "v_snapshots": """
  SELECT p_partkey, p_name, p_type, p_size, 1 AS snapshot_id FROM part WHERE p_partkey % 7 <> 0
  UNION ALL SELECT p_partkey, p_name, p_type, CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END, 2 FROM part WHERE p_partkey % 7 <> 1""",
}


def with_views(sql: str) -> str:
    """sql with the views it names put before it."""
    named: list[str] = []

    def add(text: str) -> None:
        for v in re.findall(r"\bv_[a-z_]+\b", text):
            if v in SQL and v not in named:
                add(SQL[v])
                if v not in named:
                    named.append(v)

    add(sql)
    body = sql.strip()
    ctes = ",\n".join(f"{v} AS ({SQL[v]})" for v in named)
    if not ctes:
        return body
    return f"WITH {ctes},\n{body[5:]}" if body[:5].upper() == "WITH " else f"WITH {ctes}\n{body}"
