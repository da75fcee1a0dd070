"""Every registered query of the reference's operators equals its SQL on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from colloquy import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
plans.load()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.6g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return None if v is None else str(v)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_equals_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=str)
    cursor = duck.execute(plans.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in cursor.fetchall()), key=str)
    assert got == want


def test_split_cjk(spark):
    from pyspark.sql import functions as F

    from colloquy.operators.search import join_cjk, split_cjk

    df = spark.createDataFrame([("数据库abc迁移 x",)], "t string")
    assert df.select(split_cjk(F.col("t"))).first()[0] == "数 据 库 abc 迁 移 x"
    assert df.select(join_cjk(split_cjk(F.col("t")))).first()[0] == "数据库 abc 迁移 x"


def test_stream_equals_batch(spark, tmp_path):
    from colloquy.streaming.live import hourly_error_rate
    from colloquy.plans.views import Tables

    calls = Tables(spark, SF).v_tool_calls.select("ts", "name", "status")
    calls.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(calls.schema).parquet(f"{tmp_path}/in")
    q = hourly_error_rate(stream).writeStream.format("memory").queryName("live").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda r: (r["hour"], r["name"])
    assert sorted(spark.table("live").collect(), key=key) == sorted(hourly_error_rate(spark.read.parquet(f"{tmp_path}/in"), watermark=None).collect(), key=key)
