"""The strategies for large inputs against brute force, with hot values and hot groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabscout.plans import orderstats as o

PROBS = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


def skewed(spark, n=20000):
    # A third of all rows share one value and one group; some rows are null, NaN or very large.
    return spark.range(n).selectExpr(
        "id", "if(id % 3 = 0, 'hot', concat('g', id % 50)) as g",
        "case when id % 3 = 0 then 42.5D when id % 101 = 0 then null when id % 103 = 0 then double('NaN') when id % 107 = 0 then -1e300 "
        "else cast(pmod(xxhash64(id), 100000) as double) / 7 end as v", "cast(id % 13 as int) as w")


def brute(df, column, key=None):
    pdf = df.toPandas()
    pdf[column] = pdf[column].astype("float64")
    groups = [((), pdf)] if key is None else [((k,), part) for k, part in pdf.groupby(key)]
    return {(*k, column): np.quantile(part[column].dropna(), PROBS) for k, part in groups}


@pytest.mark.parametrize("small", [1 << 40, 0])
def test_whole_columns(spark, small, monkeypatch):
    monkeypatch.setattr(o, "FINAL_ROWS", 500)
    monkeypatch.setattr(o, "BUCKETS", 32)
    df = skewed(spark)
    rows = o.quantiles(df, ["v", "w"], PROBS, small_bytes=small).collect()
    want = {**brute(df, "v"), **brute(df, "w")}
    assert len(rows) == 2
    for r in rows:
        np.testing.assert_allclose(r.q, want[(r.column,)], rtol=1e-12)


@pytest.mark.parametrize("small", [1 << 40, 0])
def test_per_group(spark, small):
    df = skewed(spark)
    rows = o.quantiles(df, ["v"], PROBS, keys=["g"], small_bytes=small).collect()
    want = brute(df, "v", "g")
    assert len(rows) == len(want)
    for r in rows:
        np.testing.assert_allclose(r.q, want[(r.g, "v")], rtol=1e-12)


def test_all_null_column(spark):
    df = spark.range(5).selectExpr("cast(null as double) as v", "cast(id as double) as w")
    for small in (0, 1 << 40):
        assert [r.column for r in o.quantiles(df, ["v", "w"], [0.5], small_bytes=small).collect()] == ["w"]


@pytest.mark.parametrize("final", [10, 1 << 20])
@pytest.mark.parametrize("n", [0, 1, 99, 101, 5000])
def test_every_nth_with_one_hot_time(spark, n, final, monkeypatch):
    monkeypatch.setattr(o, "FINAL_ROWS", final)
    df = spark.range(n).selectExpr("id", "if(id % 3 = 0, timestamp'2024-01-01', timestamp_seconds(pmod(xxhash64(id), 1000000))) as ts", "id * 2 as y")
    pdf = df.withColumn("t", o.tie_key(F.col("id"))).toPandas().sort_values(["ts", "t"]).reset_index(drop=True)
    want = pdf.iloc[::max(1, n // 100)]
    got = o.every_nth(df, "ts", "id", 100, ["id", "y"]).toPandas().sort_values("idx")
    assert got["id"].tolist() == want["id"].tolist()
    assert got["idx"].tolist() == want.index.tolist()


def test_dense_ids(spark):
    df = spark.range(3000).select(F.concat(F.lit("é" * 2), (F.col("id") % 700).cast("string")).alias("s")).distinct()
    rows = {r["value"]: r["code"] for r in o.dense_ids(df, "s").collect()}
    assert rows == {v: i for i, v in enumerate(sorted(rows, key=lambda s: s.encode()))}


def test_plan_has_no_python_and_no_collected_group(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = o.quantiles(df, ["l_tax"], [0.5])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "percentile" not in plan
