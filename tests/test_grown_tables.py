"""Queries on tables whose shape differs from the given ones as larger tables do."""

import datetime

import pytest
from pyspark.sql import functions as F

import checks


def test_interaction_of_the_columns_that_vary_most(spark, tmp_path):
    """The keys spread wider than the prices, so they come first in product and ratio."""
    spark.range(1, 101).select(F.col("id").alias("o_orderkey"), (F.col("id") % 7).alias("o_custkey"), (F.col("id") % 10 + 0.5).alias("o_totalprice")) \
        .write.parquet(f"{tmp_path}/orders.parquet")
    rows = {r["o_orderkey"]: r for r in checks.QUERIES["feat_interact"](spark, str(tmp_path)).collect()}
    assert len(rows) == 100
    assert rows[12]["o_orderkey_x_o_totalprice"] == 30.0 and rows[12]["o_orderkey_div_o_totalprice"] == pytest.approx(4.8)


def test_fitted_features_of_a_target_with_few_values(spark, tmp_path):
    """The target's values are under 5 % of its rows, so it poses a classification, which gets no powers."""
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(minutes=i), i % 50, "abc"[i % 5 % 3], float(i % 20)) for i in range(600)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    out = checks.QUERIES["prep_fitted_gaps"](spark, str(tmp_path))
    assert out.count() == 600
    assert out.columns == ["value", "user_id", "event_type", "user_id_x_event_type", "user_id_div_event_type"]
    assert out.where("user_id is null or event_type is null").isEmpty()


def test_fitted_features_of_customers_with_few_balances(spark, tmp_path):
    rows = [(i, f"c{i}", i % 25, float(i % 21), "abcde"[i % 7 % 5]) for i in range(600)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey long, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    names = ["c_nationkey", "c_mktsegment", "c_nationkey_x_c_mktsegment"]
    assert checks.QUERIES["prep_fitted"](spark, str(tmp_path)).columns == ["c_acctbal", *names]
    assert checks.QUERIES["prep_fitted_transform"](spark, str(tmp_path)).columns == names
