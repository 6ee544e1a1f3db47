"""Results do not depend on which strategy the input's size selects."""

import pytest
from pyspark.sql import functions as F

from tabscout.operators import insights, modelprep, models
from tabscout.operators.analysis import analyze
from tabscout.operators.profile import pair_correlations, top_values
from tabscout.operators.query import run
from tabscout.plans import orderstats as o, sizing


@pytest.mark.parametrize("pad", [1, 60, 64, 65, 70, 300])
def test_ties_go_to_the_smallest_text(spark, pad):
    rows = [(c * 1 + "é" * pad + tail,) for tail in ("", "x") for c in "edcba"] * 2 + [("rare" * 40,)]
    df = spark.createDataFrame(rows, "s string")
    want = sorted({r[0] for r in rows[:-1]}, key=lambda s: s.encode())[:3]
    assert [r["value"] for r in top_values(df, ["s"], 3).orderBy("rank").collect()] == want
    assert modelprep.fit_modes(df, ["s"]) == {"s": want[0]}


def test_ties_beyond_the_first_characters(spark):
    rows = [("p" * 500 + f"{i:03d}",) for i in range(200)]
    got = top_values(spark.createDataFrame(rows[::-1], "s string"), ["s"], 4).orderBy("rank").collect()
    assert [r["value"] for r in got] == [r[0] for r in rows[:4]]


@pytest.mark.parametrize("small", [True, False])
def test_median_ignores_nan(spark, small, monkeypatch):
    monkeypatch.setattr(sizing, "is_small", lambda *a: small)
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", float("nan")), ("a", None), ("b", float("nan"))], "g string, v double")
    ask = {"aggregations": [{"column": "v", "function": "median"}]}
    assert run(df, ask).first()["median_v"] == 1.5
    assert {r["g"]: r["median_v"] for r in run(df, {**ask, "groupby": ["g"]}).collect()} == {"a": 1.5, "b": None}


@pytest.mark.parametrize("final", [10, 1 << 20])
def test_every_nth_without_nan(spark, final, monkeypatch):
    monkeypatch.setattr(o, "FINAL_ROWS", final)
    df = spark.range(300).selectExpr("id", "if(id % 7 = 0, double('NaN'), if(id % 11 = 0, null, cast(id % 50 as double))) as x")
    got = [tuple(r) for r in o.every_nth(df, "x", "id", 20, ["id", "x"]).orderBy("idx").collect()]
    monkeypatch.setattr(o, "FINAL_ROWS", 1 << 20)
    clean = df.where("not isnan(x)")
    assert got == [tuple(r) for r in o.every_nth(clean, "x", "id", 20, ["id", "x"]).orderBy("idx").collect()]


@pytest.mark.parametrize("shape", ["id", "-id", "if(id % 3 = 0, 7, id)", "pmod(xxhash64(id), 1000000)", "1"])
def test_rounds_are_few(spark, shape, monkeypatch):
    """Sorted, reversed, hot, random and constant input: every round leaves a small share."""
    rounds = []
    cut_points = o.cut_points
    monkeypatch.setattr(o, "cut_points", lambda *a: rounds.append(1) or cut_points(*a))
    monkeypatch.setattr(o, "BUCKETS", 64)
    df = spark.range(20_000, numPartitions=8).select(F.expr(shape).cast("double").alias("v"))
    ranks = list(range(1, 20_001, 1000))
    found = o.select_ranks(df, {"v": ranks}, final_rows=100)
    values = sorted(r["v"] for r in df.collect())
    assert [found["v", r][0] for r in ranks] == [values[r - 1] for r in ranks]
    assert len(rounds) <= 3


def test_splits_do_not_shuffle_rows(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
    try:
        df = spark.range(5000).selectExpr("id", "concat('label ', id % 4) as label", "repeat('wide', 50) as w")
        plan = modelprep.stratified_split(df, "label", "id", 0.2)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lookup_measures_bytes(spark):
    from tabscout.plans import durable

    wide = spark.range(3).select(F.repeat(F.lit("x"), 20 << 20).alias("s"))
    assert "broadcast" not in durable.lookup(wide)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" in durable.lookup(spark.range(3))._jdf.queryExecution().logical().toString().lower()


def test_correlations_of_odd_columns(spark):
    df = spark.range(2000).selectExpr("1e12 + id as big", "cast(id % 17 as double) as w", "if(id % 5 = 0, null, cast(id as double)) as gap", "3.25D as same",
                                      "cast(null as double) as none", "if(id % 9 = 0, id, null) as few")
    got = {(r["column1"], r["column2"]): r["correlation"] for r in pair_correlations(df, df.columns).collect()}
    frame = df.toPandas().astype("float64")
    want = frame.corr()
    for (a, b), r in got.items():
        assert r == pytest.approx(want.loc[a, b], abs=1e-9)
    assert not any({"same", "none"} & set(pair) for pair in got) and len(got) == 6


def test_insight_of_a_chart_without_data(spark):
    for kind, schema in {"bar": "name string, value double", "pie": "name string, value double, percentage double", "line": "idx long, x string, y double",
                         "scatter": "x double, y double, correlation double", "box": "median double, outliers array<double>",
                         "histogram": "min double, max double, mean double, count long, bin string, bin_start double"}.items():
        told = insights.chart_insight(kind, spark.createDataFrame([], schema), "T").collect()
        assert [r["title"] for r in told] == ["Chart: T"] and told[0]["description"]


def test_best_of_equal_models(spark):
    rows = [("d", "Zeta", 0.8), ("d", "Alpha", 0.8), ("d", "Broken", None)]
    told = insights.models(spark.createDataFrame(rows, "dataset_id string, model_name string, test_score double")).collect()
    assert "Alpha" in told[0]["title"]


def test_a_failed_model_is_a_row(spark, monkeypatch):
    df = spark.range(60).selectExpr("id", "cast(id % 7 as double) as a", "cast(id % 3 as double) as b", "2.0 * (id % 7) as y")
    train_one = models.train_one

    def fail(candidate, *args):
        if candidate.name == "Linear Regression":
            raise RuntimeError("no luck")
        return train_one(candidate, *args)

    monkeypatch.setattr(models, "train_one", fail)
    rows = {r["model_name"]: r for r in models.train_and_rank(df, "y", "regression", "id", only=["Linear Regression"], folds=None).collect()}
    assert rows["Linear Regression"]["error"] == "no luck" and rows["Linear Regression"]["test_score"] is None and not rows["Linear Regression"]["is_best"]


def test_infinities_reach_no_chart(spark):
    df = spark.range(50).selectExpr("id", "if(id = 3, double('Infinity'), cast(id as double)) as x", "if(id = 4, double('NaN'), id * 2.0) as y", "concat('c', id % 3) as c")
    payloads = [r["payload"] for r in analyze(df, "d", key="id").chart_rows.collect()]
    assert payloads and not any(w in p for p in payloads for w in ("Infinity", "NaN"))


def test_positions(spark):
    df = spark.range(1000).selectExpr("id", "id % 10 as v")
    got = {r["id"]: r["position"] for r in o.with_position(df, [F.desc("v"), F.asc("id")]).collect()}
    assert [i for i, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(got, key=lambda i: (-(i % 10), i)) and set(got.values()) == set(range(1, 1001))
