import numpy as np
import pytest
from pyspark.sql import functions as F

from tabscout.operators import models as m, modelprep as mp, network
from tabscout.operators.oversample import nearest, smote


@pytest.fixture(scope="module")
def flowers(spark):
    rows = [(i, i % 10 + 10.0 * (i % 3), float(i % 7), "ABC"[i % 3]) for i in range(60)]
    return spark.createDataFrame(rows, "key long, f1 double, f2 double, label string").repartition(2).cache()


def test_train_and_rank(flowers):
    rows = m.train_and_rank(flowers, "label", "classification", "key", only=["Logistic Regression", "Random Forest"], folds=2).collect()
    assert len(rows) == 2 and all(0 <= r.test_score <= 1 and 0 <= r.cv_score <= 1 for r in rows)
    assert sum(r.is_best for r in rows) == 1 and rows[0].is_best
    assert all(r.feature_importance and set(r.metrics) >= {"accuracy", "precision", "recall", "f1_score"} for r in rows)


def test_failed_cross_validation(flowers, monkeypatch):
    """A fitted model keeps its test score; its validation has a message and no score unless asked for as written."""
    def fail(*args):
        raise ValueError("no folds today")

    monkeypatch.setattr(m, "cross_validate", fail)
    for as_written in (False, True):
        row = m.train_and_rank(flowers, "label", "classification", "key", only=["Logistic Regression"], folds=2, as_written=as_written).first()
        assert row.error is None and row.is_best and row.cv_error == "no folds today"
        assert row.cv_score == (row.test_score if as_written else None)


def test_too_little_data(flowers):
    with pytest.raises(ValueError):
        mp.prepare(flowers.where("key < 6"), "label", "classification", "key")
    with pytest.raises(ValueError):
        mp.prepare(flowers.where("label = 'A'"), "label", "classification", "key")


def test_boosting_for_several_classes(flowers, monkeypatch):
    data = mp.prepare(flowers, "label", "classification", "key")
    monkeypatch.setattr(m, "_sizes", lambda rows, tuned: (3, 3, 2, 2, 0.1))
    boosting = [c for c in m.classifiers(60, 2, 3) if c.name == "Gradient Boosting"][0]
    assert 0 <= m.train_one(boosting, data, "key", None)["test_score"] <= 1


def test_split_and_folds(spark):
    df = spark.range(1000).selectExpr("id", "if(id % 3 = 0, 'hot', concat('c', id % 5)) as c")
    out = mp.stratified_split(df, "c", "id", 0.2)
    for r in out.groupBy("c").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect():
        assert r.t == round(r.n * 0.2 + 1e-9)
    folds = mp.stratified_folds(df, "c", "id", 5).groupBy("c").pivot("fold").count().collect()
    assert all(max(r[1:]) - min(r[1:]) <= 1 for r in folds)


def test_folds_of_tiny_classes(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, c string")
    assert mp.stratified_folds(df, "c", "id", 5).where("fold between 0 and 4").count() == 3


def test_encode_large_table_without_broadcast(spark, monkeypatch):
    df = spark.range(500).selectExpr("id", "if(id % 3 = 0, 'hot', concat('v', id)) as s")
    codes = mp.fit_codes(df, "s")
    small = {r.id: r.s for r in mp.encode(df, "s", codes).collect()}
    monkeypatch.setattr(mp, "LOOKUP_ROWS", 0)
    assert small == {r.id: r.s for r in mp.encode(df, "s", codes).collect()}
    assert mp.encode(spark.createDataFrame([("new",), (None,)], "s string"), "s", codes).where("s = 0").count() == 2


def test_fitted_preparation_is_repeatable(gaps, spark):
    table = spark.range(60).selectExpr("id", "cast(id % 9 as double) as a", "if(id % 10 = 0, null, id * 1.5) as b", "if(id % 8 = 0, null, concat('k', id % 4)) as t",
                                       "'same' as fixed", "cast(id % 25 as double) * 3 as y")
    prep, fitted = mp.fit_prep(table, "y")
    assert prep.problem_type == "regression" and {"id", "fixed"} <= set(prep.dropped)
    again = prep.transform(table)
    assert sorted(again.columns) == sorted(fitted.columns)
    cols = sorted(fitted.columns)
    a = fitted.select(*[F.round(c, 6).alias(c) for c in cols]).toPandas().sort_values(cols).reset_index(drop=True)
    b = again.select(*[F.round(c, 6).alias(c) for c in cols]).toPandas().sort_values(cols).reset_index(drop=True)
    assert a.equals(b)
    assert fitted.where(" or ".join(f"`{c}` is null" for c in cols)).count() == 0


def test_metrics_of_degenerate_predictions(spark):
    one = spark.createDataFrame([(1.0, 1.0), (1.0, 0.0)], "label double, prediction double")
    got = m.classification_metrics(one).first()
    assert (got.accuracy, got.precision, got.recall) == (0.5, 1.0, 0.5)
    flat = spark.createDataFrame([(2.0, 1.0), (2.0, 3.0)], "label double, prediction double")
    assert m.regression_metrics(flat).first().r2_score is None
    assert m.auc(spark.createDataFrame([(1, 0.5)], "label int, score double")).first()[0] is None


def test_nearest_in_blocks_is_exact(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(300, 3)), 3)
    df = spark.createDataFrame([("a" if i < 260 else "b", f"p{i}", v.tolist()) for i, v in enumerate(x)], "label string, pid string, vec array<double>")
    got = {}
    for r in nearest(df, 4, pivots=8, block=25).collect():
        got.setdefault(r.pid, {})[r["rank"]] = r.distance
    for i in range(300):
        same = range(260) if i < 260 else range(260, 300)
        d = sorted(float(np.sqrt(((x[i] - x[j]) ** 2).sum())) for j in same if j != i)[:4]
        np.testing.assert_allclose([got[f"p{i}"][k] for k in (1, 2, 3, 4)], d)


def test_smote_between_neighbours_with_copies(spark):
    rows = [(i, [0.0, 0.0], "rare") for i in range(4)] + [(4, [1.0, 1.0], "rare"), (5, [2.0, 2.0], "rare")] + [(10 + i, [9.0, float(i)], "usual") for i in range(25)]
    df = spark.createDataFrame(rows, "key long, vec array<double>, y string")
    out = smote(df, "vec", "y", "key", k=5)
    assert {r.y: r.n for r in out.groupBy("y").agg(F.count("*").alias("n")).collect()} == {"rare": 25, "usual": 25}
    made = [r.vec for r in out.where("synthetic").collect()]
    assert len(made) == 19 and all(v[0] == v[1] and 0 <= v[0] <= 2 for v in made)
    assert [tuple(r) for r in smote(df, "vec", "y", "key", k=5).where("synthetic").orderBy("vec").collect()] == \
        [tuple(r) for r in out.where("synthetic").orderBy("vec").collect()]


def test_tuned_training_oversamples(spark):
    rows = [(i, float(i % 9) + (5 if i % 6 == 0 else 0), float(i % 4), int(i % 6 == 0)) for i in range(120)]
    df = spark.createDataFrame(rows, "key long, a double, b double, y int")
    out = m.train_and_rank(df, "y", "classification", "key", only=["Logistic Regression"], folds=None, tuned=True).first()
    assert 0 <= out.test_score <= 1 and "auc_roc" in out.metrics


def test_training_rows_are_spread_over_the_cores(spark):
    """A small file's rows come in one part, which one core would train on alone."""
    df = spark.range(0, 40_000, 1, 1).select("id", (F.col("id") % 13).alias("x"), F.expr("if(id % 13 < 6, 'a', 'b')").alias("y"))
    data = mp.prepare(df, "y", "classification", "id")
    sizes = [r["count"] for r in data.train.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == min(spark.sparkContext.defaultParallelism, 40_000 // mp.LEAST_ROWS)
    assert sum(sizes) + data.test.count() == 40_000 and max(sizes) < 1.2 * min(sizes)


@pytest.mark.parametrize("alone", [True, False])
def test_a_network_takes_the_steps_of_sparks_trainer(spark, monkeypatch, alone):
    """But not a job for each of them where one task can take them; rows of several parts and short blocks."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import VectorAssembler

    monkeypatch.setattr(network, "ALONE", network.ALONE if alone else 0)
    df = spark.range(0, 1500, 1, 3).selectExpr("id", "sin(id * 1.7) as a", "cos(id * 2.3) as b", "cast(pmod(id * id, 7) > 3 or sin(id * 0.9) > 0.5 as double) as label").where("id % 11 > 1")
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df).select("features", "label").localCheckpoint()
    built = [c for c in m.classifiers(1500, 2, 2) if c.name == "Neural Network"][0].build().setMaxIter(12)
    theirs = MultilayerPerceptronClassifier(layers=built.getLayers(), maxIter=12, tol=1e-4, seed=m.SEED).fit(df)
    group = f"steps-{alone}"
    spark.sparkContext.setJobGroup(group, "")
    try:
        model = built.fit(df)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    np.testing.assert_allclose(model.weights.toArray(), theirs.weights.toArray(), rtol=1e-6, atol=1e-9)
    assert model.getMaxIter() == 12
    if alone:
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) < 12


def test_steps_end_where_nothing_is_left_to_gain(spark):
    def bowl(x):
        return float(((x - 3) ** 2).sum()), 2 * (x - 3)

    x, steps = network.minimise(bowl, np.array([10.0, -4.0]), 100, 1e-9)
    assert steps < 20 and np.allclose(x, 3)
    assert network.minimise(bowl, np.array([3.0, 3.0]), 100, 1e-9)[1] == 0
    assert network.minimise(bowl, np.array([10.0, -4.0]), 1, 1e-9)[1] == 1


def test_fits_of_a_network_run_abreast_and_fail_alone(flowers, monkeypatch):
    data = mp.prepare(flowers.where("label <> 'C'"), "label", "classification", "key")
    small = m.Candidate("Neural Network", lambda: network.Perceptron(layers=[2, 4, 2], maxIter=30, seed=1), abreast=True)
    row = m.train_one(small, data, "key", 2)
    apart = m.train_one(m.Candidate("Neural Network", small.build), data, "key", 2)
    assert (row["test_score"], row["cv_score"], row["metrics"]) == (apart["test_score"], apart["cv_score"], apart["metrics"])
    monkeypatch.setattr(m, "stratified_folds", lambda *a: 1 / 0)
    row = m.train_one(small, data, "key", 2)
    assert row["cv_score"] is None and "zero" in row["cv_error"] and row["test_score"] == apart["test_score"]
