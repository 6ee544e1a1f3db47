"""Training, evaluating and ranking standard models with Spark ML."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial, reduce

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tabscout.functions.text import ref
from tabscout.operators.modelprep import TrainingData, class_balance, class_weights, evenly, prepare, stratified_folds
from tabscout.operators.network import Perceptron
from tabscout.operators.oversample import is_severe, smote
from tabscout.plans.durable import durable, lookup

log = logging.getLogger(__name__)
SEED = 42
TOP_FEATURES = 10
SMALL_TABLE, LARGE_TABLE = 500, 1000  # rows at which the tuned variants grow

#: Each row keeps its node of each tree, so that no level walks the trees from their roots again; depth bounds the lineage.
FOREST = {"cacheNodeIds": True, "checkpointInterval": -1}


@dataclass(frozen=True)
class Candidate:
    name: str
    build: Callable[[], object]
    weighted: bool = False  # trains on class weights
    abreast: bool = False  # its fits run at the same time, as one leaves cores idle


def classifiers(rows: int, features: int, classes: int, tuned: bool = False, balanced: bool = False) -> list[Candidate]:
    """Models for a classification table; ``tuned`` uses the larger variants."""
    common = {"featuresCol": "features", "labelCol": "label"}
    weight = {"weightCol": "weight"} if balanced else {}
    trees, depth, rounds, boost_depth, step = _sizes(rows, tuned)

    def boosting():
        gbt = GBTClassifier(maxIter=rounds, maxDepth=boost_depth, stepSize=step, subsamplingRate=0.8, seed=SEED, **common)
        return gbt if classes <= 2 else OneVsRest(classifier=gbt, **common)

    if tuned:
        wide = min(100, max(50, features * 2))
        hidden = [wide, wide // 2]
    else:
        hidden = [100, 50] if features < 50 else [100]
    return [
        Candidate("Logistic Regression", lambda: LogisticRegression(maxIter=2000, tol=1e-4, **common, **weight), balanced),
        Candidate("Random Forest", lambda: RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=2, seed=SEED, **FOREST, **common, **weight), balanced),
        Candidate("Gradient Boosting", boosting),
        Candidate("Neural Network", lambda: Perceptron(layers=[features, *hidden, classes], maxIter=1000, tol=1e-4, seed=SEED, **common), abreast=True),
    ]


def regressors(rows: int, features: int, tuned: bool = False) -> list[Candidate]:
    common = {"featuresCol": "features", "labelCol": "label"}
    trees, depth, rounds, boost_depth, step = _sizes(rows, tuned)
    ridge = tuned and features >= rows
    return [
        Candidate("Ridge Regression" if ridge else "Linear Regression",
                  lambda: LinearRegression(regParam=1.0 if ridge else 0.0, elasticNetParam=0.0, **common)),
        Candidate("Random Forest", lambda: RandomForestRegressor(numTrees=trees, maxDepth=depth, minInstancesPerNode=2, seed=SEED, **FOREST, **common)),
        Candidate("Gradient Boosting", lambda: GBTRegressor(maxIter=rounds, maxDepth=boost_depth, stepSize=step, subsamplingRate=0.8, seed=SEED, **common)),
    ]


def _sizes(rows: int, tuned: bool) -> tuple[int, int, int, int, float]:
    large = rows > LARGE_TABLE
    if not tuned:
        return 100, 10 if large else 5, 100, 3, 0.1
    more = 200 if rows > SMALL_TABLE else 100
    return more, 15 if large else 10, more, 5 if large else 3, 0.1 if large else 0.05


def with_weights(df: DataFrame, target: str) -> DataFrame:
    """Add the balanced class weight of each row as ``weight``."""
    weights = lookup(class_weights(df, target).select(F.col("class").alias("__class"), "weight"))
    return df.join(weights, ref(target) == F.col("__class"), "left").drop("__class")


def assemble(df: DataFrame, features: Sequence[str], target: str, *extra: str) -> DataFrame:
    out = VectorAssembler(inputCols=list(features), outputCol="features").transform(df)
    return out.select(*[ref(c) for c in extra], "features", ref(target).alias("label"))


# -- metrics over a table of predictions (label, prediction, optional score) --

def classification_metrics(predictions: DataFrame) -> DataFrame:
    """accuracy, and precision, recall and F1 weighted by class size; undefined ratios count as 0."""
    pairs = predictions.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    cells = pairs.select(F.inline(F.array(
        F.struct(F.col("label").alias("c"), F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("said"), F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("prediction").alias("c"), F.lit(0).cast("bigint").alias("actual"), F.col("n").alias("said"), F.lit(0).cast("bigint").alias("hit")))))
    per_class = cells.groupBy("c").agg(F.sum("actual").alias("actual"), F.sum("said").alias("said"), F.sum("hit").alias("hit"))
    precision = F.coalesce(F.try_divide("hit", "said"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("hit", "actual"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    total = F.sum("actual")

    def weighted(metric: Column) -> Column:
        return F.try_divide(F.sum(metric * F.col("actual")), total)
    return per_class.agg(F.try_divide(F.sum("hit"), total).alias("accuracy"), weighted(precision).alias("precision"),
                         weighted(recall).alias("recall"), weighted(f1).alias("f1_score"))


def auc(predictions: DataFrame) -> DataFrame:
    """Area under the ROC curve from (label, score), ties counted half.

    Rows are counted per score first; the rank sums then run over distinct scores in
    range partitions, so no task holds more than a slice of them.
    """
    per_score = predictions.groupBy("score").agg(
        F.sum((F.col("label") == 1).cast("bigint")).alias("pos"), F.sum((F.col("label") != 1).cast("bigint")).alias("neg"))
    sliced = durable(per_score.repartitionByRange("score").withColumn("part", F.spark_partition_id()))
    slices = sliced.groupBy("part").agg(F.sum("neg").alias("slice_neg"))
    below = slices.select("part", (F.sum("slice_neg").over(W.orderBy("part")) - F.col("slice_neg")).alias("offset"))
    local = F.sum("neg").over(W.partitionBy("part").orderBy("score").rowsBetween(W.unboundedPreceding, -1))
    ranked = sliced.withColumn("lower", F.coalesce(local, F.lit(0))).join(below, "part")
    wins = F.sum(F.col("pos") * (F.col("lower") + F.col("offset") + F.col("neg") / 2))
    return ranked.agg(F.try_divide(wins, F.sum("pos").cast("double") * F.sum("neg")).alias("auc_roc"))


def regression_metrics(predictions: DataFrame) -> DataFrame:
    y, p = F.col("label"), F.col("prediction")
    error = y - p
    base = predictions.agg(F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae"), F.var_pop(y).alias("spread"))
    return base.select((1 - F.try_divide("mse", F.nullif(F.col("spread"), F.lit(0.0)))).alias("r2_score"),
                       F.sqrt("mse").alias("rmse"), "mae", "mse")


def sanitize_score(score: Column, allow_null: bool = True) -> Column:
    """A score outside 0..1 becomes null, or 0 where null is not allowed."""
    inside = F.when(score.between(0, 1), score)
    return inside if allow_null else F.coalesce(inside, F.lit(0.0))


# -- training --

def _once(made: dict, name: tuple, build: Callable[[], DataFrame]) -> DataFrame:
    """A table that several models read, assembled and written once."""
    if name not in made:
        made[name] = durable(build())
    return made[name]


def _assembled(data: TrainingData, rows: DataFrame, weighted: bool, *extra: str) -> DataFrame:
    rows = with_weights(rows, data.target) if weighted else rows
    return assemble(rows, data.features, data.target, *extra, *(["weight"] if weighted else []))


def _folded(data: TrainingData, key: str, folds: int, weighted: bool) -> DataFrame:
    grouped = data.problem_type == "classification"
    rows = data.train if grouped else data.train.withColumn("__all", F.lit(0))
    return _assembled(data, stratified_folds(rows, data.target if grouped else "__all", key, folds), weighted, "fold")


def _abreast(spark: SparkSession, calls: Sequence[Callable[[], object]], wide: bool) -> list:
    """What the calls return; if ``wide``, they run at the same time."""
    if not wide:
        return [call() for call in calls]
    with ThreadPoolExecutor(len(calls)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(call)) for call in calls]]


def cross_validate(candidate: Candidate, data: TrainingData, key: str, folds: int, made: dict | None = None) -> float | None:
    """Mean accuracy or R2 over stratified folds."""
    grouped = data.problem_type == "classification"
    folded = _once({} if made is None else made, ("folds", folds, candidate.weighted), lambda: _folded(data, key, folds, candidate.weighted))

    def score(i: int) -> float | None:
        model = candidate.build().fit(folded.where(F.col("fold") != i))
        predicted = model.transform(folded.where(F.col("fold") == i))
        metric = classification_metrics(predicted) if grouped else regression_metrics(predicted)
        return metric.first()[0]
    scores = _abreast(folded.sparkSession, [partial(score, i) for i in range(folds)], candidate.abreast)
    known = [s for s in scores if s is not None]
    return sum(known) / len(known) if known else None


def fold_count(data: TrainingData) -> int:
    if data.problem_type == "classification":
        smallest = data.train.groupBy(ref(data.target)).count().agg(F.min("count")).first()[0]
        return min(5, max(2, smallest))
    return min(5, max(2, data.train.count() // 10))


def feature_importance(model, features: Sequence[str], k: int = TOP_FEATURES) -> list[dict] | None:
    """Tree importances or absolute coefficients (of the first class), highest first."""
    if hasattr(model, "featureImportances"):
        values = model.featureImportances.toArray()
    elif isinstance(getattr(model, "numClasses", None), int) and hasattr(model, "coefficientMatrix"):
        values = abs(model.coefficientMatrix.toArray()[0])
    elif hasattr(model, "coefficients"):
        values = abs(model.coefficients.toArray())
    else:
        return None
    pairs = sorted(zip(features, map(float, values)), key=lambda p: -p[1])[:k]
    return [{"feature": f, "importance": v} for f, v in pairs]


def oversampled(data: TrainingData, key: str) -> DataFrame:
    """Training rows with synthetic rows of the smaller classes."""
    made = smote(data.train.withColumn("__vec", F.array(*[ref(c) for c in data.features])), "__vec", data.target, key)
    return made.select(ref(key), ref(data.target), *[F.col("__vec")[i].alias(c) for i, c in enumerate(data.features)])


def train_one(candidate: Candidate, data: TrainingData, key: str, folds: int | None, fit_on: DataFrame | None = None, made: dict | None = None,
              as_written: bool = False) -> dict:
    """Fit on the training rows (or ``fit_on``), score on the test rows; ``folds`` None skips cross-validation.

    A cross-validation that fails leaves no ``cv_score`` but its message as ``cv_error``;
    with ``as_written`` the test score stands in. ``made`` keeps the assembled tables that
    several candidates share.
    """
    made = {} if made is None else made
    started = time.time()

    def fitted():
        train = _once(made, ("train", candidate.weighted), lambda: _assembled(data, data.train if fit_on is None else fit_on, candidate.weighted))
        model = candidate.build().fit(train)
        predicted = model.transform(assemble(data.test, data.features, data.target))
        if data.problem_type == "classification":
            metrics = classification_metrics(predicted).first().asDict()
            score = metrics["accuracy"]
            if "probability" in predicted.columns and data.classes.count() == 2:
                scored = predicted.select("label", vector_to_array("probability")[1].alias("score"))
                metrics["auc_roc"] = auc(scored).first()[0]
            else:
                metrics["auc_roc"] = score
        else:
            metrics = regression_metrics(predicted).first().asDict()
            score = metrics["r2_score"]
        return model, score, metrics

    def validated():
        try:
            return cross_validate(candidate, data, key, folds, made), None
        except Exception as error:
            log.warning("cross-validation of %s failed: %s", candidate.name, error)
            return None, str(error)[:ERROR_LENGTH]

    (model, score, metrics), *rest = _abreast(data.train.sparkSession, [fitted, validated] if folds else [fitted], candidate.abreast)
    cv, cv_error = rest[0] if rest else (None, None)
    if cv_error is not None and as_written:
        cv = score
    return {"model_name": candidate.name, "model_type": data.problem_type, "test_score": float(score or 0.0), "cv_score": cv, "cv_error": cv_error,
            "training_time": time.time() - started, "feature_importance": feature_importance(model, data.features),
            "metrics": {k: float(v) for k, v in metrics.items() if v is not None}}


def held_out_predictions(df: DataFrame, target: str, problem_type: str, key: str, only: Sequence[str] | None = None, tuned: bool = False) -> DataFrame:
    """(model_name, key, label, prediction) of every test row and candidate: what the metrics are computed from.

    ``label`` is the target as prepared: for classes, their place in sorted order.
    """
    data = prepare(df, target, problem_type, key)
    rows = data.train.count()
    classes = data.classes.count() if problem_type == "classification" else 0
    chosen = classifiers(rows, len(data.features), classes, tuned) if classes else regressors(rows, len(data.features), tuned)
    train, test = durable(_assembled(data, data.train, False)), durable(assemble(data.test, data.features, data.target, key))
    parts = [c.build().fit(train).transform(test).select(F.lit(c.name).alias("model_name"), ref(key).alias("key"), F.col("label").cast("double").alias("label"), F.col("prediction"))
             for c in chosen if not only or c.name in only]
    return reduce(DataFrame.unionByName, parts)


def training_folds(df: DataFrame, target: str, key: str, folds: int) -> DataFrame:
    """(key, label, fold) of every training row of a classification table, as cross-validation cuts them."""
    data = prepare(df, target, "classification", key)
    return stratified_folds(data.train, data.target, key, folds).select(ref(key).alias("key"), ref(data.target).cast("double").alias("label"), "fold")


RESULT = ("model_name string, model_type string, test_score double, cv_score double, training_time double, "
          "feature_importance array<struct<feature: string, importance: double>>, metrics map<string, double>, error string, cv_error string")
FIELDS = ("model_name", "model_type", "test_score", "cv_score", "training_time", "feature_importance", "metrics", "error", "cv_error")
ERROR_LENGTH = 500


def train_and_rank(df: DataFrame, target: str, problem_type: str, key: str, only: Sequence[str] | None = None,
                   folds: int | None = -1, tuned: bool = False, as_written: bool = False) -> DataFrame:
    """Train every candidate and rank by test score; one that fails has a row with its error and no score.

    One row per model (a handful), with scores fit for storage and the best one flagged.
    ``folds`` -1 chooses the number of folds from the data, None skips cross-validation.
    Where cross-validation fails, ``cv_score`` is null and ``cv_error`` says why, or, with
    ``as_written``, the test score stands in.
    """
    data = prepare(df, target, problem_type, key)
    rows = data.train.count()
    fit_on = None
    if problem_type == "classification":
        balance = class_balance(data.train, target).first()
        balanced = tuned and bool(balance["imbalanced"])
        if tuned and is_severe(balance["ratio"]):
            grown = durable(oversampled(data, key))
            fit_on = evenly(grown, grown.count(), [key, target, *data.features])
        chosen = classifiers(rows, len(data.features), data.classes.count(), tuned, balanced)
    else:
        chosen = regressors(rows, len(data.features), tuned)
    if folds == -1:
        folds = fold_count(data)
    results, made = [], {}
    for candidate in chosen:
        if only and candidate.name not in only:
            continue
        try:
            results.append(train_one(candidate, data, key, folds, fit_on, made, as_written))
        except Exception as error:
            log.warning("training %s failed: %s", candidate.name, error)
            results.append({"model_name": candidate.name, "model_type": problem_type, "error": str(error)[:ERROR_LENGTH]})
    ranked = df.sparkSession.createDataFrame([{**dict.fromkeys(FIELDS), **r} for r in results], RESULT)
    scored = [r for r in results if r.get("test_score") is not None]
    first = min(scored, key=lambda r: (-r["test_score"], r["model_name"]), default={"model_name": None})["model_name"]
    return (ranked.withColumns({"test_score_stored": F.when(F.col("error").isNull(), sanitize_score(F.col("test_score"), False)), "cv_score_stored": sanitize_score(F.col("cv_score")),
                                "is_best": F.coalesce(F.col("model_name") == F.lit(first), F.lit(False)), "accuracy": F.round(F.col("test_score") * 100, 1)})
            .orderBy(F.desc_nulls_last("test_score"), "model_name"))
