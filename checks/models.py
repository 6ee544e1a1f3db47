from pyspark.sql import Window as W, functions as F

from checks.profile import r
from checks.registry import query
from tabscout.operators import models as m


def labelled(t):
    """labels with what the documents offer as features."""
    words = F.size(F.split("text", r"\s+"))
    return t.labels.join(t.documents, "doc_id").select(
        "doc_id", "n_chars", words.alias("words"), (F.col("n_chars") / words).alias("word_length"), "source", "lang", "quality")


def predictions(t):
    return t.orders.select(F.expr("o_custkey % 3").cast("double").alias("label"), F.expr("if(o_orderkey % 4 = 0, o_orderkey % 3, o_custkey % 3)").cast("double").alias("prediction"))


@query("eval_classification", """
WITH p AS (SELECT o_custkey % 3 AS y, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 3 ELSE o_custkey % 3 END AS p FROM orders),
c AS (SELECT unnest([0, 1, 2]) AS c), k AS (SELECT c, (SELECT count(*) FROM p WHERE y = c) AS a, (SELECT count(*) FROM p WHERE p = c) AS s, (SELECT count(*) FROM p WHERE y = c AND p = c) AS h FROM c)
SELECT round(sum(h) / sum(a)::DOUBLE, 6) AS accuracy, round(sum(h / s::DOUBLE * a) / sum(a), 6) AS precision, round(sum(h / a::DOUBLE * a) / sum(a), 6) AS recall,
round(sum(2 * (h / s::DOUBLE) * (h / a::DOUBLE) / (h / s::DOUBLE + h / a::DOUBLE) * a) / sum(a), 6) AS f1_score FROM k""")
def eval_classification(t):
    return r(m.classification_metrics(predictions(t)), "accuracy", "precision", "recall", "f1_score", digits=6)


@query("eval_auc", """
WITH p AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, round(o_totalprice / 1000) AS s FROM orders),
k AS (SELECT s, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM p GROUP BY 1), w AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM k)
SELECT round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) AS auc_roc FROM w""")
def eval_auc(t):
    scored = t.orders.select(F.expr("if(o_orderstatus = 'F', 1, 0)").alias("label"), F.round(F.col("o_totalprice") / 1000).alias("score"))
    return r(m.auc(scored), "auc_roc", digits=6)


@query("eval_regression", """
WITH p AS (SELECT l_extendedprice AS y, l_quantity * 2100 AS p FROM lineitem)
SELECT round(1 - sum((y - p) * (y - p)) / (SELECT sum((y - a) * (y - a)) FROM p, (SELECT avg(y) AS a FROM p)), 6) AS r2_score, round(sqrt(avg((y - p) * (y - p))), 2) AS rmse,
round(avg(abs(y - p)), 2) AS mae, round(avg((y - p) * (y - p)), 0) AS mse FROM p""")
def eval_regression(t):
    out = m.regression_metrics(t.lineitem.select(F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 2100).alias("prediction")))
    return out.select(F.round("r2_score", 6).alias("r2_score"), F.round("rmse", 2).alias("rmse"), F.round("mae", 2).alias("mae"), F.round("mse", 0).alias("mse"))


@query("score_sanitize", """
SELECT c_custkey, CASE WHEN c_acctbal / 5000 BETWEEN 0 AND 1 THEN round(c_acctbal / 5000, 6) END AS cv_score,
coalesce(CASE WHEN c_acctbal / 5000 BETWEEN 0 AND 1 THEN round(c_acctbal / 5000, 6) END, 0.0) AS test_score FROM customer""")
def score_sanitize(t):
    s = F.col("c_acctbal") / 5000
    return r(t.customer.select("c_custkey", m.sanitize_score(s).alias("cv_score"), m.sanitize_score(s, False).alias("test_score")), "cv_score", "test_score", digits=6)


CLASS_METRICS, NUMBER_METRICS = "accuracy,auc_roc,f1_score,precision,recall", "mae,mse,r2_score,rmse"


def result(df):
    """What must hold whatever a model learns: names, metrics, ranges, the best flag, importances that add up."""
    everything = W.partitionBy(F.lit(0))  # a handful of models
    one_best = (F.count_if("is_best").over(everything) == 1) & (~F.col("is_best") | (F.col("test_score") == F.max("test_score").over(everything)))
    ok = F.col("error").isNull() & (F.col("test_score") <= 1) & F.coalesce(F.col("cv_score") <= 1, F.lit(True))
    sums = F.aggregate("feature_importance", F.lit(0.0), lambda a, f: a + f["importance"])
    tree = F.col("model_name").isin("Random Forest", "Gradient Boosting")
    return df.select("model_name", (ok & F.when(tree, F.coalesce(F.abs(sums - 1) < 1e-6, F.lit(True))).otherwise(True)).alias("sound"),
                     (F.col("cv_score").isNotNull()).alias("validated"), F.coalesce(F.size("feature_importance"), F.lit(0)).alias("features"),
                     F.array_join(F.array_sort(F.map_keys("metrics")), ",").alias("metrics"),
                     one_best.alias("flagged"))


def result_sql(*models, metrics=CLASS_METRICS, validated=False):
    """``models``: (name, features with an importance)."""
    return "\nUNION ALL\n".join(f"""SELECT '{n}' AS model_name, true AS sound, {str(validated).lower()} AS validated, CAST({k} AS INTEGER) AS features,
'{metrics}' AS metrics, true AS flagged""" for n, k in models)


@query("train_lr", result_sql(("Logistic Regression", 2)))
def train_lr(t):
    return result(m.train_and_rank(t.customer.drop("c_name"), "c_mktsegment", "classification", "c_custkey", only=["Logistic Regression"], folds=None))


@query("train_rf", result_sql(("Random Forest", 2)))
def train_rf(t):
    return result(m.train_and_rank(t.customer.drop("c_name"), "c_mktsegment", "classification", "c_custkey", only=["Random Forest"], folds=None))


@query("train_gbt", result_sql(("Gradient Boosting", 1), metrics=NUMBER_METRICS))
def train_gbt(t):
    return result(m.train_and_rank(t.part.drop("p_name", "p_brand", "p_type"), "p_retailprice", "regression", "p_partkey", only=["Gradient Boosting"], folds=None))


@query("train_mlp_cls", result_sql(("Neural Network", 0)))
def train_mlp_cls(t):
    return result(m.train_and_rank(labelled(t), "quality", "classification", "doc_id", only=["Neural Network"], folds=None))


@query("train_linear_reg", """
WITH o AS (SELECT o_custkey AS x, o_totalprice AS y, row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) AS r, count(*) OVER () AS n FROM orders),
s AS (SELECT *, r <= round(n * CAST(least(0.2, greatest(0.1, 5.0 / n)) AS DOUBLE)) AS test FROM o), m AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM s WHERE NOT test),
p AS (SELECT y, a * x + b AS p FROM s, m WHERE test)
SELECT 'Linear Regression' AS model_name, round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) AS r2_score, round(sqrt(avg((y - p) * (y - p))), 2) AS rmse, round(avg(abs(y - p)), 2) AS mae FROM p""")
def train_linear_reg(t):
    out = m.train_and_rank(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), "o_totalprice", "regression", "o_orderkey", only=["Linear Regression"], folds=None)
    return out.select("model_name", F.round(F.col("metrics")["r2_score"], 6).alias("r2_score"), F.round(F.col("metrics")["rmse"], 2).alias("rmse"),
                      F.round(F.col("metrics")["mae"], 2).alias("mae"))


@query("cross_validate", result_sql(("Logistic Regression", 5), validated=True))
def cross_validate(t):
    return result(m.train_and_rank(labelled(t), "quality", "classification", "doc_id", only=["Logistic Regression"]))


@query("feature_importance", """
SELECT 'Random Forest' AS model_name, unnest(['lang', 'n_chars', 'source', 'word_length', 'words']) AS feature, true AS counted, 1.0::DOUBLE AS total""")
def feature_importance(t):
    out = m.train_and_rank(labelled(t), "quality", "classification", "doc_id", only=["Random Forest"], folds=None)
    total = F.aggregate("feature_importance", F.lit(0.0), lambda a, f: a + f["importance"])
    return out.select("model_name", F.round(total, 6).alias("total"), F.explode("feature_importance").alias("f")).select(
        "model_name", "f.feature", (F.col("f.importance") >= 0).alias("counted"), "total")


@query("feature_importance_linear", """
WITH o AS (SELECT o_custkey AS x, o_totalprice AS y, row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) AS r, count(*) OVER () AS n FROM orders),
s AS (SELECT *, r <= round(n * CAST(least(0.2, greatest(0.1, 5.0 / n)) AS DOUBLE)) AS test FROM o)
SELECT 'o_custkey' AS feature, round(abs(regr_slope(y, x)) * stddev_pop(x), 2) AS importance FROM s WHERE NOT test""")
def feature_importance_linear(t):
    """With one scaled feature the coefficient has a closed form."""
    out = m.train_and_rank(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), "o_totalprice", "regression", "o_orderkey", only=["Linear Regression"], folds=None)
    return out.select(F.explode("feature_importance").alias("f")).select("f.feature", F.round("f.importance", 2).alias("importance"))


@query("train_gbt_cls", result_sql(("Gradient Boosting", 5)))
def train_gbt_cls(t):
    return result(m.train_and_rank(labelled(t), "quality", "classification", "doc_id", only=["Gradient Boosting"], folds=None))


@query("train_rank", result_sql(("Logistic Regression", 5), ("Random Forest", 5), ("Neural Network", 0), validated=True))
def train_rank(t):
    names = ["Logistic Regression", "Random Forest", "Neural Network"]
    return result(m.train_and_rank(labelled(t), "quality", "classification", "doc_id", only=names, folds=2))


@query("train_rank_regression", result_sql(("Linear Regression", 2), ("Random Forest", 2), metrics=NUMBER_METRICS, validated=True))
def train_rank_regression(t):
    table = t.part.drop("p_name", "p_brand")
    return result(m.train_and_rank(table, "p_retailprice", "regression", "p_partkey", only=["Linear Regression", "Random Forest"], folds=2, tuned=True))


#: Customers with a class that one column decides, split as the models split them.
BANDED = """WITH c AS (SELECT c_custkey, c_nationkey, CASE WHEN c_nationkey < 12 THEN 'low' ELSE 'up' END AS band FROM customer),
s AS (SELECT *, CASE WHEN band = 'low' THEN 0.0 ELSE 1.0 END AS label, row_number() OVER (PARTITION BY band ORDER BY md5(CAST(c_custkey AS VARCHAR)), c_custkey)
  <= CAST(round(count(*) OVER (PARTITION BY band) * CAST(least(0.2, greatest(0.1, 5.0 / count(*) OVER ())) AS DOUBLE)) AS BIGINT) AS test FROM c)"""
LEARNERS = ("Logistic Regression", "Random Forest", "Gradient Boosting", "Neural Network")


def banded(t):
    return t.customer.select("c_custkey", "c_nationkey", F.expr("if(c_nationkey < 12, 'low', 'up')").alias("band"))


@query("train_predictions", f"""{BANDED}
SELECT model_name, c_custkey AS key, CAST(label AS DOUBLE) AS label, CAST(label AS DOUBLE) AS prediction FROM s, (VALUES {", ".join(f"('{n}')" for n in LEARNERS)}) m(model_name) WHERE test""")
def train_predictions(t):
    """Each model finds the rule behind the class: its predictions on the test rows are known."""
    return m.held_out_predictions(banded(t), "band", "classification", "c_custkey", only=LEARNERS)


@query("train_metrics", f"""{BANDED}
SELECT model_name, true AS tied, 1.0::DOUBLE AS test_score, 1.0::DOUBLE AS f1_score, 1.0::DOUBLE AS auc_roc, model_name = 'Gradient Boosting' AS is_best
FROM (VALUES {", ".join(f"('{n}')" for n in LEARNERS)}) m(model_name) WHERE (SELECT count(DISTINCT label) FROM s WHERE test) = 2""")
def train_metrics(t):
    """The metrics of those predictions, and the best of equal models."""
    out = m.train_and_rank(banded(t), "band", "classification", "c_custkey", only=LEARNERS, folds=None)
    tied = F.max("test_score").over(W.partitionBy(F.lit(0))) == F.col("test_score")  # a row a model
    return out.select("model_name", tied.alias("tied"), "test_score", F.col("metrics")["f1_score"].alias("f1_score"), F.col("metrics")["auc_roc"].alias("auc_roc"), "is_best")


@query("train_folds", f"""{BANDED},
r AS (SELECT c_custkey, label, row_number() OVER (PARTITION BY band ORDER BY md5(CAST(c_custkey AS VARCHAR)), c_custkey) AS r, count(*) OVER (PARTITION BY band) AS n FROM s WHERE NOT test)
SELECT c_custkey AS key, CAST(label AS DOUBLE) AS label,
CAST(least(4, (r > ceil(n * 1 / 5.0::DOUBLE))::INT + (r > ceil(n * 2 / 5.0::DOUBLE))::INT + (r > ceil(n * 3 / 5.0::DOUBLE))::INT + (r > ceil(n * 4 / 5.0::DOUBLE))::INT) AS INTEGER) AS fold FROM r""")
def train_folds(t):
    return m.training_folds(banded(t), "band", "c_custkey", 5)
