from pyspark.sql import functions as F

from checks.charts import CATALOGUE_SQL, SETS, catalogue
from checks.profile import gappy, GAPPY_SQL, r
from checks.registry import query
from tabscout.operators import modelprep as mp
from tabscout.operators.oversample import nearest, smote
from tabscout.operators.profile import Profile

WITH = f"WITH {CATALOGUE_SQL}"
LIST = ", ".join(f"'{n}'" for n in mp.TARGET_NAMES)


@query("detect_target", f"""{WITH}, p AS (SELECT *, unique_count BETWEEN 2 AND 20 OR (unique_count * 1.0::DOUBLE / total_rows < 0.1 AND unique_count > 1) AS ok FROM cols),
g AS (SELECT dataset_id, min(ord) FILTER (WHERE lower(name) IN ({LIST})) AS o, max(ord) AS last FROM p GROUP BY 1),
v AS (SELECT dataset_id, first(name ORDER BY unique_count, ord) AS name FROM p WHERE ok GROUP BY 1)
SELECT g.dataset_id, coalesce(n.name, v.name, l.name) AS target, CASE WHEN n.name IS NOT NULL THEN 'name' WHEN v.name IS NOT NULL THEN 'values' ELSE 'last' END AS reason
FROM g LEFT JOIN p n ON n.dataset_id = g.dataset_id AND n.ord = g.o LEFT JOIN v ON v.dataset_id = g.dataset_id JOIN p l ON l.dataset_id = g.dataset_id AND l.ord = g.last""")
def detect_target(t):
    return mp.detect_target(catalogue(t).columns)


@query("suggest_target", f"""{WITH}, f AS (SELECT * FROM cols WHERE unique_count >= 2 AND unique_count <= total_rows * 0.5),
g AS (SELECT dataset_id, last(name ORDER BY ord) FILTER (WHERE column_type = 'numeric') AS n, last(name ORDER BY ord) FILTER (WHERE column_type <> 'numeric') AS c FROM f GROUP BY 1)
SELECT dataset_id, coalesce(n, c) AS target, CASE WHEN n IS NOT NULL THEN 'regression' WHEN c IS NOT NULL THEN 'classification' END AS problem_type FROM g""")
def suggest_target(t):
    return mp.suggest_target(catalogue(t).columns)


@query("suggest_target_last", f"""{WITH} SELECT dataset_id, name AS target,
CASE WHEN column_type = 'numeric' AND unique_count * 1.0::DOUBLE / total_rows >= 0.05 THEN 'regression' ELSE 'classification' END AS problem_type
FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY ord DESC) AS r FROM cols) WHERE r = 1""")
def suggest_target_last(t):
    return mp.suggest_last(catalogue(t).columns)


def spans(t):
    out = None
    for n in SETS:
        part = mp.integer_ranges(gappy(t) if n == "gappy" else getattr(t, n)).withColumn("dataset_id", F.lit(n))
        out = part if out is None else out.unionByName(part)
    return out


RANGE_SQL = "spans AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS name, max({n}) - min({n}) AS span FROM {tb}" for tb, n in
    (("customer", "c_custkey"), ("customer", "c_nationkey"), ("part", "p_partkey"), ("part", "p_size"), ("orders", "o_orderkey"), ("orders", "o_custkey"))) + ")"


@query("problem_type", f"""{WITH}, {RANGE_SQL}
SELECT dataset_id, ord, c.name, CASE WHEN column_type = 'categorical' OR unique_count <= 20 OR unique_count * 1.0::DOUBLE / total_rows < 0.05 OR coalesce(span <= 50, false)
THEN 'classification' ELSE 'regression' END AS problem_type FROM cols c LEFT JOIN spans s ON s.name = c.name WHERE dataset_id IN ('customer', 'part', 'orders')""")
def problem_type(t):
    c = catalogue(t, ("customer", "part", "orders"))
    ranges = mp.integer_ranges(t.customer).unionByName(mp.integer_ranges(t.part)).unionByName(mp.integer_ranges(t.orders))
    return mp.problem_types(c.columns, ranges)


@query("problem_type_strict", f"""{WITH} SELECT dataset_id, ord, name, CASE WHEN column_type = 'categorical' OR unique_count < 20 OR unique_count * 1.0::DOUBLE / total_rows < 0.05
THEN 'classification' ELSE 'regression' END AS problem_type FROM cols WHERE dataset_id IN ('customer', 'part', 'orders')""")
def problem_type_strict(t):
    c = catalogue(t, ("customer", "part", "orders"))
    return mp.problem_types(c.columns, mp.integer_ranges(t.part), strict=True)


@query("feature_types", f"""{WITH} SELECT dataset_id, ord, name, CASE WHEN unique_count * 1.0::DOUBLE / total_rows > 0.95 THEN 'id'
WHEN column_type = 'numeric' THEN CASE WHEN unique_count <= 10 THEN 'categorical' ELSE 'numeric' END WHEN column_type = 'datetime' THEN 'datetime'
ELSE CASE WHEN unique_count <= 50 THEN 'categorical' ELSE 'text' END END AS feature_type FROM cols""")
def feature_types(t):
    return mp.feature_types(catalogue(t).columns)


@query("drop_useless", f"""{WITH} SELECT ord, name, CASE WHEN unique_count <= 1 THEN 'constant' WHEN unique_count = total_rows THEN 'all unique' ELSE 'mostly missing' END AS reason
FROM cols WHERE dataset_id = 'gappy' AND name <> 'value' AND (unique_count <= 1 OR unique_count = total_rows OR missing_count > 0.95 * total_rows)""")
def drop_useless(t):
    return mp.useless(Profile(gappy(t)).columns, "value")


@query("drop_rows_null_target", f"SELECT event_id, value FROM ({GAPPY_SQL}) WHERE value IS NOT NULL")
def drop_rows_null_target(t):
    return mp.drop_null_target(gappy(t), "value").select("event_id", "value")


@query("semi_valid_class", """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 2)""")
def semi_valid_class(t):
    return mp.keep_valid_classes(t.orders, "o_custkey").select("o_orderkey", "o_totalprice")


@query("impute_mean", f"SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM ({GAPPY_SQL}))), 6) AS value FROM ({GAPPY_SQL})")
def impute_mean(t):
    g = gappy(t)
    return r(mp.fill(g, mp.fit_means(g, ["value"])), "value", digits=6).select("event_id", "value")


@query("impute_median_mode", f"""
WITH g AS ({GAPPY_SQL}), m AS (SELECT event_type FROM g WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT event_id, round(coalesce(value, (SELECT median(value) FROM g)), 6) AS value, coalesce(event_type, (SELECT event_type FROM m)) AS event_type FROM g""")
def impute_median_mode(t):
    g = gappy(t)
    filled = mp.fill(g, {**mp.fit_medians(g, ["value"]), **mp.fit_modes(g, ["event_type"])})
    return r(filled, "value", digits=6).select("event_id", "value", "event_type")


@query("clip_outliers", """
WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events), f AS (SELECT a - 3 * (b - a) AS lo, b + 3 * (b - a) AS hi FROM q),
s AS (SELECT count(*) FILTER (WHERE value < lo OR value > hi) AS o, count(*) AS n FROM events, f)
SELECT event_id, round(CASE WHEN o > 0 AND o < 0.05 * n THEN least(greatest(value, lo), hi) ELSE value END, 6) AS value FROM events, f, s""")
def clip_outliers(t):
    return r(mp.clip(t.events, mp.fit_fences(t.events, ["value"])), "value", digits=6).select("event_id", "value")


@query("label_encode", f"""
WITH g AS (SELECT event_id, coalesce(event_type, 'None') AS e FROM ({GAPPY_SQL})), k AS (SELECT e, row_number() OVER (ORDER BY e) - 1 AS code FROM (SELECT DISTINCT e FROM g))
SELECT event_id, code AS event_type FROM g JOIN k USING (e)""")
def label_encode(t):
    g = gappy(t)
    return mp.encode(g, "event_type", mp.fit_codes(g, "event_type")).select("event_id", "event_type")


@query("label_encode_wide", """
WITH k AS (SELECT text, row_number() OVER (ORDER BY text) - 1 AS code FROM (SELECT DISTINCT text FROM documents))
SELECT doc_id, code AS text FROM documents JOIN k USING (text)""")
def label_encode_wide(t):
    return mp.encode(t.documents, "text", mp.fit_codes(t.documents, "text")).select("doc_id", "text")


@query("label_encode_unseen", """
WITH k AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS code FROM (SELECT DISTINCT p_brand FROM part WHERE p_size <= 2))
SELECT p_partkey, coalesce(code, 0) AS p_brand FROM part LEFT JOIN k USING (p_brand)""")
def label_encode_unseen(t):
    return mp.encode(t.part, "p_brand", mp.fit_codes(t.part.where("p_size <= 2"), "p_brand")).select("p_partkey", "p_brand")


@query("scale_standard", """
SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_pop(c_acctbal) FROM customer), 6) AS c_acctbal FROM customer""")
def scale_standard(t):
    return r(mp.scale(t.customer, mp.fit_standard(t.customer, ["c_acctbal"])), "c_acctbal", digits=6).select("c_custkey", "c_acctbal")


@query("scale_robust", """
WITH q AS (SELECT quantile_cont(c_acctbal, 0.25) AS a, median(c_acctbal) AS m, quantile_cont(c_acctbal, 0.75) AS b FROM customer)
SELECT c_custkey, round((c_acctbal - m) / (b - a), 6) AS c_acctbal FROM customer, q""")
def scale_robust(t):
    return r(mp.scale(t.customer, mp.fit_robust(t.customer, ["c_acctbal"])), "c_acctbal", digits=6).select("c_custkey", "c_acctbal")


@query("feat_poly", """
SELECT p_partkey, CAST(p_partkey AS DOUBLE) * p_partkey AS p_partkey_squared, round(ln(1 + p_partkey), 6) AS p_partkey_log,
CAST(p_size AS DOUBLE) * p_size AS p_size_squared, round(ln(1 + p_size), 6) AS p_size_log FROM part""")
def feat_poly(t):
    chosen = mp.top_correlated(t.part, ["p_size", "p_partkey"], "p_retailprice")
    return r(mp.add_powers(t.part, chosen), "p_partkey_log", "p_size_log", digits=6).select(
        "p_partkey", "p_partkey_squared", "p_partkey_log", "p_size_squared", "p_size_log")


@query("feat_interact", """
SELECT o_orderkey, round(o_totalprice * o_orderkey, 2) AS o_totalprice_x_o_orderkey, round(o_totalprice / (o_orderkey + 1e-10), 4) AS o_totalprice_div_o_orderkey FROM orders WHERE o_orderkey > 0""")
def feat_interact(t):
    chosen = mp.top_variance(t.orders, ["o_orderkey", "o_custkey", "o_totalprice"])
    out = mp.add_interaction(t.orders.where("o_orderkey > 0"), *chosen)
    product, ratio = f"{chosen[0]}_x_{chosen[1]}", f"{chosen[0]}_div_{chosen[1]}"  # which two vary most is up to the table
    return out.select("o_orderkey", F.round(product, 2).alias(product), F.round(ratio, 4).alias(ratio))


@query("drop_low_variance", """
SELECT name, round(v, 6) AS variance FROM (SELECT 'l_quantity' AS name, var_pop(l_quantity) AS v FROM lineitem UNION ALL SELECT 'l_discount', var_pop(l_discount) FROM lineitem
UNION ALL SELECT 'l_tax', var_pop(l_tax) FROM lineitem UNION ALL SELECT 'l_linenumber', var_pop(l_linenumber) FROM lineitem) WHERE v > 0.01""")
def drop_low_variance(t):
    columns = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
    found = mp.variances(t.lineitem, columns).where("variance > 0.01")
    assert sorted(mp.varied(t.lineitem, columns)) == sorted(r["name"] for r in found.collect())  # one row a column
    return r(found, "variance", digits=6)


@query("strat_split", """
WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) AS r,
count(*) OVER (PARTITION BY o_orderstatus) AS n, least(0.2, greatest(0.1, 5.0 / count(*) OVER ())) AS share FROM orders)
SELECT o_orderkey, r <= CAST(round(n * CAST(share AS DOUBLE)) AS BIGINT) AS is_test FROM r""")
def strat_split(t):
    return mp.stratified_split(t.orders, "o_orderstatus", "o_orderkey").select("o_orderkey", "is_test")


@query("strat_folds", """
WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5(CAST(event_id AS VARCHAR)), event_id) AS r,
count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_id, CAST(least(4, (r > ceil(n * 1 / 5.0::DOUBLE))::INT + (r > ceil(n * 2 / 5.0::DOUBLE))::INT + (r > ceil(n * 3 / 5.0::DOUBLE))::INT + (r > ceil(n * 4 / 5.0::DOUBLE))::INT) AS INTEGER) AS fold FROM r""")
def strat_folds(t):
    return mp.stratified_folds(t.events, "event_type", "event_id", 5).select("event_id", "fold")


@query("class_imbalance", """
SELECT max(n) AS majority, min(n) AS minority, round(max(n) * 1.0::DOUBLE / min(n), 6) AS ratio, max(n) > 2 * min(n) AS imbalanced FROM (SELECT count(*) AS n FROM labels GROUP BY quality)""")
def class_imbalance(t):
    return r(mp.class_balance(t.labels, "quality"), "ratio", digits=6)


@query("class_weight", """
SELECT l_returnflag AS class, count(*) AS rows, round((SELECT count(*) FROM lineitem) / ((SELECT count(DISTINCT l_returnflag) FROM lineitem) * count(*)::DOUBLE), 6) AS weight
FROM lineitem GROUP BY 1""")
def class_weight(t):
    return r(mp.class_weights(t.lineitem, "l_returnflag"), "weight", digits=6)


FEATURES = {"c_nationkey": "n", "c_mktsegment": "m", "c_nationkey_squared": "n * n", "c_nationkey_log": "ln(1 + n)", "c_mktsegment_squared": "m * m",
            "c_mktsegment_log": "ln(1 + m)", "c_nationkey_x_c_mktsegment": "n * m"}
PREP_SQL = f"""WITH b AS (SELECT c_acctbal, c_nationkey::DOUBLE AS n, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::DOUBLE AS m FROM customer),
f AS (SELECT c_acctbal, {", ".join(f"{v} AS {k}" for k, v in FEATURES.items())} FROM b),
q AS (SELECT {", ".join(f"median({k}) AS {k}_c, quantile_cont({k}, 0.75) - quantile_cont({k}, 0.25) AS {k}_w" for k in FEATURES)} FROM f)
SELECT c_acctbal, {", ".join(f"round(({k} - {k}_c) / {k}_w, 6) AS {k}" for k in FEATURES)} FROM f, q"""


def fitted(prep, expected, without=()):
    """The features the table got: which ones are made follows its types, correlations and variances."""
    return sorted((c for c in prep.kept if c not in without), key=lambda c: [*expected, c].index(c))


#: A ratio by codes that start at 0 is 1e10 times larger in some rows: no digits to compare.
STEEP = ("c_nationkey_div_c_mktsegment",)


@query("prep_fitted", PREP_SQL)
def prep_fitted(t):
    prep, out = mp.fit_prep(t.customer, "c_acctbal")
    names = fitted(prep, FEATURES, STEEP)
    return r(out, *names, digits=6).select("c_acctbal", *names)


@query("prep_fitted_transform", PREP_SQL.replace("SELECT c_acctbal, round", "SELECT round"))
def prep_fitted_transform(t):
    prep, _ = mp.fit_prep(t.customer, "c_acctbal")
    names = fitted(prep, FEATURES, STEEP)
    return r(prep.transform(t.customer.drop("c_acctbal")), *names, digits=6).select(*names)


GAPS = {"user_id": "u", "event_type": "e", "user_id_squared": "u * u", "user_id_log": "ln(1 + u)", "event_type_squared": "e * e", "event_type_log": "ln(1 + e)",
        "user_id_x_event_type": "u * e", "user_id_div_event_type": "u / (e + 1e-10::DOUBLE)"}


@query("prep_fitted_gaps", f"""WITH g AS ({GAPPY_SQL}),
m AS (SELECT event_type AS mode FROM g WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 1),
b AS (SELECT value, user_id::DOUBLE AS u, (dense_rank() OVER (ORDER BY coalesce(event_type, mode)) - 1)::DOUBLE AS e FROM g, m),
f AS (SELECT value, {", ".join(f"{v} AS {k}" for k, v in GAPS.items())} FROM b),
q AS (SELECT {", ".join(f"median({k}) AS {k}_c, coalesce(nullif(quantile_cont({k}, 0.75) - quantile_cont({k}, 0.25), 0), 1) AS {k}_w" for k in GAPS)} FROM f)
SELECT value, {", ".join(f"round(({k} - {k}_c) / {k}_w, 6) AS {k}" for k in GAPS)} FROM f, q""")
def prep_fitted_gaps(t):
    """The most frequent text fills gaps; the constant, the unique and the time column are gone; the target keeps its gaps."""
    prep, out = mp.fit_prep(gappy(t), "value")
    names = fitted(prep, GAPS)
    return r(out, *names, digits=6).select("value", *names)


@query("prep_live", """
WITH c AS (SELECT *, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS code FROM customer),
p AS (SELECT c_custkey, code, c_nationkey::DOUBLE AS n, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS a, row_number() OVER (PARTITION BY code ORDER BY md5(CAST(c_custkey AS VARCHAR)), c_custkey)
  <= CAST(round(count(*) OVER (PARTITION BY code) * CAST(least(0.2, greatest(0.1, 5.0 / count(*) OVER ())) AS DOUBLE)) AS BIGINT) AS s FROM c),
f AS (SELECT * REPLACE (coalesce(a, avg(a) OVER ()) AS a) FROM p),
m AS (SELECT avg(n) AS nm, stddev_pop(n) AS ns, avg(a) AS am, stddev_pop(a) AS s_a FROM f WHERE NOT s)
SELECT c_custkey, s::INTEGER AS is_test, code::DOUBLE AS c_mktsegment, round((n - nm) / ns, 6) AS c_nationkey, round((a - am) / s_a, 6) AS c_acctbal FROM f, m""")
def prep_live(t):
    """NaN and infinities are gaps, filled by the mean of all rows."""
    odd = F.expr("case when c_custkey % 10 = 0 then double('NaN') when c_custkey % 5 = 0 then double('Infinity') else c_acctbal end")
    data = mp.prepare(t.customer.drop("c_name").withColumn("c_acctbal", odd), "c_mktsegment", "classification", "c_custkey")
    rows = data.train.withColumn("is_test", F.lit(0)).unionByName(data.test.withColumn("is_test", F.lit(1)))
    return r(rows, "c_nationkey", "c_acctbal", digits=6).select("c_custkey", "is_test", "c_mktsegment", "c_nationkey", "c_acctbal")


@query("prep_live_counts", """
SELECT count(*) AS rows, count(*) FILTER (WHERE s) AS test_rows FROM (SELECT row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(CAST(c_custkey AS VARCHAR)), c_custkey)
<= CAST(round(count(*) OVER (PARTITION BY c_mktsegment) * CAST(least(0.2, greatest(0.1, 5.0 / count(*) OVER ())) AS DOUBLE)) AS BIGINT) AS s FROM customer)""")
def prep_live_counts(t):
    data = mp.prepare(t.customer.drop("c_name"), "c_mktsegment", "classification", "c_custkey")
    return data.train.withColumn("s", F.lit(0)).unionByName(data.test.withColumn("s", F.lit(1))).agg(F.count("*").alias("rows"), F.sum("s").alias("test_rows"))


@query("smote_neighbours", """
WITH p AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT a.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), CAST(b.vec_id AS VARCHAR)) AS rank, b.vec_id AS other, list_distance(a.v, b.v) AS distance
FROM p a JOIN p b ON a.label = b.label AND a.vec_id <> b.vec_id)
SELECT CAST(vec_id AS VARCHAR) AS pid, CAST(rank AS INTEGER) AS rank, CAST(other AS VARCHAR) AS other, round(distance, 6) AS distance FROM d WHERE rank <= 5""")
def smote_neighbours(t):
    points = t.embeddings.select("label", F.col("vec_id").cast("string").alias("pid"), F.col("embedding").alias("vec"))
    return r(nearest(points, 5), "distance", digits=6).select("pid", "rank", "other", "distance")


@query("smote", """
SELECT (label = 0)::INTEGER AS y, synthetic, count(*) AS rows FROM (
SELECT label, false AS synthetic FROM embeddings UNION ALL
SELECT 0, true FROM range((SELECT CAST(sum(CASE WHEN label = 0 THEN -1 ELSE 1 END) AS BIGINT) FROM embeddings))) GROUP BY 1, 2""")
def smote_rows(t):
    table = t.embeddings.withColumn("y", F.expr("if(label = 0, 1, 0)"))
    return smote(table, "embedding", "y", "vec_id").groupBy("y", "synthetic").agg(F.count("*").alias("rows"))


@query("smote_vectors", """
WITH p AS (SELECT vec_id, (label = 0)::INTEGER AS y, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
c AS (SELECT y, count(*) AS m, max(count(*)) OVER () - count(*) AS extra, least(5, greatest(1, min_by(count(*), y) OVER () - 1)) AS k FROM p GROUP BY y),
r AS (SELECT p.*, extra, k, m, row_number() OVER (PARTITION BY y ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) AS place FROM p JOIN c USING (y) WHERE extra > 0),
t AS (SELECT *, extra // m + CASE WHEN place <= extra % m THEN 1 ELSE 0 END AS times FROM r),
n AS (SELECT a.vec_id, list(b.v ORDER BY list_distance(a.v, b.v), b.vec_id) AS near FROM r a JOIN r b ON a.y = b.y AND a.vec_id <> b.vec_id GROUP BY 1),
d AS (SELECT y, v, near[1:k] AS near, unnest(range(1, times + 1)) AS j, vec_id FROM t JOIN n USING (vec_id)),
m AS (SELECT y, v, near[CAST(CAST('0x' || substr(md5(vec_id || ':' || j || ':42'), 1, 15) AS BIGINT) % len(near) AS INTEGER) + 1] AS o,
  CAST('0x' || substr(md5(vec_id || ':' || j || ':43'), 1, 15) AS BIGINT) % 2147483648 / 2147483648.0::DOUBLE AS s FROM d)
SELECT y, false AS synthetic, vec_id, list_transform(v, lambda x: round(x, 9)) AS vec FROM p
UNION ALL SELECT y, true, NULL, list_transform(list_zip(v, o), lambda x: round(x[1] + s * (x[2] - x[1]), 9)) FROM m""")
def smote_vectors(t):
    """Every new row between a row and one of its neighbours, by value."""
    table = t.embeddings.withColumn("y", F.expr("if(label = 0, 1, 0)"))
    return smote(table, "embedding", "y", "vec_id").select("y", "synthetic", "vec_id", F.transform("embedding", lambda x: F.round(x, 9)).alias("vec"))
