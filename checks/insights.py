from pyspark.sql import functions as F

from checks.charts import CATALOGUE_SQL, catalogue, union
from checks.profile import dup_sql, r, recommend_sql
from checks.registry import query
from tabscout.operators import chartdata as cd, insights as ins
from tabscout.operators.charts import Catalogue

BASE = f"""WITH {CATALOGUE_SQL}, basic AS ({union(dup_sql)}),
quality AS (SELECT dataset_id, 100 - sum(missing_count) * 100.0::DOUBLE / sum(total_rows) AS q FROM cols GROUP BY 1),
reco AS ({union(recommend_sql)}),
models AS (SELECT 'customer' AS dataset_id, l_returnflag || l_linestatus AS model_name, avg(l_quantity) / 30 AS test_score FROM lineitem GROUP BY 2),
info AS (SELECT 'part' AS dataset_id, 'p_type' AS target_column, 'classification' AS problem_type)"""

# (dataset_id, ord, rule, category, priority, title, number) of every rule.
RULE_SQL = {
    "ins_quality": """SELECT dataset_id, 10 AS ord, 'quality' AS rule, 'data_quality' AS category, CASE WHEN q = 100 THEN 'low' WHEN q >= 80 THEN 'medium' ELSE 'high' END AS priority,
CASE WHEN q = 100 THEN 'Excellent Data Quality' WHEN q >= 80 THEN 'Good Data Quality' ELSE 'Data Quality Issues Detected' END AS title, q AS number FROM quality""",
    "ins_missing": """SELECT dataset_id, 20, 'missing', 'data_quality', CASE WHEN k = 0 THEN 'low' WHEN most * 100.0 / n > 20 THEN 'high' ELSE 'medium' END,
CASE WHEN k > 0 THEN 'Missing Values in ' || k || ' Column(s)' ELSE 'No Missing Values' END, total::DOUBLE
FROM (SELECT dataset_id, count(*) FILTER (WHERE missing_count > 0) AS k, sum(missing_count) AS total, max(missing_count) AS most, max(total_rows) AS n FROM cols GROUP BY 1)""",
    "ins_duplicates": """SELECT dataset_id, 30, 'duplicates', 'data_quality', CASE WHEN duplicate_rows * 100.0 / total_rows > 5 THEN 'high' ELSE 'medium' END,
format('{:,}', duplicate_rows) || ' Duplicate Rows Detected', duplicate_rows::DOUBLE FROM basic WHERE duplicate_rows > 0""",
    "ins_model": """SELECT dataset_id, 40, 'model', 'machine_learning', CASE WHEN hi < 0 THEN 'high' WHEN hi > 75 THEN 'medium' ELSE 'high' END,
CASE WHEN hi < 0 THEN 'Poor Model Performance — Check Target Column' WHEN hi > 90 THEN 'Excellent Model Performance (' || best || ')'
WHEN hi > 75 THEN 'Good Model Performance (' || best || ')' ELSE 'Model Performance Needs Improvement' END, hi FROM (
SELECT dataset_id, max(test_score) * 100 AS hi, arg_max(model_name, test_score) AS best FROM models GROUP BY 1)
UNION ALL SELECT dataset_id, 41, 'models_compared', 'machine_learning', 'low', count(*) || ' Models Compared', (max(test_score) - min(test_score)) * 100 FROM models GROUP BY 1""",
    "ins_corr": """SELECT dataset_id, 50, 'corr_strong', 'patterns', 'high', 'Strong Correlation: ' || first(column1 ORDER BY rank) || ' ↔ ' || first(column2 ORDER BY rank), count(*)::DOUBLE
FROM corrs WHERE abs(correlation) > 0.7 GROUP BY 1
UNION ALL SELECT dataset_id, 51, 'corr_moderate', 'patterns', 'medium', 'Moderate Correlations Detected (' || count(*) || ' pairs)', count(*)::DOUBLE FROM corrs WHERE abs(correlation) <= 0.7 GROUP BY 1
UNION ALL SELECT dataset_id, 52, 'corr_none', 'patterns', 'medium', 'No Strong Correlations Found', 0.0 FROM basic ANTI JOIN corrs USING (dataset_id)""",
    "ins_outliers": """SELECT dataset_id, 60, 'outliers', 'statistical', 'medium', 'Outliers Detected in ' || count(*) || ' Column(s)', max(outlier_count)::DOUBLE FROM outs GROUP BY 1""",
    "ins_types": """SELECT dataset_id, 70, 'types', 'statistical', 'low', 'Feature Type Distribution', count(*)::DOUBLE FROM cols GROUP BY 1""",
    "ins_highcard": """SELECT dataset_id, 80, 'high_cardinality', 'data_quality', 'medium', 'High-Cardinality Categorical Column(s)', count(*)::DOUBLE FROM cols
WHERE column_type = 'categorical' AND unique_count > 50 GROUP BY 1""",
    "ins_business": """SELECT dataset_id, 90, 'business', 'business', 'medium', 'Classification Task: Predicting ''p_type''', total_rows::DOUBLE FROM basic JOIN info USING (dataset_id)""",
    "ins_from_reco": """SELECT dataset_id, 99 + rr, 'recommendation', 'business', priority, title, amount FROM (
SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY ord) AS rr FROM reco) WHERE rr <= 2""",
}
SHAPE = "dataset_id, CAST(ord AS INTEGER) AS ord, rule, category, priority, title, round(CAST(number AS DOUBLE), 4) AS number"
HEAD = "SELECT '' AS dataset_id, 0 AS ord, '' AS rule, '' AS category, '' AS priority, '' AS title, 0.0::DOUBLE AS number WHERE false"


def sql(*rules):
    return f"{BASE} SELECT {SHAPE} FROM ({HEAD} UNION ALL " + "\nUNION ALL\n".join(RULE_SQL[k] for k in rules) + ")"


def shape(df):
    return r(df.select("dataset_id", "ord", "rule", "category", "priority", "title", "number"), "number")


def model_results(t):
    return t.lineitem.groupBy(F.concat("l_returnflag", "l_linestatus").alias("model_name")).agg(
        (F.avg("l_quantity") / 30).alias("test_score")).withColumn("dataset_id", F.lit("customer"))


def info(t):
    return t.part.agg(F.count("*").alias("rows")).select(F.lit("part").alias("dataset_id"), F.lit("p_type").alias("target_column"), F.lit("classification").alias("problem_type"))


PROFILE_RULES = {"ins_quality": ins.quality, "ins_missing": ins.missing, "ins_corr": ins.correlations,
                 "ins_outliers": ins.outliers, "ins_types": ins.types, "ins_highcard": ins.high_cardinality, "ins_from_reco": ins.from_recommendations}
for _name, _rule in PROFILE_RULES.items():
    @query(_name, sql(_name))
    def profile_rule(t, rule=_rule):
        return shape(rule(catalogue(t)))


@query("ins_duplicates", """
SELECT 'documents' AS dataset_id, 30 AS ord, 'duplicates' AS rule, 'data_quality' AS category, CASE WHEN d * 100.0 / n > 5 THEN 'high' ELSE 'medium' END AS priority,
format('{:,}', d) || ' Duplicate Rows Detected' AS title, d::DOUBLE AS number
FROM (SELECT CAST(sum(c) AS BIGINT) AS n, CAST(sum(c - 1) AS BIGINT) AS d FROM (SELECT count(*) AS c FROM documents GROUP BY text, lang)) WHERE d > 0""")
def ins_duplicates(t):
    return shape(ins.duplicates(Catalogue.of({"documents": t.documents.select("text", "lang")})))


@query("ins_model", sql("ins_model"))
def ins_model(t):
    return shape(ins.models(model_results(t)))


@query("ins_business", sql("ins_business"))
def ins_business(t):
    return shape(ins.business(catalogue(t), info(t)))


@query("ins_trim", f"""{BASE}, every AS ({HEAD} UNION ALL {' UNION ALL '.join(RULE_SQL.values())})
SELECT {SHAPE} FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY ord) AS place FROM every) WHERE place <= 5""")
def ins_trim(t):
    return shape(ins.dataset_insights(catalogue(t), model_results(t), info(t)))


@query("ins_content", """
SELECT event_id, substring(event_type || ' ' || props, 1, 500) AS stored_title,
CASE WHEN event_type = 'view' THEN 'value ' || event_id ELSE 'value ' || event_id || chr(10) || chr(10) || 'Recommended Action: ' || props END AS content FROM events""")
def ins_content(t):
    rows = t.events.select("event_id", F.concat("event_type", F.lit(" "), "props").alias("title"),
                           F.concat(F.lit("value "), F.col("event_id").cast("string")).alias("description"),
                           F.expr("if(event_type = 'view', '', props)").alias("action"))
    return ins.content(rows).select("event_id", "stored_title", "content")


@query("ins_content_long", """
SELECT doc_id, substring(text, 1, 500) AS stored_title, substring(text || chr(10) || chr(10) || 'Recommended Action: ' || source, 1, 5000) AS content FROM documents""")
def ins_content_long(t):
    return ins.content(t.documents.select("doc_id", F.col("text").alias("title"), F.col("text").alias("description"), F.col("source").alias("action"))) \
        .select("doc_id", "stored_title", "content")


@query("ins_chart_bar", """
WITH d AS (SELECT p_brand AS name, avg(p_retailprice) AS value FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15)
SELECT (SELECT name FROM d ORDER BY value DESC, name LIMIT 1) AS top, (SELECT name FROM d ORDER BY value, name LIMIT 1) AS bottom, round(max(value) - min(value), 4) AS spread, 'medium' AS priority FROM d""")
def ins_chart_bar(t):
    return r(ins.chart_bar(cd.grouped_bar(t.part, "p_brand", "p_retailprice"), "x").select("top", "bottom", "spread", "priority"), "spread")


@query("ins_chart_pie", """
SELECT o_orderstatus AS top, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM orders), 4) AS percentage, count(*) * 2 > (SELECT count(*) FROM orders) AS imbalanced
FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1""")
def ins_chart_pie(t):
    return r(ins.chart_pie(cd.distribution(t.orders, "o_orderstatus"), "x").select("top", "percentage", "imbalanced"), "percentage")


@query("ins_chart_histogram", """
WITH s AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
b AS (SELECT least(CAST(floor((value - lo) * 20 / (hi - lo)) AS BIGINT), 19) AS i, count(*) AS c FROM events, s GROUP BY 1)
SELECT round(hi - lo, 4) AS spread, round(lo + (hi - lo) * i / 20, 4) AS fullest, c AS most FROM b, s ORDER BY c DESC, i LIMIT 1""")
def ins_chart_histogram(t):
    return r(ins.chart_histogram(cd.histogram(t.events, "value"), "x").select("spread", "fullest", "most"), "spread", "fullest")


@query("ins_chart_scatter", """
SELECT CASE WHEN abs(c) > 0.7 THEN 'strong' WHEN abs(c) > 0.3 THEN 'moderate' ELSE 'weak' END AS strength, CASE WHEN abs(c) > 0.7 THEN 'high' ELSE 'medium' END AS priority,
round(c, 6) AS r, k FROM (SELECT corr(p_partkey, p_retailprice) AS c, least(count(*), 500) AS k FROM part)""")
def ins_chart_scatter(t):
    return r(ins.chart_scatter(cd.scatter(t.part, "p_partkey", "p_retailprice", "p_partkey"), "x").select("strength", "priority", "r", "k"), "r", digits=6)


@query("ins_chart_line", """
WITH n AS (SELECT value, row_number() OVER (ORDER BY ts, md5(CAST(event_id AS VARCHAR)), event_id) - 1 AS i, count(*) OVER () AS n FROM events),
d AS (SELECT * FROM n WHERE i % greatest(n // 100, 1) = 0), e AS (SELECT arg_min(value, i) AS f, arg_max(value, i) AS l, count(*) AS k FROM d)
SELECT CASE WHEN l > f THEN 'upward' ELSE 'downward' END AS trend, round((l - f) / abs(f) * 100, 4) AS change, k FROM e""")
def ins_chart_line(t):
    return r(ins.chart_line(cd.line(t.events, "ts", "value", "event_id"), "x").select("trend", "change", "k"), "change")


@query("ins_chart_box", """
SELECT round(m, 4) AS median, least(50, (SELECT count(*) FROM events WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))) AS k FROM (
SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) AS q3 FROM events)""")
def ins_chart_box(t):
    return r(ins.chart_box(cd.box(t.events, "value"), "x").select("median", "k"), "median")


@query("ins_chart_box_grouped", """
WITH s AS (SELECT event_type, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10)
SELECT (SELECT event_type FROM s ORDER BY iqr DESC, event_type LIMIT 1) AS widest, round(max(iqr), 4) AS iqr, count(*) AS k FROM s""")
def ins_chart_box_grouped(t):
    return r(ins.chart_box_grouped(cd.grouped_box(t.events, "value", "event_type"), "x").select("widest", "iqr", "k"), "iqr")


@query("exec_summary", f"""{BASE} SELECT dataset_id, total_rows, CAST(count(*) AS INTEGER) AS total_columns, duplicate_rows, round(any_value(q), 4) AS quality_score
FROM basic JOIN quality USING (dataset_id) JOIN (SELECT dataset_id, name FROM cols) USING (dataset_id) GROUP BY ALL""")
def exec_summary(t):
    c = catalogue(t)
    return r(ins.executive_summary(c, ins.dataset_insights(c)).drop("summary"), "quality_score")


@query("order_priority", """
SELECT o_orderkey, p AS priority, o_orderdate, row_number() OVER (ORDER BY {order}) AS position FROM (SELECT *, CASE WHEN o_orderpriority < '3' THEN 'high' WHEN o_orderpriority < '4' THEN 'medium' ELSE 'low' END AS p FROM orders)""".replace("{order}", "CASE p WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, o_orderdate DESC, o_orderkey"))
def order_priority(t):
    return ins.by_priority(with_priority(t), "o_orderdate", "o_orderkey").select("o_orderkey", "priority", "o_orderdate", "position")


@query("order_priority_as_written", """
SELECT o_orderkey, p AS priority, o_orderdate, row_number() OVER (ORDER BY {order}) AS position FROM (SELECT *, CASE WHEN o_orderpriority < '3' THEN 'high' WHEN o_orderpriority < '4' THEN 'medium' ELSE 'low' END AS p FROM orders)""".replace("{order}", "p DESC, o_orderdate DESC, o_orderkey"))
def order_priority_as_written(t):
    return ins.by_priority(with_priority(t), "o_orderdate", "o_orderkey", as_written=True).select("o_orderkey", "priority", "o_orderdate", "position")


def with_priority(t):
    return t.orders.withColumn("priority", F.expr("case when o_orderpriority < '3' then 'high' when o_orderpriority < '4' then 'medium' else 'low' end"))


@query("replace_by_category", """
SELECT o_custkey AS dataset_id, o_orderpriority AS category, o_orderkey FROM orders
WHERE NOT (o_orderpriority = '1-URGENT' AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'))
UNION ALL SELECT o_custkey, '1-URGENT', -o_orderkey FROM orders WHERE o_orderstatus = 'P'""")
def replace_by_category(t):
    stored = t.orders.select(F.col("o_custkey").alias("dataset_id"), F.col("o_orderpriority").alias("category"), "o_orderkey")
    new = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("dataset_id"), F.lit("1-URGENT").alias("category"), (-F.col("o_orderkey")).alias("o_orderkey"))
    return ins.replace_category(stored, new, "1-URGENT")
