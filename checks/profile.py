from pyspark.sql import functions as F

from checks.registry import query
from tabscout.operators import profile as p
from tabscout.operators.profile import Profile

# Fixed facts of the test tables: (name, Spark type, class) in column order.
COLUMNS = {
    "customer": [("c_custkey", "bigint", "numeric"), ("c_name", "string", "categorical"), ("c_nationkey", "int", "numeric"),
                 ("c_acctbal", "double", "numeric"), ("c_mktsegment", "string", "categorical")],
    "part": [("p_partkey", "bigint", "numeric"), ("p_name", "string", "categorical"), ("p_brand", "string", "categorical"),
             ("p_type", "string", "categorical"), ("p_size", "int", "numeric"), ("p_retailprice", "double", "numeric")],
    "orders": [("o_orderkey", "bigint", "numeric"), ("o_custkey", "bigint", "numeric"), ("o_orderstatus", "string", "categorical"),
               ("o_totalprice", "double", "numeric"), ("o_orderdate", "timestamp_ntz", "datetime"),
               ("o_orderpriority", "string", "categorical")],
    "lineitem": [("l_orderkey", "bigint", "numeric"), ("l_partkey", "bigint", "numeric"), ("l_suppkey", "bigint", "numeric"),
                 ("l_linenumber", "int", "numeric"), ("l_quantity", "double", "numeric"), ("l_extendedprice", "double", "numeric"),
                 ("l_discount", "double", "numeric"), ("l_tax", "double", "numeric"), ("l_returnflag", "string", "categorical"),
                 ("l_linestatus", "string", "categorical"), ("l_shipdate", "timestamp_ntz", "datetime")],
    "events": [("event_id", "bigint", "numeric"), ("ts", "timestamp_ntz", "datetime"), ("user_id", "bigint", "numeric"),
               ("event_type", "string", "categorical"), ("value", "double", "numeric"), ("props", "string", "categorical")],
}

# events with gaps, so that the missing-value rules have work to do.
GAPPY_SQL = """SELECT event_id, ts, user_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS event_type,
CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value, 'same' AS fixed FROM events"""
COLUMNS["gappy"] = [("event_id", "bigint", "numeric"), ("ts", "timestamp_ntz", "datetime"), ("user_id", "bigint", "numeric"),
                    ("event_type", "string", "categorical"), ("value", "double", "numeric"), ("fixed", "string", "categorical")]


def gappy(t):
    return t.events.select("event_id", "ts", "user_id", F.expr("if(event_id % 3 = 0, null, event_type)").alias("event_type"),
                           F.expr("if(event_id % 7 = 0, null, value)").alias("value"), F.lit("same").alias("fixed"))


def names(table, kind=None):
    return [n for n, _, k in COLUMNS[table] if kind in (None, k)]


def source(table):
    return f"({GAPPY_SQL})" if table == "gappy" else table


def columns_sql(table, dataset=None):
    """The column profile of ``table`` in SQL."""
    head = f"'{dataset}' AS dataset_id, " if dataset else ""
    rows = []
    for i, (n, dtype, kind) in enumerate(COLUMNS[table]):
        zero = f"count(*) FILTER (WHERE {n} = 0)" if kind == "numeric" else "0"
        rows.append(f"""SELECT {head}{i} AS ord, '{n}' AS name, '{dtype}' AS dtype, '{kind}' AS column_type, count(*) AS total_rows,
count(DISTINCT {n}) AS unique_count, count(DISTINCT {n}) * 100.0::DOUBLE / count(*) AS unique_percentage,
count(*) - count({n}) AS missing_count, (count(*) - count({n})) * 100.0::DOUBLE / count(*) AS missing_percentage,
CAST({zero} AS BIGINT) AS zero_count, count(DISTINCT {n}) BETWEEN 2 AND 19 AS potential_target FROM {source(table)}""")
    return "\nUNION ALL\n".join(rows)


def corr_sql(table, threshold=0.3):
    cols = names(table, "numeric")
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    rows = "\nUNION ALL\n".join(
        f"SELECT {i} AS ord, '{a}' AS column1, '{b}' AS column2, corr({a}, {b}) AS correlation FROM {source(table)}"
        for i, (a, b) in enumerate(pairs))
    return f"""SELECT *, CASE WHEN abs(correlation) >= 0.7 THEN 'strong' WHEN abs(correlation) >= 0.4 THEN 'moderate' ELSE 'weak' END AS strength
FROM ({rows}) WHERE abs(correlation) > {threshold} ORDER BY abs(correlation) DESC, ord LIMIT 20"""


def outliers_sql(table):
    rows = []
    for n in names(table, "numeric"):
        rows.append(f"""SELECT '{n}' AS "column", count(*) FILTER (WHERE v < lo OR v > hi) AS outlier_count,
count(*) FILTER (WHERE v < lo OR v > hi) * 100.0::DOUBLE / count(v) AS outlier_percentage, lo AS lower_bound, hi AS upper_bound FROM (
SELECT v, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (SELECT CAST({n} AS DOUBLE) AS v FROM {source(table)} WHERE {n} IS NOT NULL),
(SELECT quantile_cont(CAST({n} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({n} AS DOUBLE), 0.75) AS q3 FROM {source(table)}))
GROUP BY lo, hi HAVING count(v) >= 4 AND count(*) FILTER (WHERE v < lo OR v > hi) > 0""")
    return "\nUNION ALL\n".join(rows)


def dup_sql(table):
    cols = ", ".join(names(table))
    return f"SELECT CAST(sum(c) AS BIGINT) AS total_rows, CAST(sum(c - 1) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS c FROM {source(table)} GROUP BY {cols})"


def r(df, *columns, digits=4):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def r_sql(columns, digits=4):
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


@query("dup_rows", """
SELECT CAST(sum(c) AS BIGINT) AS total_rows, CAST(sum(c - 1) AS BIGINT) AS duplicate_rows,
round(sum(c - 1) * 100.0::DOUBLE / sum(c), 4) AS duplicate_percentage
FROM (SELECT count(*) AS c FROM documents GROUP BY text, lang, source)""")
def dup_rows(t):
    return r(p.duplicates(t.documents.select("text", "lang", "source")), "duplicate_percentage")


@query("prof_basic", f"""
SELECT total_rows, CAST(11 AS INTEGER) AS total_columns, duplicate_rows, round(duplicate_rows * 100.0::DOUBLE / total_rows, 4) AS duplicate_percentage
FROM ({dup_sql('lineitem')})""")
def prof_basic(t):
    return r(Profile(t.lineitem).basic, "duplicate_percentage")


for _table in ("lineitem", "customer", "gappy"):
    @query(f"prof_columns_{_table}" if _table != "lineitem" else "prof_columns", f"""
SELECT * REPLACE ({r_sql(['unique_percentage', 'missing_percentage'])}) FROM ({columns_sql(_table)})""")
    def prof_columns(t, table=_table):
        return r(Profile(gappy(t) if table == "gappy" else getattr(t, table)).columns, "unique_percentage", "missing_percentage")


@query("col_class", "\nUNION ALL\n".join(
    f"SELECT '{tb}' AS table_name, '{k}' AS column_type, CAST({sum(1 for c in COLUMNS[tb] if c[2] == k)} AS BIGINT) AS columns, count(*) AS total_rows FROM {tb}"
    for tb in ("lineitem", "part", "events") for k in ("numeric", "categorical", "datetime") if any(c[2] == k for c in COLUMNS[tb])))
def col_class(t):
    from functools import reduce
    parts = [Profile(getattr(t, tb)).columns.groupBy("column_type").agg(
        F.count("*").alias("columns"), F.max("total_rows").alias("total_rows"))
        .select(F.lit(tb).alias("table_name"), "column_type", "columns", "total_rows") for tb in ("lineitem", "part", "events")]
    return reduce(lambda a, b: a.unionByName(b), parts)


def numeric_sql(table):
    return "\nUNION ALL\n".join(f"""SELECT '{n}' AS "column", round(CAST(min({n}) AS DOUBLE), 4) AS min, round(CAST(max({n}) AS DOUBLE), 4) AS max,
round(avg({n}), 4) AS mean, round(quantile_cont(CAST({n} AS DOUBLE), 0.5), 4) AS median, round(stddev_samp({n}), 4) AS std,
round(quantile_cont(CAST({n} AS DOUBLE), 0.25), 4) AS q25, round(quantile_cont(CAST({n} AS DOUBLE), 0.75), 4) AS q75,
round(skewness({n}), 4) AS skewness, round(kurtosis({n}), 4) AS kurtosis FROM {source(table)}""" for n in names(table, "numeric"))


@query("prof_numeric", numeric_sql("lineitem"))
def prof_numeric(t):
    return r(Profile(t.lineitem).numeric_stats, "min", "max", "mean", "median", "std", "q25", "q75", "skewness", "kurtosis")


@query("prof_numeric_gappy", numeric_sql("gappy"))
def prof_numeric_gappy(t):
    return r(Profile(gappy(t)).numeric_stats, "min", "max", "mean", "median", "std", "q25", "q75", "skewness", "kurtosis")


def topk_sql(table, k=5):
    return "\nUNION ALL\n".join(f"""SELECT '{n}' AS "column", CAST(rank AS INTEGER) AS rank, value, cnt, round(cnt * 100.0::DOUBLE / total, 4) AS percentage FROM (
SELECT {n} AS value, count(*) AS cnt, row_number() OVER (ORDER BY count(*) DESC, {n}) AS rank, CAST(sum(count(*)) OVER () AS DOUBLE) AS total
FROM {source(table)} WHERE {n} IS NOT NULL GROUP BY {n}) WHERE rank <= {k}""" for n in names(table, "categorical"))


@query("topk_per_column", topk_sql("part"))
def topk_per_column(t):
    return r(Profile(t.part).top_values(), "percentage")


@query("prof_categorical", f"""
SELECT "column", value AS most_common, cnt AS most_common_count, percentage AS most_common_percentage FROM ({topk_sql('gappy')}) WHERE rank = 1""")
def prof_categorical(t):
    return r(Profile(gappy(t)).categorical_stats.drop("top_values"), "most_common_percentage")


@query("prof_datetime", """
SELECT 'ts' AS "column", min(ts) AS min_date, max(ts) AS max_date, date_sub('day', min(ts), max(ts)) AS range_days FROM events""")
def prof_datetime(t):
    return Profile(t.events).datetime_stats


@query("prof_corr", "\nUNION ALL\n".join(
    f"SELECT {i} AS ord, '{a}' AS column1, '{b}' AS column2, round(corr({a}, {b}), 6) AS correlation FROM lineitem"
    for i, (a, b) in enumerate((a, b) for i, a in enumerate(names("lineitem", "numeric")) for b in names("lineitem", "numeric")[i + 1:])))
def prof_corr(t):
    return r(p.pair_correlations(t.lineitem, names("lineitem", "numeric")), "correlation", digits=6)


@query("corr_strength", f"SELECT * REPLACE ({r_sql(['correlation'], 6)}) FROM ({corr_sql('part')})")
def corr_strength(t):
    return r(Profile(t.part).correlations(), "correlation", digits=6)


@query("prof_quality", f"""
SELECT round(100 - sum(missing_count) * 100.0::DOUBLE / sum(total_rows), 4) AS quality_score,
(count(*) FILTER (WHERE missing_percentage > 10) + count(*) FILTER (WHERE unique_count = 1)) AS total_issues FROM ({columns_sql('gappy')})""")
def prof_quality(t):
    return r(Profile(gappy(t)).quality, "quality_score")


@query("prof_quality_issues", f"""
WITH c AS ({columns_sql('gappy')})
SELECT CAST(100000 + ord AS INTEGER) AS ord, CASE WHEN missing_percentage > 30 THEN 'high' ELSE 'medium' END AS severity, name AS "column",
CASE WHEN missing_percentage > 30 THEN 'High missing values' ELSE 'Moderate missing values' END AS kind, round(missing_percentage, 4) AS value
FROM c WHERE missing_percentage > 10 UNION ALL
SELECT CAST(300000 + ord AS INTEGER), 'medium', name, 'Column has only one unique value', NULL FROM c WHERE unique_count = 1""")
def prof_quality_issues(t):
    return r(Profile(gappy(t)).quality_issues.drop("issue"), "value")


@query("prof_summary", f"""
SELECT count(*) FILTER (WHERE column_type = 'numeric') AS numeric_columns_count, count(*) FILTER (WHERE column_type = 'categorical') AS categorical_columns_count,
count(*) FILTER (WHERE column_type = 'datetime') AS datetime_columns_count, CAST(sum(missing_count) AS BIGINT) AS total_missing_values,
round(sum(missing_count) * 100.0::DOUBLE / sum(total_rows), 4) AS missing_percentage FROM ({columns_sql('gappy')})""")
def prof_summary(t):
    return r(Profile(gappy(t)).summary, "missing_percentage")


@query("prof_outliers", f"""
SELECT * REPLACE ({r_sql(['outlier_percentage', 'lower_bound', 'upper_bound'])}) FROM ({outliers_sql('events')})""")
def prof_outliers(t):
    return r(Profile(t.events).outliers, "outlier_percentage", "lower_bound", "upper_bound")


def recommend_sql(table):
    return f"""
WITH c AS ({columns_sql(table)}), o AS ({outliers_sql(table)}), k AS ({corr_sql(table)})
SELECT 1::BIGINT AS ord, 'data_quality' AS category, 'high' AS priority, 'Improve Data Quality' AS title, s AS amount
FROM (SELECT 100 - sum(missing_count) * 100.0::DOUBLE / sum(total_rows) AS s FROM c) WHERE s < 80
UNION ALL SELECT ord + 1000, 'missing_data', 'high', 'High Missing Values in ''' || name || '''', missing_percentage FROM c WHERE missing_percentage > 30
UNION ALL SELECT 1000000, 'outliers', 'medium', 'Outliers Detected', sum(outlier_count)::DOUBLE FROM o HAVING count(*) > 0
UNION ALL SELECT 1000001, 'correlations', 'medium', 'Strong Correlations Found', count(*)::DOUBLE FROM k WHERE strength = 'strong' HAVING count(*) > 0
UNION ALL SELECT 1000002, 'sample_size', 'high', 'Small Dataset', max(total_rows)::DOUBLE FROM c HAVING max(total_rows) < 100"""


@query("prof_recommend", f"SELECT * REPLACE (round(amount, 4) AS amount) FROM ({recommend_sql('gappy')})")
def prof_recommend(t):
    return r(Profile(gappy(t)).recommendations.drop("description"), "amount")


@query("prof_summary_api", f"""
SELECT 'correlation' AS section, ord::BIGINT AS ord, column1 AS a, column2 AS b FROM (SELECT * FROM ({corr_sql('gappy')}) ORDER BY abs(correlation) DESC, ord LIMIT 5)
UNION ALL SELECT 'issue', 100000 + ord, name, 'high' FROM ({columns_sql('gappy')}) WHERE missing_percentage > 30
UNION ALL SELECT 'recommendation', ord, category, title FROM (SELECT * FROM ({recommend_sql('gappy')}) ORDER BY ord LIMIT 5)""")
def prof_summary_api(t):
    parts = Profile(gappy(t)).headline()
    return (parts["top_correlations"].select(F.lit("correlation").alias("section"), F.col("ord").cast("bigint").alias("ord"),
                                             F.col("column1").alias("a"), F.col("column2").alias("b"))
            .unionByName(parts["critical_issues"].select(F.lit("issue").alias("section"), F.col("ord").cast("bigint").alias("ord"),
                                                         F.col("column").alias("a"), F.col("severity").alias("b")))
            .unionByName(parts["recommendations"].select(F.lit("recommendation").alias("section"), "ord",
                                                         F.col("category").alias("a"), F.col("title").alias("b"))))


@query("potential_target", f"SELECT name, unique_count FROM ({columns_sql('lineitem')}) WHERE potential_target")
def potential_target(t):
    return Profile(t.lineitem).columns.where("potential_target").select("name", "unique_count")


@query("kpi_cards", """
SELECT CAST(ord AS INTEGER) AS ord, title, round(number, 4) AS number FROM (
SELECT 1 AS ord, 'Total Records' AS title, count(*)::DOUBLE AS number FROM customer UNION ALL
SELECT 2, 'Total Features', 5.0 UNION ALL SELECT 3, 'Average c_custkey', avg(c_custkey) FROM customer UNION ALL
SELECT 4, 'Min c_custkey', min(c_custkey)::DOUBLE FROM customer UNION ALL SELECT 5, 'Max c_custkey', max(c_custkey)::DOUBLE FROM customer UNION ALL
SELECT 6, 'Data Completeness', (count(c_custkey) + count(c_name) + count(c_nationkey) + count(c_acctbal) + count(c_mktsegment)) * 100.0::DOUBLE / (count(*) * 5) FROM customer)""")
def kpi_cards(t):
    return r(Profile(t.customer).kpi_cards().drop("value"), "number")


@query("top_texts", """
WITH c AS (SELECT text AS value, count(*) AS cnt FROM documents GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY cnt DESC, value) AS INTEGER) AS rank, md5(value) AS digest, cnt FROM c ORDER BY cnt DESC, value LIMIT 40""")
def top_texts(t):
    """Whole texts, most of them tied: the smallest come first."""
    return p.top_values(t.documents, ["text"], 40).select("rank", F.md5(F.col("value").cast("binary")).alias("digest"), "cnt")
