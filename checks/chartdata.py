from pyspark.sql import functions as F

from checks.profile import r
from checks.registry import query
from tabscout.operators import chartdata as cd
from tabscout.plans.orderstats import every_nth


@query("cd_distribution", """
SELECT event_type AS name, count(*) AS value, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM events), 4) AS percentage,
(SELECT count(*) FROM events) AS total FROM events GROUP BY event_type ORDER BY value DESC, name LIMIT 15""")
def cd_distribution(t):
    return r(cd.distribution(t.events, "event_type"), "percentage")


@query("cd_agg_bar", """
SELECT p_brand AS name, round(sum(p_retailprice), 2) AS value FROM part GROUP BY p_brand ORDER BY sum(p_retailprice) DESC, p_brand LIMIT 15""")
def cd_agg_bar(t):
    return r(cd.grouped_bar(t.part, "p_brand", "p_retailprice", "sum"), "value", digits=2)


@query("cd_histogram", """
WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, avg(l_extendedprice) AS mean FROM lineitem),
b AS (SELECT least(CAST(floor((l_extendedprice - lo) * 20 / (hi - lo)) AS BIGINT), 19) AS i, count(*) AS c FROM lineitem, s GROUP BY 1)
SELECT g.i, coalesce(b.c, 0) AS count, round(lo + (hi - lo) * g.i / 20, 4) AS bin_start, round(lo + (hi - lo) * (g.i + 1) / 20, 4) AS bin_end,
lo AS min, hi AS max, round(mean, 4) AS mean FROM (SELECT unnest(range(20)) AS i) g CROSS JOIN s LEFT JOIN b ON b.i = g.i""")
def cd_histogram(t):
    return r(cd.histogram(t.lineitem, "l_extendedprice").drop("bin"), "bin_start", "bin_end", "mean")


@query("cd_scatter", """
SELECT l_quantity AS x, l_extendedprice AS y, round((SELECT corr(l_quantity, l_extendedprice) FROM lineitem), 6) AS correlation
FROM lineitem ORDER BY md5(CAST(l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS VARCHAR)),
l_orderkey * 1000000 + l_partkey * 10 + l_linenumber, l_quantity, l_extendedprice LIMIT 500""")
def cd_scatter(t):
    keyed = t.lineitem.withColumn("line_id", F.expr("l_orderkey * 1000000 + l_partkey * 10 + l_linenumber"))
    return r(cd.scatter(keyed, "l_quantity", "l_extendedprice", "line_id"), "correlation", digits=6)


STRIDE = """
WITH r AS (SELECT *, row_number() OVER (ORDER BY {x}, md5(CAST({k} AS VARCHAR)), {k}) - 1 AS idx, count(*) OVER () AS n FROM {t})
SELECT idx, {cols} FROM r WHERE idx % greatest(n // 100, 1) = 0"""


@query("cd_line", STRIDE.format(x="ts", k="event_id", t="events", cols="strftime(ts, '%Y-%m-%d %H:%M:%S') AS x, value AS y"))
def cd_line(t):
    return cd.line(t.events, "ts", "value", "event_id")


@query("stride_sample", STRIDE.format(x="ts", k="event_id", t="events", cols="event_id, ts, value"))
def stride_sample(t):
    return every_nth(t.events, "ts", "event_id", 100, ["event_id", "ts", "value"])


@query("stride_sample_ties", STRIDE.format(x="o_orderdate", k="o_orderkey", t="orders", cols="o_orderkey, o_orderdate"))
def stride_sample_ties(t):
    return every_nth(t.orders, "o_orderdate", "o_orderkey", 100, ["o_orderkey", "o_orderdate"])


def box_sql(table, column, where="true"):
    return f"""SELECT min(v) AS min, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3, max(v) AS max
FROM (SELECT CAST({column} AS DOUBLE) AS v FROM {table} WHERE {where})"""


@query("cd_box", f"""
WITH s AS ({box_sql('events', 'value')}),
o AS (SELECT value AS v FROM events, s WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) ORDER BY value LIMIT 50)
SELECT round(min, 4) AS min, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, round(max, 4) AS max,
(SELECT count(*) FROM o) AS outlier_rows, (SELECT round(sum(v), 2) FROM o) AS outlier_sum FROM s""")
def cd_box(t):
    out = cd.box(t.events, "value")
    return r(out.withColumns({"outlier_rows": F.size("outliers").cast("bigint"),
                              "outlier_sum": F.round(F.aggregate("outliers", F.lit(0.0), lambda a, v: a + v), 2)})
             .drop("outliers"), "min", "q1", "median", "q3", "max")


GROUPED = """
WITH top AS (SELECT user_id FROM events GROUP BY 1 ORDER BY count(*) DESC, user_id LIMIT 10),
e AS (SELECT user_id, value FROM events SEMI JOIN top USING (user_id) WHERE value IS NOT NULL),
s AS (SELECT user_id, min(value) AS mn, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS md, quantile_cont(value, 0.75) AS q3, max(value) AS mx
FROM e GROUP BY 1 HAVING count(*) >= 5),
o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) AS r FROM e JOIN s USING (user_id)
WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))
SELECT CAST(user_id AS VARCHAR) AS category, round(mn, 4) AS min, round(q1, 4) AS q1, round(md, 4) AS median, round(q3, 4) AS q3, round(mx, 4) AS max,
(SELECT count(*) FROM o WHERE o.user_id = s.user_id AND r <= 10) AS outlier_rows,
coalesce((SELECT round(sum(value), 2) FROM o WHERE o.user_id = s.user_id AND r <= 10), 0) AS outlier_sum FROM s"""


@query("cd_box_grouped", GROUPED)
def cd_box_grouped(t):
    out = cd.grouped_box(t.events, "value", "user_id")
    return r(out.withColumns({"outlier_rows": F.size("outliers").cast("bigint"),
                              "outlier_sum": F.round(F.aggregate("outliers", F.lit(0.0), lambda a, v: a + v), 2)})
             .drop("outliers"), "min", "q1", "median", "q3", "max")


@query("semi_top_cat", """
SELECT event_id, user_id FROM events SEMI JOIN (SELECT user_id FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10) USING (user_id)""")
def semi_top_cat(t):
    return cd.in_top_categories(t.events, "user_id").select("event_id", "user_id")


@query("cd_bar10", "SELECT p_brand AS category, count(*)::DOUBLE AS value FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def cd_bar10(t):
    return cd.bar10(t.part, "p_brand")


@query("cd_bar10_mean", "SELECT p_brand AS category, round(avg(p_size), 4) AS value FROM part GROUP BY 1 ORDER BY 1 LIMIT 10")
def cd_bar10_mean(t):
    return r(cd.bar10(t.part, "p_brand", "p_size"), "value")


@query("cd_pie6", "SELECT o_orderpriority AS name, count(*) AS value FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6")
def cd_pie6(t):
    return cd.pie6(t.orders, "o_orderpriority")


@query("cd_line20", """
SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS index, o_totalprice AS value FROM orders ORDER BY o_orderkey LIMIT 20""")
def cd_line20(t):
    return cd.line20(t.orders, "o_totalprice", "o_orderkey")


@query("trend_first_last", """
SELECT f AS first, l AS last, CASE WHEN l > f THEN 'increased' ELSE 'decreased' END AS trend FROM (
SELECT (SELECT value FROM events ORDER BY ts, event_id LIMIT 1) AS f, (SELECT value FROM events ORDER BY ts DESC, event_id DESC LIMIT 1) AS l)""")
def trend_first_last(t):
    return cd.trend(t.events, "ts", "value", "event_id")


@query("chart_insight", """
SELECT 'bar' AS chart, name AS top, round(v, 4) AS number FROM (SELECT event_type AS name, avg(value) AS v FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)
UNION ALL SELECT 'count', name, round(c * 100.0::DOUBLE / (SELECT count(*) FROM events), 4) FROM (SELECT event_type AS name, count(*) AS c FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)
UNION ALL SELECT 'scatter', CASE WHEN abs(c) > 0.7 THEN 'Strong' WHEN abs(c) > 0.3 THEN 'Moderate' ELSE 'Weak' END || CASE WHEN c > 0 THEN ' positive' ELSE ' negative' END, round(c, 4)
FROM (SELECT corr(user_id, value) AS c FROM events)
UNION ALL SELECT 'line', CASE WHEN l > f THEN 'increased' ELSE 'decreased' END, round(l - f, 4) FROM (
SELECT (SELECT value FROM events ORDER BY ts, event_id LIMIT 1) AS f, (SELECT value FROM events ORDER BY ts DESC, event_id DESC LIMIT 1) AS l)
UNION ALL SELECT 'histogram', CASE WHEN abs(s) < 0.5 THEN 'symmetric' WHEN s > 0 THEN 'right-skewed' ELSE 'left-skewed' END, round(s, 4)
FROM (SELECT skewness(value) AS s FROM events)""")
def chart_insight(t):
    parts = {"bar": cd.insight_bar(t.events, "event_type", "value"), "count": cd.insight_bar(t.events, "event_type"),
             "scatter": cd.insight_scatter(t.events, "user_id", "value"), "line": cd.insight_line(t.events, "ts", "value", "event_id"),
             "histogram": cd.insight_histogram(t.events, "value")}
    out = None
    for name, df in parts.items():
        row = df.select(F.lit(name).alias("chart"), "top", F.round("number", 4).alias("number"))
        out = row if out is None else out.unionByName(row)
    return out


@query("unit_price", """
SELECT l_partkey AS name, round(sum(l_extendedprice) / nullif(sum(l_quantity), 0), 0) AS price FROM lineitem GROUP BY 1""")
def unit_price(t):
    return cd.unit_price(t.lineitem, "l_partkey", "l_extendedprice", "l_quantity")


@query("running_waterfall", """
WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, sum(CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END) AS delta FROM orders GROUP BY 1),
b AS (SELECT *, 120000 + sum(delta) OVER (ORDER BY month ROWS UNBOUNDED PRECEDING) AS balance FROM m)
SELECT month, round(least(balance - delta, balance), 2) AS base, round(abs(delta), 2) AS value, delta >= 0 AS is_positive, round(balance, 2) AS balance FROM b""")
def running_waterfall(t):
    signed = t.orders.withColumn("amount", F.expr("if(o_orderstatus = 'F', -o_totalprice, o_totalprice)"))
    return r(cd.waterfall(signed, "o_orderdate", "amount"), "base", "value", "balance", digits=2)


@query("project_search", """
SELECT p_partkey, p_name, p_type FROM part WHERE (lower(p_name) LIKE '%blue%' OR lower(p_brand) LIKE '%blue%') AND p_type = 'ECONOMY'""")
def project_search(t):
    return cd.search(t.part, "BLUE", ["p_name", "p_brand"], ("p_type", "ECONOMY")).select("p_partkey", "p_name", "p_type")


@query("chart_suggest_result", """
SELECT 'bar' AS type, 'o_orderstatus' AS x_axis, 'n' AS y_axis, count(DISTINCT o_orderstatus) AS rows FROM orders
UNION ALL SELECT 'scatter', 'l_quantity', 'l_tax', count(*) FROM lineitem
UNION ALL SELECT 'line', 'day', 'n', count(DISTINCT CAST(o_orderdate AS DATE)) FROM orders
UNION ALL SELECT 'table', '', '', count(*) FROM part""")
def chart_suggest_result(t):
    results = [
        t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n")),
        t.lineitem.select("l_quantity", "l_tax"),
        t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n")),
        t.part.select("p_name", "p_brand")]
    out = None
    for df in results:
        # The type comes from the result's schema and first rows; the rows to draw are counted.
        found = cd.suggest_for_result(df)
        row = df.agg(F.count("*").alias("rows")).select(F.lit(found["type"]).alias("type"), F.lit(found.get("x_axis", "")).alias("x_axis"),
                                 F.lit(found.get("y_axis", "")).alias("y_axis"), "rows")
        out = row if out is None else out.unionByName(row)
    return out
