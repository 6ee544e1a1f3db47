from pyspark.sql import functions as F

from checks.registry import query
from tabscout.operators import query as q
from tabscout.operators.query import run


def spec(name, table, sql, post=None, **parts):
    """Register one declarative query; ``post`` rounds doubles for comparison."""
    @query(name, sql)
    def build(t):
        result = run(getattr(t, table), parts)
        return post(result) if post else result


def rounded(*columns, digits=2):
    return lambda df: df.withColumns({c: F.round(c, digits) for c in columns})


def flt(column, operator, value):
    return {"column": column, "operator": operator, "value": value}


def agg(column, function, alias=None):
    return {"column": column, "function": function, "alias": alias}


def by(column, descending=False):
    return {"column": column, "descending": descending}


spec("flagship", "lineitem", """
SELECT l_linestatus, l_returnflag, round(sum(l_extendedprice), 2) AS revenue, round(avg(l_discount), 4) AS avg_discount
FROM lineitem WHERE l_quantity BETWEEN 10 AND 40 GROUP BY l_returnflag, l_linestatus
ORDER BY l_returnflag, l_linestatus LIMIT 100""",
     post=lambda df: df.withColumns({"revenue": F.round("revenue", 2), "avg_discount": F.round("avg_discount", 4)}),
     filters=[flt("l_quantity", "between", [10, 40])], groupby=["l_returnflag", "l_linestatus"],
     aggregations=[agg("l_extendedprice", "sum", "revenue"), agg("l_discount", "mean", "avg_discount")],
     sort=[by("l_returnflag"), by("l_linestatus")])

spec("dsl_select", "part", "SELECT p_brand, p_name, p_partkey FROM part ORDER BY p_partkey LIMIT 200",
     select=["p_brand", "p_name", "p_partkey"], sort=[by("p_partkey")], limit=200)

spec("dsl_star", "nation", "SELECT * FROM nation LIMIT 100")

spec("dsl_eq", "orders", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 150",
     select=["o_orderkey", "o_orderstatus"], filters=[flt("o_orderstatus", "==", "P")], sort=[by("o_orderkey")], limit=150)

spec("dsl_ne", "orders", """
SELECT o_orderpriority, count(o_orderkey) AS count_o_orderkey FROM orders WHERE o_orderstatus != 'F'
GROUP BY o_orderpriority ORDER BY o_orderpriority LIMIT 100""",
     filters=[flt("o_orderstatus", "!=", "F")], groupby=["o_orderpriority"],
     aggregations=[agg("o_orderkey", "count")], sort=[by("o_orderpriority")])

spec("dsl_cmp", "lineitem", """
SELECT l_returnflag, count(l_orderkey) AS n, CAST(sum(l_partkey) AS BIGINT) AS parts FROM lineitem
WHERE l_quantity > 5 AND l_quantity <= 45 AND l_discount >= 0.02 AND l_tax < 0.08
GROUP BY l_returnflag ORDER BY l_returnflag LIMIT 100""",
     filters=[flt("l_quantity", ">", 5), flt("l_quantity", "<=", 45), flt("l_discount", ">=", 0.02), flt("l_tax", "<", 0.08)],
     groupby=["l_returnflag"], aggregations=[agg("l_orderkey", "count", "n"), agg("l_partkey", "sum", "parts")],
     sort=[by("l_returnflag")])

spec("dsl_like", "part", r"""
SELECT p_name, count(p_partkey) AS n FROM part WHERE p_name LIKE '%e_ w%' GROUP BY p_name ORDER BY n DESC, p_name LIMIT 100""",
     filters=[flt("p_name", "like", "%e_ w%")], groupby=["p_name"], aggregations=[agg("p_partkey", "count", "n")],
     sort=[by("n", True), by("p_name")])

spec("dsl_in", "lineitem", """
SELECT l_linenumber, count(l_orderkey) AS n FROM lineitem WHERE l_linenumber IN (1, 3, 7) AND l_returnflag IN ('A', 'R')
GROUP BY l_linenumber ORDER BY l_linenumber LIMIT 100""",
     filters=[flt("l_linenumber", "in", [1, 3, 7]), flt("l_returnflag", "in", ["A", "R"])], groupby=["l_linenumber"],
     aggregations=[agg("l_orderkey", "count", "n")], sort=[by("l_linenumber")])

spec("dsl_in_empty", "lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE 1=0",
     select=["l_orderkey", "l_linenumber"], filters=[flt("l_orderkey", "in", [])])

spec("dsl_between", "lineitem", """
SELECT l_linestatus, count(l_orderkey) AS n, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem
WHERE l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31'
GROUP BY l_linestatus ORDER BY l_linestatus LIMIT 100""",
     filters=[flt("l_shipdate", "between", ["1996-01-01", "1997-12-31"])], groupby=["l_linestatus"],
     aggregations=[agg("l_orderkey", "count", "n"), agg("l_shipdate", "min", "first_ship"), agg("l_shipdate", "max", "last_ship")],
     sort=[by("l_linestatus")])

spec("dsl_and", "customer", """
SELECT c_custkey, c_name, c_acctbal FROM customer
WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 1000 AND c_name LIKE 'Customer#%' ORDER BY c_acctbal DESC, c_custkey LIMIT 200""",
     select=["c_custkey", "c_name", "c_acctbal"], filters=[flt("c_mktsegment", "==", "BUILDING"), flt("c_acctbal", ">", 1000),
     flt("c_name", "like", "Customer#%")], sort=[by("c_acctbal", True), by("c_custkey")], limit=200)

spec("dsl_cast", "orders", """
SELECT o_orderstatus, count(o_orderkey) AS n FROM orders WHERE o_totalprice > CAST('250000.5' AS DOUBLE) AND o_custkey >= CAST('700' AS BIGINT)
GROUP BY o_orderstatus ORDER BY o_orderstatus LIMIT 100""",
     filters=[flt("o_totalprice", ">", "250000.5"), flt("o_custkey", ">=", "700")], groupby=["o_orderstatus"],
     aggregations=[agg("o_orderkey", "count", "n")], sort=[by("o_orderstatus")])

spec("agg_sum", "lineitem", """
SELECT l_suppkey, CAST(sum(l_linenumber) AS BIGINT) AS sum_l_linenumber, round(sum(l_extendedprice), 2) AS sum_l_extendedprice
FROM lineitem GROUP BY l_suppkey ORDER BY l_suppkey LIMIT 200""", post=rounded("sum_l_extendedprice"),
     groupby=["l_suppkey"], aggregations=[agg("l_linenumber", "sum"), agg("l_extendedprice", "sum")], sort=[by("l_suppkey")], limit=200)

spec("agg_mean", "lineitem", """
SELECT l_shipdate, round(avg(l_quantity), 4) AS mean_l_quantity FROM lineitem GROUP BY l_shipdate ORDER BY l_shipdate LIMIT 200""",
     post=rounded("mean_l_quantity", digits=4), groupby=["l_shipdate"], aggregations=[agg("l_quantity", "mean")],
     sort=[by("l_shipdate")], limit=200)

spec("agg_count", "events", """
SELECT user_id, count(value) AS count_value FROM events GROUP BY user_id ORDER BY user_id LIMIT 200""",
     groupby=["user_id"], aggregations=[agg("value", "count")], sort=[by("user_id")], limit=200)

spec("agg_min", "orders", """
SELECT o_orderpriority, min(o_orderdate) AS min_o_orderdate, min(o_totalprice) AS min_o_totalprice, min(o_orderstatus) AS min_o_orderstatus
FROM orders GROUP BY o_orderpriority ORDER BY o_orderpriority LIMIT 100""", groupby=["o_orderpriority"],
     aggregations=[agg("o_orderdate", "min"), agg("o_totalprice", "min"), agg("o_orderstatus", "min")], sort=[by("o_orderpriority")])

spec("agg_max", "orders", """
SELECT o_orderpriority, max(o_orderdate) AS max_o_orderdate, max(o_totalprice) AS max_o_totalprice, max(o_orderstatus) AS max_o_orderstatus
FROM orders GROUP BY o_orderpriority ORDER BY o_orderpriority LIMIT 100""", groupby=["o_orderpriority"],
     aggregations=[agg("o_orderdate", "max"), agg("o_totalprice", "max"), agg("o_orderstatus", "max")], sort=[by("o_orderpriority")])

spec("agg_median", "lineitem", """
SELECT l_returnflag, round(median(l_extendedprice), 4) AS median_l_extendedprice, round(median(l_quantity), 4) AS median_l_quantity
FROM lineitem GROUP BY l_returnflag ORDER BY l_returnflag LIMIT 100""",
     post=rounded("median_l_extendedprice", "median_l_quantity", digits=4), groupby=["l_returnflag"],
     aggregations=[agg("l_extendedprice", "median"), agg("l_quantity", "median")], sort=[by("l_returnflag")])

spec("agg_global", "lineitem", """
SELECT count(l_orderkey) AS n, round(sum(l_quantity), 2) AS q, round(avg(l_tax), 4) AS t, min(l_shipdate) AS a, max(l_shipdate) AS b,
round(median(l_discount), 4) AS m FROM lineitem LIMIT 100""",
     post=lambda df: df.withColumns({"q": F.round("q", 2), "t": F.round("t", 4), "m": F.round("m", 4)}),
     aggregations=[agg("l_orderkey", "count", "n"), agg("l_quantity", "sum", "q"), agg("l_tax", "mean", "t"),
                   agg("l_shipdate", "min", "a"), agg("l_shipdate", "max", "b"), agg("l_discount", "median", "m")])

spec("agg_group", "lineitem", """
SELECT l_linenumber, l_linestatus, l_returnflag, count(l_orderkey) AS count_l_orderkey, round(avg(l_extendedprice), 2) AS mean_l_extendedprice
FROM lineitem GROUP BY l_returnflag, l_linestatus, l_linenumber ORDER BY l_returnflag, l_linestatus, l_linenumber LIMIT 200""",
     post=rounded("mean_l_extendedprice"), groupby=["l_returnflag", "l_linestatus", "l_linenumber"],
     aggregations=[agg("l_orderkey", "count"), agg("l_extendedprice", "mean")],
     sort=[by("l_returnflag"), by("l_linestatus"), by("l_linenumber")], limit=200)

spec("agg_group_noagg", "supplier", "SELECT s_suppkey, s_nationkey FROM supplier ORDER BY s_suppkey LIMIT 200",
     select=["s_suppkey", "s_nationkey"], groupby=["s_nationkey"], sort=[by("s_suppkey")], limit=200)

spec("dsl_sort", "customer", """
SELECT c_name, c_mktsegment FROM customer ORDER BY c_mktsegment DESC NULLS LAST, c_acctbal ASC NULLS LAST, c_custkey LIMIT 120""",
     select=["c_name", "c_mktsegment"], sort=[by("c_mktsegment", True), by("c_acctbal"), by("c_custkey")], limit=120)

spec("dsl_limit", "events", "SELECT event_id, ts FROM events ORDER BY event_id DESC LIMIT 37",
     select=["event_id", "ts"], sort=[by("event_id", True)], limit=37)

spec("topn", "orders", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 5""",
     select=["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"],
     sort=[by("o_totalprice", True), by("o_orderkey")], limit=5)

spec("bottomn", "orders", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders ORDER BY o_totalprice ASC NULLS LAST, o_orderkey LIMIT 5""",
     select=["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"],
     sort=[by("o_totalprice"), by("o_orderkey")], limit=5)


@query("value_counts", """
SELECT p_type AS value, count(*) AS count FROM part WHERE p_type IS NOT NULL GROUP BY p_type""")
def value_counts(t):
    return q.value_counts(t.part, "p_type")


@query("group_mean_topk", """
SELECT p_brand AS name, round(avg(p_retailprice), 4) AS value FROM part GROUP BY p_brand ORDER BY avg(p_retailprice) DESC, p_brand LIMIT 15""")
def group_mean_topk(t):
    return q.group_topk(t.part, "p_brand", "p_retailprice").withColumn("value", F.round("value", 4))


@query("group_sum_topk", """
SELECT l_suppkey AS name, round(sum(l_extendedprice), 2) AS value FROM lineitem GROUP BY 1 ORDER BY sum(l_extendedprice) DESC, 1 LIMIT 15""")
def group_sum_topk(t):
    return q.group_topk(t.lineitem, "l_suppkey", "l_extendedprice", "sum").withColumn("value", F.round("value", 2))


@query("argmax_group", """
SELECT event_type AS name, round(avg(value), 4) AS value FROM events GROUP BY 1 ORDER BY avg(value) DESC, 1 LIMIT 1""")
def argmax_group(t):
    return q.argmax_group(t.events, "event_type", "value").withColumn("value", F.round("value", 4))


@query("argmax_count", """
SELECT o_orderpriority AS name, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1""")
def argmax_count(t):
    return q.argmax_group(t.orders, "o_orderpriority")


@query("agg_distinct_count", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS unique_count FROM lineitem"
    for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_shipdate")))
def agg_distinct_count(t):
    return q.distinct_count(t.lineitem, ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_shipdate"])


@query("agg_filter", """
SELECT o_custkey, count(DISTINCT o_orderkey) AS total,
count(DISTINCT o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS matching FROM orders GROUP BY o_custkey""")
def agg_filter(t):
    return q.count_distinct_where(t.orders, ["o_custkey"], "o_orderkey", F.col("o_orderstatus") == "F")


@query("agg_median_nan", """
SELECT l_returnflag, median(v) AS median_v, count(v) + count(*) FILTER (WHERE l_linenumber = 1) AS count_v FROM (
SELECT l_returnflag, l_linenumber, CASE WHEN l_linenumber <> 1 THEN l_extendedprice END AS v FROM lineitem) GROUP BY 1""")
def agg_median_nan(t):
    """NaN is no value for a median, in small and large inputs alike; it is one for a count."""
    odd = t.lineitem.withColumn("v", F.expr("if(l_linenumber = 1, double('NaN'), l_extendedprice)"))
    return run(odd, {"groupby": ["l_returnflag"], "aggregations": [{"column": "v", "function": "median"}, {"column": "v", "function": "count"}]})
