from pyspark.sql import functions as F

from checks.profile import r
from checks.registry import query
from tabscout.operators import platform as pf

LINE_ID = "l_orderkey * 1000000 + l_partkey * 10 + l_linenumber"


@query("view_entity_summary", """
SELECT o_orderkey, o_custkey, c_name, n_name, count(DISTINCT l_partkey) AS part_count, count(DISTINCT l_suppkey) AS supplier_count, max(l_discount) AS best_l_discount
FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2, 3, 4""")
def view_entity_summary(t):
    children = [pf.Child(t.lineitem, "l_orderkey", "l_partkey", "part_count", best="l_discount"),
                pf.Child(t.lineitem, "l_orderkey", "l_suppkey", "supplier_count")]
    return pf.entity_summary(t.orders, t.customer, "o_orderkey", "o_custkey", "c_custkey", children, (t.nation, "c_nationkey", "n_nationkey")) \
        .select("o_orderkey", "o_custkey", "c_name", "n_name", "part_count", "supplier_count", "best_l_discount")


def user_stats(t, as_written):
    lines = t.lineitem.withColumn("line_id", F.expr(LINE_ID))
    out = pf.owner_stats(t.customer.select("c_custkey", "c_name"), t.orders.withColumn("views", F.expr("o_orderkey % 50")), lines, t.events,
                         owner_key="c_custkey", owner="o_custkey", key="o_orderkey", public=F.col("o_orderstatus") == "F", views="views",
                         created="o_orderdate", export_parent="l_orderkey", export_id="line_id", history_owner="user_id", history_id="event_id", as_written=as_written)
    return out


STATS = f"""
WITH e AS (SELECT l_orderkey, count(DISTINCT {LINE_ID}) AS exports, count(*) AS copies FROM lineitem GROUP BY 1),
q AS (SELECT user_id, count(*) AS asked FROM events GROUP BY 1),
d AS (SELECT o_custkey, count(*) AS total_entities, count(*) FILTER (WHERE o_orderstatus = 'F') AS public_entities,
CAST(sum((o_orderkey % 50) * {{weight}}) AS BIGINT) AS views, max(o_orderdate) AS last_created, CAST(sum(exports) AS BIGINT) AS total_exports
FROM orders LEFT JOIN e ON l_orderkey = o_orderkey GROUP BY 1)
SELECT c_custkey, c_name, coalesce(total_entities, 0) AS total_entities, coalesce(public_entities, 0) AS public_entities, {{views}} AS total_views, last_created,
coalesce(total_exports, 0) AS total_exports, coalesce(asked, 0) AS total_queries FROM customer LEFT JOIN d ON o_custkey = c_custkey LEFT JOIN q ON user_id = c_custkey"""


@query("view_user_stats", STATS.format(weight="1", views="views"))
def view_user_stats(t):
    return user_stats(t, False)


@query("view_user_stats_as_written", f"""
WITH f AS (SELECT c_custkey, sum(o_orderkey % 50) AS total_views FROM (SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey
LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN events ON user_id = c_custkey) GROUP BY 1)
SELECT c_custkey, c_name, total_entities, public_entities, CAST(f.total_views AS BIGINT) AS total_views, last_created, total_exports, total_queries
FROM ({STATS.format(weight="1", views="views")}) s JOIN f USING (c_custkey)""")
def view_user_stats_as_written(t):
    return user_stats(t, True)


@query("stats_owner", """
SELECT o_custkey, count(*) AS total_datasets, count(DISTINCT l_orderkey) AS models_trained, count(*) AS ready_reports
FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_discount > 0.08) ON l_orderkey = o_orderkey GROUP BY 1""")
def stats_owner(t):
    return pf.owner_totals(t.orders, t.lineitem.where("l_discount > 0.08"), "o_orderkey", "l_orderkey", "o_custkey")


@query("anti_orphans", "SELECT o_orderkey, o_custkey FROM orders ANTI JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def anti_orphans(t):
    return pf.orphans(t.orders, t.customer.where("c_acctbal > 0"), "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@query("delete_cascade", """
WITH gone AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
SELECT 'lines' AS table_name, l_linenumber::BIGINT AS k, count(*) AS rows, count(l_orderkey) AS linked FROM lineitem ANTI JOIN gone ON l_orderkey = o_orderkey GROUP BY 2
UNION ALL SELECT 'log', event_id % 7, count(*), count(CASE WHEN o_orderkey IS NULL THEN event_id END) FROM events LEFT JOIN gone ON event_id = o_orderkey GROUP BY 2""")
def delete_cascade(t):
    children = {"lines": (t.lineitem, "l_orderkey"), "log": (t.events.withColumn("order_id", F.col("event_id")), "order_id")}
    left = pf.delete_cascade(t.orders.where("o_orderstatus = 'P'"), "o_orderkey", children, set_null=["log"])
    return (left["lines"].groupBy(F.col("l_linenumber").cast("bigint").alias("k")).agg(F.count("*").alias("rows"), F.count("l_orderkey").alias("linked"))
            .select(F.lit("lines").alias("table_name"), "k", "rows", "linked")
            .unionByName(left["log"].groupBy((F.col("event_id") % 7).alias("k")).agg(F.count("*").alias("rows"), F.count("order_id").alias("linked"))
                         .select(F.lit("log").alias("table_name"), "k", "rows", "linked")))


@query("distinct_on_best", f"""
SELECT l_orderkey, line_id, cv, l_discount FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY cv DESC NULLS LAST, l_discount DESC, line_id) AS r
FROM (SELECT l_orderkey, {LINE_ID} AS line_id, CASE WHEN l_tax > 0.05 THEN NULL ELSE l_tax END AS cv, l_discount FROM lineitem)) WHERE r = 1""")
def distinct_on_best(t):
    rows = t.lineitem.select("l_orderkey", F.expr(LINE_ID).alias("line_id"), F.expr("if(l_tax > 0.05, null, l_tax)").alias("cv"), "l_discount")
    return pf.best_per_key(rows, "l_orderkey", ["cv", "l_discount"], "line_id")


@query("page_history", """
SELECT event_id, ts, props, (SELECT count(*) FROM events WHERE user_id = 8 AND event_type = 'view') AS total_count FROM events
WHERE user_id = 8 AND event_type = 'view' ORDER BY ts DESC, event_id LIMIT 5 OFFSET 3""")
def page_history(t):
    mine = (F.col("user_id") == 8) & (F.col("event_type") == "view")
    return pf.history_page(t.events, mine, "ts", "event_id", limit=5, offset=3).select("event_id", "ts", "props", "total_count")


@query("list_datasets", "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM orders WHERE o_custkey = 7 ORDER BY o_orderdate DESC, o_orderkey")
def list_datasets(t):
    return pf.owned(t.orders, "o_custkey", 7, "o_orderdate", "o_orderkey", ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"])


@query("list_dataset_by_id", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 899 AND o_orderkey = 0")
def list_dataset_by_id(t):
    return pf.owned(t.orders, "o_custkey", 899, "o_orderdate", "o_orderkey", ["o_orderkey", "o_totalprice"], only=0)


@query("rank_models", """
WITH m AS (SELECT l_returnflag AS dataset_id, l_suppkey AS model_name, round(sqrt(avg(l_extendedprice)) / 400, 6) AS test_score FROM lineitem GROUP BY 1, 2)
SELECT dataset_id, model_name, test_score, round(test_score * 100, 1) AS accuracy,
row_number() OVER (PARTITION BY dataset_id ORDER BY test_score DESC, model_name) = 1 AS is_best FROM m""")
def rank_models(t):
    results = t.lineitem.groupBy(F.col("l_returnflag").alias("dataset_id"), F.col("l_suppkey").alias("model_name")) \
        .agg(F.round(F.sqrt(F.avg("l_extendedprice")) / 400, 6).alias("test_score"))
    return pf.rank_models(results, "dataset_id", "test_score", "model_name")


NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query("union_all", "\nUNION ALL\n".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in NAMES))
def union_all(t):
    return pf.row_counts({n: getattr(t, n) for n in NAMES})


@query("touch_updated", """
SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_custkey,
CASE WHEN o_orderpriority = '5-LOW' THEN TIMESTAMP '2030-01-01' ELSE o_orderdate END AS updated_at FROM orders""")
def touch_updated(t):
    old = t.orders.select("o_orderkey", "o_totalprice", "o_custkey", F.col("o_orderdate").alias("updated_at"))
    new = t.orders.select("o_orderkey", F.expr("if(o_orderpriority = '5-LOW', o_totalprice + 1, o_totalprice)").alias("o_totalprice"), "o_custkey",
                          F.col("o_orderdate").alias("updated_at"))
    return pf.touch_updated(old, new, "o_orderkey", "updated_at", F.expr("timestamp_ntz'2030-01-01'"))


@query("activity_log", """
SELECT o_custkey AS user_id, o_orderkey AS dashboard_id, 'create_dashboard' AS action_type,
'{"dashboard_id":' || o_orderkey || ',"dashboard_title":"' || o_orderpriority || '"}' AS action_details FROM orders""")
def activity_log(t):
    return pf.activity_log(t.orders, "o_custkey", "o_orderkey", "o_orderpriority")
