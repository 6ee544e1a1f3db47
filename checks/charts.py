from pyspark.sql import functions as F

from checks.profile import columns_sql, corr_sql, gappy, outliers_sql
from checks.registry import query
from tabscout.operators import charts
from tabscout.operators.analysis import analyze
from tabscout.operators.charts import Catalogue

SETS = ("customer", "part", "orders", "gappy")


def catalogue(t, names=SETS):
    return Catalogue.of({n: gappy(t) if n == "gappy" else getattr(t, n) for n in names})


def union(make):
    return "\nUNION ALL\n".join(f"SELECT '{n}' AS dataset_id, * FROM ({make(n)})" for n in SETS)


CATALOGUE_SQL = f"""cols AS ({union(columns_sql)}),
corrs AS ({union(lambda n: f'SELECT row_number() OVER (ORDER BY abs(correlation) DESC, ord) AS rank, * FROM ({corr_sql(n)})')}),
outs AS ({union(outliers_sql)})"""

RULES_SQL = f"""{CATALOGUE_SQL},
num AS (SELECT dataset_id, name AS num, row_number() OVER (PARTITION BY dataset_id ORDER BY ord) AS pos FROM cols
  WHERE column_type = 'numeric' AND lower(name) NOT LIKE '%id%' AND lower(name) NOT LIKE '%index%'),
cat AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY ord) AS pos, row_number() OVER (PARTITION BY dataset_id ORDER BY unique_count, ord) AS low
  FROM cols WHERE column_type = 'categorical' AND unique_count > 1),
d AS (SELECT dataset_id, arg_min(name, ord) AS date FROM cols WHERE column_type = 'datetime' GROUP BY dataset_id),
top AS (SELECT dataset_id, name AS cat, low FROM cat WHERE low <= 3 AND unique_count <= 50),
cand AS (
SELECT dataset_id, CAST(1000000 + pos * 2 AS BIGINT) AS ord, 'histogram' AS type, 'Distribution of ' || num AS title, num AS "column", NULL AS x_column, NULL AS y_column,
  NULL AS categorical_column, NULL AS numeric_column, NULL AS by_column, NULL AS aggregation, NULL::DOUBLE AS correlation FROM num
UNION ALL SELECT dataset_id, 1000000 + pos * 2 + 1, 'box', 'Box Plot of ' || num, num, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM num
UNION ALL SELECT dataset_id, 2000000 + pos * 2, 'bar', 'Count by ' || name, name, NULL, NULL, NULL, NULL, NULL, 'count', NULL FROM cat WHERE unique_count <= 20
UNION ALL SELECT dataset_id, 2000000 + pos * 2 + 1, 'pie', 'Share of ' || name, name, NULL, NULL, NULL, NULL, NULL, 'count', NULL FROM cat WHERE unique_count <= 5
UNION ALL SELECT dataset_id, 3000000 + rank, 'scatter', column1 || ' vs ' || column2, NULL, column1, column2, NULL, NULL, NULL, NULL, correlation FROM corrs WHERE abs(correlation) > 0.3
UNION ALL SELECT dataset_id, 4000000 + low * 100 + pos * 2, 'bar', 'Average ' || num || ' by ' || cat, NULL, NULL, NULL, cat, num, NULL, 'mean', NULL FROM top JOIN num USING (dataset_id) WHERE pos <= 3
UNION ALL SELECT dataset_id, 4000000 + low * 100 + pos * 2 + 1, 'box', num || ' Distribution by ' || cat, num, NULL, NULL, NULL, NULL, cat, NULL, NULL FROM top JOIN num USING (dataset_id) WHERE pos <= 3
UNION ALL SELECT dataset_id, 5000000 + pos, 'line', num || ' Trend', NULL, date, num, NULL, NULL, NULL, NULL, NULL FROM d JOIN num USING (dataset_id) WHERE pos <= 3),
used AS (SELECT dataset_id, ord, unnest(["column", x_column, y_column, categorical_column, numeric_column]) AS name FROM cand),
complete AS (SELECT used.dataset_id, used.ord, sum(CASE WHEN {{missing}} < 0.05 THEN 5 WHEN {{missing}} > 0.2 THEN -20 ELSE 0 END) AS pts
  FROM used JOIN cols ON cols.dataset_id = used.dataset_id AND cols.name = used.name GROUP BY 1, 2),
scored AS (SELECT cand.*, CAST(least(100, greatest(0, 50
  + CASE WHEN type = 'scatter' THEN CASE WHEN abs(correlation) > 0.7 THEN 30 WHEN abs(correlation) > 0.5 THEN 20 WHEN abs(correlation) > 0.3 THEN 10 ELSE 0 END ELSE 0 END
  + CASE WHEN type IN ('box', 'histogram') AND EXISTS (SELECT 1 FROM outs o WHERE o.dataset_id = cand.dataset_id AND o."column" = cand."column") THEN 15 ELSE 0 END
  + CASE WHEN type = 'line' THEN 20 ELSE 0 END
  + CASE WHEN type IN ('bar', 'pie') THEN (SELECT CASE WHEN unique_count < 10 THEN 10 WHEN unique_count > 50 THEN -30 ELSE 0 END FROM cols c
      WHERE c.dataset_id = cand.dataset_id AND c.name = coalesce(cand."column", cand.categorical_column)) ELSE 0 END
  + coalesce(pts, 0))) AS INTEGER) AS score FROM cand LEFT JOIN complete USING (dataset_id, ord))"""

FLAT = ("column", "x_column", "y_column", "categorical_column", "numeric_column", "by_column", "aggregation")
FLAT_SQL = 'dataset_id, ord, type, title, "column", x_column, y_column, categorical_column, numeric_column, by_column, aggregation'


def flat(df, *extra):
    return df.select("dataset_id", "ord", "type", "title", *[F.col(f"config.{c}").alias(c) for c in FLAT], *extra)


@query("chart_candidates", f"WITH {RULES_SQL.format(missing='missing_count')} SELECT {FLAT_SQL} FROM cand")
def chart_candidates(t):
    c = catalogue(t)
    return flat(charts.candidates(c.columns, c.correlations))


def scored(t, ratio=False):
    c = catalogue(t)
    return charts.score(charts.candidates(c.columns, c.correlations), c.columns, c.outliers, ratio)


@query("chart_score", f"WITH {RULES_SQL.format(missing='missing_count')} SELECT {FLAT_SQL}, score FROM scored")
def chart_score(t):
    return flat(scored(t), "score")


@query("chart_score_ratio", f"WITH {RULES_SQL.format(missing='missing_count / total_rows')} SELECT {FLAT_SQL}, score FROM scored")
def chart_score_ratio(t):
    return flat(scored(t, ratio=True), "score")


DIVERSE_SQL = f"""WITH {RULES_SQL.format(missing='missing_count')},
item AS (SELECT dataset_id, type, ord, score, coalesce(y_column, numeric_column, "column") AS p, coalesce(categorical_column, by_column, x_column, "column") AS x FROM scored),
walked AS (SELECT dataset_id, type, list_reduce([[]] || list([{{'s': -score, 'o': ord, 'p': p, 'x': x}}] ORDER BY score DESC, ord), lambda acc, c:
  CASE WHEN len(acc) >= 3 OR len(list_filter(acc, lambda a: a.p = c[1].p)) > 0 OR len(list_filter(acc, lambda a: a.x = c[1].x)) >= 2 THEN acc ELSE acc || c END) AS kept
  FROM item GROUP BY 1, 2),
best AS (SELECT dataset_id, unnest(kept).o AS ord FROM walked),
ranked AS (SELECT scored.*, CAST(row_number() OVER (PARTITION BY dataset_id ORDER BY score DESC, ord) AS INTEGER) AS rank FROM scored SEMI JOIN best USING (dataset_id, ord))"""


@query("chart_diversify", f"{DIVERSE_SQL} SELECT {FLAT_SQL}, score, rank FROM ranked")
def chart_diversify(t):
    return flat(charts.diversify(scored(t)), "score", "rank")


@query("page_charts", f"""{DIVERSE_SQL}, counted AS (SELECT *, count(*) OVER (PARTITION BY dataset_id) AS total FROM ranked)
SELECT dataset_id, rank, title, total FROM counted WHERE rank > 4 AND rank <= 8""")
def page_charts(t):
    return charts.page(charts.diversify(scored(t)), limit=4, offset=4).select("dataset_id", "rank", "title", "total")


@query("chart_reco", f"""{DIVERSE_SQL} SELECT dataset_id, rank, CASE type WHEN 'scatter' THEN 'Investigate causal drivers behind ' || title || '.'
WHEN 'bar' THEN 'Focus resources on top performing segments in ' || title || '.' WHEN 'line' THEN 'Monitor this trend for future anomalies.'
WHEN 'box' THEN 'Review outlier data points for data quality or fraud.' ELSE 'Explore this Metric further in detailed analysis.' END AS recommendation FROM ranked""")
def chart_reco(t):
    return charts.recommend(catalogue(t)).select("dataset_id", "rank", "recommendation")


@query("chart_suggest_simple", f"""WITH {CATALOGUE_SQL},
f AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, column_type ORDER BY ord) AS r, unique_count + CASE WHEN missing_count > 0 THEN 1 ELSE 0 END AS vals FROM cols),
c AS (SELECT * FROM f WHERE r = 1 AND column_type = 'categorical'), n AS (SELECT * FROM f WHERE r = 1 AND column_type = 'numeric')
SELECT dataset_id, CAST(1 AS INTEGER) AS ord, 'bar' AS type, name || ' Distribution' AS title, name AS x, 'count' AS y FROM c WHERE vals <= 10
UNION ALL SELECT dataset_id, 2, 'pie', name || ' Breakdown', name, NULL FROM c WHERE vals <= 6
UNION ALL SELECT dataset_id, 3, 'line', name || ' Trend', 'index', name FROM n
UNION ALL SELECT c.dataset_id, 4, 'bar', n.name || ' by ' || c.name, c.name, n.name FROM c JOIN n USING (dataset_id)""")
def chart_suggest_simple(t):
    return charts.suggest_simple(catalogue(t).columns)


@query("analyze_dataset", f"""{DIVERSE_SQL} SELECT dataset_id, rank, type, title, score, CAST(2 AS INTEGER) AS insights FROM ranked WHERE dataset_id = 'orders' AND rank <= 7""")
def analyze_dataset(t):
    return analyze(t.orders, "orders", key="o_orderkey").charts.select("dataset_id", "rank", "type", "title", "score", F.size("insights").alias("insights"))


#: Points behind each ranked chart of a table, by the chart type's own limit.
POINTS_SQL = """points AS (SELECT rank, type, CAST(CASE WHEN type = 'histogram' THEN 20 WHEN type = 'scatter' THEN least(500, t.n)
  WHEN type = 'line' THEN ceil(t.n / greatest(t.n // 100, 1)::DOUBLE) WHEN type = 'box' AND by_column IS NULL THEN 1
  WHEN type = 'box' THEN least(10, unique_count) ELSE least(15, unique_count) END AS BIGINT) AS points
  FROM ranked LEFT JOIN cols c ON c.dataset_id = ranked.dataset_id AND c.name = coalesce(ranked.categorical_column, ranked.by_column, ranked."column"),
  (SELECT count(*) AS n FROM {table}) t WHERE ranked.dataset_id = '{table}' AND rank <= 7)"""


@query("analyze_chart_data", f"{DIVERSE_SQL}, {POINTS_SQL.format(table='orders')} SELECT *, CAST(points AS INTEGER) AS last, true AS full FROM points")
def analyze_chart_data(t):
    """Every chart has all its points, in places without gaps, and no payload lacks its value."""
    rows = analyze(t.orders, "orders", key="o_orderkey").chart_rows
    return rows.groupBy("rank", "type").agg(F.count("*").alias("points"), F.max("place").alias("last"),
                                            F.bool_and(F.col("payload").startswith("{") & ~F.col("payload").contains("NaN")).alias("full"))
