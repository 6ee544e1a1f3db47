"""Whole-table analysis: profile, charts, chart data and insights, tied together."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from tabscout.operators import chartdata, charts, insights
from tabscout.operators.charts import Catalogue
from tabscout.operators.profile import Profile, clean
from tabscout.plans.durable import local

NO_CHARTS = {"category": "visualization", "priority": "low", "title": "Charts Available",
             "description": "None of the columns suits a chart.", "action": "Add a number, a date or a column with few values."}


@dataclass
class Analysis:
    catalogue: Catalogue
    charts: DataFrame       # ranked charts of the page, each with its insight texts
    chart_rows: DataFrame   # rank, place, type, payload: the data behind each chart, in its own order
    insights: DataFrame     # rank, category, priority, title, description, action


def analyze(df: DataFrame, dataset_id: str, key: str | None = None, limit: int = 7, offset: int = 0) -> Analysis:
    """Analyse one table; ``key`` names a unique column used to draw sampled points."""
    df = clean(df)  # charts and profile see the same values
    if key is None:
        df, key = df.withColumn("__row", charts.row_text(df)), "__row"
    shown = [c for c in df.columns if c != "__row"]
    profile = Profile(df, shown)
    catalogue = Catalogue.of({dataset_id: profile})
    ranked = local(charts.page(charts.recommend(catalogue), limit, offset))
    chosen = ranked.orderBy("rank").collect()  # one page of chart settings
    together = chartdata.shared(df, chosen, profile, key)
    rows, found = [], []
    for chart in chosen:
        data = together.get(chart["rank"])
        if data is None:
            data = charts.chart_data(df, chart, key)
            if data is None:
                continue
            data = local(data)  # bounded by the chart's own point limit; read twice below
        at = [c for c in ("idx", "index", "i", "bin", "name", "category", "x", "y") if c in data.columns]
        place = F.row_number().over(W.orderBy(*at) if at else W.orderBy(F.lit(0)))
        rows.append(data.select(F.lit(chart["rank"]).alias("rank"), place.alias("place"), F.lit(chart["type"]).alias("type"), F.to_json(F.struct("*")).alias("payload")))
        grouped = chart["type"] == "box" and chart["config"]["by_column"] is not None
        found.append(insights.chart_insight(chart["type"], data, chart["title"], grouped)
                     .select(F.lit(chart["rank"]).alias("rank"), "*"))
    spark = df.sparkSession
    if not found:
        nothing = spark.range(1).select(F.lit(0).alias("rank"), *[F.lit(v).alias(k) for k, v in NO_CHARTS.items()])
        return Analysis(catalogue, ranked.withColumn("insights", F.array().cast("array<string>")),
                        spark.createDataFrame([], "rank int, place int, type string, payload string"), nothing)
    told = reduce(DataFrame.unionByName, found)
    texts = told.select("rank", F.array("description", F.concat(F.lit("Recommendation: "), "action")).alias("insights"))
    return Analysis(catalogue, ranked.join(texts, "rank", "left"), reduce(DataFrame.unionByName, rows), told)


def report(analysis: Analysis, dataset_id: str, history: DataFrame | None = None, details: DataFrame | None = None) -> DataFrame:
    """Report data as (section, ord, place, payload): details, insights, charts with data, last ten questions.

    ``history`` has ts and query_text columns; ``details`` is one row about the dataset.
    """
    c = analysis.catalogue
    if details is None:
        details = c.basic.join(c.quality, "dataset_id")
    sections = [
        details.select(F.lit("dataset").alias("section"), F.lit(1).alias("ord"), F.to_json(F.struct("*")).alias("payload")),
        insights.content(insights.dataset_insights(c)).select(
            F.lit("insight").alias("section"), F.col("place").alias("ord"),
            F.to_json(F.struct(F.col("stored_title").alias("title"), "content")).alias("payload")),
        analysis.charts.select(F.lit("chart").alias("section"), F.col("rank").alias("ord"),
                               F.to_json(F.struct("type", "title", "description", "config", "score", "insights", "recommendation")).alias("payload")),
        analysis.chart_rows.select(F.lit("chart_data").alias("section"), F.col("rank").alias("ord"), "payload", "place")]
    if history is not None:
        last = history.orderBy(F.col("ts").desc(), "query_text").limit(10)
        newest = F.row_number().over(W.orderBy(F.col("ts").desc(), "query_text"))  # ten rows
        sections.append(last.select(F.lit("history").alias("section"), newest.alias("ord"),
                                    F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd HH:mm").alias("created_at"), "query_text")).alias("payload")))
    placed = [s if "place" in s.columns else s.withColumn("place", F.lit(1)) for s in sections]
    return reduce(DataFrame.unionByName, placed)
