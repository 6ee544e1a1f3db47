"""Plain-English questions mapped to queries by keyword rules, as one job over a table of questions."""

from __future__ import annotations

import json
import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tabscout.functions.stats import percent
from tabscout.functions.text import contains_any, ref
from tabscout.operators.chartdata import suggest_for_result
from tabscout.operators.profile import column_class, per_column
from tabscout.operators.query import MAX_ROWS, run
from tabscout.plans.durable import durable

# Phrases that mark a conversational question.
TRIGGERS = [
    "about", "tell me", "describe", "what is", "what are", "summarize", "summary", "overview", "explain", "who", "help",
    "can you", "dataset", "columns", "how many rows", "how many col", "what data", "what kind", "recommendation",
    "suggest", "clean", "improve", "visuali",
]
ADVICE_WORDS = ["recommendation", "suggest", "clean", "improve"]

# Words behind each pattern, tried in this order.
PATTERNS = {
    "top": r"\btop\b|\bhighest\b|\bbest\b|\blargest\b|\bmost\b",
    "bottom": r"\bbottom\b|\blowest\b|\bworst\b|\bsmallest\b|\bleast\b",
    "count": r"\bcount\b[^\n]*\bby\b|\bhow many\b[^\n]*\bper\b|\bhow many\b[^\n]*\bby\b|\bcount\b[^\n]*\bper\b|\bcount\b[^\n]*\beach\b",
    "mean": r"\baverage\b|\bmean\b",
    "sum": r"\bsum\b|\btotal\b",
    "show": r"\bshow\b|\blist\b|\bdisplay\b|\bgive\b|\bget\b",
}
# Fixed value: how a question names a number of rows.
LIMIT = r"(?:top|first|last|bottom|show|list)\s+(\d+)"
PREVIEW_ROWS = 50

EXAMPLES = 'Try, for example: *"average price by flag"*, *"top 5 quantity"* or *"how many rows per status"*.'
ALL_WELL = "• No column has many gaps. Scale the numbers before you train a model."
FOUND = "These rows answer the question."


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _lowered(questions: DataFrame) -> DataFrame:
    """Lower-case text as a column of its own, so that the rules share it."""
    return questions if "__lower" in questions.columns else questions.withColumn("__lower", F.lower("question"))


def with_intent(questions: DataFrame) -> DataFrame:
    chatty = contains_any(F.col("__lower"), TRIGGERS)
    return _tidy(_lowered(questions).withColumn("intent", F.when(chatty, "conversational").otherwise("data_query")), questions)


def _tidy(out: DataFrame, given: DataFrame) -> DataFrame:
    return out if "__lower" in given.columns else out.drop("__lower")


def with_mentions(questions: DataFrame, names: Sequence[str]) -> DataFrame:
    """``mentioned``: the column names found in the question, longest first."""
    by_length = sorted(names, key=len, reverse=True)
    hits = [F.when(F.col("__lower").contains(n.lower()), F.lit(n)) for n in by_length]
    return _tidy(_lowered(questions).withColumn("mentioned", F.array_compact(F.array(*hits))), questions)


def with_limit(questions: DataFrame) -> DataFrame:
    """``asked``: the number after top, first, last, bottom, show or list."""
    found = F.regexp_extract("__lower", LIMIT, 1)
    number = F.try_to_number(F.nullif(found, F.lit("")), F.lit("9" * 18)).cast("bigint")
    asked = F.when(F.length(found) > 18, F.lit(MAX_ROWS).cast("bigint")).otherwise(number)
    return _tidy(_lowered(questions).withColumn("asked", asked), questions)


def with_pattern(questions: DataFrame) -> DataFrame:
    chosen = F.lit("default")
    for name, regex in reversed(PATTERNS.items()):
        # (?U): word boundaries respect letters beyond ASCII.
        chosen = F.when(F.col("__lower").rlike("(?U)" + regex), name).otherwise(chosen)
    return _tidy(_lowered(questions).withColumn("pattern", chosen), questions)


def route(questions: DataFrame, columns: Sequence[tuple[str, str]]) -> DataFrame:
    """Intent and query of each question; ``columns`` lists (name, class) of the dataset."""
    names = [n for n, _ in columns]
    numeric = [n for n, k in columns if k == "numeric"]
    categorical = [n for n, k in columns if k == "categorical"]
    read = with_pattern(with_limit(with_mentions(with_intent(_lowered(questions)), names))).drop("__lower")
    pattern, mentioned = F.col("pattern"), F.col("mentioned")
    none = F.lit(None).cast("string")
    first_number = F.lit((numeric or names)[0])
    number = F.coalesce(F.get(F.filter(mentioned, lambda c: F.array_contains(_strings(numeric), c)), F.lit(0)), first_number)
    group = F.get(F.filter(mentioned, lambda c: F.array_contains(_strings(categorical), c)), F.lit(0))
    counted = F.coalesce(F.get(mentioned, F.lit(0)), F.lit((categorical or names)[0]))
    ranked_by = F.when(F.array_contains(_strings(numeric), F.get(mentioned, F.lit(0))), F.get(mentioned, F.lit(0))).otherwise(first_number)
    ranks, averages, sums = pattern.isin("top", "bottom"), pattern == "mean", pattern == "sum"
    aggregated = averages | sums
    alias = F.when(pattern == "count", F.concat(F.lit("count_"), counted)).when(averages, F.concat(F.lit("avg_"), number)) \
        .when(sums, F.concat(F.lit("total_"), number))
    groupby = F.when(pattern == "count", counted).when(aggregated, group)
    default = F.when(ranks, 5).when((pattern == "count") | (aggregated & group.isNotNull()), 20).when(pattern == "show", 100).otherwise(10)
    limit = F.when(aggregated & group.isNull(), 1).otherwise(
        F.least(F.coalesce(F.nullif(F.col("asked"), F.lit(0).cast("bigint")), default.cast("bigint")), F.lit(MAX_ROWS).cast("bigint")))
    plain = ranks | pattern.isin("show", "default")
    shown = F.when((pattern == "show") & (F.size(mentioned) > 0), F.slice(mentioned, 1, 5)).when(plain, _strings(names[:5]))
    return read.withColumn("query", F.struct(
        shown.alias("columns"), groupby.alias("groupby"),
        F.when(pattern == "count", counted).when(aggregated, number).alias("agg_column"),
        F.when(pattern == "count", "count").when(averages, "mean").when(sums, "sum").alias("agg_function"), alias.alias("agg_alias"),
        F.when(ranks, ranked_by).when(groupby.isNotNull(), alias).otherwise(none).alias("sort_column"),
        F.when(ranks, pattern == "top").when(groupby.isNotNull(), True).alias("descending"), limit.cast("int").alias("limit")))


def to_spec(query) -> dict:
    """One routed query (a Row) as a query spec."""
    spec = {"limit": query["limit"]}
    if query["agg_column"] is not None:
        spec["aggregations"] = [{"column": query["agg_column"], "function": query["agg_function"], "alias": query["agg_alias"]}]
        spec["groupby"] = [query["groupby"]] if query["groupby"] is not None else []
    else:
        spec["select"] = list(query["columns"])
    if query["sort_column"] is not None:
        spec["sort"] = [{"column": query["sort_column"], "descending": query["descending"]}]
    return spec


def column_classes(df: DataFrame) -> list[tuple[str, str]]:
    return [(f.name, column_class(f.dataType)) for f in df.schema.fields]


def overview(df: DataFrame) -> DataFrame:
    """One row: total_rows, the overview text and the tips text about a table."""
    columns = column_classes(df)
    of = {k: [n for n, kind in columns if kind == k] for k in ("categorical", "numeric", "datetime")}
    missing = per_column(df, df.columns, lambda c: [ref(c).isNull().alias("missing")],
                         [F.count(F.lit(1)).alias("n"), F.count_if("missing").alias("gaps")])
    gaps = missing.withColumn("share", percent("gaps", "n")).agg(
        F.max("n").alias("total_rows"), F.array_sort(F.collect_list(F.when(F.col("share") > 5, F.struct("column", "share")))).alias("gaps"))
    tips = F.array_join(F.transform("gaps", lambda g: F.format_string("• **%s**: %.1f%% of the rows are empty; fill or drop it.", g["column"], g["share"])), "\n")
    names = [f"{label}: {', '.join(of[kind][:k])}." for kind, label, k in
             (("categorical", "Categorical columns", 5), ("numeric", "Numeric columns", 5), ("datetime", "Date/time columns", 3)) if of[kind]]
    text = [F.format_string("The table has **%d rows** and **%d columns**.", "total_rows", F.lit(len(columns))), *[F.lit(n) for n in names]]
    rows = gaps
    if of["numeric"]:
        c = ref(of["numeric"][0]).cast("double")
        rows = gaps.withColumn("s", df.agg(F.struct(F.min(c).alias("lo"), F.max(c).alias("hi"), F.avg(c).alias("mean")).alias("s")).scalar())
        text.append(F.format_string(f"**{of['numeric'][0].replace('%', '%%')}** lies between %s and %s, on average %.2f.", "s.lo", "s.hi", "s.mean"))
    return rows.select("total_rows", F.concat_ws("\n\n", *text).alias("overview"),
                       F.concat(F.lit("**What to do:**\n"), F.when(F.size("gaps") == 0, ALL_WELL).otherwise(tips)).alias("tips"))


def answer_conversation(questions: DataFrame, df: DataFrame) -> DataFrame:
    """``text_response`` of conversational questions about ``df``; the fixed reply for data queries."""
    known = overview(df).select(F.struct("overview", "tips").alias("o")).scalar()
    closing = F.when(contains_any(F.lower("question"), ADVICE_WORDS), known["tips"]).otherwise(EXAMPLES)
    text = F.concat_ws("\n\n", known["overview"], closing)
    return with_intent(questions).withColumn("text_response", F.when(F.col("intent") == "conversational", text).otherwise(FOUND))


def ask(df: DataFrame, question: str) -> dict:
    """Answer one question: intent, reply, and for data queries the spec, rows and chart type."""
    started = time.time()
    one = df.sparkSession.range(1).select(F.lit(question).alias("question"))
    routed = route(one, column_classes(df)).first()
    answer = {"question": question, "intent": routed["intent"], "text_response": None, "spec": None, "result": None, "chart": None, "error": None}
    if routed["intent"] == "conversational":
        answer["text_response"] = answer_conversation(one, df).first()["text_response"]
    else:
        answer.update(text_response=FOUND, spec=to_spec(routed["query"]))
        try:
            answer["result"] = durable(run(df, answer["spec"]))  # 200 rows at most, read by the chart rule, the caller and the history
            answer["chart"] = suggest_for_result(answer["result"])
        except Exception as error:
            answer["error"] = str(error)
    answer["seconds"] = time.time() - started
    return answer


def history_row(answer: dict, spark, user_id: str, dataset_id: str) -> DataFrame:
    """The answered question as one history row, with the first rows of its result as JSON."""
    text = lambda v: F.lit(v).cast("string")
    preview = F.lit(None).cast("string")
    if answer["result"] is not None:
        rows = answer["result"].limit(PREVIEW_ROWS).select(F.struct("*").alias("r"))
        preview = rows.agg(F.to_json(F.collect_list("r"))).scalar()
    return spark.range(1).select(
        text(user_id).alias("user_id"), text(dataset_id).alias("dataset_id"), text(answer["question"]).alias("query_text"),
        text(json.dumps(answer["spec"]) if answer["spec"] else None).alias("generated_query"), preview.alias("result_preview"),
        F.lit(answer["seconds"] * 1000.0).alias("execution_ms"), F.lit(answer["error"] is None).alias("was_successful"),
        text(answer["error"]).alias("error_message"), F.current_timestamp().alias("timestamp"))


def append_history(row: DataFrame, path: str) -> None:
    """Add history rows to the stored history."""
    row.write.mode("append").parquet(path)
