from pyspark.sql import functions as F

from checks.profile import COLUMNS
from checks.registry import query
from tabscout.operators import questions as nl

TEMPLATES = ["top 7 by l_extendedprice", "Average l_discount by l_returnflag", "count by l_linestatus", "lowest l_tax", "total l_quantity", "list 30 l_orderkey l_shipdate",
             "how many lines per l_shipmode", "mean of l_tax", "Show the l_returnflag", "best", "sum l_extendedprice by l_linestatus", "describe it", "plain words",
             "clean and improve", "bottom 250 l_quantity", "first 0 rows"]
LIST = "[" + ", ".join("'" + s + "'" for s in TEMPLATES) + "]"
ASKED = f"(SELECT conv_id, turn, ({LIST})[(conv_id + turn) % {len(TEMPLATES)} + 1] || ' ' || text AS question FROM conversations)"
SCHEMA = [(n, k) for n, _, k in COLUMNS["lineitem"]]
NUM = [n for n, k in SCHEMA if k == "numeric"]
CAT = [n for n, k in SCHEMA if k == "categorical"]


def asked(t):
    choice = F.element_at(F.array(*[F.lit(s) for s in TEMPLATES]), ((F.col("conv_id") + F.col("turn")) % len(TEMPLATES) + 1).cast("int"))
    return t.conversations.select("conv_id", "turn", F.concat(choice, F.lit(" "), "text").alias("question"))


def lists(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


CONV = " OR ".join(f"contains(lower(question), '{w}')" for w in nl.TRIGGERS)
INTENT = f"CASE WHEN {CONV} THEN 'conversational' ELSE 'data_query' END"
BY_LENGTH = sorted([n for n, _ in SCHEMA], key=len, reverse=True)
MENTIONED = f"list_filter({lists(BY_LENGTH)}, lambda c: contains(lower(question), c))"
ASKED_N = r"TRY_CAST(nullif(regexp_extract(lower(question), '(?:top|first|last|bottom|show|list)\s+(\d+)', 1), '') AS BIGINT)"
L, R, MID = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])", r"([^\p{L}\p{N}_\n][^\n]*)?[^\p{L}\p{N}_\n]"


def words(*ws):
    return " OR ".join(f"regexp_matches(lower(question), '{L}{w}{R}')" for w in ws)


COUNT = " OR ".join(f"regexp_matches(lower(question), '{L}{a}{MID}{b}{R}')" for a, b in (("count", "by"), ("how many", "per"), ("how many", "by"), ("count", "per"), ("count", "each")))
PATTERN = f"""CASE WHEN {words('top', 'highest', 'best', 'largest', 'most')} THEN 'top' WHEN {words('bottom', 'lowest', 'worst', 'smallest', 'least')} THEN 'bottom'
WHEN {COUNT} THEN 'count' WHEN {words('average', 'mean')} THEN 'mean' WHEN {words('sum', 'total')} THEN 'sum' WHEN {words('show', 'list', 'display', 'give', 'get')} THEN 'show' ELSE 'default' END"""


@query("nl_intent", f"SELECT conv_id, turn, {INTENT} AS intent FROM {ASKED}")
def nl_intent(t):
    return nl.with_intent(asked(t)).drop("question")


@query("nl_columns", f"SELECT conv_id, turn, array_to_string({MENTIONED}, ',') AS mentioned FROM {ASKED}")
def nl_columns(t):
    return nl.with_mentions(asked(t), [n for n, _ in SCHEMA]).select("conv_id", "turn", F.array_join("mentioned", ",").alias("mentioned"))


@query("nl_limit", f"SELECT conv_id, turn, {ASKED_N} AS asked FROM {ASKED}")
def nl_limit(t):
    return nl.with_limit(asked(t)).drop("question")


@query("nl_pattern", f"SELECT conv_id, turn, {PATTERN} AS pattern FROM {ASKED}")
def nl_pattern(t):
    return nl.with_pattern(asked(t)).drop("question")


DSL = f"""
WITH p AS (SELECT conv_id, turn, {INTENT} AS intent, {MENTIONED} AS m, {ASKED_N} AS asked, {PATTERN} AS pattern FROM {ASKED}),
g AS (SELECT *, coalesce(list_filter(m, lambda c: list_contains({lists(NUM)}, c))[1], '{NUM[0]}') AS num, list_filter(m, lambda c: list_contains({lists(CAT)}, c))[1] AS grp,
coalesce(m[1], '{CAT[0]}') AS cnt, CASE WHEN list_contains({lists(NUM)}, m[1]) THEN m[1] ELSE '{NUM[0]}' END AS ranked FROM p),
a AS (SELECT *, CASE pattern WHEN 'count' THEN 'count_' || cnt WHEN 'mean' THEN 'avg_' || num WHEN 'sum' THEN 'total_' || num END AS agg_alias,
CASE WHEN pattern = 'count' THEN cnt WHEN pattern IN ('mean', 'sum') THEN grp END AS groupby FROM g)
SELECT conv_id, turn, intent, pattern,
CASE WHEN pattern = 'show' AND len(m) > 0 THEN array_to_string(m[1:5], ',') WHEN pattern IN ('top', 'bottom', 'show', 'default') THEN '{",".join(n for n, _ in SCHEMA[:5])}' END AS columns,
groupby, CASE WHEN pattern = 'count' THEN cnt WHEN pattern IN ('mean', 'sum') THEN num END AS agg_column, CASE WHEN pattern IN ('count', 'mean', 'sum') THEN pattern END AS agg_function, agg_alias,
CASE WHEN pattern IN ('top', 'bottom') THEN ranked WHEN groupby IS NOT NULL THEN agg_alias END AS sort_column,
CASE WHEN pattern IN ('top', 'bottom') THEN pattern = 'top' WHEN groupby IS NOT NULL THEN true END AS descending,
CAST(CASE WHEN pattern IN ('mean', 'sum') AND grp IS NULL THEN 1 ELSE least(200, coalesce(nullif(asked, 0),
CASE WHEN pattern IN ('top', 'bottom') THEN 5 WHEN pattern IN ('count', 'mean', 'sum') THEN 20 WHEN pattern = 'show' THEN 100 ELSE 10 END)) END AS INTEGER) AS limit_rows FROM a"""


@query("nl_dsl", DSL)
def nl_dsl(t):
    q = F.col("query")
    return nl.route(asked(t), SCHEMA).select("conv_id", "turn", "intent", "pattern", F.array_join(q["columns"], ",").alias("columns"),
                                             *[q[c].alias(c) for c in ("groupby", "agg_column", "agg_function", "agg_alias", "sort_column", "descending")],
                                             q["limit"].alias("limit_rows"))


ADVICE = " OR ".join(f"contains(lower(question), '{w}')" for w in nl.ADVICE_WORDS)


@query("nl_summary", f"""
WITH o AS (SELECT 'The table has **' || count(*) || ' rows** and **5 columns**.' || E'\\n\\nCategorical columns: c_name, c_mktsegment.\\n\\nNumeric columns: c_custkey, c_nationkey, c_acctbal.\\n\\n'
|| '**c_custkey** lies between ' || min(c_custkey)::DOUBLE || ' and ' || max(c_custkey)::DOUBLE || ', on average ' || printf('%.2f', avg(c_custkey)) || '.' AS known FROM customer)
SELECT conv_id, turn, {INTENT} AS intent, CASE WHEN {CONV} THEN known || E'\\n\\n' || CASE WHEN {ADVICE} THEN E'**What to do:**\\n{nl.ALL_WELL}' ELSE '{nl.EXAMPLES}' END ELSE '{nl.FOUND}' END AS text_response FROM {ASKED}, o""")
def nl_summary(t):
    return nl.answer_conversation(asked(t), t.customer).select("conv_id", "turn", "intent", "text_response")


@query("ask", """
SELECT l_returnflag, round(avg(l_extendedprice), 4) AS avg_l_extendedprice FROM lineitem GROUP BY 1 ORDER BY avg(l_extendedprice) DESC LIMIT 20""")
def ask(t):
    return nl.ask(t.lineitem, "Average l_extendedprice by l_returnflag?")["result"].withColumn("avg_l_extendedprice", F.round("avg_l_extendedprice", 4))


@query("ask_history", """
SELECT 'u1' AS user_id, 'lineitem' AS dataset_id, 'count by l_linestatus' AS query_text, true AS was_successful, CAST(NULL AS VARCHAR) AS error_message,
'[' || string_agg('{"l_linestatus":"' || l_linestatus || '","count_l_linestatus":' || n || '}', ',' ORDER BY n DESC, l_linestatus) || ']' AS result_preview
FROM (SELECT l_linestatus, count(*) AS n FROM lineitem GROUP BY 1)""")
def ask_history(t):
    answer = nl.ask(t.lineitem, "count by l_linestatus")
    return nl.history_row(answer, t.spark, "u1", "lineitem").select("user_id", "dataset_id", "query_text", "was_successful", "error_message", "result_preview")
