"""The scalar functions the operators are written with, each group over a whole table."""

from pyspark.sql import functions as F

from checks.profile import r
from checks.registry import query
from tabscout.functions.text import commas, contains_any, like


@query("fn_string", """
SELECT p_partkey, lower(p_brand) AS lowered, contains(lower(p_name), 'ring') OR contains(lower(p_name), 'bolt') AS has, p_name LIKE '%e\\_%' AS liked,
substring(p_name, 1, 5) AS cut, p_brand || ' / ' || p_type AS joined, replace(p_name, ' ', '_') AS replaced,
upper(substring(p_type, 1, 1)) || lower(substring(p_type, 2)) AS titled, format('{:,}', p_partkey * 1234) AS grouped FROM part""".replace("\\\\", "\\"))
def fn_string(t):
    return t.part.select("p_partkey", F.lower("p_brand").alias("lowered"), contains_any(F.lower("p_name"), ["ring", "bolt"]).alias("has"),
                         like(F.col("p_name"), "%e\\_%").alias("liked"), F.substring("p_name", 1, 5).alias("cut"),
                         F.concat_ws(" / ", "p_brand", "p_type").alias("joined"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("replaced"),
                         F.initcap("p_type").alias("titled"), commas(F.col("p_partkey") * 1234).alias("grouped"))


@query("fn_regex", r"""
SELECT page_id, regexp_matches(url, '(?i)^HTTPS://') AS secure, regexp_extract(url, '/([a-z]{2})/(\d+)', 1) AS lang, regexp_extract(url, '/([a-z]{2})/(\d+)', 2) AS number FROM pages""")
def fn_regex(t):
    pattern = r"/([a-z]{2})/(\d+)"
    return t.pages.select("page_id", F.col("url").rlike("(?i)^HTTPS://").alias("secure"), F.regexp_extract("url", pattern, 1).alias("lang"),
                          F.regexp_extract("url", pattern, 2).alias("number"))


@query("fn_date", """
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS text, TRY_CAST(strftime(ts, '%Y-%m-%d') AS DATE) AS day, TRY_CAST(event_type AS DATE) AS bad_day,
CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS seconds, date_sub('day', ts, TIMESTAMP '2024-02-01') AS days FROM events""")
def fn_date(t):
    ts = F.col("ts")
    return t.events.select("event_id", F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("text"),
                           F.try_to_timestamp(F.date_format(ts, "yyyy-MM-dd")).cast("date").alias("day"),
                           F.try_to_timestamp("event_type").cast("date").alias("bad_day"), F.unix_timestamp(ts.cast("timestamp")).alias("seconds"),
                           F.timestamp_diff("DAY", ts, F.expr("timestamp_ntz'2024-02-01'")).alias("days"))


@query("fn_math", """
SELECT c_custkey, abs(c_acctbal) AS size, round(sqrt(abs(c_acctbal)), 6) AS root, round(c_acctbal * c_acctbal, 2) AS square, round(ln(1 + abs(c_acctbal)), 6) AS log,
least(c_acctbal, 100.0::DOUBLE) AS low, greatest(c_acctbal, 100.0::DOUBLE) AS high, round(c_acctbal, 0) AS whole, round(c_acctbal / nullif(c_nationkey, 0), 6) AS ratio,
((c_custkey - 700) % 7 + 7) % 7 AS rest FROM customer""")
def fn_math(t):
    c = F.col("c_acctbal")
    out = t.customer.select("c_custkey", F.abs(c).alias("size"), F.sqrt(F.abs(c)).alias("root"), F.round(F.pow(c, F.lit(2)), 2).alias("square"), F.log1p(F.abs(c)).alias("log"),
                            F.least(c, F.lit(100.0)).alias("low"), F.greatest(c, F.lit(100.0)).alias("high"), F.round(c, 0).alias("whole"),
                            F.try_divide(c, F.col("c_nationkey")).alias("ratio"), F.pmod(F.col("c_custkey") - 700, F.lit(7)).alias("rest"))
    return r(out, "root", "log", "ratio", digits=6)


@query("fn_null", """
SELECT event_id, nullif(event_type, 'view') IS NULL AS missing, coalesce(nullif(event_type, 'view'), 'none') AS filled, CASE WHEN value BETWEEN 0 AND 1 THEN value END AS bounded FROM events""")
def fn_null(t):
    kind = F.nullif("event_type", F.lit("view"))
    return t.events.select("event_id", kind.isNull().alias("missing"), F.coalesce(kind, F.lit("none")).alias("filled"),
                           F.when(F.col("value").between(0, 1), F.col("value")).alias("bounded"))


@query("fn_json", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{"id":' || event_id || ',"kind":"' || event_type || '"}' AS object FROM events""")
def fn_json(t):
    return t.events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))).alias("object"))


@query("fn_array", """
WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents)
SELECT doc_id, CAST(len(w) AS INTEGER) AS words, array_to_string(w[1:3], ' ') AS first_words, list_contains(w, 'the') AS has_the FROM w""")
def fn_array(t):
    words = F.split("text", " ")
    return t.documents.select("doc_id", F.size(words).alias("words"), F.array_join(F.slice(words, 1, 3), " ").alias("first_words"), F.array_contains(words, "the").alias("has_the"))
