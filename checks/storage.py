import math
import re

import pyarrow as pa
from pyspark.sql import functions as F, types as T

from checks.charts import DIVERSE_SQL, POINTS_SQL
from checks.profile import columns_sql, r, topk_sql
from checks.registry import query
from tabscout.operators.analysis import analyze, report
from tabscout.plans.durable import scratch_path
from tabscout.sources import files as f
from tabscout.sources.records import few_rows


@query("src_csv", "SELECT CAST(c_custkey AS INTEGER) AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def src_csv(t):
    path = scratch_path(t.spark, "customer-csv")
    t.customer.write.option("header", True).csv(path)
    return f.read_csv(t.spark, path)


def _bytewise(encoding: str, back: bool):
    """Texts in a one-byte set, as ISO-8859-1 writes its bytes: a backslash doubled, what the set cannot hold as \\xXX, \\uXXXX or \\UXXXXXXXX; ``back`` reads them again."""
    escape = lambda t: t.replace("\\", "\\\\").encode(encoding, "backslashreplace").decode("latin-1")
    known = re.compile(r"\\(?:\\|x([0-9a-f]{2})|u([0-9a-f]{4})|U([0-9a-f]{8}))")
    plain = lambda t: known.sub(lambda m: chr(int(m[1] or m[2] or m[3], 16)) if m.lastindex else "\\", t)

    def run(batches):
        for b in few_rows(batches):
            texts = [None if t is None else (plain if back else escape)(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["doc_id", "source", "text"])

    return run


@query("src_csv_encodings", """
SELECT enc, doc_id, source, text FROM documents, (VALUES ('utf8'), ('bom'), ('latin'), ('windows')) e(enc)""")
def src_csv_encodings(t):
    """Every document with its whole text, in many files of each encoding, each with its own header and mark."""
    rows, schema, out = t.documents.select("doc_id", "source", "text"), "doc_id bigint, source string, text string", None
    each = math.ceil(max(rows.count(), 1) / int(t.spark.conf.get("spark.sql.shuffle.partitions")))  # of a file: many files, but no shuffle of whole texts
    for name, encoding, mark in (("utf8", "UTF-8", ""), ("bom", "UTF-8", "\ufeff"), ("latin", "latin-1", ""), ("windows", "cp1252", "")):
        path, bytewise = scratch_path(t.spark, name), encoding != "UTF-8"
        body = rows.mapInArrow(_bytewise(encoding, False), schema) if bytewise else rows
        (body.withColumnRenamed("doc_id", mark + "doc_id").write.option("maxRecordsPerFile", each).option("header", True).option("escape", '"')
         .option("encoding", "ISO-8859-1" if bytewise else encoding).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
        # Four times the whole texts unpacked would take several times the table's disk.
        found = f.read_csv(t.spark, path, T._parse_datatype_string(schema), line_breaks=True, consume=True)
        found = found.mapInArrow(_bytewise(encoding, True), schema) if bytewise else found
        found = found.select(F.lit(name).alias("enc"), *[F.col(c) for c in ("doc_id", "source", "text")])
        out = found if out is None else out.unionByName(found)
    return out


@query("src_file", """
SELECT 'csv' AS source, CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation
UNION ALL SELECT 'json', n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 'parquet', n_nationkey, n_name, n_regionkey FROM nation""")
def src_file(t):
    base, out = scratch_path(t.spark, "nation"), None
    t.nation.write.option("header", True).csv(base + ".csv")
    t.nation.write.json(base + ".json")
    t.nation.write.parquet(base + ".parquet")
    for kind in ("csv", "json", "parquet"):
        part = f.read_file(t.spark, f"{base}.{kind}").select(F.lit(kind).alias("source"), F.col("n_nationkey").cast("bigint").alias("n_nationkey"), "n_name",
                                                              F.col("n_regionkey").cast("bigint").alias("n_regionkey"))
        out = part if out is None else out.unionByName(part)
    return out


@query("src_records", """
SELECT o_custkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderkey, o_orderpriority, o_orderstatus, o_totalprice FROM orders""")
def src_records(t):
    path = scratch_path(t.spark, "orders-records")
    f.write_records(t.orders, path)
    return f.read_records(t.spark, path, lines=True)


def _arrays(batches):
    """The lines of a task as one JSON array."""
    sign = "["
    for b in few_rows(batches):
        yield pa.RecordBatch.from_arrays([pa.array([("[" if i == 0 and sign == "[" else ",") + line for i, line in enumerate(b.column(0).to_pylist())], pa.string())], names=["value"])
        sign = ","
    yield pa.RecordBatch.from_arrays([pa.array(["[]" if sign == "[" else "]"], pa.string())], names=["value"])


@query("src_records_array", "SELECT doc_id, source, text FROM documents")
def src_records_array(t):
    """Every document with its whole text, from JSON arrays that split over tasks."""
    path = scratch_path(t.spark, "documents-array")
    lines = t.documents.select(F.to_json(F.struct("doc_id", "source", "text")).alias("value"))
    lines.repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(_arrays, "value string").write.text(path)
    return f.read_records(t.spark, path, schema=T._parse_datatype_string("doc_id bigint, source string, text string"))


@query("sink_dataset", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def sink_dataset(t):
    root = scratch_path(t.spark, "datasets")
    f.save_dataset(t.orders.where("o_orderkey < 0"), root, "orders / 1")
    f.save_dataset(t.orders, root, "orders / 1")
    return f.load_dataset(t.spark, root, "orders / 1")


@query("src_dataset", "SELECT 'customer' AS name, count(*) AS rows FROM customer UNION ALL SELECT 'part', count(*) FROM part")
def src_dataset(t):
    root = scratch_path(t.spark, "datasets")
    f.save_dataset(t.customer, root, "customer")
    f.save_dataset(t.part, root, "part")
    parts = [f.load_dataset(t.spark, root, n).agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows") for n in ("customer", "part")]
    return parts[0].unionByName(parts[1])


@query("sink_head", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 500")
def sink_head(t):
    return f.head(t.orders, "o_orderkey")


@query("preview", "SELECT * FROM customer ORDER BY c_custkey LIMIT 10")
def preview(t):
    return f.preview(t.customer, "c_custkey")


@query("san_ts", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, value FROM events")
def san_ts(t):
    return f.timestamps_as_text(t.events).select("event_id", "ts", "value")


@query("san_null", "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN value END AS value FROM events")
def san_null(t):
    odd = F.expr("""case event_id % 4 when 0 then double('NaN') when 1 then double('Infinity') when 2 then double('-Infinity') else value end""")
    return f.sanitize(t.events.withColumn("value", odd)).select("event_id", "value")


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations")
WIDTH = {"region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11, "events": 6, "documents": 5, "pages": 3, "labels": 3, "conversations": 4}
LIMIT_SQL = "\nUNION ALL\n".join(f"""SELECT '{n}' AS table_name, rule, amount, bound FROM (SELECT 'file type' AS rule, NULL::BIGINT AS amount, NULL::BIGINT AS bound WHERE {str(n == 'pages').lower()}
UNION ALL SELECT 'too few rows', count(*), 10 FROM {n} HAVING count(*) < 10 UNION ALL SELECT 'too many rows', count(*), 1000 FROM {n} HAVING count(*) > 1000
UNION ALL SELECT 'too many columns', {WIDTH[n]}, 10 WHERE {WIDTH[n]} > 10)""" for n in TABLES)


@query("validate_limits", LIMIT_SQL)
def validate_limits(t):
    out = None
    for n in TABLES:
        found = f.validate(getattr(t, n), f"{n}.parquet" if n == "pages" else f"{n}.csv", min_rows=10, max_rows=1000, max_columns=10) \
            .select(F.lit(n).alias("table_name"), "rule", "amount", "bound")
        out = found if out is None else out.unionByName(found)
    return out


@query("upload_cols", f"""
WITH c AS ({columns_sql('part')}), s AS (SELECT "column" AS name, string_agg(value, ',' ORDER BY rank) AS samples FROM ({topk_sql('part')}) GROUP BY 1),
n AS (SELECT 'p_partkey' AS name, min(p_partkey)::DOUBLE AS min, max(p_partkey)::DOUBLE AS max, avg(p_partkey) AS mean FROM part
UNION ALL SELECT 'p_size', min(p_size), max(p_size), avg(p_size) FROM part UNION ALL SELECT 'p_retailprice', min(p_retailprice), max(p_retailprice), avg(p_retailprice) FROM part)
SELECT ord, c.name, dtype, CASE WHEN column_type = 'numeric' THEN 'numeric' ELSE 'categorical' END AS type, unique_count, missing_count, round(missing_percentage, 4) AS missing_percentage,
min, max, round(mean, 4) AS mean, samples FROM c LEFT JOIN s ON s.name = c.name LEFT JOIN n ON n.name = c.name""")
def upload_cols(t):
    out = f.describe_columns(t.part)
    return r(out, "missing_percentage", "mean").withColumn("samples", F.array_join("sample_values", ",")).drop("sample_values")


@query("report_bundle", f"""{DIVERSE_SQL}, {POINTS_SQL.format(table='customer')},
h AS (SELECT strftime(ts, '%Y-%m-%d %H:%M') || ' ' || props AS said, row_number() OVER (ORDER BY ts DESC, props) AS o FROM events)
SELECT 'history' AS section, CAST(o AS INTEGER) AS ord, 1::BIGINT AS rows, said FROM h WHERE o <= 10
UNION ALL SELECT 'chart_data', rank, points, NULL FROM points UNION ALL SELECT 'chart', rank, 1, title FROM ranked WHERE dataset_id = 'customer' AND rank <= 7
UNION ALL SELECT 'insight', CAST(unnest(range(1, 6)) AS INTEGER), 1, NULL UNION ALL SELECT 'dataset', 1, 1, (SELECT count(*) FROM customer)::VARCHAR""")
def report_bundle(t):
    """Places of every section, titles of the charts, the last ten questions and the number of rows."""
    history = t.events.select("ts", F.col("props").alias("query_text"))
    out = report(analyze(t.customer, "customer", key="c_custkey"), "customer", history)
    field = lambda name: F.get_json_object("payload", f"$.{name}")
    said = (F.when(F.col("section") == "history", F.concat_ws(" ", field("created_at"), field("query_text")))
            .when(F.col("section") == "chart", field("title")).when(F.col("section") == "dataset", field("total_rows")))
    return out.groupBy("section", F.col("ord").cast("int").alias("ord")).agg(F.count("*").alias("rows"), F.max(said).alias("said"))
