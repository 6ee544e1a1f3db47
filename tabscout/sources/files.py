"""Reading tables from files, cleaning them, and storing them by dataset."""

from __future__ import annotations

import csv
import io
from collections.abc import Sequence
from functools import reduce
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tabscout.functions.text import ref
from tabscout.operators.profile import Profile, clean, number_cell, per_column, top_values
from tabscout.plans.durable import scratch_path
from tabscout.sources.records import split_records

SUFFIXES = (".csv", ".xlsx")
HEAD_ROWS = 500
PREVIEW_ROWS = 10
SAMPLE_VALUES = 5


#: Where windows-1252 has other characters than ISO-8859-1, and the bytes that it leaves undefined.
_OTHER = {chr(b): bytes([b]).decode("cp1252", "ignore") for b in range(0x80, 0xA0)}
CONTROLS, CHARACTERS = "".join(k for k, v in _OTHER.items() if v), "".join(_OTHER.values())
UNDEFINED = [k.encode("latin-1") for k, v in _OTHER.items() if not v]


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, encoding: str | None = None, line_breaks: bool = False,
             consume: bool = False) -> DataFrame:
    """A CSV file, or a folder of them, with a header each.

    Without ``encoding``, it is UTF-8 (with or without a mark) if all bytes are, else
    windows-1252 if no byte is undefined in it, else ISO-8859-1.

    ``line_breaks``: quoted cells may hold line breaks, and a quote in them is doubled. Files
    split over tasks then too, and the scan that finds where records begin also finds the encoding.
    The files have then been read when this returns, and with ``consume`` they are deleted meanwhile.

    Rows that do not fit the schema raise when read. Give ``schema`` for large files:
    inferring it costs a pass over the data.
    """
    reader = spark.read.option("header", True).option("mode", "FAILFAST")
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    if line_breaks:
        return _split_csv(spark, path, schema, encoding, consume)
    if consume:
        raise ValueError("files that are read later cannot be deleted")
    if encoding is None:
        encoding = _encoding(spark, path)
    windows = encoding.lower() in ("cp1252", "windows-1252")
    # Spark's reader knows ISO-8859-1, whose control characters stand for the other 27.
    df = reader.option("encoding", "ISO-8859-1" if windows else encoding).csv(path)
    if not df.columns:
        raise ValueError("CSV file is empty")
    if windows:
        names = str.maketrans(CONTROLS, CHARACTERS)
        df = df.select(*[(F.translate(ref(f.name), CONTROLS, CHARACTERS) if isinstance(f.dataType, T.StringType) else ref(f.name)).alias(f.name.translate(names))
                         for f in df.schema.fields])
    return df


#: Types of a CSV column, the first that all its values fit; else text.
CSV_TYPES = ("int", "bigint", "double", "date", "timestamp", "boolean")


def _split_csv(spark: SparkSession, path: str, schema: T.StructType | None, encoding: str | None, consume: bool = False) -> DataFrame:
    records = split_records(spark, path, "csv", encoding, consume)
    options = {"mode": "FAILFAST", "escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"}
    parse = lambda fields: records.where("not first").select(F.from_csv("text", _ddl(fields), options).alias("r")).select("r.*")
    if schema:
        return parse([(f.name, f.dataType.simpleString()) for f in schema.fields])
    head = records.where("first").select(F.min("text")).first()[0]
    if head is None:
        raise ValueError("CSV file is empty")
    names = next(csv.reader(io.StringIO(head, newline="")))
    texts = parse([(n, "string") for n in names])
    fits = texts.agg(*[F.coalesce(F.bool_and(ref(n).try_cast(t).isNotNull() | ref(n).isNull()) & (F.count(ref(n)) > 0), F.lit(False)) for n in names for t in CSV_TYPES]).first()
    found = [next((t for j, t in enumerate(CSV_TYPES) if fits[i * len(CSV_TYPES) + j]), "string") for i in range(len(names))]
    return parse(list(zip(names, found)))


def _ddl(fields) -> str:
    return ", ".join("`{}` {}".format(n.replace("`", "``"), t) for n, t in fields)


def _encoding(spark: SparkSession, path: str) -> str:
    # The reader would replace bytes that are not UTF-8 without an error.
    lines = spark.read.text(path)
    if lines.where(~F.is_valid_utf8("value")).limit(1).isEmpty():
        return "UTF-8"
    odd = [F.contains(F.col("value").cast("binary"), F.lit(b)) for b in UNDEFINED]
    return "windows-1252" if lines.where(reduce(lambda x, y: x | y, odd)).limit(1).isEmpty() else "ISO-8859-1"


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """Scan by suffix: .json, .parquet, anything else as CSV."""
    if path.endswith(".json"):
        return spark.read.json(path)
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def read_records(spark: SparkSession, path: str | None, lines: bool = False, schema: T.StructType | None = None) -> DataFrame:
    """Records stored as one JSON array, or one record per line (``lines``); both split across tasks.

    An element of an array that is no object raises, as does a broken one.
    """
    if path is None:
        return spark.createDataFrame([], schema or T.StructType([]))
    if not lines:  # a raw line break never lies in a JSON string
        path, array = scratch_path(spark, "records"), path
        split_records(spark, array, "json", "utf-8").select(F.translate("text", "\r\n", "  ").alias("value")).write.text(path)
    reader = spark.read if lines else spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def timestamps_as_text(df: DataFrame) -> DataFrame:
    """Date and time columns as ``yyyy-MM-dd HH:mm:ss``."""
    kinds = (T.TimestampType, T.TimestampNTZType, T.DateType)
    times = [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]
    return df.withColumns({c: F.date_format(ref(c), "yyyy-MM-dd HH:mm:ss") for c in times}) if times else df


def sanitize(df: DataFrame) -> DataFrame:
    """The stored form: times as text; NaN and infinities as null."""
    return clean(timestamps_as_text(df))


def dataset_path(root: str, dataset_id: str) -> str:
    return f"{root.rstrip('/')}/dataset_id={quote(dataset_id, safe='')}"


def save_dataset(df: DataFrame, root: str, dataset_id: str) -> None:
    """Store a dataset, replacing an earlier one with the same id. Each has its own schema."""
    df.write.mode("overwrite").parquet(dataset_path(root, dataset_id))


def load_dataset(spark: SparkSession, root: str, dataset_id: str) -> DataFrame:
    try:
        df = spark.read.parquet(dataset_path(root, dataset_id))
    except AnalysisException as error:
        raise LookupError(f"dataset {dataset_id!r} not found") from error
    if df.isEmpty():
        raise ValueError(f"dataset {dataset_id!r} holds no rows")
    return df


def write_records(df: DataFrame, path: str) -> None:
    """One JSON record per line, times as text."""
    sanitize(df).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def head(df: DataFrame, key: str, rows: int = HEAD_ROWS) -> DataFrame:
    """The first rows in key order, as stored for display."""
    return clean(df).orderBy(ref(key)).limit(rows)


def preview(df: DataFrame, key: str) -> DataFrame:
    return head(df, key, PREVIEW_ROWS)


def validate(df: DataFrame, name: str | None = None, size_bytes: int | None = None, *, suffixes: Sequence[str] = SUFFIXES,
             max_bytes: int | None = None, max_rows: int | None = None, max_columns: int | None = None,
             min_rows: int = 1, min_columns: int = 1) -> DataFrame:
    """(rule, amount, bound) for each limit the table breaks. Bounds are off unless given."""
    wide = df.agg(F.count(F.lit(1)).alias("rows"))
    broken = []

    def rule(name_, amount, bound, condition):
        broken.append(F.when(condition, F.struct(F.lit(name_).alias("rule"), amount.cast("bigint").alias("amount"), F.lit(bound).cast("bigint").alias("bound"))))
    columns = F.lit(len(df.columns))
    if name is not None and suffixes:
        rule("file type", F.lit(None), None, F.lit(not name.lower().endswith(tuple(suffixes))))
    if max_bytes is not None and size_bytes is not None:
        rule("file size", F.lit(size_bytes), max_bytes, F.lit(size_bytes > max_bytes))
    rule("too few columns", columns, min_columns, columns < min_columns)
    rule("too few rows", F.col("rows"), min_rows, F.col("rows") < min_rows)
    if max_rows is not None:
        rule("too many rows", F.col("rows"), max_rows, F.col("rows") > max_rows)
    if max_columns is not None:
        rule("too many columns", columns, max_columns, columns > max_columns)
    return wide.select(F.inline(F.array_compact(F.array(*broken))))


def describe_columns(df: DataFrame) -> DataFrame:
    """Per column: type, distinct and missing values; range and mean, or five sample values.

    Samples are the most frequent values, ties in order of the value.
    """
    profile = Profile(df)
    base = profile.columns.select("ord", "name", "dtype", F.when(F.col("column_type") == "numeric", "numeric").otherwise("categorical").alias("type"),
                                  "unique_count", "missing_count", "missing_percentage")
    others = [c for c in profile.names if c not in profile.numeric]
    out = base.withColumns({c: F.lit(None).cast("double") for c in ("min", "max", "mean")})
    if profile.numeric:
        spans = per_column(profile.df, profile.numeric, number_cell, [
            F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean")]).withColumnRenamed("column", "name")
        out = base.join(spans, "name", "left")
    samples = top_values(profile.df, others, SAMPLE_VALUES).groupBy(F.col("column").alias("name")).agg(F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("s"))
    return out.join(samples, "name", "left").select("ord", "name", "dtype", "type", "unique_count", "missing_count", "missing_percentage", "min", "max", "mean",
                                                    F.col("s.value").alias("sample_values"))
