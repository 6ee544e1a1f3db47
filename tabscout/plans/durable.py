"""Reliable cut points for plans that read an intermediate result many times."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

# A lookup table is sent to every executor only up to this many rows.
LOOKUP_ROWS = 100_000
# And up to this many bytes, written as text.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="tabscout-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """``df`` materialised on shared storage, so that later plans read it back."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def local(df: DataFrame) -> DataFrame:
    """``df``, which the schema or a limit bounds, brought to the driver and back: later plans know its size."""
    return df.sparkSession.createDataFrame(df.toArrow(), schema=df.schema)


def local_rows(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A few rows that the driver knows, as a table of known size."""
    schema = T.StructType.fromDDL(ddl)
    table = pa.Table.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=to_arrow_schema(schema))
    return spark.createDataFrame(table, schema=schema)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path on the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def hadoop_path(spark: SparkSession, path: str) -> tuple:
    """The path and its file system, as Spark's readers see it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def discard(spark: SparkSession, path: str) -> None:
    """Delete what was written under a ``scratch_path`` and is not read again."""
    at, fs = hadoop_path(spark, path)
    fs.delete(at, True)


def lookup(df: DataFrame, most: int | None = None) -> DataFrame:
    """``df`` materialised and measured: broadcast when it is small, joined by shuffle when not.

    Rows and bytes are known before the join is planned, so the large side is not shuffled
    first only to find that the small side fits.
    """
    kept = durable(df)
    width = F.octet_length(F.to_json(F.struct("*")))
    size = kept.agg(F.count(F.lit(1)).alias("n"), F.sum(width).alias("b")).first()
    small = size["n"] <= (LOOKUP_ROWS if most is None else most) and (size["b"] or 0) <= BROADCAST_BYTES
    return F.broadcast(kept) if small else kept
