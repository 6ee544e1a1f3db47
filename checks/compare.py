"""Run registered queries next to their oracles: python -m checks.compare SF [NAME ...]"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()

FAMILY = {"tinyint": "int", "smallint": "int", "integer": "int", "int": "int", "bigint": "bigint", "hugeint": "hugeint",
          "double": "double", "float": "float", "varchar": "string", "string": "string", "boolean": "boolean",
          "timestamp": "timestamp", "timestamp_ntz": "timestamp", "date": "date"}


def session(cpus: int = 8) -> SparkSession:
    return (SparkSession.builder.master(f"local[{cpus}]").appName("tabscout")
            .config("spark.sql.shuffle.partitions", str(cpus)).config("spark.ui.enabled", "false")
            .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.ui.showConsoleProgress", "false").getOrCreate())


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def _canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, run, sql, sf_dir) -> str | None:
    """None when both agree, else what differs."""
    df = run(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    if sql is None:
        return None if rows else "no rows"
    rel = con.sql(sql)
    theirs = rel.fetchall()
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {df.columns} / {rel.columns}"
    types = {c: FAMILY.get(t.split("(")[0], t) for c, t in df.dtypes}
    other = {c: FAMILY.get(str(t).lower().split("(")[0], str(t)) for c, t in zip(rel.columns, rel.types)}
    wrong = {c: (types[c], other[c]) for c in types if types[c] != other[c] and "array" not in types[c]}
    if wrong:
        return f"types {wrong}"
    a, b = _canonical(df.columns, rows), _canonical(list(rel.columns), theirs)
    if a != b:
        extra = [x for x in a if x not in b][:3] if len(a) < 5000 else a[:2]
        lost = [x for x in b if x not in a][:3] if len(b) < 5000 else b[:2]
        return f"rows {len(a)} / {len(b)}; ours {extra}; oracle {lost}"
    return None if a else "both empty"


def main(argv):
    import checks

    sf_dir = argv[0] if "/" in argv[0] else f"/root/testdata/{argv[0]}"
    wanted = argv[1:]
    spark, con = session(), connect(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name, run in checks.QUERIES.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, run, checks.ORACLE.get(name), sf_dir)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        note = "" if name in checks.ORACLE else " (rows only)"
        bad += problem not in (None, "both empty")
        print(f"{'ok  ' if problem is None else 'DIFF'} {time.time() - start:6.2f}s {name}{note} {problem or ''}", flush=True)
    print("differences:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
