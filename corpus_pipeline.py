"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with all
their columns; the last adds shard and slot. Stage results are written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabscout.llm import decontam, mixing, neardup, quality, sharding
from tabscout.llm.common import NO_ID, id_of, stored, text_key, text_of

#: Some stages have no SQL (cube sampling, random shuffles): tests compare with brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep. Null and empty texts go; repeated rows share their fate."""
    return quality.quality(docs, into="__quality").where("__quality.kept").drop("__quality")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the least id (null last), then the least text key.

    Five-word shingles, similarity of 0.8 or more. Texts without words stay, each as it is;
    repeated rows of one id and text become one.
    """
    found = neardup.near_duplicates(docs).select("d", "k", F.coalesce("group", F.xxhash64("d", "k")).alias("group"), F.col("group").isNull().alias("alone"))
    first = found.groupBy("group", "alone").agg(F.min(F.struct(F.col("d").isNull().alias("no"), "d", "k")).alias("first"))
    kept = first.select(F.coalesce("first.d", F.lit(NO_ID)).alias("__d"), F.col("first.k").alias("__k")).distinct()
    rows = docs.select(F.struct("*").alias("__row"), id_of("doc_id").alias("__d"), text_key(text_of("text")).alias("__k"))
    return rows.join(kept, ["__d", "__k"]).dropDuplicates(["__d", "__k"]).select("__row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found. Null and empty texts hold none; repeated rows share their fate."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.find_items(docs, items, into="__found").where(F.size("__found") == 0).drop("__found")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none, one or two rows each. Documents without words go."""
    mixed = mixing.with_times(docs, mixing.mix(docs), [F.struct("*").alias("__row")])
    return mixed.where("__said.size > 0 AND __said.times > 0").select(
        "__row", F.explode(F.sequence(F.lit(1), F.col("__said.times"))).alias("__copy")).select("__row.*")


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with ``shard`` (0 to 39, counts at most one apart) and ``slot`` (gapless from 0 in a shard)."""
    keyed = docs.drop("shard", "slot").withColumn("__key", text_key(text_of("text")))
    return sharding.shard(keyed, ["doc_id", "__key"]).drop("__key")


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("decontamination", decontaminate), ("source mix", source_mix), ("sharding", shards)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last stored in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, "stage")
    return docs
