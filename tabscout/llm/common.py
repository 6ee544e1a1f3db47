"""What several operators share: row identity, stored intermediate results, text slices."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tabscout.plans.durable import scratch_path, shared_dir

#: Stands for a null integer id inside an operator; it sorts before every real id.
NO_ID = -(2**63)
#: Text bytes that a task holds as arrays at a time; one longer text is still taken whole.
SLICE_BYTES = 2 << 20
#: And rows of such a slice.
SLICE_ROWS = 1000


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends and no executor's loss matters."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed to the shared folder, partitions and their order kept."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def text_of(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def id_of(name: str) -> Column:
    return F.coalesce(F.col(name).cast("bigint"), F.lit(NO_ID))


def back(name: str) -> Column:
    """The id as the input had it."""
    return F.when(F.col(name) != NO_ID, F.col(name))


def text_key(text: Column) -> Column:
    """Tells rows of one id with different texts apart."""
    return F.xxhash64(F.lit("text"), text)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def text_slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of Arrow batches whose texts fit in SLICE_BYTES together, each with its texts as bytes."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if i > start and (held + size > SLICE_BYTES or i - start >= SLICE_ROWS):
                yield batch.slice(start, i - start), texts.slice(start, i - start).to_pylist()
                start, held = i, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start), texts.slice(start).to_pylist()

