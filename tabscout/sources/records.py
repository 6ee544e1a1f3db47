"""Records that may hold line breaks, from files that split over tasks.

A CSV record ends at a line end outside quotes; an element of a JSON array ends at a closing
brace outside strings that leaves no object open. One scan finds what each byte range does to
that state, prefix sums give the state in which each range starts, and a second scan cuts the
records. Only the pieces of records that cross ranges, at most two a range, are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tabscout.plans.durable import discard, durable, hadoop_path, scratch_path

#: States of so many ranges (24 bytes each) may be sent to every task; more are joined by shuffle.
RANGES = 1_000_000
#: Rows of a batch that are Python values at a time.
SLICE = 256
#: Of zstd, for the pieces.
LEVEL = 9
#: Files to be deleted are read in so many rounds at most, each of as many bytes at least.
ROUNDS, ROUND_BYTES = 4, 32 << 20
SEPARATOR = {"csv": b"\n", "json": b"}"}
#: Bytes that windows-1252 leaves undefined.
UNDEFINED = re.compile(rb"[\x81\x8d\x8f\x90\x9d]")
_EFFECT = "file string, start bigint, flip int, outside bigint, inside bigint, not_utf8 boolean, undefined boolean"
_PIECE = "file string, start bigint, part int, first boolean, text string"
_WHOLE, _HEAD, _MIDDLE, _TAIL, _END = range(5)


def _units(spark: SparkSession, path: str | list[str], kind: str) -> DataFrame:
    """The file's texts between separators, with the byte range in which each begins."""
    lines = spark.read.option("lineSep", SEPARATOR[kind].decode()).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("unit"))


def _effect(kind: str, unit: bytes) -> tuple[int, int, int]:
    """Whether quotes stay open, and the objects that stay open if the unit begins outside or inside a string."""
    if kind == "csv":
        return unit.count(b'"') & 1, 0, 0
    parts = re.sub(rb"\\.", b"", unit, flags=re.S).split(b'"')
    flip = (len(parts) - 1) & 1
    even, odd = (sum(p.count(b"{") for p in parts[i::2]) for i in (0, 1))
    return flip, even - (flip == 0), odd - (flip == 1)  # the brace at the unit's end


def few_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``batches`` in slices, as a whole one as Python values takes several times its bytes."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in few_rows(batches):
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _not_utf8(unit: bytes) -> bool:
    try:
        unit.decode()
    except UnicodeDecodeError:
        return True
    return False


def _effects(kind: str):
    """One row a range: the sum of its units' effects, for both states that it may begin in."""
    names = ["file", "start", "flip", "outside", "inside", "not_utf8", "undefined"]

    def run(batches):
        at, said = None, None
        for file, start, unit in _rows(batches):
            if (file, start) != at:
                if at:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, (*at, *said)))], schema=schema)
                at, said = (file, start), [0, 0, 0, False, False]
            flip, outside, inside = _effect(kind, unit)
            said[1] += inside if said[0] else outside
            said[2] += outside if said[0] else inside
            said[0] ^= flip
            said[3] = said[3] or _not_utf8(unit)
            said[4] = said[4] or UNDEFINED.search(unit) is not None
        if at:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (*at, *said)))], schema=schema)

    schema = pa.schema(list(zip(names, (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()))))
    return run


def _finished(kind: str, text: bytes, begins: bool, ends: bool) -> bytes:
    """A record without what lies between records: a line end after it, commas and brackets before it."""
    if kind == "csv":
        return text[:-1].removesuffix(b"\r") if ends else text
    return re.sub(rb"\A[\s,\[]+", b"", text) if begins else text


def _cut(kind: str, encoding: str):
    """Whole records of each range, and the pieces at its ends."""
    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("part", pa.int32()), ("first", pa.bool_()), ("text", pa.string())])
    separator, nothing = SEPARATOR[kind], (b"",) if kind == "csv" else (b"]", b"[]")

    def run(batches):
        at, held, out, size = None, [], [], 0

        def piece(part):
            nonlocal first
            text = _finished(kind, b"".join(held), part in (_WHOLE, _TAIL), part in (_WHOLE, _HEAD)).decode(encoding)
            out.append((*at, part, first, text.removeprefix("\ufeff") if first else text))
            held.clear()
            first = False
            return len(text)

        for file, start, unit, inside_, depth_ in _rows(batches):
            if (file, start) != at:
                if held:
                    size += piece(_MIDDLE if before else _TAIL)
                at, inside, depth, first = (file, start), inside_, depth_, start == 0
                before = bool(inside or depth)  # the record at hand began in an earlier range
            if not (held or before) and (bare := b"".join(unit.split())) in nothing:
                if bare:
                    out.append((*at, _END, False, None))
                continue
            flip, outside, within = _effect(kind, unit)
            held.append(unit + separator)
            depth += within if inside else outside
            inside ^= flip
            if depth < 0:
                raise ValueError(f"{file} is no array of JSON objects")
            if not inside and not depth:
                size += piece(_HEAD if before else _WHOLE)
                before = False
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out.clear()
                size = 0
        if held:
            piece(_MIDDLE if before else _TAIL)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def _rounds(spark: SparkSession, path: str) -> list[list[str]]:
    """The files under ``path`` in a few even parts."""
    files = sorted(unquote(f) for f in spark.read.text(path).inputFiles())
    at, fs = hadoop_path(spark, path)
    n = max(1, min(ROUNDS, len(files), fs.getContentSummary(at).getLength() // ROUND_BYTES))
    return [files[i::n] for i in range(n) if files]


def _write_pieces(spark: SparkSession, path: str | list[str], kind: str, encoding: str, effects: DataFrame, at: str) -> None:
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    states = effects.withColumn("quoted", (F.coalesce(F.sum("flip").over(before), F.lit(0)) % 2).cast("int"))
    change = F.when(F.col("quoted") == 0, F.col("outside")).otherwise(F.col("inside"))
    states = durable(states.select(F.xxhash64("file").alias("f"), F.col("start").alias("s"), "quoted", F.coalesce(F.sum(change).over(before), F.lit(0)).alias("depth")))
    few = states.count() <= RANGES
    placed = _units(spark, path, kind).withColumns({"f": F.xxhash64("file"), "place": F.monotonically_increasing_id()})
    joined = placed.withColumnRenamed("start", "s").join(F.broadcast(states) if few else states, ["f", "s"], "left")
    if not few:  # back in the order of the file
        joined = joined.repartition("file", "s").sortWithinPartitions("file", "s", "place")
    # A range that the first scan did not see would begin in an unknown state.
    known = F.when(F.col("quoted").isNull(), F.raise_error(F.lit("byte ranges changed between scans"))).otherwise(F.col("quoted")).cast("int")
    cut = joined.select("file", F.col("s").alias("start"), "unit", known.alias("quoted"), "depth").mapInArrow(_cut(kind, encoding), _PIECE)
    # As Parquet, which packs the texts and reads the columns asked for: a checkpoint would write every text unpacked.
    cut.write.mode("append").option("compression", "zstd").option("parquet.compression.codec.zstd.level", LEVEL).parquet(at)


def split_records(spark: SparkSession, path: str, kind: str, encoding: str | None = None, consume: bool = False) -> DataFrame:
    """The records of CSV files or JSON arrays (``kind``) as (first, text); ``first`` marks the first one of a file.

    Without ``encoding`` the one found by the first scan: UTF-8, else windows-1252, else ISO-8859-1.
    The files are read when this returns; later reads take the pieces that it wrote. ``consume``:
    the files are deleted, in a few rounds as their pieces are written, so that both are not kept whole.
    CSV: a quote stands only around a cell or doubled in it; empty lines outside cells are no records.
    """
    rounds = (_rounds(spark, path) if consume else None) or [path]
    scans = [durable(_units(spark, files, kind).mapInArrow(_effects(kind), _EFFECT)) for files in rounds]
    if encoding is None:
        odd = reduce(DataFrame.unionByName, scans).agg(F.bool_or("not_utf8"), F.bool_or("undefined"), F.count(F.lit(1))).first()
        encoding = "utf-8" if not odd[0] else "latin-1" if odd[1] else "cp1252"
    at = scratch_path(spark, "pieces")
    for files, effects in zip(rounds, scans):
        _write_pieces(spark, files, kind, encoding, effects, at)
        for file in files if consume and files != path else ():
            discard(spark, file)
    if consume:
        discard(spark, path)
    pieces = spark.read.schema(_PIECE).parquet(at)
    if kind == "json":  # the brace put back at the end of a file cut short would hide that
        short = pieces.groupBy("file").agg(F.bool_or(F.col("part") == _END).alias("ends")).where("not ends").select("file").first()
        if short:
            raise ValueError(f"{short[0]} ends within its array")
    tail = (F.col("part") == _TAIL).cast("int")
    # Pieces are numbered by the tails up to them, so that a record's pieces share a number.
    crossing = pieces.where(F.col("part").between(_HEAD, _TAIL)).withColumn("tail", tail).drop("part")
    numbers = crossing.select("file", "start", "tail").withColumn("record", F.sum("tail").over(Window.partitionBy("file").orderBy("start", "tail")))
    joined = crossing.join(numbers, ["file", "start", "tail"]).groupBy("file", "record").agg(
        F.bool_or("first").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "tail", "text"))), lambda p: p["text"]), "").alias("text"))
    return pieces.where(F.col("part") == _WHOLE).select("first", "text").unionByName(joined.select("first", "text"))
