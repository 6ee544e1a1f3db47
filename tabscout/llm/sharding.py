"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows lie in logical partitions by hash. How many rows each partition sends to each shard is
drawn from the multivariate hypergeometric law, as in a uniform shuffle of all rows: the
shards' free places are dealt over a binary tree of partitions, each node splitting its
places between its two halves. Then rows are permuted within partitions, exchanged, and
permuted within shards. DataFrame expressions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

#: Rows of a logical partition or a slot range, about.
ROWS_EACH = 1_000_000
#: Fewest logical partitions.
LEAST = 16
#: Standard deviations around the mean that a draw covers; the rest has probability below 1e-30.
WIDTH = 12


def _uniform(*key: Column) -> Column:
    """In (0, 1), from a hash of the key."""
    return (F.pmod(F.xxhash64(*key), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def _let(value: Column, use) -> Column:
    """``use`` of ``value``, which is evaluated once."""
    return F.transform(F.array(value), use)[0]


def _log_factorial(n: Column) -> Column:
    """ln n! for n >= 0 by Stirling's series at n + 9, right to about 1e-12."""
    x = n + 9.0
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    below = n + 1.0
    for i in range(2, 9):
        below = below * (n + float(i))
    return series - F.log(below)


def hypergeometric(good: Column, bad: Column, draws: Column, u: Column) -> Column:
    """Good ones among ``draws`` from ``good + bad``, by inversion of the law at ``u``."""
    def bounds(c: Column) -> Column:
        total = c["good"] + c["bad"]
        mean = c["draws"].cast("double") * c["good"] / F.greatest(total, F.lit(1))
        spread = F.sqrt(F.greatest(mean * c["bad"] / F.greatest(total, F.lit(1)) * (total - c["draws"]) / F.greatest(total - 1, F.lit(1)), F.lit(0.0)))
        return _let(F.struct(mean.alias("mean"), (WIDTH * spread + WIDTH).alias("reach")), lambda m: F.struct(
            F.greatest(F.lit(0), c["draws"] - c["bad"], F.floor(m["mean"] - m["reach"])).cast("bigint").alias("first"),
            F.least(c["good"], c["draws"], F.ceil(m["mean"] + m["reach"])).cast("bigint").alias("last")))

    def invert(c: Column, b: Column) -> Column:
        x, good, bad, draws = b["first"], c["good"], c["bad"], c["draws"]
        # All factorials of the first probability in one pass over (number, sign).
        terms = F.array(*[F.struct(n.cast("double").alias("n"), F.lit(sign).alias("sign")) for n, sign in (
            (good, 1.0), (x, -1.0), (good - x, -1.0), (bad, 1.0), (draws - x, -1.0), (bad - draws + x, -1.0),
            (good + bad, -1.0), (draws, 1.0), (good + bad - draws, 1.0))])
        log_first = F.aggregate(terms, F.lit(0.0), lambda a, t: a + t["sign"] * _log_factorial(t["n"]))

        def step(a: Column, at: Column) -> Column:
            ratio = (good - at).cast("double") * (draws - at) / ((at + 1).cast("double") * (bad - draws + at + 1))
            return F.struct((a["p"] * ratio).alias("p"), (a["sum"] + a["p"]).alias("sum"), F.when(a["sum"] + a["p"] < c["u"], at + 1).otherwise(a["x"]).alias("x"))

        walked = F.aggregate(F.sequence(x, b["last"]), F.struct(F.exp(log_first).alias("p"), F.lit(0.0).alias("sum"), x.alias("x")), step)
        return F.least(walked["x"], b["last"])

    case = F.struct(good.alias("good"), bad.alias("bad"), draws.alias("draws"), u.alias("u"))
    return _let(case, lambda c: _let(bounds(c), lambda b: F.when(b["first"] >= b["last"], b["first"]).otherwise(invert(c, b))))


def communication_matrix(counts: DataFrame, parts: int, shards: int, rows: int, seed: int) -> DataFrame:
    """One row per non-empty partition: ``part`` and ``sends``, its rows for each shard.

    ``counts`` has a row (part, n) per non-empty partition. Free places of a shard: rows
    divided by shards, one more in the first ones.
    """
    places = F.array([F.lit(rows // shards + (s < rows % shards)).cast("bigint") for s in range(shards)])
    sizes = F.map_from_entries(F.collect_list(F.struct("part", "n")))
    node = counts.agg(sizes.alias("m")).select(
        F.lit(0).alias("node"), F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.coalesce(F.try_element_at("m", p), F.lit(0).cast("bigint"))).alias("sizes"),
        places.alias("places"))
    for level in range(parts.bit_length() - 1):
        half = parts >> (level + 1)
        left, right = F.slice("sizes", 1, half), F.slice("sizes", half + 1, half)
        wanted = F.aggregate(left, F.lit(0).cast("bigint"), lambda a, x: a + x)
        total = F.aggregate("places", F.lit(0).cast("bigint"), lambda a, x: a + x)
        node = node.withColumns({"wanted": wanted, "total": total})
        # Shard by shard: how many of its places go to the left half, given what is left to deal.
        dealt = F.aggregate(
            F.arrays_zip("places", F.sequence(F.lit(0), F.lit(shards - 1)).alias("s")),
            F.struct(F.col("wanted").alias("wanted"), F.col("total").alias("total"), F.array().cast("array<bigint>").alias("out")),
            lambda a, z: _let(
                hypergeometric(z["places"], a["total"] - z["places"], a["wanted"], _uniform(F.lit(seed), F.lit(level), F.col("node"), z["s"])),
                lambda x: F.struct((a["wanted"] - x).alias("wanted"), (a["total"] - z["places"]).alias("total"), F.concat(a["out"], F.array(x)).alias("out"))))
        node = node.withColumn("left", dealt["out"])
        child = F.explode(F.array(
            F.struct((F.col("node") * 2).alias("node"), left.alias("sizes"), F.col("left").alias("places")),
            F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("sizes"), F.zip_with("places", "left", lambda a, b: a - b).alias("places"))))
        node = node.select(child.alias("c")).select("c.*")
        if level in (4, 9):
            node = node.repartition("node")  # more nodes than a task should draw for
    return node.select(F.col("node").alias("part"), F.col("places").alias("sends"))


def shard(rows: DataFrame, key: list[str], shards: int = 40, seed: int = 8, rows_each: int | None = None) -> DataFrame:
    """``rows`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 within the shard).

    Shard sizes differ by one at most. Every draw follows hashes of ``key``, so reruns agree;
    rows with equal keys are interchangeable, null keys are keys like others. ``key`` should
    tell rows apart; copies of a row then differ in slot and maybe in shard. Columns named
    shard or slot are replaced. An empty table gives no rows.
    """
    each = rows_each or ROWS_EACH
    hashed = lambda salt: F.xxhash64(F.lit(seed), F.lit(salt), *[F.col(k) for k in key])
    n = rows.count()
    parts = 1 << max(int(math.log2(LEAST)), (max(n, 1) // each).bit_length())
    part = F.pmod(hashed("part"), F.lit(parts)).cast("int")
    packed = rows.drop("shard", "slot")
    packed = packed.select(F.struct("*").alias("row"), part.alias("part"), hashed("within").alias("r1"), hashed("slot").alias("r2"),
                           F.struct(*[F.col(k) for k in key]).alias("key"))
    counts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    matrix = communication_matrix(counts, parts, shards, n, seed)
    from pyspark.sql import Window

    ranked = packed.withColumn("i", F.row_number().over(Window.partitionBy("part").orderBy("r1", "key")))
    sent = ranked.join(matrix, "part")
    # The i-th row of the permuted partition goes to the shard whose range of the partition's rows holds i.
    to = F.aggregate("sends", F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(0).alias("shard")),
                     lambda a, x: F.struct((a["sum"] + x).alias("sum"), (a["shard"] + (a["sum"] + x < F.col("i")).cast("int")).alias("shard")))["shard"]
    # Ranges of the second random key keep a shard's sort in many tasks; their counts give offsets.
    ranges = 1 << max(2, (max(n, 1) // shards // each).bit_length())
    placed = sent.select("row", "key", "r2", to.alias("shard"), F.pmod(F.shiftrightunsigned("r2", 20), F.lit(ranges)).cast("int").alias("range"))
    sizes = placed.groupBy("shard", "range").agg(F.count("*").alias("n"))
    offsets = sizes.select("shard", "range", (F.sum("n").over(Window.partitionBy("shard").orderBy("range")) - F.col("n")).alias("offset"))
    order = Window.partitionBy("shard", "range").orderBy("r2", "key")
    return (placed.withColumn("j", F.row_number().over(order)).join(offsets, ["shard", "range"])
            .select("row.*", "shard", (F.col("offset") + F.col("j") - 1).alias("slot")))
