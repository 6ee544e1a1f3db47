"""Column profile of any table, as tidy DataFrames."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tabscout.functions.stats import percent, strength
from tabscout.functions.text import ref
from tabscout.plans.durable import durable, local, local_rows, lookup
from tabscout.plans.summary import Exact, Summary, exact_all, summarize, summarize_all

# Columns turned into rows together; wider tables take several column-pruned passes.
COLUMNS_PER_PASS = 200
COLUMN_ROWS = ("ord int, name string, dtype string, column_type string, total_rows long, unique_count long, unique_percentage double, "
               "missing_count long, missing_percentage double, zero_count long, potential_target boolean")
QUARTILES = (0.25, 0.5, 0.75)
# Strings longer than this are compared by length and SHA-256 when rows are compared.
DIGEST_FROM = 64


def column_class(dtype: T.DataType) -> str:
    """numeric, datetime or categorical; a boolean is categorical."""
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "categorical"


def columns_of(df: DataFrame, kind: str) -> list[str]:
    return [f.name for f in df.schema.fields if column_class(f.dataType) == kind]


def clean(df: DataFrame) -> DataFrame:
    """NaN and infinities become null in floating-point columns."""
    floating = (T.FloatType, T.DoubleType)
    return df.select(*[
        F.when(F.abs(ref(f.name)) < float("inf"), ref(f.name)).alias(f.name)
        if isinstance(f.dataType, floating) else ref(f.name) for f in df.schema.fields])


def value_text(field: T.StructField) -> Column:
    """A value as text, one text per distinct value."""
    c = ref(field.name)
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return (c + F.lit(0.0)).cast("string")  # -0.0 equals 0.0
    if isinstance(field.dataType, (T.MapType, T.StructType, T.ArrayType, T.VariantType)):
        return F.when(c.isNotNull(), F.to_json(F.struct(c)))
    return F.hex(c) if isinstance(field.dataType, T.BinaryType) else c.cast("string")


def _value_cell(i: int, field: T.StructField) -> Column:
    """A value in the field of its own kind, so that one grouping tells the values of all columns apart."""
    c, kind = ref(field.name), field.dataType
    whole, real, time, size, text = (F.lit(None).cast(t) for t in ("bigint", "double", "timestamp_ntz", "int", "string"))
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        whole = c.cast("bigint")
    elif isinstance(kind, T.DateType):
        whole = F.unix_date(c).cast("bigint")
    elif isinstance(kind, T.TimestampType):
        whole = F.unix_micros(c)
    elif isinstance(kind, T.TimestampNTZType):
        time = c
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        real = c.cast("double")
    else:
        size, text = compact(value_text(field), "value")
        if isinstance(kind, T.DecimalType):
            real = c.cast("double")
    return F.struct(F.lit(i).alias("__c"), whole.alias("whole"), real.alias("real"), time.alias("time"), size.alias("size"), text.alias("text"))


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(__c, whole, real, time, size, text, cnt): one row per column (by place) and distinct value, nulls included, in one scan."""
    parts = []
    for start in range(0, len(columns), COLUMNS_PER_PASS):
        cells = F.array(*[_value_cell(i, df.schema[c]) for i, c in list(enumerate(columns))[start:start + COLUMNS_PER_PASS]])
        parts.append(df.select(F.inline(cells)).groupBy("__c", "whole", "real", "time", "size", "text").agg(F.count(F.lit(1)).alias("cnt")))
    return reduce(DataFrame.unionByName, parts)


def _counted(values: DataFrame, keys: Sequence[str], number: Column) -> DataFrame:
    """keys..., total_rows, unique_count, missing_count, zero_count from ``value_counts``; ``number``: whether the column holds numbers."""
    there = F.col("whole").isNotNull() | F.col("real").isNotNull() | F.col("time").isNotNull() | F.col("text").isNotNull()
    zero = number & ((F.col("whole") == 0) | (F.col("real") == 0))
    none = F.lit(0).cast("bigint")
    return values.groupBy(*keys).agg(
        F.sum("cnt").alias("total_rows"), F.count_if(there).alias("unique_count"),
        F.sum(F.when(there, none).otherwise(F.col("cnt"))).alias("missing_count"), F.sum(F.when(zero, F.col("cnt")).otherwise(none)).alias("zero_count"))


def column_counts(df: DataFrame, columns: Sequence[str], numeric: Sequence[str] = ()) -> DataFrame:
    """(column, total_rows, unique_count, missing_count, zero_count), distinct values compared in their own type."""
    names = F.array(*[F.lit(c) for c in columns])
    number = F.get(F.array(*[F.lit(c in numeric) for c in columns]), F.col("__c"))
    return _counted(value_counts(df, columns), ["__c"], number).select(
        F.element_at(names, F.col("__c") + 1).alias("column"), "total_rows", "unique_count", "missing_count", "zero_count")


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, unique_count) of non-null values, compared in their own type; none for an all-null column."""
    return column_counts(df, df.columns if columns is None else list(columns)).where("unique_count > 0").select("column", "unique_count")


def compact(text: Column, name: str) -> list[Column]:
    """A text as two narrow fields: its length, and itself or (when long) its SHA-256."""
    size = F.octet_length(text)
    return [size.alias(f"{name}_size"), F.when(size > DIGEST_FROM, F.sha2(text.cast("binary"), 256)).otherwise(text.cast("string")).alias(name)]


def per_column(df: DataFrame, columns: Sequence[str], cell, metrics: Sequence[Column]) -> DataFrame:
    """One row per column: ``cell(name)`` lists the fields that ``metrics`` aggregate.

    Columns become rows inside each task and are aggregated there, so one short
    generated loop serves any number of columns and only totals are shuffled.
    """
    passes = []
    for start in range(0, len(columns), COLUMNS_PER_PASS):
        chunk = list(columns[start:start + COLUMNS_PER_PASS])
        cells = F.array(*[F.struct(F.lit(i).alias("__c"), *cell(c)) for i, c in enumerate(chunk)])
        totals = df.select(F.inline(cells)).groupBy("__c").agg(*metrics)
        names = F.array(*[F.lit(c) for c in chunk])
        passes.append(totals.withColumn("column", F.element_at(names, F.col("__c") + 1)).drop("__c"))
    return reduce(DataFrame.unionByName, passes)


def number_cell(name: str) -> list[Column]:
    return [ref(name).cast("double").alias("value")]


def distinct_rows(df: DataFrame) -> DataFrame:
    """One row per distinct row of ``df`` with its number of copies (``cnt``)."""
    keys = []
    for i, f in enumerate(df.schema.fields):
        c = ref(f.name)
        if isinstance(f.dataType, (T.MapType, T.VariantType)):
            keys.append(F.to_json(F.struct(c)).alias(f"k{i}"))
        elif isinstance(f.dataType, (T.StringType, T.BinaryType)):
            keys += compact(value_text(f), f"k{i}")
        else:
            keys.append(c.alias(f"k{i}"))
    named = df.select(*keys)
    return named.groupBy(*named.columns).agg(F.count(F.lit(1)).alias("cnt"))


def duplicates(df: DataFrame) -> DataFrame:
    """Rows, duplicate rows and their share; nulls count as equal."""
    counted = distinct_rows(df).agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("total_rows"),
                                    F.coalesce(F.sum(F.col("cnt") - 1), F.lit(0)).alias("duplicate_rows"))
    return counted.withColumn("duplicate_percentage", percent("duplicate_rows", "total_rows"))


class Profile:
    """All profile sections of one table, each a DataFrame built when first read.

    The core sections (one row per column or pair) are brought to the driver by ``keep``
    when first read, so that the rules derived from them do not scan the table again and
    know how small they are. Number columns take two scans in all.
    """

    def __init__(self, df: DataFrame, columns: Sequence[str] | None = None, keep=local):
        self._keep = keep
        self.df = clean(df if columns is None else df.select(*[ref(c) for c in columns]))
        self.fields = self.df.schema.fields
        self.names = [f.name for f in self.fields]
        self.numeric = columns_of(self.df, "numeric")
        self.categorical = columns_of(self.df, "categorical")
        self.datetime = columns_of(self.df, "datetime")
        self.spark = df.sparkSession

    @cached_property
    def basic(self) -> DataFrame:
        return self._keep(duplicates(self.df).select(
            "total_rows", F.lit(len(self.names)).alias("total_columns"),
            "duplicate_rows", "duplicate_percentage"))

    @cached_property
    def counts(self) -> DataFrame:
        """column, total_rows, unique_count, missing_count, zero_count."""
        return column_counts(self.df, self.names, self.numeric)

    @cached_property
    def total_rows(self) -> int:
        first = self.columns.first()
        return first["total_rows"] if first else self.df.count()

    @cached_property
    def numbers(self) -> Summary:
        """Moments, co-moments and sketches of the number columns, from one scan."""
        share_numbers([self])
        return self.__dict__["numbers"]

    @cached_property
    def exact(self) -> Exact:
        """Quartiles and the counts of values beyond the fences, from one more scan."""
        share_exact([self])
        return self.__dict__["exact"]

    @cached_property
    def columns(self) -> DataFrame:
        share_columns([self])
        return self.__dict__["columns"]

    def column_rows(self, counts: dict[str, tuple[int, int, int, int]]) -> DataFrame:
        """The column rows from total, distinct, missing and zero counts; a table without rows has none of these."""
        rows = []
        for i, f in enumerate(self.fields):
            total, unique, missing, zero = counts.get(f.name, (0, 0, 0, 0))
            share = lambda part: part / total * 100 if total else None  # noqa: B023, E731
            rows.append((i, f.name, f.dataType.simpleString(), column_class(f.dataType), total, unique, share(unique), missing, share(missing), zero, 2 <= unique <= 19))
        return local_rows(self.spark, rows, COLUMN_ROWS)

    @cached_property
    def quartiles(self) -> DataFrame:
        """column, n, q = [q25, median, q75]."""
        at = {c: i for i, c in enumerate(self.numeric)}
        return local_rows(self.spark, [(c, int(self.numbers.n[at[c]]), q) for c, q in self.exact.quantiles.items()], "column string, n long, q array<double>")

    @cached_property
    def numeric_stats(self) -> DataFrame:
        rows = []
        for i, c in enumerate(self.numeric):
            s, n = self.numbers, int(self.numbers.n[i])
            if n:
                q = self.exact.quantiles[c]
                spread = None if n < 2 else 0.0 if s.low[i] == s.high[i] else math.sqrt(s.m2[i] / (n - 1))
                rows.append((c, float(s.low[i]), float(s.high[i]), float(s.total[i] / n), q[1], spread, q[0], q[2], s.skewness(i), s.kurtosis(i)))
        return local_rows(self.spark, rows, "column string, min double, max double, mean double, median double, std double, "
                                            "q25 double, q75 double, skewness double, kurtosis double")

    def top_values(self, k: int = 5) -> DataFrame:
        """The ``k`` most frequent values per categorical column, with their share."""
        return top_values(self.df, self.categorical, k)

    @cached_property
    def categorical_stats(self) -> DataFrame:
        top = self.top_values()
        return top.groupBy("column").agg(
            F.max(F.when(F.col("rank") == 1, F.col("value"))).alias("most_common"),
            F.max(F.when(F.col("rank") == 1, F.col("cnt"))).alias("most_common_count"),
            F.max(F.when(F.col("rank") == 1, F.col("percentage"))).alias("most_common_percentage"),
            F.sort_array(F.collect_list(F.struct("rank", "value", "cnt", "percentage"))).alias("top_values"))

    @cached_property
    def datetime_stats(self) -> DataFrame:
        if not self.datetime:
            return self.spark.createDataFrame([], "column string, min_date timestamp_ntz, max_date timestamp_ntz, range_days long")
        lo, hi = F.min("value"), F.max("value")
        return per_column(self.df, self.datetime, lambda name: [ref(name).cast("timestamp_ntz").alias("value")], [
            lo.alias("min_date"), hi.alias("max_date"), F.timestamp_diff("DAY", lo, hi).alias("range_days")]) \
            .where("min_date is not null").select("column", "min_date", "max_date", "range_days")

    @cached_property
    def pairs(self) -> DataFrame | None:
        return None if len(self.numeric) < 2 else _pair_rows(self.spark, self.numeric, self.numbers)

    def correlations(self, threshold: float = 0.3, k: int = 20) -> DataFrame:
        found = self.pairs
        if found is None:
            return self.spark.createDataFrame([], "ord int, column1 string, column2 string, correlation double, strength string")
        return (found.where(F.abs("correlation") > threshold).withColumn("strength", strength(F.col("correlation")))
                .orderBy(F.desc(F.abs("correlation")), "ord").limit(k))

    @cached_property
    def outliers(self) -> DataFrame:
        """Values outside the 1.5 x IQR fences, for columns with four values or more."""
        at = {c: i for i, c in enumerate(self.numeric)}
        rows = [(c, n, n * 100 / int(self.numbers.n[at[c]]), low, high) for c, (low, high, n) in self.exact.beyond.items() if n and self.numbers.n[at[c]] >= 4]
        return local_rows(self.spark, rows, "column string, outlier_count long, outlier_percentage double, lower_bound double, upper_bound double")

    @cached_property
    def summary(self) -> DataFrame:
        return self.columns.agg(
            F.count(F.when(F.col("column_type") == "numeric", 1)).alias("numeric_columns_count"),
            F.count(F.when(F.col("column_type") == "categorical", 1)).alias("categorical_columns_count"),
            F.count(F.when(F.col("column_type") == "datetime", 1)).alias("datetime_columns_count"),
            F.sum("missing_count").alias("total_missing_values"),
            percent(F.sum("missing_count"), F.sum("total_rows")).alias("missing_percentage"))

    @cached_property
    def quality(self) -> DataFrame:
        """quality_score and total_issues."""
        score = self.columns.agg((100 - percent(F.sum("missing_count"), F.sum("total_rows"))).alias("quality_score"))
        issues = self.quality_issues.agg(F.count(F.lit(1)).alias("total_issues"))
        return score.select("quality_score", issues.scalar().alias("total_issues"))

    @cached_property
    def quality_issues(self) -> DataFrame:
        """ord, severity, column, kind, value, issue."""
        missing = self.columns.where("missing_percentage > 10").select(
            F.lit(1).alias("part"), "ord",
            F.when(F.col("missing_percentage") > 30, "high").otherwise("medium").alias("severity"),
            F.col("name").alias("column"),
            F.when(F.col("missing_percentage") > 30, "High missing values").otherwise("Moderate missing values").alias("kind"),
            F.col("missing_percentage").alias("value"))
        copies = self.basic.where("duplicate_percentage > 5").select(
            F.lit(2).alias("part"), F.lit(0).alias("ord"), F.lit("high").alias("severity"), F.lit("all").alias("column"),
            F.lit("High duplicate rows").alias("kind"), F.col("duplicate_percentage").alias("value"))
        constant = self.columns.where("unique_count = 1").select(
            F.lit(3).alias("part"), "ord", F.lit("medium").alias("severity"), F.col("name").alias("column"),
            F.lit("Column has only one unique value").alias("kind"), F.lit(None).cast("double").alias("value"))
        text = F.when(F.col("value").isNull(), F.col("kind")).otherwise(F.format_string("%s (%.1f%%)", "kind", "value"))
        return (missing.unionByName(copies).unionByName(constant)
                .select((F.col("part") * 100_000 + F.col("ord")).alias("ord"), "severity", "column", "kind", "value",
                        text.alias("issue")))

    @cached_property
    def recommendations(self) -> DataFrame:
        """ord, category, priority, title, amount, description."""
        def rule(source, ord_, category, priority, title, amount, description):
            return source.select(ord_.cast("bigint").alias("ord"), F.lit(category).alias("category"),
                                 F.lit(priority).alias("priority"), title.alias("title"),
                                 amount.cast("double").alias("amount"), description.alias("description"))
        low = rule(self.quality.where("quality_score < 80"), F.lit(1), "data_quality", "high",
                   F.lit("Improve Data Quality"), F.col("quality_score"),
                   F.format_string("The quality score is %.1f%%; fill gaps and look at repeated rows.", "quality_score"))
        missing = rule(self.columns.where("missing_percentage > 30"), F.col("ord") + 1000, "missing_data", "high",
                       F.format_string("High Missing Values in '%s'", "name"), F.col("missing_percentage"),
                       F.format_string("%.1f%% of its rows are empty: fill them or leave the column out.", "missing_percentage"))
        beyond = self.outliers.agg(F.count(F.lit(1)).alias("k"), F.sum("outlier_count").alias("total")).where("k > 0")
        outliers = rule(beyond, F.lit(1_000_000), "outliers", "medium", F.lit("Outliers Detected"), F.col("total"),
                        F.format_string("%d far values in %d columns may be mistakes.", "total", "k"))
        strong = self.correlations().where("strength = 'strong'").agg(F.count(F.lit(1)).alias("k")).where("k > 0")
        related = rule(strong, F.lit(1_000_001), "correlations", "medium", F.lit("Strong Correlations Found"), F.col("k"),
                       F.format_string("%d pairs of columns say almost the same; keep one of each.", "k"))
        few = self.df.agg(F.count(F.lit(1)).alias("k")).where("k < 100")
        small = rule(few, F.lit(1_000_002), "sample_size", "high", F.lit("Small Dataset"), F.col("k"),
                     F.format_string("%d rows are few to train on.", "k"))
        return reduce(DataFrame.unionByName, [low, missing, outliers, related, small])

    def headline(self) -> dict[str, DataFrame]:
        """The short form: five correlations, severe issues, five recommendations."""
        return {"top_correlations": self.correlations(k=5),
                "critical_issues": self.quality_issues.where("severity = 'high'"),
                "recommendations": self.recommendations.orderBy("ord").limit(5)}

    def kpi_cards(self) -> DataFrame:
        """At most six (ord, title, value) cards."""
        cards = [("Total Records", F.count(F.lit(1)).cast("double"), "%.0f"),
                 ("Total Features", F.lit(float(len(self.names))), "%.0f")]
        if self.numeric:
            c = ref(self.numeric[0]).cast("double")
            cards += [(f"{word} {self.numeric[0]}", f(c), "%.2f")
                      for word, f in (("Average", F.avg), ("Min", F.min), ("Max", F.max))]
        present = reduce(lambda a, b: a + b, [F.count(ref(c)) for c in self.names])
        cards.append(("Data Completeness", percent(present, F.count(F.lit(1)) * len(self.names)), "%.1f%%"))
        wide = self.df.agg(*[v.alias(f"c{i}") for i, (_, v, _) in enumerate(cards)])
        rows = [F.struct(F.lit(i + 1).alias("ord"), F.lit(t).alias("title"), F.col(f"c{i}").alias("number"),
                         F.format_string(fmt, f"c{i}").alias("value")) for i, (t, _, fmt) in enumerate(cards)]
        return wide.select(F.inline(F.array(*rows))).where("ord <= 6")


#: Tables that share a job.
TOGETHER = 64


def share_numbers(profiles: Sequence[Profile]) -> None:
    """Fill ``numbers`` of several profiles from one job."""
    todo = [p for p in profiles if "numbers" not in p.__dict__]
    for start in range(0, len(todo), TOGETHER):
        some = todo[start:start + TOGETHER]
        for p, found in zip(some, summarize_all([(p.df, p.numeric) for p in some])):
            p.__dict__["numbers"] = found


def share_exact(profiles: Sequence[Profile]) -> None:
    """Fill ``exact`` of several profiles from one job."""
    share_numbers(profiles)
    todo = [p for p in profiles if "exact" not in p.__dict__]
    for start in range(0, len(todo), TOGETHER):
        some = todo[start:start + TOGETHER]
        for p, found in zip(some, exact_all([(p.df, p.numeric, p.numbers) for p in some], QUARTILES, (0, 2))):
            p.__dict__["exact"] = found


def share_columns(profiles: Sequence[Profile]) -> None:
    """Fill ``columns`` of several profiles from one job: the values of all tables are counted as rows keyed by table and column."""
    todo = [p for p in profiles if "columns" not in p.__dict__]
    for start in range(0, len(todo), TOGETHER):
        some = todo[start:start + TOGETHER]
        counted = reduce(DataFrame.unionByName, [value_counts(p.df, p.names).withColumn("t", F.lit(t)) for t, p in enumerate(some)])
        places = [F.array(*[F.lit(c in p.numeric) for c in p.names]) for p in some]
        number = F.get(F.get(F.array(*places), F.col("t")), F.col("__c"))
        rows = _counted(counted, ["t", "__c"], number).collect()  # a row a column
        for t, p in enumerate(some):
            mine = {p.names[r["__c"]]: (r["total_rows"], r["unique_count"], r["missing_count"], r["zero_count"]) for r in rows if r["t"] == t}
            p.__dict__["columns"] = p.column_rows(mine)


def _compact_cells(fields) -> list[list[Column]]:
    return [[F.lit(i).alias("__c"), *compact(value_text(f), "value"), F.substring(value_text(f).cast("string"), 1, DIGEST_FROM).alias("head")] for i, f in enumerate(fields)]


def compact_frequencies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(__c, value_size, value, head, cnt): one row per distinct value; long texts as their digest and first characters."""
    fields = [df.schema[c] for c in columns]
    cells = F.array(*[F.struct(*cell) for cell in _compact_cells(fields)])
    return (df.select(F.inline(cells)).where("value is not null")
            .groupBy("__c", "value_size", "value", "head").agg(F.count(F.lit(1)).alias("cnt")))


def rank_frequencies(freq: DataFrame, k: int) -> DataFrame:
    """What may be among the ``k`` most frequent values per column: values that tie in their first characters all stay."""
    best = W.partitionBy("__c").orderBy(F.desc("cnt"), "head")
    # The rank filter lets each task keep only these rows per column before the shuffle.
    return freq.withColumn("rank", F.rank().over(best)).where(F.col("rank") <= k)


def _long_texts(df: DataFrame, columns: Sequence[str], of: DataFrame, part) -> DataFrame:
    """(__c, value_size, value, part): ``part`` of each long text whose digest is in ``of``."""
    fields = [df.schema[c] for c in columns]
    cells = F.array(*[F.struct(*cell[:3], value_text(f).cast("string").alias("text")) for cell, f in zip(_compact_cells(fields), fields)])
    keys = ["__c", "value_size", "value"]
    return (df.select(F.inline(cells)).where(F.col("value_size") > DIGEST_FROM).join(lookup(of.select(*keys)), keys)
            .groupBy(*keys).agg(F.min(part(F.col("text"))).alias("part")))


def refined(df: DataFrame, columns: Sequence[str], top: DataFrame, k: int) -> DataFrame:
    """``top`` of ``rank_frequencies`` cut to ``k`` values per column, or those that no further character tells apart.

    While more than ``k`` stay, the values that tie at the border are compared by their next
    characters, twice as many each time: texts that begin alike are never ranked whole.
    """
    done = DIGEST_FROM
    width = DIGEST_FROM
    while True:
        sizes = top.groupBy("__c").agg(F.count(F.lit(1)).alias("kept"), F.max("rank").alias("border"), F.max("value_size").alias("longest"))
        open_ = [r for r in sizes.collect() if r["kept"] > k and r["longest"] > done]  # a row a column
        if not open_:
            return top
        borders = F.array(*[F.struct(F.lit(r["__c"]).alias("c"), F.lit(r["border"]).alias("b")) for r in open_])
        tied = F.exists(borders, lambda x: (x["c"] == F.col("__c")) & (x["b"] == F.col("rank")))
        start = done + 1
        more = _long_texts(df, columns, top.where(tied & (F.col("value_size") > DIGEST_FROM)), lambda text: F.substring(text, start, width))
        further = W.partitionBy("__c").orderBy("rank", F.coalesce("part", F.lit("")))
        keys = ["__c", "value_size", "value"]
        top = durable(top.join(more, keys, "left").withColumn("rank", F.rank().over(further)).where(F.col("rank") <= k).drop("part"))
        done, width = done + width, width * 2


def top_values(df: DataFrame, columns: Sequence[str], k: int = 5) -> DataFrame:
    """column, rank, value, cnt, percentage of the ``k`` most frequent non-null values per column.

    Ties go to the smallest value. Long texts are counted by digest and compared by their
    first characters, at the border by more of them; only winners are read back whole.
    """
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, rank int, value string, cnt long, percentage double")
    freq = compact_frequencies(df, columns)
    totals = freq.groupBy("__c").agg(F.sum("cnt").alias("total"))
    top = refined(df, columns, durable(rank_frequencies(freq, k)), k)
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("__c") + 1).alias("column")
    digests = top.where(F.col("value_size") > DIGEST_FROM)
    text = F.col("value")
    if not digests.isEmpty():
        top = top.join(_long_texts(df, columns, digests, lambda t: t), ["__c", "value_size", "value"], "left")  # k rows a column
        text = F.coalesce("part", "value")
    ordered = W.partitionBy("__c").orderBy(F.desc("cnt"), "text")
    best = (top.select("__c", text.alias("text"), "cnt").withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= k).join(totals, "__c"))
    return best.select(name, "rank", F.col("text").alias("value"), "cnt", percent("cnt", "total").alias("percentage"))


def _pair_rows(spark, columns: Sequence[str], found: Summary) -> DataFrame:
    k = len(columns)
    pairs = [(i, j) for i in range(k) for j in range(i + 1, k)]
    rows = [(ord_, columns[i], columns[j], found.correlation(i, j)) for ord_, (i, j) in enumerate(pairs)]
    return local_rows(spark, [r for r in rows if r[3] is not None], "ord int, column1 string, column2 string, correlation double")


def pair_correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame | None:
    """Pearson of every pair, over the rows where both are present, in one scan for all pairs."""
    return None if len(columns) < 2 else _pair_rows(df.sparkSession, columns, summarize(df, columns, sketched=False))
