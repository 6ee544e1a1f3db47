"""Preparing a table for modelling: target choice, cleaning, encoding, scaling, splitting."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabscout.functions.stats import guarded_corr
from tabscout.functions.text import ref
from tabscout.operators.profile import Profile, clean, columns_of, number_cell, per_column, top_values, value_text
from tabscout.plans.durable import BROADCAST_BYTES, LOOKUP_ROWS, durable, lookup
from tabscout.plans.orderstats import dense_ids, md5_cutoffs, quantiles, tie_key

# Column names that usually hold the target.
TARGET_NAMES = [
    "target", "label", "class", "category", "output", "prediction", "price", "salary", "revenue", "sales", "profit", "amount",
    "churn", "fraud", "default", "outcome", "result", "status", "rating", "score", "grade", "rank", "survived", "approved",
]
TEXT_NULL = "None"
#: Rows that are worth a task of their own when models are fitted, and the most that a task gets.
LEAST_ROWS, MOST_ROWS = 4096, 1 << 20


# -- choosing target and types from the column profile (one row per column and dataset) --

def detect_target(columns: DataFrame) -> DataFrame:
    """Per dataset: a usual target name, else the fewest-valued plausible column, else the last."""
    named = F.lower("name").isin(TARGET_NAMES)
    share = F.try_divide(F.col("unique_count"), F.col("total_rows"))
    plausible = F.col("unique_count").between(2, 20) | ((share < 0.1) & (F.col("unique_count") > 1))
    picked = columns.groupBy("dataset_id").agg(
        F.min_by("name", F.when(named, F.col("ord"))).alias("by_name"),
        F.min_by("name", F.when(plausible, F.struct("unique_count", "ord"))).alias("by_values"), F.max_by("name", "ord").alias("last"))
    return picked.select("dataset_id", F.coalesce("by_name", "by_values", "last").alias("target"),
                         F.when(F.col("by_name").isNotNull(), "name").when(F.col("by_values").isNotNull(), "values").otherwise("last").alias("reason"))


def suggest_target(columns: DataFrame) -> DataFrame:
    """Per dataset: last numeric column with 2..n/2 values (regression), else last categorical."""
    fits = (F.col("unique_count") >= 2) & (F.col("unique_count") <= F.col("total_rows") * 0.5)
    number = fits & (F.col("column_type") == "numeric")
    picked = columns.groupBy("dataset_id").agg(
        F.max_by("name", F.when(number, F.col("ord"))).alias("n"),
        F.max_by("name", F.when(fits & (F.col("column_type") != "numeric"), F.col("ord"))).alias("c"))
    return picked.select("dataset_id", F.coalesce("n", "c").alias("target"),
                         F.when(F.col("n").isNotNull(), "regression").when(F.col("c").isNotNull(), "classification").alias("problem_type"))


def suggest_last(columns: DataFrame) -> DataFrame:
    """Per dataset: the last column; numeric with 5 % distinct values or more is regression."""
    picked = columns.groupBy("dataset_id").agg(F.max_by(F.struct("name", "column_type", "unique_count", "total_rows"), "ord").alias("l"))
    regression = (F.col("l.column_type") == "numeric") & (F.try_divide(F.col("l.unique_count"), F.col("l.total_rows")) >= 0.05)
    return picked.select("dataset_id", F.col("l.name").alias("target"), F.when(regression, "regression").otherwise("classification").alias("problem_type"))


def integer_ranges(df: DataFrame) -> DataFrame:
    """name, span (max - min) of integer columns."""
    whole = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.IntegerType, T.LongType, T.ShortType, T.ByteType))]
    if not whole:
        return df.sparkSession.createDataFrame([], "name string, span double")
    span = (F.max("value") - F.min("value")).alias("span")
    return per_column(df, whole, number_cell, [span]).withColumnRenamed("column", "name").select("name", "span")


def problem_types(columns: DataFrame, spans: DataFrame, strict: bool = False) -> DataFrame:
    """The problem each column would pose as a target. ``strict``: under 20 values, no span rule."""
    share = F.try_divide(F.col("unique_count"), F.col("total_rows"))
    text = F.col("column_type") == "categorical"
    few = F.col("unique_count") < 20 if strict else F.col("unique_count") <= 20
    rule = text | few | (share < 0.05)
    if not strict:
        rule = rule | F.coalesce(F.col("span") <= 50, F.lit(False))
    on = [c for c in ("dataset_id", "name") if c in spans.columns]
    joined = columns.join(spans, on, "left")
    return joined.select("dataset_id", "ord", "name", F.when(rule, "classification").otherwise("regression").alias("problem_type"))


def feature_types(columns: DataFrame) -> DataFrame:
    """id, numeric, categorical, datetime, text or boolean for each column."""
    unique = F.col("unique_count")
    text = F.col("dtype") == "string"
    kind = (F.when((unique == F.col("total_rows")) | (F.try_divide(unique, F.col("total_rows")) > 0.95), "id")
            .when(F.col("column_type") == "numeric", F.when(unique <= 10, "categorical").otherwise("numeric"))
            .when(F.col("column_type") == "datetime", "datetime").when(F.col("dtype") == "boolean", "boolean")
            .when(text, F.when(unique <= 50, "categorical").otherwise("text")))
    return columns.select("dataset_id", "ord", "name", kind.alias("feature_type")).where("feature_type is not null")


def useless(columns: DataFrame, target: str | None = None) -> DataFrame:
    """Columns to drop before modelling, with the reason."""
    reason = (F.when(F.col("unique_count") <= 1, "constant").when(F.col("unique_count") == F.col("total_rows"), "all unique")
              .when(F.try_divide(F.col("missing_count"), F.col("total_rows")) > 0.95, "mostly missing"))
    found = columns.select("ord", "name", reason.alias("reason")).where("reason is not null")
    return found if target is None else found.where(F.col("name") != target)


# -- rows --

def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    return df.na.drop(subset=[target])


def keep_valid_classes(df: DataFrame, target: str, least: int = 2) -> DataFrame:
    """Rows whose class has at least ``least`` rows."""
    enough = df.groupBy(ref(target).alias("__class")).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least).select("__class")
    return df.join(enough, ref(target) == F.col("__class"), "left_semi")


# -- missing values and outliers: one fitted row per table, applied as literals --

def fit_means(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    row = df.agg(*[F.avg(ref(c)).alias(f"m{i}") for i, c in enumerate(columns)]).first() if columns else []
    return {c: row[i] for i, c in enumerate(columns) if row[i] is not None}


def fit_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    return {r["column"]: r["q"][0] for r in quantiles(df, columns, [0.5]).collect()} if columns else {}


def fit_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Most frequent text per column; ties: the smallest."""
    return {r["column"]: r["value"] for r in top_values(df, columns, 1).collect()} if columns else {}


def fill(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Gaps replaced by a number, or by a text in the value's text form."""
    kinds = {f.name: f for f in df.schema.fields}
    return df.withColumns({c: F.coalesce(ref(c).cast("double") if isinstance(v, float) else value_text(kinds[c]), F.lit(v)) for c, v in values.items()}) if values else df


def fit_fences(df: DataFrame, columns: Sequence[str], k: float = 3.0, most: float = 0.05) -> dict[str, tuple[float, float]]:
    """k x IQR fences of the columns that have outliers, but fewer than ``most`` of the rows."""
    if not columns:
        return {}
    found = {}
    for r in quantiles(df, columns, [0.25, 0.75]).collect():
        spread = (r["q"][1] - r["q"][0]) * k
        found[r["column"]] = (r["q"][0] - spread, r["q"][1] + spread)
    if not found:
        return {}
    beyond = df.agg(F.count(F.lit(1)).alias("n"), *[
        F.count(F.when((ref(c) < lo) | (ref(c) > hi), 1)).alias(f"o{i}") for i, (c, (lo, hi)) in enumerate(found.items())]).first()
    return {c: f for i, (c, f) in enumerate(found.items()) if 0 < beyond[f"o{i}"] < most * beyond["n"]}


def clip(df: DataFrame, fences: Mapping[str, tuple[float, float]]) -> DataFrame:
    def inside(c, lo, hi):
        return F.when(ref(c).isNotNull(), F.least(F.greatest(ref(c).cast("double"), F.lit(lo)), F.lit(hi)))
    return df.withColumns({c: inside(c, *f) for c, f in fences.items()}) if fences else df


# -- text to numbers --

def fit_codes(df: DataFrame, column: str) -> DataFrame:
    """value, code: the position of each distinct text in sorted order; null counts as a text."""
    text = F.coalesce(ref(column).cast("string"), F.lit(TEXT_NULL)).alias("value")
    return durable(dense_ids(df.select(text).distinct(), "value"))


def encode(df: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    """Replace a text column by its code; a text not seen when fitting gets code 0."""
    size = codes.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value")).alias("b")).first()
    table = codes.select(F.col("value").alias("__value"), F.col("code").alias("__code"))
    if size["n"] <= LOOKUP_ROWS and (size["b"] or 0) <= BROADCAST_BYTES:
        table = F.broadcast(table)
    text = F.coalesce(ref(column).cast("string"), F.lit(TEXT_NULL))
    # Codes are unique, so with a large table a hot text only lengthens one side, which AQE splits.
    joined = df.join(table, text == F.col("__value"), "left")
    return joined.withColumn(column, F.coalesce("__code", F.lit(0).cast("bigint"))).select(*[ref(c) for c in df.columns])


# -- scaling and features --

def fit_standard(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """(mean, population deviation) per column; a constant column is only centred."""
    row = df.agg(*[F.struct(F.avg(ref(c)), F.stddev_pop(ref(c))).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    return {c: (row[i][0], row[i][1] or 1.0) for i, c in enumerate(columns) if row[i][0] is not None}


def fit_robust(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """(median, IQR) per column; a zero IQR leaves the scale."""
    found = quantiles(df, columns, [0.25, 0.5, 0.75]).collect()
    return {r["column"]: (r["q"][1], (r["q"][2] - r["q"][0]) or 1.0) for r in found}


def scale(df: DataFrame, stats: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (ref(c) - F.lit(float(centre))) / F.lit(float(width)) for c, (centre, width) in stats.items()}) if stats else df


def top_correlated(df: DataFrame, columns: Sequence[str], target: str, k: int = 3) -> list[str]:
    row = df.agg(*[guarded_corr(ref(c), ref(target)).alias(f"r{i}") for i, c in enumerate(columns)]).first()
    known = [(abs(row[i]), -i, c) for i, c in enumerate(columns) if row[i] is not None]
    return [c for _, _, c in sorted(known, reverse=True)[:k]]


def top_variance(df: DataFrame, columns: Sequence[str], k: int = 2) -> list[str]:
    row = df.agg(*[F.var_samp(ref(c)).alias(f"v{i}") for i, c in enumerate(columns)]).first()
    known = [(row[i], -i, c) for i, c in enumerate(columns) if row[i] is not None]
    return [c for _, _, c in sorted(known, reverse=True)[:k]]


def add_powers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    new = {}
    for c in columns:
        new[f"{c}_squared"] = F.pow(ref(c).cast("double"), F.lit(2.0))
        new[f"{c}_log"] = F.log1p(F.abs(ref(c).cast("double")))
    return df.withColumns(new) if new else df


def add_interaction(df: DataFrame, a: str, b: str) -> DataFrame:
    x, y = ref(a).cast("double"), ref(b).cast("double")
    return df.withColumns({f"{a}_x_{b}": x * y, f"{a}_div_{b}": F.try_divide(x, y + F.lit(1e-10))})


def variances(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(name, variance): the population variance of each column; null where there is none."""
    return per_column(df, columns, number_cell, [F.var_pop("value").alias("variance")]).select(F.col("column").alias("name"), "variance")


def varied(df: DataFrame, columns: Sequence[str], threshold: float | None = 0.01) -> list[str]:
    """Columns whose population variance exceeds ``threshold``; with None, whose variance is not zero."""
    if not columns:
        return []
    row = df.agg(*[F.var_pop(ref(c).cast("double")).alias(f"v{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if row[i] is not None and row[i] > (threshold or 0.0)]


# -- splits: thresholds in md5 order of the key, so no rows are shuffled to be split --

def test_share(rows: int) -> float:
    return min(0.2, max(0.1, 5 / rows))


def _with_cuts(df: DataFrame, label: str, key: str, cuts: DataFrame) -> DataFrame:
    per_label = cuts.groupBy(F.col("label").alias("__label")).agg(F.sort_array(F.collect_list(F.struct("i", "cut"))).alias("__cuts"))
    here = F.struct(tie_key(ref(key)).alias("__t"), ref(key).alias("__k"))
    return (df.join(lookup(per_label), ref(label) == F.col("__label"), "left")
            .withColumn("__passed", F.size(F.filter("__cuts", lambda c: here > c["cut"]))))


def stratified_split(df: DataFrame, label: str, key: str, share: float | None = None) -> DataFrame:
    """Add ``is_test``: per label, the first round(share x n) rows in md5 order of ``key``."""
    if share is None:
        share = test_share(max(df.count(), 1))
    ranks = F.array(F.round(F.col("n") * F.lit(share)).cast("bigint"))
    cut = _with_cuts(df, label, key, md5_cutoffs(df, label, key, ranks))
    return cut.withColumn("is_test", (F.size(F.coalesce("__cuts", F.array())) > 0) & (F.col("__passed") == 0)).select(*[ref(c) for c in df.columns], "is_test")


def plain_split(df: DataFrame, key: str, share: float | None = None) -> DataFrame:
    return stratified_split(df.withColumn("__one", F.lit(1)), "__one", key, share).drop("__one")


def stratified_folds(df: DataFrame, label: str, key: str, k: int) -> DataFrame:
    """Add ``fold`` (0..k-1): per label, k even runs in md5 order of ``key``."""
    ranks = F.array(*[F.ceil(F.col("n") * F.lit(i) / F.lit(k)).cast("bigint") for i in range(1, k)])
    cut = _with_cuts(df, label, key, md5_cutoffs(df, label, key, ranks))
    # A label smaller than k repeats some cut ranks; each passed cut still moves one fold on.
    return cut.withColumn("fold", F.least(F.coalesce("__passed", F.lit(0)), F.lit(k - 1))).select(*[ref(c) for c in df.columns], "fold")


# -- class balance --

def class_balance(df: DataFrame, target: str) -> DataFrame:
    """One row: majority, minority, ratio and whether the ratio exceeds two."""
    counts = df.where(ref(target).isNotNull()).groupBy(ref(target).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.max("n").alias("majority"), F.min("n").alias("minority")).select(
        "majority", "minority", F.try_divide(F.col("majority"), F.col("minority")).alias("ratio"),
        (F.try_divide(F.col("majority"), F.col("minority")) > 2).alias("imbalanced"))


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """class, rows, weight = n / (classes x rows)."""
    counts = df.where(ref(target).isNotNull()).groupBy(ref(target).alias("class")).agg(F.count(F.lit(1)).alias("rows"))
    total = counts.agg(F.struct(F.sum("rows").alias("n"), F.count(F.lit(1)).alias("k")).alias("t")).scalar()
    return counts.select("class", "rows", (total["n"] / (total["k"] * F.col("rows"))).alias("weight"))


# -- fitted preparation --

@dataclass
class FittedPrep:
    """What was learnt from the training table; ``transform`` applies it to any other."""
    target: str
    problem_type: str
    dropped: list[str] = field(default_factory=list)
    fills: dict[str, object] = field(default_factory=dict)
    codes: dict[str, DataFrame] = field(default_factory=dict)
    powers: list[str] = field(default_factory=list)
    interaction: list[str] = field(default_factory=list)
    kept: list[str] = field(default_factory=list)
    scales: dict[str, tuple[float, float]] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        out = fill(clean(df).drop(*self.dropped), self.fills)
        out = clip(out, fit_fences(out, _features(out, self.target)))  # fences follow the table at hand
        out = _engineer(_encode_all(out, self.codes), self)
        return scale(out.select(*[ref(c) for c in self.kept], *[ref(self.target)] if self.target in out.columns else []), self.scales)


def _features(df: DataFrame, target: str) -> list[str]:
    return [c for c in columns_of(df, "numeric") if c != target]


def _encode_all(df: DataFrame, codes: Mapping[str, DataFrame]) -> DataFrame:
    for column, table in codes.items():
        df = encode(df, column, table)
    return df


def _engineer(df: DataFrame, prep: FittedPrep) -> DataFrame:
    out = add_powers(df, prep.powers)
    return add_interaction(out, *prep.interaction) if len(prep.interaction) == 2 else out


def fit_prep(df: DataFrame, target: str, problem_type: str | None = None) -> tuple[FittedPrep, DataFrame]:
    """Learn the preparation in order: type, useless, impute, clip, encode, engineer, variance, scale.

    Datetime columns are left out of the features.
    """
    df = clean(df)  # NaN and infinities are gaps here as in the profile
    profile = Profile(df)
    columns = profile.columns.withColumn("dataset_id", F.lit(""))
    if problem_type is None:
        problem_type = problem_types(columns, integer_ranges(df), strict=True).where(F.col("name") == target).first()["problem_type"]
    prep = FittedPrep(target, problem_type)
    prep.dropped = [r["name"] for r in useless(columns, target).orderBy("ord").collect()]
    out = df.drop(*prep.dropped, *[c for c in profile.datetime if c != target])
    prep.dropped += [c for c in profile.datetime if c != target]
    gaps = {r["name"] for r in columns.where("missing_count > 0").collect()}
    texts = [c for c in columns_of(out, "categorical") if c != target]
    # Other kinds become text before they are encoded, so a text may fill them.
    out = out.withColumns({f.name: value_text(f) for f in out.schema.fields if f.name in texts and f.dataType.typeName() != "string"})
    prep.fills = {**fit_medians(out, [c for c in _features(out, target) if c in gaps]), **fit_modes(out, [c for c in texts if c in gaps])}
    out = fill(out, prep.fills)
    out = clip(out, fit_fences(out, _features(out, target)))
    prep.codes = {c: fit_codes(out, c) for c in texts}
    out = _encode_all(out, prep.codes)
    numeric = _features(out, target)
    if len(numeric) >= 2:
        prep.powers = top_correlated(out, numeric, target) if problem_type == "regression" else []
        prep.interaction = top_variance(out, numeric)
    out = _engineer(out, prep)
    prep.kept = varied(out, _features(out, target))
    out = out.select(*[ref(c) for c in prep.kept], ref(target))
    prep.scales = fit_robust(out, prep.kept) if prep.kept else {}
    return prep, scale(out, prep.scales)


@dataclass
class TrainingData:
    train: DataFrame
    test: DataFrame
    features: list[str]
    target: str
    problem_type: str
    classes: DataFrame | None  # value, code of the encoded target
    rows: int


def evenly(df: DataFrame, rows: int, order: Sequence[str]) -> DataFrame:
    """``df`` written in even parts, as many as there are cores, each sorted by ``order``, so that reruns agree.

    Fitting passes over the rows hundreds of times. A table of few bytes is one part of a
    file or a shuffle however many rows it has, and one core would do all of the work; with
    more parts than cores, trees would send their node statistics more often than needed.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = max(min(cores, rows // LEAST_ROWS), math.ceil(rows / MOST_ROWS))
    return durable(df.repartition(parts).sortWithinPartitions(*[ref(c) for c in order]) if parts > 1 else df)


def prepare(df: DataFrame, target: str, problem_type: str, key: str) -> TrainingData:
    """The live preparation: drop, encode, fill, split, scale; ``key`` orders the split and is no feature."""
    out = drop_null_target(clean(df), target)
    # Read about ten times below; what it is derived from, once.
    out = durable(out.drop(*[c for c in columns_of(out, "datetime") if c not in (key, target)]))
    if problem_type == "classification":
        sizes = out.groupBy(ref(target)).count().where("count >= 2").limit(2).count()
        if sizes < 2:
            raise ValueError("each class needs two samples and there must be two classes")
        out = keep_valid_classes(out, target)
    texts = [c for c in columns_of(out, "categorical") if c not in (key, target)]
    for c in texts:
        out = encode(out, c, fit_codes(out, c))
    classes = None
    if problem_type == "classification":
        classes = fit_codes(out, target)
        out = encode(out, target, classes)
    numeric = [c for c in _features(out, target) if c != key]
    out = fill(out, {c: float(v) for c, v in fit_means(out, numeric).items()})
    features = varied(out, numeric, None)
    out = out.select(ref(key), ref(target).cast("double").alias(target), *[ref(c).cast("double").alias(c) for c in features])
    rows = out.count()
    if rows < 10:
        raise ValueError(f"found {rows} samples, need at least 10")
    share = test_share(rows)
    split = stratified_split(out, target, key, share) if problem_type == "classification" else plain_split(out, key, share)
    split = evenly(split, rows, [key, target, *features])
    train, test = split.where("not is_test").drop("is_test"), split.where("is_test").drop("is_test")
    stats = fit_standard(train, features)
    return TrainingData(scale(train, stats), scale(test, stats), features, target, problem_type, classes, rows)
