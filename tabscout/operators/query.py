"""One-table queries described by a small declarative spec."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from tabscout.functions.text import like, ref
from tabscout.plans import sizing
from tabscout.plans.orderstats import quantiles, same_keys

MAX_ROWS = 200

COMPARISONS = {
    "==": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    ">": lambda c, v: c > v,
    "<": lambda c, v: c < v,
    ">=": lambda c, v: c >= v,
    "<=": lambda c, v: c <= v,
    "like": like,
    "in": lambda c, v: c.isin(list(v)) if v else F.lit(False),
    "between": lambda c, v: c.between(v[0], v[1]),
}

def _median(column: Column) -> Column:
    """NaN is no value for an order statistic, whatever the input's size."""
    return F.median(F.when(~F.isnan(column.cast("double")), column))


AGGREGATES = {
    "sum": F.sum, "mean": F.avg, "count": F.count,
    "min": F.min, "max": F.max, "median": _median,
}


@dataclass(frozen=True)
class Filter:
    column: str
    operator: str
    value: Any

    def __post_init__(self):
        if self.operator not in COMPARISONS:
            raise ValueError(f"unknown operator {self.operator!r}")
        many = isinstance(self.value, (list, tuple))
        if self.operator == "between" and not (many and len(self.value) == 2):
            raise ValueError("'between' needs a list of two values")
        if self.operator == "in" and not many:
            raise ValueError("'in' needs a list of values")


@dataclass(frozen=True)
class Aggregation:
    column: str
    function: str
    alias: str | None = None

    def __post_init__(self):
        if self.function not in AGGREGATES:
            raise ValueError(f"unknown function {self.function!r}")

    @property
    def name(self) -> str:
        return self.alias or f"{self.function}_{self.column}"


@dataclass(frozen=True)
class Sort:
    column: str
    descending: bool = False


@dataclass(frozen=True)
class QuerySpec:
    select: Sequence[str] | None = None
    filters: Sequence[Filter] = field(default_factory=tuple)
    groupby: Sequence[str] = field(default_factory=tuple)
    aggregations: Sequence[Aggregation] = field(default_factory=tuple)
    sort: Sequence[Sort] = field(default_factory=tuple)
    limit: int = 100

    def __post_init__(self):
        if not 1 <= self.limit <= MAX_ROWS:
            raise ValueError(f"limit must be between 1 and {MAX_ROWS}")

    @classmethod
    def from_dict(cls, spec: Mapping[str, Any]) -> "QuerySpec":
        unknown = set(spec) - set(cls.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown fields {sorted(unknown)}")
        parts = {"filters": Filter, "aggregations": Aggregation, "sort": Sort}
        given = {k: v for k, v in spec.items() if v is not None}
        return cls(**{k: tuple(parts[k](**item) for item in v) if k in parts else v
                      for k, v in given.items()})


def run(df: DataFrame, spec: QuerySpec | Mapping[str, Any]) -> DataFrame:
    """The lazy DataFrame that answers ``spec`` over ``df``."""
    if not isinstance(spec, QuerySpec):
        spec = QuerySpec.from_dict(spec)
    _check_columns(df, spec)
    kept = df
    if spec.filters:
        kept = df.where(reduce(lambda a, b: a & b,
                               [COMPARISONS[f.operator](ref(f.column), f.value) for f in spec.filters]))
    result = aggregate(kept, spec.groupby, spec.aggregations) if spec.aggregations else kept
    if spec.sort:
        result = result.orderBy(*[ref(s.column).desc_nulls_last() if s.descending
                                  else ref(s.column).asc_nulls_last() for s in spec.sort])
    result = result.limit(spec.limit)
    if spec.select and not spec.aggregations:
        result = result.select(*[ref(c) for c in spec.select])
    return result


def aggregate(df: DataFrame, groupby: Sequence[str], aggregations: Sequence[Aggregation]) -> DataFrame:
    """Grouped (or global) aggregates; keys come first, in reverse request order."""
    keys = list(dict.fromkeys(groupby))
    medians = list(dict.fromkeys(a.column for a in aggregations if a.function == "median"))
    needed = df.select(*[ref(c) for c in dict.fromkeys([*keys, *[a.column for a in aggregations]])])
    spread = bool(medians) and not sizing.is_small(needed)
    direct = [a for a in aggregations if not (spread and a.function == "median")]
    result = df.groupBy(*[ref(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("__rows"), *[AGGREGATES[a.function](ref(a.column)).alias(a.name) for a in direct])
    if spread:
        result = _join_medians(result, needed, keys, medians, aggregations)
    return result.select(*[ref(k) for k in reversed(keys)], *[ref(a.name) for a in aggregations])


def _join_medians(result, needed, keys, medians, aggregations) -> DataFrame:
    """Medians of large inputs: exact order statistics instead of one buffer per group."""
    found = quantiles(needed, medians, [0.5], keys=keys)
    per_key = found.groupBy(*[ref(k) for k in keys]).agg(*[
        F.max(F.when(F.col("column") == a.column, F.col("q")[0])).alias(a.name)
        for a in aggregations if a.function == "median"])
    on = reduce(lambda a, b: a & b, same_keys("a", "m", keys), F.lit(True))
    names = [ref(a.name) for a in aggregations if a.function == "median"]
    return result.alias("a").join(per_key.alias("m"), on, "left").select("a.*", *names)


def _check_columns(df: DataFrame, spec: QuerySpec) -> None:
    known = {c.lower() for c in df.columns}
    used = [*(spec.select or ()), *spec.groupby, *[f.column for f in spec.filters],
            *[a.column for a in spec.aggregations]]
    produced = {a.name.lower() for a in spec.aggregations}
    used += [s.column for s in spec.sort if s.column.lower() not in produced]
    missing = sorted({c for c in used if c.lower() not in known})
    if missing:
        raise ValueError(f"unknown columns {missing}")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Frequency of each non-null value; ties in order of the value."""
    return (df.where(ref(column).isNotNull()).groupBy(ref(column).alias("value"))
            .agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "value"))


def group_topk(df: DataFrame, category: str, number: str, function: str = "mean", k: int = 15) -> DataFrame:
    """The ``k`` categories with the highest aggregate of ``number``."""
    return (df.where(ref(category).isNotNull()).groupBy(ref(category).alias("name"))
            .agg(AGGREGATES[function](ref(number)).alias("value"))
            .orderBy(F.desc_nulls_last("value"), "name").limit(k))


def argmax_group(df: DataFrame, category: str, number: str | None = None) -> DataFrame:
    """The category with the highest mean of ``number``, or the most frequent one."""
    measure = F.avg(ref(number)) if number else F.count(F.lit(1)).cast("double")
    return (df.where(ref(category).isNotNull()).groupBy(ref(category).alias("name"))
            .agg(measure.alias("value")).orderBy(F.desc_nulls_last("value"), "name").limit(1))


def distinct_count(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Non-null distinct values per column."""
    from tabscout.operators.profile import distinct_counts

    if approximate:
        cells = [F.struct(F.lit(c).alias("column"), F.approx_count_distinct(ref(c)).alias("unique_count"))
                 for c in columns]
        return df.agg(F.array(*cells).alias("c")).select(F.inline("c"))
    return distinct_counts(df, columns)


def count_distinct_where(df: DataFrame, keys: Sequence[str], column: str, condition: Column) -> DataFrame:
    """Distinct values of ``column``, all and among rows meeting ``condition``."""
    return df.groupBy(*[ref(k) for k in keys]).agg(
        F.count_distinct(ref(column)).alias("total"),
        F.count_distinct(F.when(condition, ref(column))).alias("matching"))
