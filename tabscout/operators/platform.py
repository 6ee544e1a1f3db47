"""Summaries over related tables: owners, entities and their children.

Children are counted per parent before any join, so no join multiplies rows and a
parent with very many children costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tabscout.functions.text import ref


@dataclass(frozen=True)
class Child:
    """A table whose rows belong to an entity through ``parent``; counted as ``name``."""
    rows: DataFrame
    parent: str
    id: str
    name: str
    best: str | None = None  # also report the highest value of this column

    def counted(self) -> DataFrame:
        measures = [F.count_distinct(ref(self.id)).alias(self.name)]
        if self.best:
            measures.append(F.max(ref(self.best)).alias(f"best_{self.best}"))
        return self.rows.where(ref(self.parent).isNotNull()).groupBy(ref(self.parent).alias("__parent")).agg(*measures)


def entity_summary(entities: DataFrame, owners: DataFrame, key: str, owner: str, owner_key: str, children: Sequence[Child],
                   lookup: tuple[DataFrame, str, str] | None = None) -> DataFrame:
    """Each owned entity with its owner, an optional lookup row and distinct child counts.

    Children are joined first: they are counted by the entity's key, so one exchange of the
    entities serves them all.
    """
    out, added = entities, []
    for child in children:
        out = out.join(child.counted(), ref(key) == F.col("__parent"), "left").drop("__parent") \
            .withColumn(child.name, F.coalesce(ref(child.name), F.lit(0).cast("bigint")))
        added += [child.name, *([f"best_{child.best}"] if child.best else [])]
    out = out.join(owners, ref(owner) == ref(owner_key))
    if lookup:
        table, left, right = lookup
        out = out.join(table, ref(left) == ref(right), "left")
    return out.select(*[ref(c) for c in out.columns if c not in added], *[ref(c) for c in added])


def owner_stats(owners: DataFrame, entities: DataFrame, exports: DataFrame, history: DataFrame, *, owner_key: str, owner: str, key: str,
                public: Column, views: str, created: str, export_parent: str, export_id: str, history_owner: str, history_id: str,
                as_written: bool = False) -> DataFrame:
    """Per owner: entities, public ones, views, latest entity, exports and questions.

    ``as_written`` repeats an entity's views for each of its exports and each question
    of the owner, as a single join over all children would.
    """
    exported = (exports.where(ref(export_parent).isNotNull()).groupBy(ref(export_parent).alias("__parent"))
                .agg(F.count_distinct(ref(export_id)).alias("exports"), F.count(F.lit(1)).alias("copies")))
    asked = (history.where(ref(history_owner).isNotNull()).groupBy(ref(history_owner).alias("__asker"))
             .agg(F.count_distinct(ref(history_id)).alias("total_queries"), F.count(F.lit(1)).alias("asked")))
    weight = F.coalesce("copies", F.lit(1)) if as_written else F.lit(1)
    per_owner = (entities.join(exported, ref(key) == F.col("__parent"), "left").groupBy(ref(owner).alias("__owner")).agg(
        F.count(ref(key)).alias("total_entities"), F.count(F.when(public, 1)).alias("public_entities"),
        F.sum(ref(views) * weight).alias("total_views"), F.max(ref(created)).alias("last_created"), F.sum("exports").alias("total_exports")))
    zero = F.lit(0).cast("bigint")
    repeat = F.coalesce("asked", F.lit(1)) if as_written else F.lit(1)
    return (owners.join(per_owner, ref(owner_key) == F.col("__owner"), "left").join(asked, ref(owner_key) == F.col("__asker"), "left")
            .select(*[ref(c) for c in owners.columns], F.coalesce("total_entities", zero).alias("total_entities"),
                    F.coalesce("public_entities", zero).alias("public_entities"), (F.col("total_views") * repeat).alias("total_views"),
                    "last_created", F.coalesce("total_exports", zero).alias("total_exports"), F.coalesce("total_queries", zero).alias("total_queries")))


def owner_totals(entities: DataFrame, models: DataFrame, key: str, model_parent: str, owner: str) -> DataFrame:
    """Per owner: number of entities, and of entities with a model."""
    trained = models.select(ref(model_parent).alias("__parent"), F.lit(1).alias("__trained")).distinct()
    return (entities.join(trained, ref(key) == F.col("__parent"), "left").groupBy(ref(owner).alias(owner))
            .agg(F.count(F.lit(1)).alias("total_datasets"), F.count("__trained").alias("models_trained"))
            .withColumn("ready_reports", F.col("total_datasets")))


def orphans(child: DataFrame, parent: DataFrame, foreign_key: str, key: str) -> DataFrame:
    """Child rows whose parent does not exist; a null key has no parent to miss."""
    keys = parent.select(ref(key).alias("__key"))
    return child.where(ref(foreign_key).isNotNull()).join(keys, ref(foreign_key) == F.col("__key"), "left_anti")


def delete_cascade(deleted: DataFrame, key: str, children: Mapping[str, tuple[DataFrame, str]], set_null: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Children after ``deleted`` parents are gone: rows dropped, or keys nulled for ``set_null``."""
    gone = deleted.select(ref(key).alias("__gone")).distinct()
    result = {}
    for name, (rows, foreign_key) in children.items():
        if name in set_null:
            marked = rows.join(gone, ref(foreign_key) == F.col("__gone"), "left")
            result[name] = marked.withColumn(foreign_key, F.when(F.col("__gone").isNull(), ref(foreign_key))).select(*[ref(c) for c in rows.columns])
        else:
            result[name] = rows.join(gone, ref(foreign_key) == F.col("__gone"), "left_anti")
    return result


def best_per_key(rows: DataFrame, key: str, order: Sequence[str], tie: str) -> DataFrame:
    """The row with the highest ``order`` columns per key, nulls last; ties by smallest ``tie``.

    An aggregate keeps one candidate per key and task, so a hot key is never gathered.
    """
    rank = F.struct(*[e.alias(f"r{i}{j}") for i, c in enumerate(order) for j, e in enumerate((ref(c).isNotNull(), ref(c)))], (-ref(tie)).alias("t"))
    whole = F.struct(*[ref(c) for c in rows.columns if c != key])
    best = rows.groupBy(ref(key)).agg(F.max_by(whole, rank).alias("__best"))
    return best.select(ref(key), "__best.*").select(*[ref(c) for c in rows.columns])


def page(rows: DataFrame, order: Sequence[Column], limit: int = 20, offset: int = 0, most: int = 50) -> DataFrame:
    """One page in the given order, never more than ``most`` rows."""
    return rows.orderBy(*order).offset(offset).limit(min(limit, most))


def history_page(history: DataFrame, condition: Column, time: str, key: str, limit: int = 20, offset: int = 0) -> DataFrame:
    """Newest questions first, with the total that match."""
    matching = history.where(condition)
    total = matching.agg(F.count(F.lit(1)).alias("n")).scalar()
    return page(matching, [ref(time).desc_nulls_last(), ref(key).asc()], limit, offset).withColumn("total_count", total)


def owned(entities: DataFrame, owner: str, value, created: str, key: str, columns: Sequence[str], only=None) -> DataFrame:
    """An owner's entities (or one of them), newest first."""
    rows = entities.where(ref(owner) == value)
    if only is not None:
        rows = rows.where(ref(key) == only)
    return rows.orderBy(ref(created).desc_nulls_last(), ref(key)).select(*[ref(c) for c in columns])


def rank_models(results: DataFrame, dataset: str, score: str, name: str) -> DataFrame:
    """Results by score, the best one flagged (first name on ties), score as a percentage."""
    best = results.groupBy(ref(dataset).alias("__d")).agg(F.min_by(ref(name), F.struct(-ref(score), ref(name))).alias("__best"))
    return (results.join(best, ref(dataset) == F.col("__d"))
            .withColumns({"is_best": ref(name) == F.col("__best"), "accuracy": F.round(ref(score) * 100, 1)})
            .drop("__d", "__best").orderBy(ref(dataset), ref(score).desc_nulls_last(), ref(name)))


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def touch_updated(old: DataFrame, new: DataFrame, key: str, updated: str, at: Column) -> DataFrame:
    """``new`` with ``updated`` set to ``at`` on rows that differ from ``old``."""
    compared = [c for c in new.columns if c not in (key, updated)]
    before = old.select(ref(key).alias("__key"), F.struct(*[ref(c) for c in compared]).alias("__before"))
    changed = F.col("__key").isNotNull() & ~F.struct(*[ref(c) for c in compared]).eqNullSafe(F.col("__before"))
    return (new.join(before, ref(key) == F.col("__key"), "left").withColumn(updated, F.when(changed, at).otherwise(ref(updated)))
            .select(*[ref(c) for c in new.columns]))


def activity_log(created: DataFrame, owner: str, key: str, title: str, action: str = "create_dashboard") -> DataFrame:
    """One activity row per new entity, details as JSON."""
    details = F.to_json(F.struct(ref(key).alias("dashboard_id"), ref(title).alias("dashboard_title")))
    return created.select(ref(owner).alias("user_id"), ref(key).alias("dashboard_id"), F.lit(action).alias("action_type"), details.alias("action_details"))
