"""Constraint audit: CHECK, UNIQUE, NOT NULL and foreign keys as counts of violations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tabscout.functions.text import ref


@dataclass(frozen=True)
class Check:
    """A row-level rule: ``broken`` is true on rows that violate it."""
    table: str
    kind: str
    name: str
    broken: Column


@dataclass(frozen=True)
class Unique:
    table: str
    columns: tuple[str, ...]
    where: str | None = None

    @property
    def name(self) -> str:
        return f"{self.table}.{'+'.join(self.columns)} unique"


@dataclass(frozen=True)
class ForeignKey:
    table: str
    column: str
    parent: str
    key: str

    @property
    def name(self) -> str:
        return f"{self.table}.{self.column} -> {self.parent}.{self.key}"


def one_of(table: str, column: str, values: Sequence[str]) -> Check:
    return Check(table, "enum", f"{table}.{column} in list", ~ref(column).isin(list(values)))


def in_range(table: str, column: str, low=None, high=None) -> Check:
    broken = F.lit(False)
    if low is not None:
        broken = broken | (ref(column) < low)
    if high is not None:
        broken = broken | (ref(column) > high)
    return Check(table, "range", f"{table}.{column} range", broken)


def after(table: str, later: str, earlier: str) -> Check:
    return Check(table, "order", f"{table}.{later} > {earlier}", ref(later) <= ref(earlier))


def matches(table: str, column: str, pattern: str, needs: str | None = None) -> Check:
    """``needs`` is text that every match holds; values without it are not scanned by the pattern."""
    found = ref(column).rlike("(?i)" + pattern)
    if needs is not None:
        found = F.when(ref(column).contains(needs), found).when(ref(column).isNotNull(), False)
    return Check(table, "regex", f"{table}.{column} pattern", ~found)


def not_null(table: str, column: str) -> Check:
    return Check(table, "not_null", f"{table}.{column} not null", ref(column).isNull())


def audit(tables: Mapping[str, DataFrame], rules: Sequence[Check | Unique | ForeignKey]) -> DataFrame:
    """(rule, kind, violations) of every rule. Row rules of a table share one pass."""
    parts = []
    for table in dict.fromkeys(r.table for r in rules if isinstance(r, Check)):
        own = [r for r in rules if isinstance(r, Check) and r.table == table]
        wide = tables[table].agg(*[F.count(F.when(r.broken, 1)).alias(f"v{i}") for i, r in enumerate(own)])
        parts.append(wide.select(F.inline(F.array(*[
            F.struct(F.lit(r.name).alias("rule"), F.lit(r.kind).alias("kind"), F.col(f"v{i}").alias("violations")) for i, r in enumerate(own)]))))
    for r in rules:
        if isinstance(r, Unique):
            parts.append(duplicate_keys(tables[r.table] if r.where is None else tables[r.table].where(r.where), r.columns)
                         .agg(F.count(F.lit(1)).alias("violations")).select(F.lit(r.name).alias("rule"), F.lit("unique").alias("kind"), "violations"))
        elif isinstance(r, ForeignKey):
            parts.append(missing_parents(tables[r.table], tables[r.parent], r.column, r.key)
                         .agg(F.coalesce(F.sum("rows"), F.lit(0).cast("bigint")).alias("violations"))
                         .select(F.lit(r.name).alias("rule"), F.lit("foreign_key").alias("kind"), "violations"))
    return reduce(DataFrame.unionByName, parts)


def duplicate_keys(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Key values used more than once; a key with a null part is never a duplicate."""
    present = reduce(lambda a, b: a & b, [ref(c).isNotNull() for c in columns])
    return rows.where(present).groupBy(*[ref(c) for c in columns]).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def missing_parents(child: DataFrame, parent: DataFrame, column: str, key: str) -> DataFrame:
    """Foreign-key values without a parent and their number of rows.

    Rows are counted per key first, so a parent with very many children is one row in the join.
    """
    used = child.where(ref(column).isNotNull()).groupBy(ref(column).alias("key")).agg(F.count(F.lit(1)).alias("rows"))
    return used.join(parent.select(ref(key).alias("__key")).distinct(), F.col("key") == F.col("__key"), "left_anti")


# The allowed words of the platform tables.
ROLES = ["user", "admin", "analyst"]
PROBLEM_TYPES = ["classification", "regression", "clustering"]
INSIGHT_TYPES = ["trend", "comparison", "anomaly", "recommendation", "distribution", "general"]
PRIORITIES = ["low", "medium", "high"]
CHART_TYPES = ["bar", "line", "pie", "scatter", "heatmap", "histogram", "area", "table"]
AGGREGATIONS = ["sum", "mean", "count", "max", "min", "median"]
PERMISSIONS = ["view", "edit"]
EXPORT_TYPES = ["pdf", "excel", "png", "csv"]
EXPORT_STATUS = ["pending", "processing", "completed", "failed"]
ACTIONS = ["register", "login", "logout", "upload_dataset", "create_dashboard", "view_dashboard", "update_dashboard",
           "delete_dashboard", "share_dashboard", "export_dashboard", "query_data", "update_profile"]
# The columns of the platform tables that must not be null.
REQUIRED = {
    "users": ["email", "password_hash", "name", "role", "is_active", "email_verified", "created_at", "updated_at"],
    "sessions": ["user_id", "token", "login_time", "is_active", "expires_at"],
    "user_preferences": ["user_id", "default_theme", "notifications_enabled", "updated_at"],
    "themes": ["name", "display_name", "colors", "is_default", "is_active", "created_at", "updated_at"],
    "dashboards": ["user_id", "title", "dataset_filename", "is_public", "view_count", "created_at", "updated_at"],
    "dataset_storage": ["dashboard_id", "data", "created_at"],
    "ml_results": ["dashboard_id", "model_name", "model_type", "test_score", "is_best_model", "created_at"],
    "insights": ["dashboard_id", "insight_type", "title", "content", "priority", "created_at"],
    "chart_configurations": ["dashboard_id", "chart_type", "title", "order_index", "is_visible", "created_at", "updated_at"],
    "dashboard_shares": ["dashboard_id", "created_by", "share_token", "permission_level", "is_public", "is_active", "view_count", "created_at"],
    "query_history": ["user_id", "query_text", "was_successful", "timestamp"],
    "exports": ["dashboard_id", "export_type", "status", "download_count", "created_at"],
    "user_activity": ["action_type", "created_at"],
}
#: Fixed value: the pattern of an e-mail address.
EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}$"


def platform_rules() -> list[Check | Unique | ForeignKey]:
    """The constraints of the platform's thirteen tables."""
    enums = [("users", "role", ROLES), ("dashboards", "problem_type", PROBLEM_TYPES), ("insights", "insight_type", INSIGHT_TYPES),
             ("insights", "priority", PRIORITIES), ("chart_configurations", "chart_type", CHART_TYPES),
             ("chart_configurations", "aggregation", AGGREGATIONS), ("dashboard_shares", "permission_level", PERMISSIONS),
             ("exports", "export_type", EXPORT_TYPES), ("exports", "status", EXPORT_STATUS), ("user_activity", "action_type", ACTIONS)]
    at_least_zero = [("dashboards", "row_count"), ("dashboards", "column_count"), ("dashboards", "view_count"), ("dataset_storage", "row_count"),
                     ("ml_results", "training_time"), ("dashboard_shares", "view_count"), ("query_history", "execution_time"), ("exports", "download_count")]
    shares = [("ml_results", "test_score"), ("ml_results", "cv_score"), ("insights", "confidence_score")]
    unique = [("users", "email"), ("sessions", "token"), ("user_preferences", "user_id"), ("themes", "name"),
              ("dataset_storage", "dashboard_id"), ("dashboard_shares", "share_token")]
    to_user = [("sessions", "user_id"), ("user_preferences", "user_id"), ("dashboards", "user_id"), ("dashboard_shares", "created_by"),
               ("dashboard_shares", "shared_with_user_id"), ("query_history", "user_id"), ("exports", "user_id"), ("user_activity", "user_id")]
    to_dashboard = ["dataset_storage", "ml_results", "insights", "chart_configurations", "dashboard_shares", "query_history", "exports", "user_activity"]
    return [
        *[one_of(*e) for e in enums], *[in_range(t, c, 0) for t, c in at_least_zero], *[in_range(t, c, 0, 1) for t, c in shares],
        after("sessions", "expires_at", "login_time"), after("dashboard_shares", "expires_at", "created_at"), matches("users", "email", EMAIL),
        *[not_null(t, c) for t, columns in REQUIRED.items() for c in columns],
        *[Unique(t, ("id",)) for t in REQUIRED], *[Unique(t, (c,)) for t, c in unique], Unique("themes", ("is_default",), "is_default"),
        *[ForeignKey(t, c, "users", "id") for t, c in to_user], ForeignKey("dashboards", "theme_id", "themes", "id"),
        *[ForeignKey(t, "dashboard_id", "dashboards", "id") for t in to_dashboard]]
