"""Plan-size checks: choose a strategy from Catalyst's estimate, without a job."""

from __future__ import annotations

from pyspark.sql import DataFrame

# One task may sort the distinct values of inputs up to this size.
SMALL_INPUT_BYTES = 64 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of ``df``, or None when it gives none."""
    try:
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    except Exception:
        return None


def is_small(df: DataFrame, limit: int | None = None) -> bool:
    """True only when the estimate exists and is within ``limit`` bytes."""
    size = estimated_bytes(df)
    return size is not None and size <= (SMALL_INPUT_BYTES if limit is None else limit)
