"""Column references and formatted text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def ref(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def fmt(pattern: str, *parts: Column | str) -> Column:
    return F.format_string(pattern, *parts)


def commas(column: str | Column) -> Column:
    """A whole number with thousands separators."""
    return F.format_number(F.col(column) if isinstance(column, str) else column, 0)


def contains_any(text: Column, words: Sequence[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | text.contains(w)
    return hit


def like(text: Column, pattern: str) -> Column:
    """SQL LIKE without an escape character: a backslash stands for itself."""
    return text.like(pattern.replace("\\", "\\\\"))
