"""Registered queries: one Spark callable per operator, with its SQL oracle."""

from checks.registry import ORACLE, QUERIES  # noqa: F401
from checks import (  # noqa: F401
    query, profile, chartdata, charts, insights, platform, audit, questions, modelprep, models, storage, functions)
