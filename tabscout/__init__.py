"""Automatic table analysis on Spark: query, profile, chart, explain, model, audit."""
