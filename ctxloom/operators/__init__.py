"""Operators: ``DataFrame -> DataFrame`` functions built from joins, windows and aggregates."""
