"""Unions that later groupings can rely on."""

from __future__ import annotations

from pyspark.sql import DataFrame

from plumbline.session import prepare


def union(first: DataFrame, *others: DataFrame) -> DataFrame:
    """unionByName of all, in a prepared session (see `session.prepare`)."""
    prepare(first.sparkSession)
    for other in others:
        first = first.unionByName(other)
    return first
