"""Keyed sinks as DataFrame operations: latest wins, first wins, insert if absent, counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_wins(changes: DataFrame, keys: Sequence[str], order: Sequence[str], first_kept: Sequence[str] = ()) -> DataFrame:
    """One row for each key: every column from its last change by ``order``, those of ``first_kept`` from its first."""
    at = F.struct(*order)
    rest = [c for c in changes.columns if c not in keys and c not in first_kept]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), at).alias("_last"), *(F.min_by(c, at).alias(c) for c in first_kept)).select(*keys, *first_kept, "_last.*")


def first_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")).select(*keys, "_first.*")


def insert_if_absent(held: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``held`` and, for keys it lacks, the first incoming row."""
    return held.unionByName(first_wins(incoming.join(held.select(*keys), list(keys), "left_anti"), keys, order).select(held.columns))


def add_counts(held: DataFrame, delta: DataFrame, keys: Sequence[str], counts: Sequence[str]) -> DataFrame:
    """Counters by key: those held plus what has come."""
    return held.select(*keys, *counts).unionByName(delta.select(*keys, *counts)).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in counts))
