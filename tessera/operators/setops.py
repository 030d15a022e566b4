"""UNION and UNION ALL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tessera.plans.lexer import SqlError


def union(left: DataFrame, right: DataFrame, every: bool, kind_of: Callable) -> DataFrame:
    """Appends by position under the left names; without `every`, removes duplicates from all so far."""
    if len(left.columns) != len(right.columns):
        raise SqlError("UNION branches must have the same number of columns.")
    for a, b in zip(left.schema, right.schema, strict=True):
        kinds = {kind_of(a.dataType), kind_of(b.dataType)} - {"null"}
        if len(kinds) > 1:
            raise SqlError(f"UNION branches have incompatible types: {' and '.join(sorted(kinds))}.")
    out = left.union(right)
    return out if every else out.distinct()
