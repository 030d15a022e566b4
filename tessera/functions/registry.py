"""Aggregates and scalar functions by name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX")
SCALARS = {"LEN": F.length, "LENGTH": F.length, "UPPER": F.upper, "LOWER": F.lower}


def aggregate(name: str, of: Column | None, distinct: bool) -> Column:
    """Sums and averages are doubles; nulls are left out of all but COUNT(*)."""
    if of is None:
        return F.count(F.lit(1))
    match name, distinct:
        case "COUNT", False:
            return F.count(of)
        case "COUNT", True:
            return F.count_distinct(of)
        case "SUM", False:
            return F.sum(of.cast("double"))
        case "SUM", True:
            return F.sum_distinct(of.cast("double"))
        case "AVG", False:
            return F.avg(of)
        case "AVG", True:
            return F.sum_distinct(of.cast("double")) / F.count_distinct(of)
        case "MIN", _:
            return F.min(of)
        case _:
            return F.max(of)
