"""Evaluation statistics as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the 95 % interval of k successes in n, in 0..1, three digits; none tried is (0, 0)."""
    k, n = k.cast("double"), n.cast("double")
    p = k / n
    centre, reach, whole = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    low, high = F.greatest(F.lit(0.0), (centre - reach) / whole), F.least(F.lit(1.0), (centre + reach) / whole)
    return tuple(F.when(n > 0, F.round(x, 3)).otherwise(0.0) for x in (low, high))


def percent(v: Column) -> Column:
    return F.coalesce(F.concat(F.format_number(v * 100, 0), F.lit("%")), F.lit("n/a"))
