"""Ratios with the reference's two null / zero conventions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def guarded_ratio(num, den) -> Column:
    """n / d, but 0 when d is 0; null when either side is null."""
    n, d = _c(num), _c(den)
    return F.when(d == 0, F.lit(0.0)).otherwise(F.try_divide(n.cast("double"), d.cast("double")))


def safe_ratio(num, den) -> Column:
    """n / d, null when d is 0 (the non-ANSI division result)."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))
