"""Statistics over short arrays (click histories), as higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8   # fixed value: added to list lengths in the shares, means and spreads


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def list_share(arr, value) -> Column:
    """Share of the elements equal to ``value``: hits / (n + 1e-8).

    Compared in the ids' own type, so large and string ids stay apart. Empty
    list -> 0; null list or null value -> null.
    """
    v = _c(value)
    a = _c(arr)
    hits = F.size(F.filter(a, lambda x: x == v))
    return F.when(v.isNotNull() & a.isNotNull(), hits / (F.size(a) + F.lit(EPS)))


def list_mean(arr) -> Column:
    """sum / (n + 1e-8); a null element or a null list gives null."""
    a = _c(arr)
    s = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return s / (F.size(a) + F.lit(EPS))


def list_std(arr) -> Column:
    """Population standard deviation with the same epsilon in both divisions."""
    a = _c(arr)
    m = list_mean(a)
    ss = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + (x.cast("double") - m) * (x.cast("double") - m))
    return F.sqrt(ss / (F.size(a) + F.lit(EPS)))
