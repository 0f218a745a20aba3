"""CASE flags, fills, fallbacks, the target and the label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the source system
DEFAULT_CONVERSION = 0.0049     # conversion assumed for a place without one
POPULARITY_SCALE = 2 * 100      # place score = 200 * conversion * sqrt(popularity)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def place_score(conversion="conversion", popularity="popularity") -> Column:
    """200 * coalesce(conversion, 0.0049) * sqrt(popularity)."""
    conv = F.coalesce(_c(conversion).cast("double"), F.lit(DEFAULT_CONVERSION))
    return F.lit(float(POPULARITY_SCALE)) * conv * F.sqrt(_c(popularity).cast("double"))


def flag(cond: Column) -> Column:
    """1 when the condition holds, else 0 (null conditions give 0)."""
    return F.when(cond, 1).otherwise(0)


def target(realised="realised_flag", event="event") -> Column:
    """'realised' for a realised booking, else the event (null = no action)."""
    return F.coalesce(F.when(_c(realised).isNotNull(), F.lit("realised")), _c(event))


def label(target_col="target", positives=("realised", "booking")) -> Column:
    """1 for realised or booked candidates, 0 for details pages and no action."""
    return F.when(_c(target_col).isin(list(positives)), 1).otherwise(0)


def fallback(cond: Column, when_true, otherwise) -> Column:
    return F.when(cond, _c(when_true)).otherwise(_c(otherwise))


def fill_existing(df: DataFrame, value, subset: list[str]) -> DataFrame:
    """fillna on the subset columns that exist (unknown names are skipped)."""
    cols = [c for c in subset if c in df.columns]
    return df.fillna(value, subset=cols) if cols else df


def fill_map(df: DataFrame, values: dict) -> DataFrame:
    """Per-column fill values, for the columns present."""
    vals = {k: v for k, v in values.items() if k in df.columns}
    return df.fillna(vals) if vals else df
