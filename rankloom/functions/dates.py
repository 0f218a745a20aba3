"""Date helpers (session time zone UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WEEKEND_DAYS = (6, 7, 1)   # fixed value: Friday, Saturday, Sunday (dayofweek 1 = Sunday)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def epoch_ms_to_date(c="searchtime") -> Column:
    """Epoch milliseconds -> UTC calendar date, by day arithmetic (independent
    of the session time zone)."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(_c(c) / 86_400_000).cast("int"))


def clamped_days(later, earlier) -> Column:
    """datediff(later, earlier) when positive, else 0 (also when null)."""
    d = F.datediff(_c(later), _c(earlier))
    return F.when(d > 0, d).otherwise(0)


def day_of_week(c) -> Column:
    return F.dayofweek(_c(c))


def is_weekend(c) -> Column:
    return F.when(F.dayofweek(_c(c)).isin(list(WEEKEND_DAYS)), 1).otherwise(0)


def hour_key_to_date(c="inserted_at") -> Column:
    """'yyyyMMddHH' partition key (string or number) -> date."""
    return F.to_date(F.substring(_c(c).cast("string"), 1, 8), "yyyyMMdd")
