"""Great-circle distance as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0   # fixed value: mean Earth radius


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def haversine_km(lat1, lng1, lat2, lng2) -> Column:
    """Distance in km between two points given in degrees (atan2 form)."""
    la1, lo1, la2, lo2 = (F.radians(_c(x)) for x in (lat1, lng1, lat2, lng2))
    dlat = la1 - la2
    dlng = lo1 - lo2
    a = (F.sin(dlat / 2) * F.sin(dlat / 2)
         + F.cos(la1) * F.cos(la2) * F.sin(dlng / 2) * F.sin(dlng / 2))
    return F.lit(EARTH_RADIUS_KM) * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))
