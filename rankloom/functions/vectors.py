"""Array helpers: zip + explode, vector text parsing, dot products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def zip_explode(df: DataFrame, keep: list[str], arrays: dict[str, str]) -> DataFrame:
    """Zip parallel arrays and emit one row per position, fields by name."""
    z = F.arrays_zip(*[F.col(src).alias(name) for name, src in arrays.items()])
    return df.select(*keep, F.inline(z))


def parse_vector(c) -> Column:
    """Text '[f f ...\\n f]' -> array<float>: drop the brackets, newlines are
    blanks, empty tokens skipped."""
    s = _c(c)
    inner = F.regexp_replace(F.regexp_replace(s, r"^\[|\]$", ""), "\n", " ")
    toks = F.filter(F.split(inner, " "), lambda t: t != "")
    return F.transform(toks, lambda t: t.cast("float"))


def dot(a, b) -> Column:
    """Sum of element-wise products of two equal-length arrays."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)
