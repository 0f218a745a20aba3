"""Words as maximal runs of characters, as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text) -> Column:
    """A-Z lower-cased, all else as it is (``lower`` does the same, faster, where every character is ASCII)."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def runs(text: Column, breaks: str) -> Column:
    """The maximal runs of characters outside the class ``breaks``, in order; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{breaks}+"), "")

