"""Column functions on arrays of any element type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pad_or_cut(values: Column, length: Column, padding: Column) -> Column:
    """Exactly ``length`` elements: the tail is cut or filled with ``padding``."""
    missing = F.greatest(length - F.size(values), F.lit(0)).cast("int")
    return F.concat(F.slice(values, F.lit(1), length), F.array_repeat(padding, missing))


def fill_missing(values: Column, default: float = 0.0) -> Column:
    return F.transform(values, lambda x: F.coalesce(x, F.lit(default)))
