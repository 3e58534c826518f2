"""Rounding, missing values and safe division."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sigmoid(x: Column) -> Column:
    """1 / (1 + e^-x)."""
    return 1 / (1 + F.exp(-x))


def pyround(x: str | Column, digits: int = 2) -> Column:
    """Half-even on the exact binary value, as a decimal formatter rounds; plain round() works on the shortest decimal."""
    pattern = "0." + "0" * digits if digits else "0"
    return F.call_function("format_number", col(x).cast("double"), F.lit(pattern)).cast("double") + F.lit(0.0)


def nz(x: str | Column) -> Column:
    """Null where the value is 0: zero means missing in heart rates, cadences, loads and scores."""
    return F.nullif(col(x), F.lit(0))


def cents(x: str | Column, digits: int = 2) -> Column:
    """A value rounded to fixed decimals, so that sums don't depend on the order of rows."""
    return col(x).cast(f"decimal(18,{digits})")


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b as double; null where b is 0 or null."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))
