"""Column expressions shared by the operators (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fixed(c, digits: int = 4) -> Column:
    """Portable half-up rounding: floor(x * 10^d + 0.5) / 10^d as double.

    Spark's ``round`` works on the decimal text, other engines on the double;
    this form gives the same bits everywhere (SURVEY 2.11 n.16).
    """
    scale = float(10 ** digits)
    return (F.floor(col(c) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)).cast("double")


def safe_div(num, den, default: float | None = 0.0) -> Column:
    """num / den with a default on a zero or null denominator (ANSI-safe)."""
    q = F.try_divide(col(num).cast("double"), col(den).cast("double"))
    return q if default is None else F.coalesce(q, F.lit(float(default)))


def flag_equals(c, value: str) -> Column:
    """1 when the column equals ``value`` (null-safe: null -> 0), as int."""
    return col(c).eqNullSafe(F.lit(value)).cast("int")


def clip_low(c, low: float) -> Column:
    return F.greatest(col(c), F.lit(low))


def as_int(c) -> Column:
    return col(c).cast("int")


def as_long(c) -> Column:
    return col(c).cast("long")
