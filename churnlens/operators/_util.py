"""Small Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(c: Column) -> Column:
    """Exact decimal money presented as DOUBLE."""
    return c.cast("double")


def ratio(num: Column, den: Column) -> Column:
    """num / den in DOUBLE; NULL when den is 0 or NULL (ANSI-safe, no error)."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def half_up(num: Column, den: Column, scale: int) -> Column:
    """round(num/den, scale) half-up, exact for non-negative integers
    (integer arithmetic, so no floating-point boundary cases)."""
    f = 10 ** scale
    a = num.cast("long") * (2 * f) + den.cast("long")
    b = den.cast("long") * 2
    q = ((a - F.pmod(a, b)) / b).cast("long")  # exact integer quotient
    return F.try_divide(q.cast("double"), F.lit(float(f)))
