"""Scalar expressions that the queries share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_epoch(ts: Column | str, origin: str = "2024-01-01") -> Column:
    """Days since origin."""
    return F.date_diff(F.col(ts) if isinstance(ts, str) else ts, F.lit(origin).cast("date")).cast("long")


def tokens(text: Column | str) -> Column:
    """Lower-cased words between white space (ASCII)."""
    t = F.translate(F.lower(F.col(text) if isinstance(text, str) else text), "\t\n\x0b\f\r", "     ")
    return F.array_remove(F.split(t, " "), "")  # a single character is split at without a pattern


def money(x: Column | str) -> Column:
    """A sum of amounts with two places, exact and independent of order, as a double."""
    return F.sum(cents(x)) / F.lit(100.0)


def cents(x: Column | str) -> Column:
    """Hundredths, rounded half away from zero, in machine arithmetic."""
    v = F.col(x) if isinstance(x, str) else x
    return (F.signum(v) * F.floor(F.abs(v) * 100 + 0.5)).cast("long")


def div(a: Column, b: int) -> Column:
    """Integer division that truncates towards zero."""
    return F.when(a >= 0, F.floor(a / b)).otherwise(F.ceil(a / b)).cast("long")


def collatz(x: Column) -> Column:
    return F.when(x % 2 == 0, F.floor(x / 2)).otherwise(x * 3 + 1).cast("long")
