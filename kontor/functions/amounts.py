"""Amounts in cents, German number cells, and what is derived from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_german_amount(c: Column) -> Column:
    """``1.234,56``, ``-12,34``, ``+1 234,56 €`` as decimal(18,4); null where it is no number."""
    s = F.regexp_replace(F.trim(c), r"(?U)[\s€]", "")
    s = F.regexp_replace(s, r"^\+", "")
    return F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("decimal(18,4)")


def to_cents(amount: Column) -> Column:
    """Half-even, as decimals are rounded on entry."""
    return F.bround(amount * 100, 0).cast("long")


def is_income(cents: Column) -> Column:
    return (cents > 0).cast("int")


def is_round(cents: Column) -> Column:
    """A multiple of five euros, not nothing."""
    return ((cents != 0) & (F.abs(cents) % 500 == 0)).cast("int")


def bucket(cents: Column) -> Column:
    a = F.abs(cents)
    return F.when(a < 1000, "<10").when(a < 5000, "10-50").when(a < 20000, "50-200").when(a < 100000, "200-1000").otherwise(">1000")


def log_abs(cents: Column) -> Column:
    return F.log1p(F.abs(cents) / F.lit(100.0))


def euros(cents: Column) -> Column:
    """Exact cents to euros, last of all."""
    return cents / F.lit(100.0)
