"""Dates: German cells, calendar features, keys of periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cadence names and their days.
CADENCES = (("weekly", 7.0), ("bi-weekly", 14.0), ("monthly", 30.4), ("quarterly", 91.3), ("semi-annual", 182.6), ("annual", 365.25))


def parse_german_date(c: Column) -> Column:
    """``8.5.2026``, ``08.05.26``, ISO, and slashes; two-digit years from 69 on are 19xx. Null where it is no date."""
    s = F.trim(c)
    four = [(r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"), (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy")]
    two = [(r"^\d{1,2}\.\d{1,2}\.\d{2}$", "d.M.yy"), (r"^\d{1,2}/\d{1,2}/\d{2}$", "d/M/yy")]

    def read(shape: str, pattern: str) -> Column:
        return F.try_to_timestamp(F.when(s.rlike(shape), s), F.lit(pattern)).cast("date")

    out = [read(*x) for x in four]
    for x in two:
        d = read(*x)
        out.append(F.when(F.year(d) >= 2069, F.add_months(d, -1200)).otherwise(d))
    return F.coalesce(*out)


def month_key(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def week_key(d: Column) -> Column:
    """``2023-W07``: weeks begin on Monday, the days before the year's first Monday are week 00 (not ISO)."""
    return F.concat(F.year(d).cast("string"), F.lit("-W"), F.lpad(F.floor((F.dayofyear(d) - 1 + 7 - F.weekday(d)) / 7).cast("string"), 2, "0"))


def calendar_features(d: Column) -> dict[str, Column]:
    return {
        "year": F.year(d), "month": F.month(d), "quarter": F.quarter(d), "week": F.weekofyear(d), "day_of_month": F.dayofmonth(d),
        "day_of_week": F.weekday(d), "is_weekend": (F.weekday(d) >= 5).cast("int"), "is_month_end": (F.dayofmonth(d) >= 25).cast("int"),
    }


def cadence(gap: Column) -> Column:
    """struct(label, days) of the bucket nearest by ratio to a gap in days, the earlier one on ties; null for gaps of 0, below, or null."""
    near = F.array_min(F.array(*[F.struct(F.abs(F.log(gap / F.lit(days))).alias("off"), F.lit(i).alias("i"), F.lit(label).alias("label"), F.lit(days).alias("days")) for i, (label, days) in enumerate(CADENCES)]))
    return F.when(gap > 0, F.struct(near["label"].alias("label"), near["days"].alias("days")))


def previous_period(since: str, until: str) -> tuple[str, str]:
    """The period of equal length that ends the day before ``since``."""
    from datetime import date, timedelta

    a, b = date.fromisoformat(since), date.fromisoformat(until)
    return (a - timedelta(days=(b - a).days + 1)).isoformat(), (a - timedelta(days=1)).isoformat()
