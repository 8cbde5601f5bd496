"""Recurring payments: cadence by the median gap between charges, projections, and fixed against variable spend."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kontor.functions import dates
from kontor.operators.reports import between, external


def recurring_subscriptions(tx: DataFrame, since: str | None = None, until: str | None = None, min_charges: int = 3) -> DataFrame:
    """Vendors with a cadence: name (of the last charge), cadence, last_seen, typical_amount (median), charges_per_year, annualised, n_charges."""
    rows = tx.where((F.col("is_income") == 0) & (F.col("vendor") != "") & between(since, until)).select("vendor", "id", "date", "counterparty", F.abs("cents").alias("c"))
    # gaps between charges: one for each date that follows another, and 0 for every further charge of a date
    days = rows.groupBy("vendor", "date").agg(F.count(F.lit(1)).alias("k"))
    days = days.withColumn("gap", F.datediff("date", F.lag("date").over(Window.partitionBy("vendor").orderBy("date"))))
    gaps = days.groupBy("vendor", "gap").agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("k") - 1).alias("same"))
    gaps = gaps.where("gap is not null").select("vendor", "gap", "k").unionByName(gaps.groupBy("vendor").agg(F.lit(0).alias("gap"), F.sum("same").alias("k")).where("k > 0"))
    gaps = gaps.groupBy("vendor").agg(F.expr("percentile(gap, 0.5, k)").alias("gap"))
    # the median over distinct amounts and how often they come, added up before anything of a vendor meets
    amounts = rows.groupBy("vendor", "c").agg(F.count(F.lit(1)).alias("k"), F.max(F.struct("date", "id", "counterparty")).alias("last"))
    v = amounts.groupBy("vendor").agg(F.sum("k").alias("n_charges"), (F.expr("percentile(c, 0.5, k)") / 100.0).alias("typical_amount"), F.max("last").alias("last"))
    v = v.select("vendor", "n_charges", "typical_amount", F.col("last.date").alias("last_seen"), F.col("last.counterparty").alias("name")).join(gaps, "vendor")
    v = v.where(F.col("n_charges") >= min_charges).withColumn("k", dates.cadence(F.col("gap"))).where("k is not null")
    yearly = F.lit(365.25) / F.col("k.days")
    return v.select(
        F.coalesce(F.nullif("name", F.lit("")), "vendor").alias("name"), F.col("k.label").alias("cadence"), "last_seen", "typical_amount", yearly.alias("charges_per_year"), (F.col("typical_amount") * yearly).alias("annualised"), "n_charges"
    )


def upcoming_recurring(tx: DataFrame, today: str, horizon_days: int = 30, min_charges: int = 3) -> DataFrame:
    """The next charge of each within the horizon; overdue ones are moved on by whole gaps, in closed form."""
    gap = F.bround(F.lit(365.25) / F.col("charges_per_year"), 0).cast("int")
    day = F.lit(today).cast("date")
    steps = F.greatest(F.lit(1), F.ceil(F.datediff(day, F.col("last_seen")) / gap).cast("int"))
    r = recurring_subscriptions(tx, min_charges=min_charges).withColumn("expected_date", F.date_add("last_seen", (gap * steps).cast("int")))
    return r.withColumn("days_until", F.datediff("expected_date", day)).where(F.col("days_until") <= horizon_days).select("name", "cadence", "expected_date", "typical_amount", "days_until")


def fixed_vs_variable(tx: DataFrame, min_charges: int = 3) -> DataFrame:
    """One row: fixed_monthly (at most the whole), variable_monthly, total_monthly (mean of months that have rows), fixed_share."""
    fixed = recurring_subscriptions(tx, min_charges=min_charges).agg(F.coalesce(F.sum("annualised") / 12.0, F.lit(0.0)).alias("f"))
    months = tx.where((F.col("is_income") == 0) & external()).groupBy(dates.month_key(F.col("date")).alias("ym")).agg(F.sum(F.abs("cents")).alias("m"))
    both = fixed.crossJoin(months.agg(F.coalesce(F.sum("m") / F.count("m") / 100.0, F.lit(0.0)).alias("t")))  # one row each
    f, t = F.least("f", "t"), F.col("t")
    return both.select(f.alias("fixed_monthly"), F.greatest(t - f, F.lit(0.0)).alias("variable_monthly"), t.alias("total_monthly"), F.when(t > 0, f / t).alias("fixed_share"))
