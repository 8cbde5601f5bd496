"""Spend reports. Sums are exact in cents and become euros last. ``s``: the spine of :mod:`kontor.operators.labels`; ``tx``: the facts alone."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kontor.functions import dates
from kontor.operators.labels import category_color, category_name, spine
from kontor.scratch import scratch_table


def between(since: str | None = None, until: str | None = None) -> Column:
    """Dates from ``since`` to ``until``, both included, each optional."""
    test = F.lit(True)
    if since:
        test = test & (F.col("date") >= F.lit(since).cast("date"))
    if until:
        test = test & (F.col("date") <= F.lit(until).cast("date"))
    return test


def external() -> Column:
    """No transfer between own accounts."""
    return F.coalesce("iban_is_known_self", F.lit(0)) == 0


def not_savings() -> Column:
    return F.coalesce("is_savings", F.lit(0)) == 0


def spent() -> Column:
    return F.sum(F.abs("cents"))


def expenses(df: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    return df.where((F.col("is_income") == 0) & between(since, until))


def euro(c: Column) -> Column:
    return F.coalesce(c, F.lit(0)) / F.lit(100.0)


def income_sum() -> Column:
    return F.sum(F.when(F.col("is_income") == 1, F.col("cents")).otherwise(0))


def expense_sum() -> Column:
    return F.sum(F.when(F.col("is_income") == 0, F.abs("cents")).otherwise(0))


def spend_by_category(s: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    return expenses(s, since, until).groupBy("category_id", category_name().alias("name"), category_color().alias("color")).agg(euro(spent()).alias("amount")).drop("category_id")


def spend_shares(s: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """Spend by category with each one's share of the whole."""
    return spend_by_category(s, since, until).withColumn("share", F.col("amount") / F.sum("amount").over(Window.partitionBy()))  # one row per category


def monthly_flow_by_category(s: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    rows = s.where(between(since, until) & external() & not_savings())
    return rows.groupBy(dates.month_key(F.col("date")).alias("ym"), category_name().alias("name"), category_color().alias("color")).agg(euro(F.sum("cents")).alias("amount"))


def amount_distribution(s: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    return expenses(s, since, until).select("id", (F.abs("cents") / 100.0).alias("amount"), category_name().alias("name"))


def amount_histogram(s: DataFrame, bins: int = 30) -> DataFrame:
    """(name, bin, n): equal bins from the smallest to the largest amount of all, the largest in the last bin."""
    rows = amount_distribution(s)
    ends = rows.agg(F.min("amount").alias("low"), F.max("amount").alias("high"))  # one row
    place = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("amount") - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1))).otherwise(0)
    return rows.join(F.broadcast(ends)).groupBy("name", place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def top_counterparties(tx: DataFrame, n: int = 15, since: str | None = None, until: str | None = None) -> DataFrame:
    rows = expenses(tx, since, until).groupBy(F.coalesce(F.nullif("vendor", F.lit("")), F.lit("(unbekannt)")).alias("name"))
    return rows.agg(euro(spent()).alias("amount"), F.count(F.lit(1)).alias("n_tx")).orderBy(F.desc("amount"), "name").limit(n)


def daily_spend(tx: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    return expenses(tx, since, until).groupBy(F.col("date").alias("d")).agg(euro(spent()).alias("amount"))


def daily_by_category(s: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    return expenses(s, since, until).groupBy(F.col("date").alias("d"), category_name().alias("name"), category_color().alias("color")).agg(euro(spent()).alias("amount"))


def weekly_by_category(s: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    return expenses(s, since, until).groupBy(dates.week_key(F.col("date")).alias("yw"), category_name().alias("name"), category_color().alias("color")).agg(euro(spent()).alias("amount"))


def savings_flow(s: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    rows = s.where((F.coalesce("is_savings", F.lit(0)) == 1) & between(since, until)).groupBy(dates.month_key(F.col("date")).alias("ym"))
    out = rows.agg(expense_sum().alias("t"), income_sum().alias("f"))
    return out.select("ym", euro(F.col("t")).alias("to_savings"), euro(F.col("f")).alias("from_savings"), euro(F.col("t") - F.col("f")).alias("net"))


def with_rate(df: DataFrame) -> DataFrame:
    """income, expenses, net and savings_rate (null without income) from the sums ``i`` and ``e``."""
    i, e = F.coalesce("i", F.lit(0)), F.coalesce("e", F.lit(0))
    return df.withColumns({"income": i / 100.0, "expenses": e / 100.0, "net": (i - e) / 100.0, "savings_rate": F.when(i > 0, (i - e) / i)}).drop("i", "e")


def monthly_income_vs_expense(s: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    rows = s.where(between(since, until) & external() & not_savings())
    return with_rate(rows.groupBy(dates.month_key(F.col("date")).alias("ym")).agg(income_sum().alias("i"), expense_sum().alias("e")))


def period_totals(s: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    return with_rate(s.where(between(since, until) & external() & not_savings()).agg(income_sum().alias("i"), expense_sum().alias("e")))


def headline(s: DataFrame, since: str, until: str) -> DataFrame:
    """Totals of the period and of the one before, the changes in percent, and net savings; one scan."""
    before_since, before_until = dates.previous_period(since, until)
    now, then = between(since, until), between(before_since, before_until)
    rows = s.where(between(before_since, until))
    kept = external() & not_savings()
    part = lambda test, income: F.sum(F.when(test & kept & (F.col("is_income") == int(income)), F.abs("cents")).otherwise(0))
    saved = F.sum(F.when(now & (F.coalesce("is_savings", F.lit(0)) == 1), -F.col("cents")).otherwise(0))
    r = rows.agg(part(now, True).alias("i"), part(now, False).alias("e"), part(then, True).alias("pi"), part(then, False).alias("pe"), saved.alias("s"))
    r = r.select(*[F.coalesce(c, F.lit(0)).alias(c) for c in ("i", "e", "pi", "pe", "s")])
    change = lambda a, b: F.when(F.col(b) > 0, (F.col(a) - F.col(b)) / F.col(b) * 100.0)
    return r.select(
        (F.col("i") / 100.0).alias("income"), (F.col("e") / 100.0).alias("expenses"), ((F.col("i") - F.col("e")) / 100.0).alias("net"),
        F.when(F.col("i") > 0, (F.col("i") - F.col("e")) / F.col("i") * 100.0).alias("savings_rate_pct"), change("i", "pi").alias("income_change_pct"), change("e", "pe").alias("expenses_change_pct"), (F.col("s") / 100.0).alias("net_to_savings"),
    )


def category_period_comparison(s: DataFrame, since: str, until: str) -> DataFrame:
    """Expenses by category in the period and the one before; one scan with conditional sums."""
    before_since, before_until = dates.previous_period(since, until)
    rows = s.where((F.col("is_income") == 0) & between(before_since, until) & external() & not_savings())
    part = lambda test: F.sum(F.when(test, F.abs("cents")).otherwise(0))
    out = rows.groupBy(category_name().alias("name")).agg(part(between(since, until)).alias("c"), part(between(before_since, before_until)).alias("p"))
    return out.select("name", euro(F.col("c")).alias("current"), euro(F.col("p")).alias("previous"), euro(F.col("c") - F.col("p")).alias("delta"), F.when(F.col("p") > 0, (F.col("c") - F.col("p")) / F.col("p")).alias("pct"))


def top_movers(s: DataFrame, since: str, until: str, n: int = 8) -> DataFrame:
    return category_period_comparison(s, since, until).where(F.abs("delta") >= 0.005).orderBy(F.desc(F.abs("delta")), "name").limit(n)


def month_to_date_pace(s: DataFrame, today: str, trailing_months: int = 6) -> DataFrame:
    """One row: spent, days_elapsed, days_in_month, projected, and baseline, the mean of the last complete months that have rows."""
    d = date.fromisoformat(today)
    first, days = d.replace(day=1).isoformat(), (date(d.year + d.month // 12, d.month % 12 + 1, 1) - d.replace(day=1)).days
    rows = s.where((F.col("is_income") == 0) & external() & not_savings())
    this_month = rows.where(between(first, today)).agg(F.coalesce(F.sum(F.abs("cents")), F.lit(0)).alias("s"))
    months = rows.where(F.col("date") < F.lit(first).cast("date")).groupBy(dates.month_key(F.col("date")).alias("ym")).agg(spent().alias("m")).orderBy(F.desc("ym")).limit(trailing_months)
    both = this_month.crossJoin(months.agg((F.sum("m") / F.count("m") / 100.0).alias("baseline")))  # one row each
    return both.select((F.col("s") / 100.0).alias("spent"), F.lit(d.day).alias("days_elapsed"), F.lit(days).alias("days_in_month"), (F.col("s") / 100.0 / d.day * days).alias("projected"), "baseline")


def anomalies(tx: DataFrame, labels: DataFrame, categories: DataFrame, since: str | None = None, until: str | None = None, z: float = 2.0, min_history: int = 3, limit: int = 25) -> DataFrame:
    """Expenses far above their vendor's mean over the whole history, the latest and farthest first.

    The vendors' statistics are aggregated before the join, so that a vendor with very many rows is no window of its own; labels are read for the
    ``limit`` rows alone.
    """
    a = F.abs("cents")
    rows = tx.where("is_income = 0 and vendor <> ''").select("id", "date", "vendor", "counterparty", "cents")
    stats = rows.groupBy("vendor").agg(F.avg(a).alias("mean"), F.avg(a.cast("double") * a).alias("square"), F.count(F.lit(1)).alias("n_history"))
    stats = stats.where((F.col("n_history") >= min_history) & (F.col("square") - F.col("mean") * F.col("mean") > 0))
    out = rows.where(between(since, until)).join(stats, "vendor").withColumn("zscore", (a - F.col("mean")) / F.sqrt(F.col("square") - F.col("mean") * F.col("mean"))).where(F.col("zscore") > z)
    out = scratch_table(out.orderBy(F.desc("date"), F.desc("zscore"), "id").limit(limit), "anomalies")
    theirs = labels.join(F.broadcast(out.select(F.col("id").alias("expense_id"))), "expense_id", "left_semi").select(*labels.columns)
    out = spine(out, theirs, categories)
    return out.select("id", "date", "counterparty", category_name().alias("category"), (a / 100.0).alias("amount"), (F.col("mean") / 100.0).alias("typical"), (a / F.col("mean")).alias("vs_typical"), "zscore", "n_history")


def records(s: DataFrame, labels: DataFrame, notes: DataFrame) -> DataFrame:
    """The spine with note and the time of the last change (label, note or import, whichever is there)."""
    touched = labels.groupBy(F.col("expense_id").alias("id")).agg(F.max("created_at").alias("labelled_at"))
    n = notes.select(F.col("expense_id").alias("id"), F.col("text").alias("note"), "updated_at")
    out = s.join(touched, "id", "left").join(n, "id", "left")
    return out.withColumn("last_modified", F.greatest("imported_at", "labelled_at", "updated_at")).drop("labelled_at", "updated_at")


def latest_records(s: DataFrame, limit: int = 5000) -> DataFrame:
    return s.orderBy(F.desc("date"), F.desc("id")).limit(limit).select("id", "date", "counterparty", category_name().alias("category"), (F.col("cents") / 100.0).alias("amount"))


def selection_total(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n"), euro(F.sum("cents")).alias("total"))


def search_transactions(
    s: DataFrame, *, since: str | None = None, until: str | None = None, include_income: bool = True, least: float | None = None, most: float | None = None,
    text: str | None = None, categories: tuple[str, ...] = (), source: str | None = None, ids: DataFrame | None = None,
) -> DataFrame:
    """Rows of the spine that pass all filters given; ``ids`` overrides the others. ``text`` is plain, without wildcards; ``source``: user, model or unlabeled."""
    if ids is not None:
        return s.join(ids.select("id"), "id", "left_semi")
    test = between(since, until)
    if not include_income:
        test = test & (F.col("is_income") == 0)
    if least is not None:
        test = test & (F.abs("cents") >= int(least * 100))
    if most is not None:
        test = test & (F.abs("cents") <= int(most * 100))
    if text:
        test = test & (F.lower("counterparty").contains(text.lower()) | F.lower("memo").contains(text.lower()))
    if categories:
        test = test & category_name().isin(*categories)
    if source in ("user", "model"):
        test = test & (F.col("label_source") == source)
    elif source == "unlabeled":
        test = test & F.col("label_source").isNull()
    return s.where(test)


def wildcard_search(df: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows in which every word of ``query`` occurs somewhere in ``columns``; ``*`` stands for anything."""
    hay = F.lower(F.concat_ws(" · ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))
    for term in query.lower().split():
        pattern = ".*".join(f"\\Q{part}\\E" if part else "" for part in term.split("*"))
        df = df.where(hay.rlike(f"(?s){pattern}"))
    return df
