"""Queries and SQL of the label log, the reports, recurring payments and history features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kontor.operators import labels as lb
from kontor.operators import recurring, reports, temporal
from kontor.plans import tables as t
from kontor.plans.tables import PREFIX

SINCE, UNTIL, TODAY = "1998-01-01", "1998-12-31", "1998-09-17"
Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NAME, COLOR = "coalesce(category, '(unkategorisiert)')", "coalesce(color, '#bbbbbb')"
KEPT = "coalesce(self, 0) = 0 AND coalesce(is_savings, 0) = 0"
INC, EXP = "sum(CASE WHEN is_income = 1 THEN cents ELSE 0 END)", "sum(CASE WHEN is_income = 0 THEN a ELSE 0 END)"


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to a few places, as sums of parts differ in their last bits."""
    return df.select(*[F.round(c, places).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def add(name: str, sql: str | None, *, prefix: bool = True) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        Q[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            SQL[name] = PREFIX + sql if prefix else sql
        return f

    return register


def spine(spark: SparkSession, d: str) -> DataFrame:
    return lb.spine(t.transactions(spark, d), t.labels(spark, d), t.categories(spark, d))


def on_spine(name: str, sql: str, f: Callable[[DataFrame], DataFrame]) -> None:
    add(name, sql)(lambda spark, d: f(spine(spark, d)))


def on_tx(name: str, sql: str, f: Callable[[DataFrame], DataFrame]) -> None:
    add(name, sql)(lambda spark, d: f(t.transactions(spark, d)))


def on_log(name: str, sql: str, f: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    add(name, sql)(lambda spark, d: f(t.transactions(spark, d), t.labels(spark, d)))


def on_three(name: str, sql: str, f: Callable[[DataFrame, DataFrame, DataFrame], DataFrame]) -> None:
    add(name, sql)(lambda spark, d: f(t.transactions(spark, d), t.labels(spark, d), t.categories(spark, d)))


RANGE = f"date BETWEEN DATE '{SINCE}' AND DATE '{UNTIL}'"
BEFORE = "date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'"

# labels
on_log("e1_latest_label", "SELECT expense_id, label_id, category_id, source AS label_source, confidence FROM latest", lambda tx, l: lb.latest_labels(l))
on_log("e2_latest_user_label", "SELECT expense_id, category_id FROM latest_user", lambda tx, l: lb.latest_labels(l, "user").select("expense_id", "category_id"))
on_spine("d1_spine", "SELECT id, date, cents, category, label_source, confidence FROM s", lambda s: s.select("id", "date", "cents", "category", "label_source", "confidence"))
on_three("d2_e24_category_stats", """SELECT c.category_id, c.name, c.is_savings, count(tx.id) AS n_expenses, round(coalesce(sum(cents), 0) / 100.0, 6) AS total_eur, round(coalesce(sum(a), 0) / 100.0, 6) AS abs_total_eur, max(tx.date) AS last_seen
FROM cat c LEFT JOIN latest l USING (category_id) LEFT JOIN tx ON tx.id = l.expense_id GROUP BY 1, 2, 3""", lb.category_stats)
on_three("e25_uncategorized_stat", "SELECT count(*) AS n_expenses, round(coalesce(sum(cents), 0) / 100.0, 6) AS total_eur, round(coalesce(sum(a), 0) / 100.0, 6) AS abs_total_eur, max(date) AS last_seen FROM s WHERE known IS NULL", lb.uncategorized_stat)
on_log("e20_categorization_mix", """SELECT *, greatest(total - "user" - high - medium - low, 0) AS uncategorized FROM (SELECT count(*) AS total, count(*) FILTER (u = 1) AS "user", count(*) FILTER (u = 0 AND ls = 'model' AND cf >= 0.7) AS high,
count(*) FILTER (u = 0 AND ls = 'model' AND cf >= 0.4 AND cf < 0.7) AS medium, count(*) FILTER (u = 0 AND ls = 'model' AND (cf IS NULL OR cf < 0.4)) AS low FROM st)""", lb.categorization_mix)
on_log("e21_queue_counts", """SELECT *, needs_label + low_conf + confirm AS queue_size FROM (SELECT count(*) FILTER (u = 0 AND m = 0) AS needs_label, count(*) FILTER (u = 0 AND ls = 'model' AND (cf IS NULL OR cf < 0.4)) AS low_conf,
count(*) FILTER (u = 0 AND ls = 'model' AND cf >= 0.4 AND cf < 0.7) AS confirm FROM st)""", lb.queue_counts)
on_log("e22_review_queue", "SELECT id, date FROM st WHERE u = 0 AND (m = 0 OR (ls = 'model' AND (cf IS NULL OR cf < 0.7)))", lb.review_queue)
on_log("e23_auto_coverage", "SELECT round(least((sum(u) + count(*) FILTER (ls = 'model' AND cf >= 0.7)) / count(*) * 100.0, 100.0), 6) AS coverage FROM st", lb.auto_coverage)
on_log("e26_vendor_label_distribution", "SELECT vendor, category_id, count(*) AS n FROM lab JOIN tx ON tx.id = expense_id WHERE source = 'user' AND vendor <> '' GROUP BY 1, 2", lambda tx, l: lb.label_distribution(tx, l, "vendor"))
on_log("e26_iban_label_distribution", "SELECT iban, category_id, count(*) AS n FROM lab JOIN tx ON tx.id = expense_id WHERE source = 'user' AND iban <> '' GROUP BY 1, 2", lambda tx, l: lb.label_distribution(tx, l, "iban"))
on_log("e27_vendor_majority", """, d AS (SELECT iban, category_id, count(*) AS n FROM lab JOIN tx ON tx.id = expense_id WHERE source = 'user' AND iban <> '' GROUP BY 1, 2)
SELECT iban, category_id, round(n / t, 6) AS agreement FROM (SELECT *, sum(n) OVER (PARTITION BY iban) AS t, row_number() OVER (PARTITION BY iban ORDER BY n DESC, category_id) AS r FROM d) WHERE r = 1 AND n / t >= 0.3""", lambda tx, l: lb.majority(lb.label_distribution(tx, l, "iban"), "iban", 0.3))
on_log("e28_sign_consistency", """SELECT category_id, CASE WHEN p >= n THEN 1 ELSE -1 END AS sign, round(greatest(p, n) / (p + n), 6) AS consistency, p + n AS support
FROM (SELECT lab.category_id, count(*) FILTER (cents > 0) AS p, count(*) FILTER (cents < 0) AS n FROM lab JOIN tx ON tx.id = expense_id WHERE source = 'user' AND cents <> 0 GROUP BY 1)""", lb.sign_consistency)
on_log("e29_labelled_vendors", "SELECT DISTINCT vendor FROM lab JOIN tx ON tx.id = expense_id WHERE source = 'user' AND vendor <> ''", lb.labelled_vendors)
on_three("e30_undercovered", """SELECT category_id, n_labels FROM (SELECT cat.category_id, count(lab.label_id) AS n_labels FROM cat LEFT JOIN lab ON lab.category_id = cat.category_id AND source = 'user' GROUP BY 1)
WHERE n_labels < (SELECT count(*) / 25 FROM lab WHERE source = 'user')""", lambda tx, l, c: lb.undercovered(l, c, 1 << 62).join(l.where("source = 'user'").agg((F.count(F.lit(1)) / 25).alias("mean")), F.col("n_labels") < F.col("mean")).select("category_id", "n_labels"))
on_log("e31_label_counts", "SELECT category_id, count(*) AS n, (count(*) >= 2)::INT AS eligible FROM latest_user GROUP BY 1", lambda tx, l: lb.label_counts(l))
on_log("e32_removal_impact", "SELECT count(*) AS n_labels, count(DISTINCT expense_id) AS n_expenses FROM lab WHERE category_id = 3", lambda tx, l: lb.removal_impact(l, 3))
on_three("a17_status", "SELECT (SELECT count(*) FROM tx) AS n_expenses, (SELECT count(DISTINCT expense_id) FROM lab WHERE source = 'user') AS n_labelled, (SELECT count(*) FROM cat) AS n_categories", lb.status)
on_log("d7_without_user_label", "SELECT id FROM tx WHERE id NOT IN (SELECT expense_id FROM lab WHERE source = 'user')", lambda tx, l: lb.without_label(tx, l).select("id"))
on_log("d8_latest_in_band", "SELECT id, date FROM st WHERE ls = 'model' AND cf >= 0.4 AND cf < 0.7", lambda tx, l: lb.label_state(tx, l).where(lb.is_model(lb.LOW, lb.MEDIUM)).select("id", "date"))
on_log("b29_confidence_band", """SELECT ls AS source, CASE WHEN ls = 'user' THEN 'user' WHEN ls IS NULL THEN 'none' WHEN cf >= 0.7 THEN 'high' WHEN cf >= 0.4 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM st GROUP BY 1, 2""",
       lambda tx, l: lb.label_state(tx, l).groupBy(F.col("label_source").alias("source"), F.when(F.col("label_source") == "user", "user").when(F.col("label_source").isNull(), "none").when(F.col("confidence") >= lb.MEDIUM, "high").when(F.col("confidence") >= lb.LOW, "medium").otherwise("low").alias("band")).agg(F.count(F.lit(1)).alias("n")))

# reports
SPENT = f"FROM s WHERE is_income = 0 AND {RANGE}"
on_spine("e3_spend_by_category", f"SELECT {NAME} AS name, {COLOR} AS color, round(sum(a) / 100.0, 6) AS amount {SPENT} GROUP BY category_id, 1, 2", lambda s: reports.spend_by_category(s, SINCE, UNTIL))
on_spine("e4_spend_shares", f"SELECT *, round(amount / sum(amount) OVER (), 6) AS share FROM (SELECT {NAME} AS name, {COLOR} AS color, round(sum(a) / 100.0, 6) AS amount {SPENT} GROUP BY category_id, 1, 2)", lambda s: reports.spend_shares(s, SINCE, UNTIL))
on_spine("e5_monthly_flow", f"SELECT strftime(date, '%Y-%m') AS ym, {NAME} AS name, {COLOR} AS color, round(sum(cents) / 100.0, 6) AS amount FROM s WHERE {KEPT} GROUP BY 1, 2, 3", reports.monthly_flow_by_category)
on_spine("e6_amount_distribution", f"SELECT id, round(a / 100.0, 6) AS amount, {NAME} AS name {SPENT}", lambda s: reports.amount_distribution(s, SINCE, UNTIL))
on_spine("e6_amount_histogram", f"""SELECT name, least(floor((amount - low) / (high - low) * 30), 29)::INT AS bin, count(*) AS n FROM (SELECT {NAME} AS name, a / 100.0 AS amount FROM s WHERE is_income = 0), (SELECT min(a) / 100.0 AS low, max(a) / 100.0 AS high FROM s WHERE is_income = 0) GROUP BY 1, 2""", reports.amount_histogram)
on_tx("e7_top_counterparties", f"SELECT coalesce(nullif(vendor, ''), '(unbekannt)') AS name, round(sum(a) / 100.0, 6) AS amount, count(*) AS n_tx FROM tx WHERE is_income = 0 AND {RANGE} GROUP BY 1 ORDER BY sum(a) DESC, name LIMIT 15", lambda x: reports.top_counterparties(x, 15, SINCE, UNTIL))
on_tx("e8_daily_spend", "SELECT date AS d, round(sum(a) / 100.0, 6) AS amount FROM tx WHERE is_income = 0 GROUP BY 1", reports.daily_spend)
on_spine("e9_daily_by_category", f"SELECT date AS d, {NAME} AS name, {COLOR} AS color, round(sum(a) / 100.0, 6) AS amount FROM s WHERE is_income = 0 GROUP BY 1, 2, 3", reports.daily_by_category)
on_spine("e9_weekly_by_category", f"SELECT strftime(date, '%Y-W%W') AS yw, {NAME} AS name, {COLOR} AS color, round(sum(a) / 100.0, 6) AS amount FROM s WHERE is_income = 0 GROUP BY 1, 2, 3", reports.weekly_by_category)
on_spine("e10_savings_flow", f"SELECT strftime(date, '%Y-%m') AS ym, round({EXP} / 100.0, 6) AS to_savings, round({INC} / 100.0, 6) AS from_savings, round(({EXP} - {INC}) / 100.0, 6) AS net FROM s WHERE coalesce(is_savings, 0) = 1 GROUP BY 1", reports.savings_flow)
TOTALS = f"round({INC} / 100.0, 6) AS income, round({EXP} / 100.0, 6) AS expenses, round(({INC} - {EXP}) / 100.0, 6) AS net, round(CASE WHEN {INC} > 0 THEN ({INC} - {EXP}) / {INC} END, 6) AS savings_rate FROM s WHERE {KEPT}"
on_spine("e11_monthly_income_vs_expense", f"SELECT strftime(date, '%Y-%m') AS ym, {TOTALS} GROUP BY 1", reports.monthly_income_vs_expense)
on_spine("e12_period_totals", f"SELECT {TOTALS} AND {RANGE}", lambda s: reports.period_totals(s, SINCE, UNTIL))
on_spine("e13_headline", f"""SELECT round(i / 100.0, 6) AS income, round(e / 100.0, 6) AS expenses, round((i - e) / 100.0, 6) AS net, round((i - e) / i * 100.0, 6) AS savings_rate_pct, round((i - pi) / pi * 100.0, 6) AS income_change_pct, round((e - pe) / pe * 100.0, 6) AS expenses_change_pct, round(sv / 100.0, 6) AS net_to_savings
FROM (SELECT sum(a) FILTER (is_income = 1 AND {KEPT} AND {RANGE}) AS i, sum(a) FILTER (is_income = 0 AND {KEPT} AND {RANGE}) AS e, sum(a) FILTER (is_income = 1 AND {KEPT} AND {BEFORE}) AS pi, sum(a) FILTER (is_income = 0 AND {KEPT} AND {BEFORE}) AS pe, sum(-cents) FILTER (is_savings = 1 AND {RANGE}) AS sv FROM s)""", lambda s: reports.headline(s, SINCE, UNTIL))
COMPARE = f"SELECT {NAME} AS name, coalesce(sum(a) FILTER ({RANGE}), 0) AS c, coalesce(sum(a) FILTER ({BEFORE}), 0) AS p FROM s WHERE is_income = 0 AND {KEPT} AND ({RANGE} OR {BEFORE}) GROUP BY 1"
COMPARED = "SELECT name, round(c / 100.0, 6) AS current, round(p / 100.0, 6) AS previous, round((c - p) / 100.0, 6) AS delta, round(CASE WHEN p > 0 THEN (c - p) / p END, 6) AS pct FROM"
on_spine("e14_category_period_comparison", f"{COMPARED} ({COMPARE})", lambda s: reports.category_period_comparison(s, SINCE, UNTIL))
on_spine("e14_top_movers", f"{COMPARED} ({COMPARE}) ORDER BY abs(c - p) DESC, name LIMIT 8", lambda s: reports.top_movers(s, SINCE, UNTIL))
on_spine("e15_g2_month_to_date_pace", f"""SELECT round(sp / 100.0, 6) AS spent, 17 AS days_elapsed, 30 AS days_in_month, round(sp / 100.0 / 17 * 30, 6) AS projected, round(b, 6) AS baseline FROM (SELECT coalesce(sum(a), 0) AS sp FROM s WHERE is_income = 0 AND {KEPT} AND date BETWEEN DATE '1998-09-01' AND DATE '{TODAY}'),
(SELECT avg(m) / 100.0 AS b FROM (SELECT sum(a) AS m FROM s WHERE is_income = 0 AND {KEPT} AND date < DATE '1998-09-01' GROUP BY strftime(date, '%Y-%m') ORDER BY strftime(date, '%Y-%m') DESC LIMIT 6))""", lambda s: reports.month_to_date_pace(s, TODAY))
REC = """, gaps AS (SELECT vendor, id, date, counterparty, a, date - lag(date) OVER (PARTITION BY vendor ORDER BY date, id) AS gap FROM tx WHERE is_income = 0 AND vendor <> ''),
vend AS (SELECT vendor, count(*) AS n_charges, median(gap) AS gap, median(a) / 100.0 AS typical_amount, max(date) AS last_seen, arg_max(counterparty, {'d': date, 'i': id}) AS cname FROM gaps GROUP BY 1 HAVING count(*) >= 3),
buck AS (SELECT * FROM (VALUES ('weekly', 7.0::DOUBLE, 1), ('bi-weekly', 14.0::DOUBLE, 2), ('monthly', 30.4::DOUBLE, 3), ('quarterly', 91.3::DOUBLE, 4), ('semi-annual', 182.6::DOUBLE, 5), ('annual', 365.25::DOUBLE, 6)) b(cadence, days, o)),
rec AS (SELECT coalesce(nullif(cname, ''), vendor) AS name, cadence, last_seen, typical_amount, 365.25::DOUBLE / days AS charges_per_year, typical_amount * (365.25::DOUBLE / days) AS annualised, n_charges FROM vend JOIN buck ON gap > 0 QUALIFY row_number() OVER (PARTITION BY vendor ORDER BY abs(ln(gap / days)), o) = 1)
"""
on_tx("e16_f9_recurring_subscriptions", REC + "SELECT name, cadence, last_seen, round(typical_amount, 6) AS typical_amount, round(charges_per_year, 6) AS charges_per_year, round(annualised, 6) AS annualised, n_charges FROM rec", recurring.recurring_subscriptions)
on_tx("e17_upcoming_recurring", REC + """SELECT name, cadence, e AS expected_date, round(typical_amount, 6) AS typical_amount, (e - DATE '2001-07-15')::INT AS days_until FROM (SELECT *, (last_seen + (g * greatest(1, ceil((DATE '2001-07-15' - last_seen) / g)))::INT)::DATE AS e FROM (SELECT *, round_even(365.25 / charges_per_year, 0)::INT AS g FROM rec)) WHERE e - DATE '2001-07-15' <= 30""", lambda x: recurring.upcoming_recurring(x, "2001-07-15"))
on_tx("e18_fixed_vs_variable", REC + """SELECT round(least(f, t), 6) AS fixed_monthly, round(greatest(t - least(f, t), 0), 6) AS variable_monthly, round(t, 6) AS total_monthly, round(least(f, t) / t, 6) AS fixed_share FROM (SELECT coalesce(sum(annualised) / 12, 0) AS f FROM rec), (SELECT avg(m) / 100.0 AS t FROM (SELECT sum(a) AS m FROM tx WHERE is_income = 0 AND coalesce(self, 0) = 0 GROUP BY strftime(date, '%Y-%m')))""", recurring.fixed_vs_variable)
add("e19_d3_anomalies", f"""SELECT id, date, counterparty, {NAME} AS category, round(a / 100.0, 6) AS amount, round(mean / 100.0, 6) AS typical, round(a / mean, 6) AS vs_typical, round(z, 6) AS zscore, n_history FROM (SELECT s.*, mean, k AS n_history, (a - mean) / sqrt(sq - mean * mean) AS z FROM s JOIN (SELECT vendor, avg(a) AS mean, avg(a::DOUBLE * a) AS sq, count(*) AS k FROM s WHERE is_income = 0 AND vendor <> '' GROUP BY 1) USING (vendor) WHERE is_income = 0 AND k >= 3 AND sq - mean * mean > 0)
WHERE z > 2 ORDER BY date DESC, z DESC, id LIMIT 25""")(lambda spark, d: reports.anomalies(t.transactions(spark, d), t.labels(spark, d), t.categories(spark, d)))
on_spine("e33_g1_latest_records", f"SELECT id, date, counterparty, {NAME} AS category, round(cents / 100.0, 6) AS amount FROM s ORDER BY date DESC, id DESC LIMIT 5000", reports.latest_records)
NOTES = ", notes AS (SELECT event_id * 4 AS expense_id, max(event_type) AS text, max(ts)::DATE AS updated FROM events WHERE event_id % 10 = 0 GROUP BY 1)\n"
add("e33_b30_records", NOTES + """SELECT s.id, s.date, text AS note, greatest(s.date, (SELECT max(created) FROM lab WHERE lab.expense_id = s.id), updated) AS last_modified FROM s LEFT JOIN notes n ON n.expense_id = s.id""")(
    lambda spark, d: reports.records(spine(spark, d), t.labels(spark, d), t.notes(spark, d)).select("id", "date", "note", F.to_date("last_modified").alias("last_modified")))
on_spine("e33_selection_total", f"SELECT count(*) AS n, round(sum(cents) / 100.0, 6) AS total FROM s WHERE {RANGE}", lambda s: reports.selection_total(s.where(reports.between(SINCE, UNTIL))))
on_spine("c5_search_transactions", f"SELECT id FROM s WHERE {RANGE} AND is_income = 0 AND a BETWEEN 500000 AND 40000000 AND (lower(counterparty) LIKE '%markt%' OR lower(memo) LIKE '%markt%') AND label_source = 'model'",
         lambda s: reports.search_transactions(s, since=SINCE, until=UNTIL, include_income=False, least=5000, most=400000, text="MARKT", source="model").select("id"))
on_spine("c6_wildcard_search", "SELECT id FROM s WHERE lower(concat_ws(' · ', id, date, counterparty, memo, coalesce(category, ''))) LIKE '%netflix%' AND lower(concat_ws(' · ', id, date, counterparty, memo, coalesce(category, ''))) LIKE '%rech%vom%'", lambda s: reports.wildcard_search(s, "Netflix rech*vom", ["id", "date", "counterparty", "memo", "category"]).select("id"))
on_spine("c1_c4_filters", f"SELECT id FROM s WHERE {RANGE} AND is_income = 0 AND {KEPT}", lambda s: reports.expenses(s, SINCE, UNTIL).where(reports.external() & reports.not_savings()).select("id"))

# history
on_tx("f1_f3_vendor_history", """SELECT id, CASE WHEN vendor <> '' THEN (date - lag(date) OVER w)::INT END AS days_since_prev_same_cp, CASE WHEN vendor = '' OR count(*) OVER p < 2 THEN NULL WHEN avg(a::DOUBLE * a) OVER p - (avg(a) OVER p) * (avg(a) OVER p) <= 0 THEN 0 ELSE round((a - avg(a) OVER p) / sqrt(avg(a::DOUBLE * a) OVER p - (avg(a) OVER p) * (avg(a) OVER p)), 4) END AS amount_zscore_within_cp
FROM tx WINDOW w AS (PARTITION BY vendor ORDER BY date, id), p AS (PARTITION BY vendor ORDER BY date, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""", lambda x: rounded(temporal.temporal_features(x, features=("days_since_prev_same_cp", "amount_zscore_within_cp")), 4))
on_tx("f4_d5_vendor_counts", """SELECT e.id, count(p.id) FILTER (e.date - p.date <= 30) AS count_same_cp_30d, count(p.id) FILTER (e.date - p.date <= 90) AS count_same_cp_90d, count(p.id) FILTER (e.date - p.date <= 365) AS count_same_cp_365d FROM tx e LEFT JOIN tx p ON e.vendor <> '' AND p.vendor = e.vendor AND p.date < e.date AND e.date - p.date <= 365 GROUP BY 1""", lambda x: temporal.temporal_features(x, features=("count_same_cp_30d", "count_same_cp_90d", "count_same_cp_365d")))
on_tx("f5_d4_recurrence", """SELECT e.id, (count(DISTINCT strftime(p.date, '%Y-%m')) >= 3)::INT AS is_likely_recurring, count(DISTINCT CASE WHEN e.date - p.date <= 365 THEN strftime(p.date, '%Y-%m') END) AS recurring_months_12, (count(p.id) > 0 AND count(p.id) = count(p.id) FILTER (p.a = e.a))::INT AS recurring_is_exact_amount FROM tx e LEFT JOIN tx p ON e.vendor <> '' AND p.vendor = e.vendor AND p.date < e.date AND e.a > 0 AND abs(p.a - e.a) <= e.a * 0.1::DOUBLE GROUP BY 1""", lambda x: temporal.temporal_features(x, features=temporal.SIMILAR_FEATURES))
on_tx("f6_d6_iban_count", "SELECT e.id, count(p.id) AS iban_count_before FROM tx e LEFT JOIN tx p ON e.iban <> '' AND p.iban = e.iban AND p.date < e.date GROUP BY 1", lambda x: temporal.temporal_features(x, features=temporal.IBAN_FEATURES))
on_log("f7_f8_features_of_subset", "SELECT e.id, count(p.id) AS count_same_cp_365d FROM tx e LEFT JOIN tx p ON e.vendor <> '' AND p.vendor = e.vendor AND p.date < e.date AND e.date - p.date <= 365 WHERE e.id NOT IN (SELECT expense_id FROM lab WHERE source = 'user') GROUP BY 1", lambda tx, l: temporal.temporal_features(tx, lb.without_label(tx, l), ("count_same_cp_365d",)))
