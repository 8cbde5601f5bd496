"""The append-only label log: latest labels, the spine of facts with their category, queues and label statistics.

``labels``: label_id, expense_id, category_id, source (``user`` or ``model``), confidence; a larger ``label_id`` is later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNCATEGORISED, NO_COLOR = "(unkategorisiert)", "#bbbbbb"
LOW, MEDIUM = 0.40, 0.70


def latest_labels(labels: DataFrame, source: str | None = None) -> DataFrame:
    """One row per expense, its last label of any source, or of ``source`` alone. One shuffle with partial aggregation."""
    rows = labels if source is None else labels.where(F.col("source") == source)
    last = F.max_by(F.struct("label_id", "category_id", "source", "confidence"), "label_id")
    return rows.groupBy("expense_id").agg(last.alias("l")).select("expense_id", "l.label_id", "l.category_id", F.col("l.source").alias("label_source"), "l.confidence")


def spine(tx: DataFrame, labels: DataFrame, categories: DataFrame) -> DataFrame:
    """Facts with latest label and category (all null where there is none). Categories are a dimension; Spark broadcasts them by their size."""
    c = categories.select(F.col("category_id").alias("known_category_id"), F.col("name").alias("category"), "color", "is_savings")
    with_label = tx.join(latest_labels(labels), tx.id == F.col("expense_id"), "left").drop("expense_id")
    return with_label.join(c, F.col("category_id") == F.col("known_category_id"), "left")


def category_name() -> Column:
    return F.coalesce("category", F.lit(UNCATEGORISED))


def category_color() -> Column:
    return F.coalesce("color", F.lit(NO_COLOR))


def labelled_by(labels: DataFrame, source: str) -> DataFrame:
    return labels.where(F.col("source") == source).select(F.col("expense_id").alias("id")).distinct()


def without_label(tx: DataFrame, labels: DataFrame, source: str = "user") -> DataFrame:
    return tx.join(labelled_by(labels, source), "id", "left_anti")


def label_state(tx: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, date, has_user, has_model, label_source, confidence) of every expense: all queue reports read this one pass over the log."""
    last = F.max_by(F.struct("source", "confidence"), "label_id")
    state = labels.groupBy("expense_id").agg(F.max((F.col("source") == "user").cast("int")).alias("has_user"), F.max((F.col("source") == "model").cast("int")).alias("has_model"), last.alias("l"))
    out = tx.select("id", "date").join(state, F.col("id") == F.col("expense_id"), "left")
    zero = F.lit(0)
    return out.select("id", "date", F.coalesce("has_user", zero).alias("has_user"), F.coalesce("has_model", zero).alias("has_model"), F.col("l.source").alias("label_source"), F.col("l.confidence").alias("confidence"))


def is_model(low: float | None, high: float | None, or_null: bool = False) -> Column:
    """The latest label is the model's, with a confidence in [low, high)."""
    test = F.lit(True)
    if low is not None:
        test = test & (F.col("confidence") >= low)
    if high is not None:
        test = test & (F.col("confidence") < high)
    if or_null:
        test = test | F.col("confidence").isNull()
    return (F.col("label_source") == "model") & test


def count_if(test: Column) -> Column:
    return F.count(F.when(test, 1))


def categorization_mix(tx: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: total, user, high, medium, low, uncategorized."""
    free = F.col("has_user") == 0
    out = label_state(tx, labels).agg(
        F.count(F.lit(1)).alias("total"), count_if(~free).alias("user"), count_if(free & is_model(MEDIUM, None)).alias("high"),
        count_if(free & is_model(LOW, MEDIUM)).alias("medium"), count_if(free & is_model(None, LOW, or_null=True)).alias("low"),
    )
    return out.withColumn("uncategorized", F.greatest(F.col("total") - F.col("user") - F.col("high") - F.col("medium") - F.col("low"), F.lit(0)))


def queue_counts(tx: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: needs_label, low_conf, confirm and their sum, the queue's size."""
    free = F.col("has_user") == 0
    out = label_state(tx, labels).agg(count_if(free & (F.col("has_model") == 0)).alias("needs_label"), count_if(free & is_model(None, LOW, or_null=True)).alias("low_conf"), count_if(free & is_model(LOW, MEDIUM)).alias("confirm"))
    return out.withColumn("queue_size", F.col("needs_label") + F.col("low_conf") + F.col("confirm"))


def review_queue(tx: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, date) of all rows to review: no user label, and no model label or one below the upper band. Order by date and id, last first, or by id for predictions."""
    return label_state(tx, labels).where((F.col("has_user") == 0) & ((F.col("has_model") == 0) | is_model(None, MEDIUM, or_null=True))).select("id", "date")


def auto_coverage(tx: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: percent of expenses with a user label or a confident model label; rows with both count twice, and the whole is capped at 100."""
    r = label_state(tx, labels).agg(F.count(F.lit(1)).alias("n"), (F.sum("has_user") + count_if(is_model(MEDIUM, None))).alias("k"))
    return r.select(F.when(F.col("n") > 0, F.least(F.col("k") / F.col("n") * 100.0, F.lit(100.0))).otherwise(0.0).alias("coverage"))


def category_stats(tx: DataFrame, labels: DataFrame, categories: DataFrame) -> DataFrame:
    """Per category, used or not: rows, signed and absolute total, last date."""
    used = tx.join(latest_labels(labels), tx.id == F.col("expense_id")).groupBy("category_id").agg(F.count("id").alias("n"), F.sum("cents").alias("s"), F.sum(F.abs("cents")).alias("a"), F.max("date").alias("last_seen"))
    zero = F.lit(0)
    return categories.join(used, "category_id", "left").select(
        "category_id", "name", "is_savings", F.coalesce("n", zero).alias("n_expenses"), (F.coalesce("s", zero) / 100.0).alias("total_eur"), (F.coalesce("a", zero) / 100.0).alias("abs_total_eur"), "last_seen"
    )


def uncategorized_stat(tx: DataFrame, labels: DataFrame, categories: DataFrame) -> DataFrame:
    s = spine(tx, labels, categories).where("known_category_id is null")
    return s.agg(F.count("id").alias("n_expenses"), (F.coalesce(F.sum("cents"), F.lit(0)) / 100.0).alias("total_eur"), (F.coalesce(F.sum(F.abs("cents")), F.lit(0)) / 100.0).alias("abs_total_eur"), F.max("date").alias("last_seen"))


def label_distribution(tx: DataFrame, labels: DataFrame, key: str, only: DataFrame | None = None) -> DataFrame:
    """(key, category_id, n): every user label, not the latest alone, by vendor or IBAN; ``only``: ids of expenses that may count."""
    rows = labels.where("source = 'user'").select(F.col("expense_id").alias("id"), "category_id")
    if only is not None:
        rows = rows.join(only.select("id"), "id", "left_semi")
    return rows.join(tx.where((F.col(key) != "") & F.col(key).isNotNull()).select("id", key), "id").groupBy(key, "category_id").agg(F.count(F.lit(1)).alias("n"))


def majority(distribution: DataFrame, key: str | list[str], least: float = 0.8) -> DataFrame:
    """(key, category_id, agreement) where the largest category has that share; ties to the smaller category."""
    keys = [key] if isinstance(key, str) else key
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "category_id"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*keys))
    return distribution.withColumn("agreement", share).withColumn("r", rank).where((F.col("r") == 1) & (F.col("agreement") >= least)).select(*keys, "category_id", "agreement")


def sign_consistency(tx: DataFrame, labels: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Per category: the sign most of its user labels have (even: income), their share, and how many there are."""
    rows = labels.where("source = 'user'").select(F.col("expense_id").alias("id"), "category_id")
    if only is not None:
        rows = rows.join(only.select("id"), "id", "left_semi")
    n = rows.join(tx.where("cents <> 0").select("id", "cents"), "id").groupBy("category_id").agg(count_if(F.col("cents") > 0).alias("pos"), count_if(F.col("cents") < 0).alias("neg"))
    return signs(n, "category_id")


def signs(counts: DataFrame, *keys: str) -> DataFrame:
    """(keys, sign, consistency, support) from (keys, pos, neg)."""
    both = F.col("pos") + F.col("neg")
    return counts.select(*keys, F.when(F.col("pos") >= F.col("neg"), 1).otherwise(-1).alias("sign"), (F.greatest("pos", "neg") / both).alias("consistency"), both.alias("support"))


def labelled_vendors(tx: DataFrame, labels: DataFrame) -> DataFrame:
    return tx.where("vendor <> ''").join(labelled_by(labels, "user"), "id", "left_semi").select("vendor").distinct()


def undercovered(labels: DataFrame, categories: DataFrame, least: int) -> DataFrame:
    """Categories with fewer user labels than ``least``, none included."""
    n = labels.where("source = 'user'").groupBy("category_id").agg(F.count(F.lit(1)).alias("n"))
    return categories.join(n, "category_id", "left").withColumn("n_labels", F.coalesce("n", F.lit(0))).where(F.col("n_labels") < least).select("category_id", "n_labels")


def label_counts(labels: DataFrame) -> DataFrame:
    """Per category of the latest user labels: rows, and whether there are two at least (it can be evaluated)."""
    return latest_labels(labels, "user").groupBy("category_id").agg(F.count(F.lit(1)).alias("n")).withColumn("eligible", (F.col("n") >= 2).cast("int"))


def removal_impact(labels: DataFrame, category_id: int) -> DataFrame:
    return labels.where(F.col("category_id") == category_id).agg(F.count(F.lit(1)).alias("n_labels"), F.count_distinct("expense_id").alias("n_expenses"))


def status(tx: DataFrame, labels: DataFrame, categories: DataFrame) -> DataFrame:
    one = tx.agg(F.count(F.lit(1)).alias("n_expenses"))
    return one.crossJoin(labels.where("source = 'user'").agg(F.count_distinct("expense_id").alias("n_labelled"))).crossJoin(categories.agg(F.count(F.lit(1)).alias("n_categories")))  # one row each
