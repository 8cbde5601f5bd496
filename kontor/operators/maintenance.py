"""Own accounts, resets and exports: maintenance of the tables as whole snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kontor.functions import iban, text
from kontor.operators import labels as lb

#: What ingest and learning have made, and what the user has set up.
DATA, SETTINGS = ("labels", "embeddings", "notes", "vendor_cache", "transactions"), ("categories", "own_ibans")
BYTE_ORDER_MARK = "﻿"


def account_rows(rows: DataFrame) -> DataFrame:
    """(iban, label), the number in its one spelling, blank labels null; of one number's rows that with a label, by alphabet."""
    number = iban.clean(F.col("iban"))
    return rows.select(number.alias("iban"), F.nullif(F.trim(text.or_empty(F.col("label"))), F.lit("")).alias("label")).groupBy("iban").agg(F.min("label").alias("label"))


def flagged(tx: DataFrame, accounts: DataFrame, value: int) -> tuple[DataFrame, DataFrame]:
    """``tx`` with ``iban_is_known_self`` set to ``value`` for rows of ``accounts``, and one row: changed, how many of them had another value."""
    hit = tx.withColumn("_number", iban.clean(F.col("iban"))).join(accounts.select(F.col("iban").alias("_number"), F.lit(True).alias("_hit")).distinct(), "_number", "left")
    old = F.coalesce("iban_is_known_self", F.lit(0))
    changed = F.coalesce("_hit", F.lit(False)) & (old != value)
    report = hit.agg(F.count(F.when(changed, 1)).alias("changed"))
    return hit.withColumn("iban_is_known_self", F.when(changed, value).otherwise(F.col("iban_is_known_self")).cast("int")).select(*tx.columns), report


def add_own(own: DataFrame, new: DataFrame, tx: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The own accounts with ``new`` (iban, label) added or labelled anew, ``tx`` with their rows flagged, one row: changed, and the rows of ``new`` that are no valid numbers."""
    ok = iban.is_valid(iban.clean(F.col("iban")))
    good = account_rows(new.where(ok))
    kept = own.select("iban", "label").join(good.select("iban"), "iban", "left_anti").unionByName(good)
    out, report = flagged(tx, good, 1)
    return kept, out, report, new.where(~F.coalesce(ok, F.lit(False)))


def remove_own(own: DataFrame, gone: DataFrame, tx: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The own accounts without ``gone`` (iban), ``tx`` with the rows of those that were there no longer flagged, and one row: changed."""
    number = gone.select(iban.clean(F.col("iban")).alias("iban")).distinct()
    out, report = flagged(tx, own.join(number, "iban", "left_semi"), 0)
    return own.join(number, "iban", "left_anti"), out, report


def relabel_own(own: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The own accounts with other labels where ``labels`` (iban, label) has them, and one row: changed, the number of accounts found."""
    new = account_rows(labels).withColumnRenamed("label", "_label").withColumn("_hit", F.lit(True))
    both = own.select("iban", "label").join(new, "iban", "left")
    hit = F.coalesce("_hit", F.lit(False))
    return both.select("iban", F.when(hit, F.col("_label")).otherwise(F.col("label")).alias("label")), both.agg(F.count(F.when(hit, 1)).alias("changed"))


def reset(tables: dict[str, DataFrame], *, everything: bool = False) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables, those of :data:`DATA` empty (and those of :data:`SETTINGS`, if ``everything``), and (table, n_rows) of what went. A table that hangs on another's rows goes with it."""
    names = [n for n in (*DATA, *(SETTINGS if everything else ())) if n in tables]
    report = None
    for n in names:
        one = tables[n].agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table"), "n_rows")
        report = one if report is None else report.unionByName(one)
    return {n: df.limit(0) if n in names else df for n, df in tables.items()}, report


def delete_user_labels(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The log of the model's labels alone, and one row: deleted."""
    return labels.where("source <> 'user'"), labels.where("source = 'user'").agg(F.count(F.lit(1)).alias("deleted"))


def labels_handoff(labels: DataFrame, categories: DataFrame) -> DataFrame:
    """(expense_id, category_id, category, source, confidence) of the latest label of each expense."""
    c = categories.select("category_id", F.col("name").alias("category"))
    return lb.latest_labels(labels).join(c, "category_id", "left").select("expense_id", "category_id", "category", F.col("label_source").alias("source"), "confidence")


def write_export(rows: DataFrame, path: str, format: str = "csv", order: tuple[Column | str, ...] = ()) -> None:
    """``rows`` as files under ``path``, in ``order`` over all of them: CSV with a header and a UTF-8 mark in each file, as spreadsheets want it, or Parquet."""
    if order:
        rows = rows.orderBy(*order)
    if format == "parquet":
        rows.write.parquet(path)
        return
    if format != "csv":
        raise ValueError(f"unknown format {format}")
    plain = rows.select(*[F.date_format(c, "yyyy-MM-dd").alias(c) if k == "date" else F.col(c) for c, k in rows.dtypes])
    first = plain.columns[0]
    plain.withColumnRenamed(first, BYTE_ORDER_MARK + first).write.option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", '""').option("nullValue", "").csv(path)


def read_export(spark, path: str, schema: str) -> DataFrame:  # noqa: ANN001
    """What :func:`write_export` wrote as CSV, of this schema."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("quote", '"').option("escape", '"').option("multiLine", True).option("emptyValue", "").option("nullValue", "").csv(path)
