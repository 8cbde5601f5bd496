"""Evaluation: stratified folds without leaks, scores, confusion, stages, and ablation."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kontor.operators.cascade import STAGES, CascadeConfig, choose, label_free, predict, stage_store
from kontor.operators.numbering import rank_in_groups
from kontor.scratch import scratch_table


def stratified_folds(truth: DataFrame, n_folds: int, seed: int = 0) -> DataFrame:
    """(id, category_id, fold) from (id, category_id): classes of one row are left out; as many folds as the smallest class has rows, from 2 to ``n_folds``."""
    sizes = truth.groupBy("category_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    smallest = sizes.agg(F.min("n")).first()[0]
    k = max(2, min(n_folds, smallest or 2))
    rows = truth.join(sizes.select("category_id"), "category_id", "left_semi").select("id", "category_id")
    placed = rank_in_groups(rows, "category_id", [F.xxhash64(F.lit(seed), "id"), F.col("id")])
    return placed.select("id", "category_id", (F.col("rank") % k).cast("int").alias("fold"))


def fold_sizes(folds: DataFrame) -> DataFrame:
    n = folds.groupBy("fold").agg(F.count(F.lit(1)).alias("test"))
    return n.withColumn("train", F.sum("test").over(Window.partitionBy()) - F.col("test"))  # one row per fold


def cross_validate(folds: DataFrame, run: Callable[[DataFrame, DataFrame], DataFrame], only: DataFrame | None = None) -> DataFrame:
    """(id, truth, predicted, stage, confidence): each fold predicted with the labels of the others; ``run(test ids, train ids)`` gives predictions.

    ``only``: ids that may be learnt from; all are predicted.
    """
    folds = scratch_table(folds, "folds")
    out = None
    for f in sorted(r[0] for r in folds.select("fold").distinct().collect()):
        test, train = folds.where(F.col("fold") == f), folds.where(F.col("fold") != f)
        if only is not None:
            train = train.join(only.select("id"), "id", "left_semi")
        p = run(test.select("id"), train.select("id")).select("id", F.col("category_id").alias("predicted"), "stage", "confidence")
        rows = test.select("id", F.col("category_id").alias("truth")).join(p, "id", "left")
        out = rows if out is None else out.unionByName(rows)
    return out


def cascade_run(tx: DataFrame, labels: DataFrame, categories: DataFrame, embeddings: DataFrame, config: CascadeConfig) -> Callable[[DataFrame, DataFrame], DataFrame]:
    return lambda test, train: predict(test, tx, labels, categories, embeddings, config, only=train)


def correct() -> F.Column:
    return F.coalesce(F.col("truth") == F.col("predicted"), F.lit(False))


def scores(records: DataFrame) -> DataFrame:
    """One row: n, accuracy (an abstention is wrong), covered_accuracy, coverage."""
    n, hit, covered = F.count(F.lit(1)), F.count(F.when(correct(), 1)), F.count("predicted")
    return records.agg(n.alias("n"), (hit / n).alias("accuracy"), F.when(covered > 0, hit / covered).otherwise(0.0).alias("covered_accuracy"), (covered / n).alias("coverage"))


def per_category(records: DataFrame) -> DataFrame:
    """precision, recall, f1 and support by category; 0 where undefined."""
    truth = records.groupBy(F.col("truth").alias("category_id")).agg(F.count(F.lit(1)).alias("support"), F.count(F.when(correct(), 1)).alias("hit"))
    said = records.where("predicted is not null").groupBy(F.col("predicted").alias("category_id")).agg(F.count(F.lit(1)).alias("said"))
    r = truth.join(said, "category_id", "full").na.fill(0, ["support", "hit", "said"])
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return r.select("category_id", share(F.col("hit"), F.col("said")).alias("precision"), share(F.col("hit"), F.col("support")).alias("recall"), share(2 * F.col("hit"), F.col("said") + F.col("support")).alias("f1"), "support")


def f1_summary(records: DataFrame) -> DataFrame:
    p = per_category(records)
    return p.agg(F.avg("f1").alias("macro_f1"), F.when(F.sum("support") > 0, F.sum(F.col("f1") * F.col("support")) / F.sum("support")).otherwise(0.0).alias("weighted_f1"))


def confusion(records: DataFrame) -> DataFrame:
    return records.groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("n"))


def stage_breakdown(records: DataFrame) -> DataFrame:
    n, hit = F.count(F.lit(1)), F.count(F.when(correct(), 1))
    return records.groupBy(F.coalesce("stage", F.lit("unknown")).alias("stage")).agg(n.alias("n_predicted"), hit.alias("n_correct"), (hit / n).alias("accuracy"))


def misclassified(records: DataFrame, tx: DataFrame, categories: DataFrame) -> DataFrame:
    """The wrong ones with the row's details and both categories' names."""
    name = lambda c: categories.select(F.col("category_id").alias(c), F.col("name").alias(f"{c}_name"))
    wrong = records.where(~correct()).join(tx.select("id", "date", "counterparty", "cents"), "id")
    return wrong.join(name("truth"), "truth", "left").join(name("predicted"), "predicted", "left")


# The labels of an ablation's runs.
CUMULATIVE, WHOLE, WITHOUT = "cumulative: {}", "full baseline: {}", "leave-one-out: drop {}"


def ablation_plan(stages: tuple[str, ...] = STAGES[:4]) -> list[tuple[str, tuple[str, ...]]]:
    """Which stages each run has: the first few, more and more; all; and all but one."""
    first = {CUMULATIVE.format("+".join(stages[:n])): stages[:n] for n in range(1, len(stages) + 1)}
    whole = {WHOLE.format("+".join(stages)): stages}
    without = {WITHOUT.format(s): tuple(x for x in stages if x != s) for s in stages if len(stages) > 1}
    return list((first | whole | without).items())


def records(store: DataFrame, enabled: tuple[str, ...]) -> DataFrame:
    """(id, truth, predicted, stage, confidence) of the cascade with these stages, from a stage store: a projection."""
    p = choose(enabled)
    return store.select("id", "truth", p["category_id"].alias("predicted"), p["stage"].alias("stage"), p["confidence"].alias("confidence"))


def ablation(store: DataFrame, stages: tuple[str, ...]) -> DataFrame:
    """(run, accuracy, coverage, delta against the whole) of each run of the plan: one aggregate over the stage store, in which each choice of stages is an expression."""
    plan = ablation_plan(stages)
    different = list(dict.fromkeys(s for _, s in plan))
    n, sums = F.count(F.lit(1)).alias("n"), []
    for i, enabled in enumerate(different):
        said = choose(enabled)["category_id"]
        sums += [F.count(F.when(said == F.col("truth"), 1)).alias(f"hit{i}"), F.count(said).alias(f"covered{i}")]
    rate = lambda c: F.when(F.col("n") > 0, F.col(c) / F.col("n")).otherwise(0.0)
    whole = rate(f"hit{different.index(tuple(stages))}")
    rows = [F.struct(F.lit(label).alias("run"), rate(f"hit{i}").alias("accuracy"), rate(f"covered{i}").alias("coverage"), (rate(f"hit{i}") - whole).alias("delta")) for label, s in plan for i in [different.index(s)]]
    return store.agg(n, *sums).select(F.inline(F.array(*rows)))


def batch_impact(records_without: DataFrame, records_with: DataFrame) -> DataFrame:
    """One row: accuracy and macro F1 without and with a batch of labels, and the accuracies' difference."""
    one = lambda r, when: scores(r).select(F.col("accuracy").alias(when)).crossJoin(f1_summary(r).select(F.col("macro_f1").alias(f"{when}_macro_f1")))
    return one(records_without, "before").crossJoin(one(records_with, "after")).withColumn("delta", F.col("after") - F.col("before"))  # one row each


def label_batch_impact(folds: DataFrame, batch: DataFrame, run: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """What the labels of ``batch`` (id) are worth: two cross-validations over all of ``folds``, one that may not learn from them and one that may. Plus ``n_batch``."""
    mine = folds.join(batch.select("id"), "id", "left_semi")
    rest = folds.join(batch.select("id"), "id", "left_anti")
    before, after = cross_validate(folds, run, only=rest), cross_validate(folds, run)
    return batch_impact(scratch_table(before, "impact"), scratch_table(after, "impact")).crossJoin(mine.agg(F.count(F.lit(1)).alias("n_batch")))


def cascade_batch_impact(folds: DataFrame, batch: DataFrame, tx: DataFrame, labels: DataFrame, categories: DataFrame, embeddings: DataFrame, config: CascadeConfig, **other: Any) -> DataFrame:
    """:func:`label_batch_impact` for the cascade: two stage stores that share everything no label changes."""
    free = label_free(folds, tx, categories, embeddings, config, vendors=other.get("vendors"))
    store = lambda only: records(stage_store(folds, tx, labels, categories, embeddings, config, only=only, free=free, **other), config.enabled)
    mine = folds.join(batch.select("id"), "id", "left_semi")
    impact = batch_impact(store(folds.join(batch.select("id"), "id", "left_anti")), store(None))
    return impact.crossJoin(mine.agg(F.count(F.lit(1)).alias("n_batch")))  # one row each
