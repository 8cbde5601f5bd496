"""Which rows to label next."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kontor.operators import labels as lb
from kontor.operators.knn import nearest_category, slices
from kontor.scratch import scratch_table


def in_turn(*picks: DataFrame, n: int) -> DataFrame:
    """(id, source, pos): the picks one list after another, each id once at its first place, ``n`` in all. Picks: (id, pos)."""
    every = None
    for i, p in enumerate(picks):
        rows = p.select("id", F.lit(i).alias("source"), F.col("pos").cast("long").alias("pos"))
        every = rows if every is None else every.unionByName(rows)
    first = every.groupBy("id").agg(F.min(F.struct("source", "pos")).alias("f")).select("id", "f.source", "f.pos")
    return first.orderBy("source", "pos", "id").limit(n)


def numbered(rows: DataFrame, *order) -> DataFrame:  # noqa: ANN002
    """(id, pos) of a list already cut to a few rows."""
    from pyspark.sql import Window

    return rows.withColumn("pos", F.row_number().over(Window.orderBy(*order))).select("id", "pos")  # ``n`` rows, asked for by the caller


def select_uncertain(predictions: DataFrame, n: int) -> DataFrame:
    """The lowest confidence first, then the smallest margin to the runner-up."""
    order = ("confidence", F.col("confidence") - F.col("runner_up_confidence"), "id")
    return numbered(predictions.orderBy(*order).limit(n), *order)


def select_low_confidence(tx: DataFrame, labels: DataFrame, n: int, predictions: DataFrame | None = None) -> DataFrame:
    """Stored model labels below the low band, lowest first; filled up with the most uncertain ``predictions``."""
    state = lb.label_state(tx, labels).where((F.col("has_user") == 0) & lb.is_model(None, lb.LOW, or_null=True))
    order = (F.coalesce("confidence", F.lit(0.0)), "id")
    low = numbered(state.orderBy(*order).limit(n), *order)
    return low.select("id", F.lit(0).alias("source"), F.col("pos").cast("long").alias("pos")) if predictions is None else in_turn(low, select_uncertain(predictions, n), n=n)


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return ((x - y) ** 2).sum(axis=1)


def greedy(ids: np.ndarray, x: np.ndarray, n: int, centre: np.ndarray) -> list[int]:
    """Places of the ``n`` rows that a farthest-first walk takes: first the farthest from the centre, then always the farthest from all taken; ties to the smaller id."""
    order = np.argsort(ids, kind="stable")
    x = x[order]
    away, out = squares(x, centre), []
    while len(out) < min(n, len(x)):
        out.append(int(away.argmax()))
        away = np.minimum(away if len(out) > 1 else np.inf, squares(x, x[out[-1]]))
        away[out] = -np.inf
    return order[out].tolist()


def batch_arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    v = batch.column("vector")
    return batch.column("id").to_numpy(zero_copy_only=False), v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(v), -1)


def in_order(spark: SparkSession, ids: list[int]) -> DataFrame:
    """(id, pos) of rows that the driver holds; from Arrow, as a list would go through Python workers beside the executors' own."""
    return spark.createDataFrame(pa.table({"id": pa.array(ids, pa.int64()), "pos": pa.array(range(1, len(ids) + 1), pa.int32())}))


def farthest_first(rows: DataFrame, n: int) -> DataFrame:
    """(id, pos): ``n`` rows (id, vector), first the farthest from the centre, then always the farthest from all chosen; ties to the smaller id.

    Not a pass a choice: every task walks through its rows and keeps the ``n`` that it would take (a core-set), the core-sets are walked through again, and the walk over what is left is the proposal.
    A pass over all rows then gives the row that really is the farthest at each step of it. Where that is another one the walk is repeated with it, and checked again;
    each time at least one more step is right, and mostly the first proposal is, so that there are three passes whatever ``n``.
    """
    spark = rows.sparkSession
    rows = scratch_table(rows.select("id", F.col("vector").cast("array<double>").alias("vector")).where("vector is not null"), "farthest")
    width = rows.select(F.max(F.size("vector"))).first()[0]
    if not width or n < 1:
        return in_order(spark, [])
    centre = np.array(rows.agg(*[F.avg(F.col("vector")[i]) for i in range(width)]).first(), float)
    schema = "id long, vector array<double>"

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in (part for batch in batches for part in slices(batch, width)):
            t = pa.Table.from_batches([*held, b]).combine_chunks()
            ids, x = batch_arrays(t.to_batches()[0])
            held = t.take(pa.array(greedy(ids, x, n, centre))).combine_chunks().to_batches()
        yield from held

    parts = rows.rdd.getNumPartitions()
    core = rows.mapInArrow(reduce, schema)
    if parts > 16:  # the core-sets' own core-sets, so that what reaches the driver grows with the root of the tasks
        core = core.repartition(int(parts**0.5)).mapInArrow(reduce, schema)
    found = {r["id"]: np.array(r["vector"]) for r in core.collect()}
    while True:
        ids, x = np.array(list(found)), np.array(list(found.values()))
        walk = [int(ids[i]) for i in greedy(ids, x, n, centre)]
        shared = spark.sparkContext.broadcast((walk, [found[i] for i in walk]))

        def farthest(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            walk, taken = shared.value
            best: dict[int, tuple[float, int, np.ndarray]] = {}
            for b in (part for batch in batches for part in slices(batch, width)):
                ids, x = batch_arrays(b)
                away = squares(x, centre)
                for step in range(len(walk)):
                    if step:
                        away = np.minimum(away if step > 1 else np.inf, squares(x, taken[step - 1]))
                        away[ids == walk[step - 1]] = -np.inf
                    top = np.flatnonzero(away == away.max())
                    i = top[ids[top].argmin()]
                    if step not in best or (-away[i], ids[i]) < (-best[step][0], best[step][1]):
                        best[step] = (float(away[i]), int(ids[i]), x[i])
            if best:
                yield pa.RecordBatch.from_arrays([pa.array(list(best)), pa.array([v[0] for v in best.values()]), pa.array([v[1] for v in best.values()]), pa.array([v[2].tolist() for v in best.values()])], ["step", "away", "id", "vector"])

        seen = rows.mapInArrow(farthest, "step long, away double, id long, vector array<double>")
        true = {r["step"]: r["b"] for r in seen.groupBy("step").agg(F.max_by(F.struct("id", "vector"), F.struct("away", -F.col("id"))).alias("b")).collect()}
        if all(true[s]["id"] == i for s, i in enumerate(walk)):
            return in_order(spark, walk)
        found |= {b["id"]: np.array(b["vector"]) for b in true.values()}


def select_diverse(rows: DataFrame, train: DataFrame, train_labels: DataFrame, undercovered: DataFrame | None, n: int) -> DataFrame:
    """Farthest-first over ``rows``; with ``undercovered`` categories given, first over rows whose nearest labelled row is in one of them."""
    if undercovered is None:
        return farthest_first(rows, n)
    few = scratch_table(undercovered.select("category_id"), "undercovered")
    preferred, others = rows.limit(0), rows
    if not few.isEmpty():  # else no row is near one of them; the search runs once, for both walks
        rows, train = (scratch_table(v.select("id", "vector"), "diverse") for v in (rows, train))
        near = scratch_table(nearest_category(rows, train, train_labels).join(few, "category_id", "left_semi").select("id"), "preferred")
        preferred, others = rows.join(near, "id", "left_semi"), rows.join(near, "id", "left_anti")
    return in_turn(farthest_first(preferred, n), farthest_first(others, n), n=n).select("id", (F.col("source") * n + F.col("pos")).alias("pos"))


def pick_candidates(strategy: str, n: int, *, tx: DataFrame, labels: DataFrame, predictions: DataFrame, rows: DataFrame, train: DataFrame, train_labels: DataFrame, undercovered: DataFrame | None = None) -> DataFrame:
    """(id, pos, ...) of ``n`` rows to label next, by ``uncertainty``, ``low-confidence-first``, ``diverse`` or ``mixed``: half by uncertainty, half diverse, each id once.

    ``predictions``: of the rows without a user label; ``rows``, ``train``: vectors without and with one.
    """
    half = max(1, n // 2)
    if strategy == "uncertainty":
        return select_uncertain(predictions, n)
    if strategy == "low-confidence-first":
        return select_low_confidence(tx, labels, n, predictions)
    if strategy == "diverse":
        return select_diverse(rows, train, train_labels, undercovered, n)
    if strategy == "mixed":
        return in_turn(select_uncertain(predictions, half), select_diverse(rows, train, train_labels, undercovered, half), n=n)
    raise ValueError(f"unknown strategy {strategy}")


def review_batch(tx: DataFrame, labels: DataFrame, picks: DataFrame, n: int) -> DataFrame:
    """Rows to confirm first (model labels of the middle band, least sure first), then ``picks``."""
    order = ("confidence", "id")
    confirm = numbered(lb.label_state(tx, labels).where((F.col("has_user") == 0) & lb.is_model(lb.LOW, lb.MEDIUM)).orderBy(*order).limit(n), *order)
    return in_turn(confirm, picks, n=n)
