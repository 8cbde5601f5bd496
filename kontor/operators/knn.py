"""Exact nearest neighbours by cosine, in cells around pivots, and what is voted from them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kontor.scratch import scratch_table

#: Cells at most, so that the pivots fit the driver and a task; rows a cell has at least, on the average; rows and queries of a block.
MOST_CELLS, CELL_ROWS, BLOCK_ROWS, BLOCK_QUERIES = 4096, 2048, 16384, 4096
#: Of the driver's sample: rows for each pivot. Of a query's first cells: rows for each neighbour that is sought.
SAMPLE_ROWS, FIRST_ROWS = 8, 4
#: Numbers of a matrix that a task makes at a time, whatever the number of cells and the size of a batch.
ENTRIES = 1 << 20
#: What rounding may take from a bound, in distance.
SLACK = 1e-5


def unit_matrix(column: pa.ChunkedArray | pa.Array, *, train: bool) -> np.ndarray:
    """Rows of length one, and two places more: a zero vector, whose cosine with everything is 0, stands alone in the first of them if it is to be found, in the second if it asks."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    out = np.hstack([x / np.where(n == 0, 1.0, n), np.zeros((len(x), 2))])
    out[n[:, 0] == 0, -2 if train else -1] = 1.0
    return out


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ y.T)))


def slices(batch: pa.RecordBatch, width: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of which a matrix of ``width`` numbers a row has at most :data:`ENTRIES`."""
    step = max(1, ENTRIES // width)
    return (batch.slice(at, step) for at in range(0, len(batch), step))


def spread_out(sample: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows of the sample: half of them each as far from those before as can be, so that no group of vectors is without a pivot, the others as they come."""
    chosen, away = [0], distances(sample, sample[:1])[:, 0]
    while len(chosen) < n // 2:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, distances(sample, sample[chosen[-1:]])[:, 0])
    rest = np.setdiff1d(np.arange(len(sample)), chosen)
    return sample[np.concatenate([chosen, rest[: n - len(chosen)]])]


@dataclass
class Cells:
    """The pivots, each cell's rows, least and greatest distance from its pivot, and the blocks that it lies in: ``parts`` from ``block`` on."""

    pivots: np.ndarray
    rows: np.ndarray
    low: np.ndarray
    high: np.ndarray
    block: np.ndarray
    parts: np.ndarray

    @property
    def width(self) -> int:
        """Numbers that a query may need: a few for each cell, and its own vector for each block."""
        return 2 * len(self.rows) + 66 * int(self.parts.sum())

    @staticmethod
    def of(pivots: np.ndarray, rows: np.ndarray, low: np.ndarray, high: np.ndarray, block_rows: int) -> Cells:
        """Large cells have blocks of their own, small ones share one."""
        block, parts, at, filled = np.zeros(len(rows), np.int64), np.maximum(1, -(-rows // block_rows)), -1, block_rows
        for i, n in enumerate(rows):
            if filled + n > block_rows:
                at, filled = at + 1, 0
            block[i] = at
            at, filled = at + parts[i] - 1, block_rows if parts[i] > 1 else filled + n
        return Cells(pivots, rows, low, high, block, parts)

    def first(self, x: np.ndarray, least: int) -> np.ndarray:
        """Which cells each searches at first: those of the nearest pivots, as many as have ``least`` rows."""
        order = np.argsort(distances(x, self.pivots), axis=1, kind="stable")
        rows = self.rows[order]
        out = np.zeros(order.shape, bool)
        np.put_along_axis(out, order, (np.cumsum(rows, axis=1) - rows < least) & (rows > 0), axis=1)
        return out

    def within(self, x: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """Which cells may have a row within ``reach`` of each: by the triangle's inequality from the cell's own pivot, and by the plane between it and the nearest pivot."""
        d = distances(x, self.pivots)
        at = np.argmin(d, axis=1)
        own = np.take_along_axis(d, at[:, None], axis=1)
        between = distances(self.pivots[at], self.pivots)
        between[np.arange(len(at)), at] = 0.0
        plane = (d * d - own * own) / np.where(between > 0, 2 * between, 1.0)
        bound = np.maximum(np.maximum(d - self.high, self.low - d), np.where(between > 0, plane, 0.0))
        return (bound - SLACK <= reach[:, None]) & (self.rows > 0)


def top_of_block(a: pa.Table, b: pa.Table, k: int) -> pa.Table:
    """Of the queries ``a`` and a block's rows ``b``: up to ``k`` nearest of each query in the cells that it asks for."""
    out = [[], [], []]
    if len(a) and len(b):
        ids, x, y = b["t"].to_numpy(), unit_matrix(a["q_vector"], train=False), unit_matrix(b["t_vector"], train=True)
        group, own, mine, cells = b["t_apart"].to_numpy(), a["q"].to_numpy(), a["q_apart"].to_numpy(), a["cells"]
        known, cell = np.unique(b["cell"].to_numpy(), return_inverse=True)
        step = max(1, ENTRIES // len(ids))
        for low in range(0, len(a), step):
            part = slice(low, low + step)
            lists = cells.slice(low, step).to_pylist()
            asks = np.array([np.isin(known, c) for c in lists])
            s = x[part] @ y.T
            s[(own[part][:, None] == ids[None, :]) | ~asks[:, cell] | (mine[part][:, None] == group[None, :])] = -np.inf
            least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
            who, near = np.nonzero((s >= least[:, None] - 2e-12) & np.isfinite(s))  # what rounding may make equal to the last is among them
            top = np.round(s[who, near], 12)
            order = np.lexsort((ids[near], -top, who))
            who, near, top = who[order], near[order], top[order]
            keep = np.arange(len(who)) - np.searchsorted(who, who) < k
            out[0].append(own[part][who[keep]])
            out[1].append(ids[near[keep]])
            out[2].append(top[keep])
    cat = [np.concatenate(o) if o else np.zeros(0) for o in out]
    return pa.table({"id": pa.array(cat[0].astype(np.int64)), "neighbour": pa.array(cat[1].astype(np.int64)), "similarity": pa.array(cat[2].astype(float))})


def best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search(sent: DataFrame, placed: DataFrame, k: int, block_queries: int) -> DataFrame:
    """The ``k`` nearest found by each row of ``sent`` (block, q, q_vector, q_apart, cells). A block that very many ask is given out as often as it takes."""
    counts = sent.groupBy("block").agg(F.count(F.lit(1)).alias("n")).withColumn("turns", F.ceil(F.col("n") / block_queries).cast("int"))
    counts = scratch_table(counts.select("block", "turns"), "knn-turns")
    left = sent.join(counts, "block").withColumn("turn", F.pmod(F.xxhash64("q"), F.col("turns")).cast("int")).drop("turns")
    right = placed.join(counts, "block").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).drop("turns")
    pairs = left.groupBy("block", "turn").cogroup(right.groupBy("block", "turn"))
    return best(pairs.applyInArrow(lambda a, b: top_of_block(a, b, k), "id long, neighbour long, similarity double"), k)


def knn_search(
    queries: DataFrame, train: DataFrame, k: int, *, apart: str | None = None, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES
) -> tuple[DataFrame, DataFrame]:
    """:func:`knn_join`, and one row with the number of ``pairs`` that were compared.

    Rows lie in cells around pivots, rows of a sample drawn by a hash. A query searches the cells of its nearest pivots first; then, with its ``k``-th best as reach, all cells that a bound does not rule
    out. What is searched is exact; how much is left out depends on the vectors: where they form groups nearly all, where they lie evenly in many dimensions little.
    """
    side = lambda df, c: df.select(F.col("id").alias(c), F.col("vector").cast("array<double>").alias(f"{c}_vector"), (F.col(apart).cast("long") if apart else F.lit(None).cast("long")).alias(f"{c}_apart"))
    queries, train = side(queries, "q"), side(train, "t")
    n = train.count()
    n_cells = min(MOST_CELLS, max(1, n // cell_rows))
    some = train.orderBy(F.xxhash64("t"), "t").limit(SAMPLE_ROWS * n_cells).select("t_vector").toArrow() if n_cells > 1 else None
    pivots = spread_out(unit_matrix(some["t_vector"], train=True), n_cells) if some is not None else np.zeros((1, 1))
    shared = train.sparkSession.sparkContext.broadcast(pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, len(shared.value)):
                x = unit_matrix(b.column("t_vector"), train=True)
                d = distances(x, shared.value) if shared.value.shape[0] > 1 else np.zeros((len(b), 1))
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], [*b.schema.names, "cell", "distance"])

    # a whole number and a null that is never equal to it: groups that are to stay apart
    train = train.withColumn("t_apart", F.coalesce("t_apart", F.lit(-1).cast("long")))
    queries = queries.withColumn("q_apart", F.coalesce("q_apart", F.lit(-2).cast("long")))
    if len(pivots) > 1:
        placed = scratch_table(train.mapInArrow(place, "t long, t_vector array<double>, t_apart long, cell int, distance double"), "knn-placed")
        stats = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("distance").alias("low"), F.max("distance").alias("high")).collect()}
        column = lambda c, kind: np.array([stats[i][c] if i in stats else 0 for i in range(len(pivots))], kind)
        cells = Cells.of(pivots, column("n", np.int64), column("low", float), column("high", float), block_rows)
    else:
        placed = train.withColumns({"cell": F.lit(0), "distance": F.lit(0.0)})
        cells = Cells.of(pivots, np.array([n]), np.zeros(1), np.full(1, 2.0), block_rows)
    block = F.element_at(F.array(*[F.lit(int(x)) for x in cells.block]), F.col("cell") + 1)
    parts = F.element_at(F.array(*[F.lit(int(x)) for x in cells.parts]), F.col("cell") + 1)
    placed = placed.withColumn("block", (block + F.pmod(F.xxhash64("t"), parts)).cast("int"))
    known = train.sparkSession.sparkContext.broadcast(cells)

    def send(first: bool):  # noqa: ANN202
        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = known.value
            for b in (part for batch in batches for part in slices(batch, c.width)):
                x = unit_matrix(b.column("q_vector"), train=False)
                ask = c.first(x, FIRST_ROWS * k)
                if not first:
                    ask = c.within(x, b.column("reach").to_numpy(zero_copy_only=False)) & ~ask
                who, which = np.nonzero(ask)
                times = c.parts[which]
                who, which, part = np.repeat(who, times), np.repeat(which, times), np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                block = c.block[which] + part
                order = np.lexsort((which, block, who))
                who, which, block = who[order], which[order], block[order]
                cuts = np.flatnonzero(np.diff(who, prepend=-1) | np.diff(block, prepend=-1)) if len(who) else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(which)).astype(np.int32)), pa.array(which.astype(np.int32)))
                rows = np.add.reduceat(c.rows[which] // c.parts[which], cuts) if len(cuts) else cuts
                table = b.select(["q", "q_vector", "q_apart"]).take(pa.array(who[cuts]))
                yield pa.RecordBatch.from_arrays([*table.columns, pa.array(block[cuts].astype(np.int32)), lists, pa.array(rows.astype(np.int64))], ["q", "q_vector", "q_apart", "block", "cells", "n_rows"])

        return apply

    schema = "q long, q_vector array<double>, q_apart long, block int, cells array<int>, n_rows long"
    if len(pivots) == 1:
        every = F.explode(F.sequence(F.lit(0), F.lit(int(cells.parts[0]) - 1)))
        sent = queries.select("*", every.alias("block"), F.array(F.lit(0)).alias("cells"), F.lit(int(n // cells.parts[0])).cast("long").alias("n_rows"))
        return search(sent, placed, k, block_queries), sent.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("pairs"))
    sent = scratch_table(queries.mapInArrow(send(True), schema), "knn-first")
    near = scratch_table(search(sent, placed, k, block_queries), "knn-near")
    reach = near.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("similarity").alias("s")).select(F.col("id").alias("q"), F.when(F.col("n") >= k, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("s")))).alias("reach"))
    asked = queries.join(reach, "q", "left").withColumn("reach", F.coalesce("reach", F.lit(9.0)))
    more = scratch_table(asked.mapInArrow(send(False), schema), "knn-more")
    found = best(near.drop("rank").unionByName(search(more, placed, k, block_queries).drop("rank")), k)
    return found, sent.unionByName(more).agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("pairs"))


def knn_join(queries: DataFrame, train: DataFrame, k: int, *, apart: str | None = None) -> DataFrame:
    """(id, neighbour, rank, similarity): the ``k`` rows of ``train`` nearest by cosine to each of ``queries`` (id, vector both), ties to the smaller id; a row is not its own neighbour.

    ``apart``: a column of both, rows with equal values of which are not neighbours either, such as a fold. See :func:`knn_search`.
    """
    return knn_search(queries, train, k, apart=apart)[0].select("id", "neighbour", "rank", "similarity")


def knn_vote(neighbours: DataFrame, labels: DataFrame, k: int = 5) -> DataFrame:
    """(id, category_id, votes, runner_up, runner_up_votes, k): ``labels``: (id, category_id) of the train rows; ties to the smaller category."""
    votes = neighbours.join(labels.select(F.col("id").alias("neighbour"), "category_id"), "neighbour").groupBy("id", "category_id").agg(F.count(F.lit(1)).alias("votes"))
    ranked = votes.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("votes"), "category_id")))
    pick = lambda c, r: F.max(F.when(F.col("r") == r, F.col(c)))
    return ranked.groupBy("id").agg(pick("category_id", 1).alias("category_id"), pick("votes", 1).alias("votes"), pick("category_id", 2).alias("runner_up"), F.coalesce(pick("votes", 2), F.lit(0)).alias("runner_up_votes"), F.sum("votes").alias("k"))


def nearest_category(queries: DataFrame, train: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, category_id) of each row's nearest labelled row."""
    near = knn_join(queries, train, 1)
    return near.join(labels.select(F.col("id").alias("neighbour"), "category_id"), "neighbour").select("id", "category_id")


def neighbour_context(queries: DataFrame, train: DataFrame, spine: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` nearest labelled rows of each query with their details, for all queries at once."""
    about = spine.select(F.col("id").alias("neighbour"), "date", "counterparty", "cents", "category")
    return knn_join(queries, train, n).join(about, "neighbour")


def share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)
