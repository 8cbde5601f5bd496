"""Approximate nearest neighbours by learned partitions.

On a bounded sample, the graph of nearest neighbours is cut into balanced partitions with few edges between them, and a
softmax classifier learns which partitions a vector's neighbours are in. Every vector is put into its most probable
partition; a query goes to as many of the most probable ones as the sample says it needs, and what it meets there is ranked by
the exact inner product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kontor.llm.common import scratch_table


def usable(vector: Column) -> Column:
    """Vectors that take part: not null, not zero, all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def neighbour_graph(q: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` others of ``x`` with the largest inner product with each of ``q``, the same rows as queries."""
    out = np.empty((len(x), k), np.int64)
    for low in range(0, len(x), 512):
        s = q[low : low + 512] @ x.T
        s[np.arange(len(s)), np.arange(low, low + len(s))] = -np.inf
        out[low : low + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 0.1, rounds: int = 30) -> np.ndarray:
    """A part for each row, none over ``1 + slack`` times its share: median cuts along principal directions, then moves to the part of most neighbours."""
    part = np.zeros(len(x), np.int64)
    groups = [(np.arange(len(x)), 0, parts)]
    while groups:
        rows, first, n = groups.pop()
        if n == 1:
            part[rows] = first
            continue
        y = x[rows] - x[rows].mean(axis=0)
        order = rows[np.argsort(y @ np.linalg.svd(y.T @ y)[0][:, 0], kind="stable")]
        cut = len(rows) * (n // 2) // n
        groups += [(order[:cut], first, n // 2), (order[cut:], first + n // 2, n - n // 2)]
    most = int((1 + slack) * len(x) / parts) + 1
    both = np.concatenate([np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()]), np.concatenate([graph.ravel(), np.repeat(np.arange(len(x)), graph.shape[1])])
    for _ in range(rounds):
        votes = np.bincount(both[0] * parts + part[both[1]], minlength=len(x) * parts).reshape(-1, parts)
        here = votes[np.arange(len(x)), part]
        best = votes.argmax(axis=1)
        gain = votes[np.arange(len(x)), best] - here
        size, moved = np.bincount(part, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[best[i]] < most:
                size[part[i]] -= 1
                size[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if not moved:
            break
    return part


@dataclass
class Router:
    """``largest``: the largest norm; weights of the classifier; ``level``: what is taken off when rows are placed, so that no partition gets far more than its share; ``probes``: how many partitions a query goes to."""

    largest: float
    weights: np.ndarray
    bias: np.ndarray
    level: np.ndarray
    probes: int

    def lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Vectors on the unit sphere of one more dimension, where the largest inner product is the smallest angle."""
        norm = np.sqrt((x * x).sum(axis=1))
        if query:
            return np.concatenate([x / norm[:, None], np.zeros((len(x), 1))], axis=1)
        x = x / self.largest
        return np.concatenate([x, np.sqrt(np.maximum(0.0, 1 - (x * x).sum(axis=1)))[:, None]], axis=1)

    def rank(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Partitions of each vector, most probable first."""
        return np.argsort(-(self.lift(x, query) @ self.weights + self.bias), axis=1, kind="stable")

    def place(self, x: np.ndarray) -> np.ndarray:
        """The partition of each row."""
        return (self.lift(x, query=False) @ self.weights + self.bias - self.level).argmax(axis=1)


def levels(z: np.ndarray, slack: float = 0.25, rounds: int = 500) -> np.ndarray:
    """What to take off each column so that it is the largest of a row about as often as any other: prices that rise where there are too many and fall where there are too few."""
    share, price = len(z) / z.shape[1], np.zeros(z.shape[1])
    best, least, step = price, np.inf, z.std() / 4
    for _ in range(rounds):
        size = np.bincount((z - price).argmax(axis=1), minlength=z.shape[1])
        if size.max() < least:
            best, least = price, size.max()
        if least <= (1 + slack) * share:
            break
        price = price + step * np.clip(size / share - 1, -1, 1)
        step *= 0.995
    return best


def fit_router(x: np.ndarray, largest: float, *, parts: int, k: int, target_recall: float, steps: int = 300) -> Router:
    """Partition the sample ``x`` and learn to route; ``probes`` is the least number that finds ``target_recall`` of the sample's neighbours."""
    router = Router(largest, np.zeros((x.shape[1] + 1, 1)), np.zeros(1), np.zeros(1), 1)
    parts, k = max(1, min(parts, len(x) // 50)), min(k, len(x) - 1)
    if parts == 1:
        return router
    rows, asked = router.lift(x, query=False), router.lift(x, query=True)
    graph = neighbour_graph(asked, rows, k)
    own = np.eye(parts)[balanced_partition(rows, graph, parts)]
    # a row is to go to its own part, a query to where the rows are that it seeks
    lifted, target = np.concatenate([rows, asked]), np.concatenate([own, own[graph].mean(axis=1)])
    w, b = np.zeros((lifted.shape[1], parts)), np.zeros(parts)
    m = [np.zeros_like(w), np.zeros_like(b), np.zeros_like(w), np.zeros_like(b)]
    for t in range(1, steps + 1):
        z = lifted @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = (p - target) / len(lifted)
        for i, grad in enumerate((lifted.T @ g + 1e-5 * w, g.sum(axis=0))):
            m[i] = 0.9 * m[i] + 0.1 * grad
            m[i + 2] = 0.999 * m[i + 2] + 0.001 * grad * grad
            step = 0.2 * (m[i] / (1 - 0.9**t)) / (np.sqrt(m[i + 2] / (1 - 0.999**t)) + 1e-9)
            if i == 0:
                w = w - step
            else:
                b = b - step
    router.weights, router.bias = w, b
    router.level = levels(rows @ w + b)
    # where the neighbours of sample rows stand in the order of their partitions
    order = router.rank(x, query=True)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(parts)[None, :].repeat(len(x), axis=0), axis=1)
    needed = place[np.arange(len(x))[:, None], router.place(x)[graph]]
    found = np.cumsum(np.bincount(needed.ravel(), minlength=parts)) / needed.size
    router.probes = int(min(parts, np.searchsorted(found, target_recall) + 1))
    return router


def matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def top_of_block(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best ids of a block for each query: query, candidate, score; ties to the smaller id; never the query's own id. An id of several vectors counts once, with its best."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    order = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[order], c[order]
    first = np.flatnonzero(np.diff(c_ids, prepend=c_ids[0] - 1))
    names, count = c_ids[first], np.diff(np.append(first, len(c_ids)))
    for low in range(0, len(q), 128):
        s = q[low : low + 128] @ c.T
        if len(names) < len(c_ids):
            s = np.maximum.reduceat(s, first, axis=1)
        s[q_ids[low : low + 128][:, None] == names[None, :]] = -np.inf
        edge = np.partition(s, len(names) - k, axis=1)[:, len(names) - k] if len(names) > k else np.full(len(s), -np.inf)
        for i in range(len(s)):
            near = np.flatnonzero((s[i] >= edge[i] - 1e-9 * max(1.0, abs(edge[i]))) & np.isfinite(s[i])) if np.isfinite(edge[i]) else np.flatnonzero(np.isfinite(s[i]))
            if not len(near):
                continue
            begin = np.cumsum(count[near]) - count[near]
            every = np.repeat(first[near] - begin, count[near]) + np.arange(count[near].sum())
            exact = np.maximum.reduceat((c[every] * q[low + i]).sum(axis=1), begin)  # the same order of sums for equal vectors, so that ties are ties
            best = np.lexsort((names[near], -exact))[:k]
            out.append((np.full(len(best), q_ids[low + i]), names[near[best]], exact[best]))
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(none, *out, strict=True))  # type: ignore[return-value]


def nearest(
    df: DataFrame, is_query: Column, *, key: str = "vec_id", vector: str = "embedding", k: int = 20, parts: int | None = None, sample_rows: int = 8192, target_recall: float = 0.96, block_rows: int = 16384, query_rows: int = 4096, seed: int = 0
) -> DataFrame:
    """(query_id, rank, ``key``, score): for each row with ``is_query`` its ``k`` nearest other rows found, by inner product in double precision.

    The router is fitted on at most ``sample_rows`` rows, those of the smallest hashes; all rows are indexed. Partitions are cut into blocks of about
    ``block_rows`` rows, their queries into about ``query_rows``, so that neither a hot partition nor a hot vector
    fills a task; every block gives at most ``k`` rows per query. ``parts``, where not given, grows with the root of the rows, from 16 up to what the sample can teach
    (50 of its rows each). How many partitions a query goes to is what ``target_recall`` takes on the sample: few where vectors form groups, most where they
    lie about evenly. Queries that find fewer than ``k`` rows there go to all other partitions too.

    A row's partition is the classifier's choice under levels that even out the partitions on the sample, as the balanced cut does.

    Edge cases: repeated rows are one row, and vectors of one id one candidate or query: the score of two ids is the largest between their vectors, and an id is
    found once. Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without a key
    or of another length than most; a query never finds its own key, repeated or not; fewer candidates than ``k`` give all;
    up to 99 rows there is one partition, and the search is exact; no usable rows give no rows.
    """
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v")))
    widths = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("norm"))
    width = widths.orderBy(F.desc("n"), "d").first()
    empty = "query_id long, rank int, vec_id long, score double".replace("vec_id", key)
    if width is None:
        return df.sparkSession.createDataFrame([], empty)
    rows = rows.where(F.size("v") == width["d"])
    parts = max(16, int(width["n"] ** 0.5) // 4) if parts is None else parts
    sample = rows.select("id", "v").withColumn("h", F.xxhash64(F.lit(seed), "id", "v")).orderBy("h").limit(sample_rows).toPandas()
    router = fit_router(np.array(sample["v"].tolist(), dtype=np.float64).reshape(len(sample), -1), width["norm"], parts=parts, k=k, target_recall=target_recall)
    shared = df.sparkSession.sparkContext.broadcast(router)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = shared.value
        for batch in batches:
            x = matrix(batch.column(1))
            part = r.place(x) if len(x) else np.zeros(0, np.int64)
            asked = r.rank(x, query=True)[:, : r.probes] if len(x) else np.zeros((0, 1), np.int64)
            is_q = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part.astype(np.int32)), pa.array([list(map(int, a)) if y else [] for a, y in zip(asked, is_q, strict=True)], pa.list_(pa.int32()))], names=["id", "v", "q", "part", "asked"])

    routed = scratch_table(rows.mapInArrow(route, "id long, v array<double>, q boolean, part int, asked array<int>"), "neighbours-routed")
    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            q, c, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        else:
            q, c, s = top_of_block(left["q_id"].to_numpy(), matrix(left["q_v"]), right["id"].to_numpy(), matrix(right["v"]), k)
        return pa.table({"query_id": pa.array(q, pa.int64()), "id": pa.array(c, pa.int64()), "score": pa.array(s, pa.float64())})

    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    block = lambda n: F.pmod(F.xxhash64("id", "v"), F.col(n)).cast("int")

    def met(asked: DataFrame) -> DataFrame:
        """What the queries of ``asked`` (id, v, part) find in those partitions."""
        sizes = routed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).join(asked.groupBy("part").agg(F.count(F.lit(1)).alias("m")), "part")
        plan = sizes.select("part", F.ceil(F.col("n") / block_rows).cast("int").alias("c_blocks"), F.ceil(F.col("m") / query_rows).cast("int").alias("q_blocks"))
        plan = F.broadcast(plan)  # one row per partition
        candidates = routed.select("id", "v", "part").join(plan, "part").withColumn("c", block("c_blocks")).withColumn("b", every("q_blocks")).select("part", "c", "b", "id", "v")
        queries = asked.join(plan, "part").withColumn("b", block("q_blocks")).withColumn("c", every("c_blocks"))
        queries = queries.select(F.col("part").alias("q_part"), F.col("c").alias("q_c"), F.col("b").alias("q_b"), F.col("id").alias("q_id"), F.col("v").alias("q_v"))  # names of their own, as both come from one table
        return queries.groupBy("q_part", "q_c", "q_b").cogroup(candidates.groupBy("part", "c", "b")).applyInArrow(search, "query_id long, id long, score double")

    found = met(routed.where("q").select("id", "v", F.explode("asked").alias("part")))
    used = len(router.bias)
    if router.probes < used:
        found = scratch_table(found, "neighbours-found")
        enough = found.groupBy("query_id").agg(F.count_distinct("id").alias("n")).where(F.col("n") >= k).select(F.col("query_id").alias("id"))
        short = scratch_table(routed.where("q").join(enough, "id", "left_anti").select("id", "v", "asked"), "neighbours-short")
        if not short.isEmpty():
            others = F.array_except(F.array(*[F.lit(i) for i in range(used)]), "asked")
            found = found.unionByName(met(short.select("id", "v", F.explode(others).alias("part"))))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.groupBy("query_id", "id").agg(F.max("score").alias("score")).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")
