"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Row ``i`` of the matrix says how many rows input partition ``i`` sends to each destination. It is drawn from the
multivariate hypergeometric law, so the destinations' sizes are exact and every arrangement is equally likely. The
matrix is never held anywhere: each task descends a binary tree over the input partitions, whose nodes are seeded by
their place, and gets its own row alone: shards times the logarithm of the partitions, however many rows there are.

Within a shard, every row falls into one of many chunks by a random number of its own and is put in order there, which is a uniform
arrangement again; a chunk's first slot is the number of rows in the chunks before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kontor.llm.common import fresh, scratch_table

EXACT_LIMIT = 10**9  # numpy's own hypergeometric sampler ends here


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """One hypergeometric draw for populations of any size."""
    if good < EXACT_LIMIT and bad < EXACT_LIMIT:
        return int(rng.hypergeometric(good, bad, draws)) if draws and good else 0
    low, high = max(0, draws - bad), min(good, draws)
    total = good + bad
    mode = min(high, max(low, int((draws + 1) * (good + 1) / (total + 2))))
    spread = np.sqrt(draws * (good / total) * (bad / total) * ((total - draws) / max(1, total - 1)))
    k = np.arange(max(low, mode - int(12 * spread) - 30), min(high, mode + int(12 * spread) + 30) + 1, dtype=np.float64)
    # the law's neighbouring ratios, summed in log space away from the mode
    step = np.log((good - k[:-1]) * (draws - k[:-1])) - np.log((k[:-1] + 1) * (bad - draws + k[:-1] + 1))
    log_p = np.concatenate([[0.0], np.cumsum(step)])
    p = np.exp(log_p - log_p.max())
    return int(k[min(len(k) - 1, np.searchsorted(np.cumsum(p), rng.random() * p.sum()))])


def multivariate(rng: np.random.Generator, columns: np.ndarray, draws: int) -> np.ndarray:
    """How many of ``draws`` rows fall to each column, drawn without replacement."""
    if int(columns.sum()) < EXACT_LIMIT:
        return rng.multivariate_hypergeometric(columns, draws, method="marginals")
    if len(columns) == 1:
        return np.array([draws], dtype=np.int64)
    half = len(columns) // 2
    first = hypergeometric(rng, int(columns[:half].sum()), int(columns[half:].sum()), draws)
    return np.concatenate([multivariate(rng, columns[:half], first), multivariate(rng, columns[half:], draws - first)])


def matrix_row(offsets: np.ndarray, columns: np.ndarray, i: int, seed: int) -> np.ndarray:
    """Row ``i`` of the communication matrix whose rows sum to ``diff(offsets)`` and columns to ``columns``."""
    low, high, left = 0, len(offsets) - 1, columns.astype(np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        first = multivariate(rng, left, int(offsets[middle] - offsets[low]))
        left, low, high = (first, low, middle) if i < middle else (left - first, middle, high)
    return left


def shuffle_into_shards(df: DataFrame, n_shards: int, *, seed: int = 0, rows_per_chunk: int = 16384, stable_input: bool = False) -> DataFrame:
    """All rows and columns of ``df`` plus ``shard`` (int, 0 to ``n_shards - 1``) and ``slot`` (long, gapless from 0 in each shard).

    A uniform random arrangement: shard sizes differ by one row at most, the first ``n mod n_shards`` shards have the extra
    row. Three steps: a count of rows per input partition; each task labels its rows with a random
    arrangement of its matrix row; one exchange by shard and chunk, and the order within the chunk gives the slot. Chunks have about
    ``rows_per_chunk`` rows, so that no task holds a shard; their sizes are counted in a pass over the labels alone.
    What is broadcast is one long per input partition.

    ``stable_input``: ``df`` reads files and each partition gives the same rows again (no shuffle, no sample); else it is
    written to the shared scratch folder first, as the counts and the labels are two passes.

    Edge cases: nulls, empty texts, ties and repeated rows are rows like others (each gets a slot of its own); an empty
    table gives no rows; fewer rows than shards leave the last shards empty; existing columns ``shard`` and ``slot`` are replaced.
    """
    df = df.drop("shard", "slot")
    if not stable_input:
        df = scratch_table(df, "shards-input")
    counts = sorted((r[0], r[1]) for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    n = sum(c for _, c in counts)
    rows_of = np.array([n // n_shards + (s < n % n_shards) for s in range(n_shards)], dtype=np.int64)
    per_shard = max(1, -(-(-(-n // n_shards)) // rows_per_chunk))
    place = {p: i for i, (p, _) in enumerate(counts)}
    offsets = np.concatenate([[0], np.cumsum([c for _, c in counts])]).astype(np.int64)
    known = df.sparkSession.sparkContext.broadcast((place, offsets))

    def labels(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        left = rng = None
        for part in parts:
            if not len(part):
                yield pd.Series([], dtype="int64")
                continue
            if left is None:
                here, cuts = known.value
                at = int(part.iloc[0])
                left = matrix_row(cuts, rows_of, here[at], seed)
                rng = np.random.default_rng([seed, at, 1])
            if len(part) > int(left.sum()):
                raise ValueError("a partition gave more rows than were counted: use stable_input=False")
            some = np.flatnonzero(left)
            take = multivariate(rng, left[some], len(part))
            left[some] -= take
            out = np.repeat(some, take)
            rng.shuffle(out)
            yield pd.Series(out)

    label = F.pandas_udf(labels, "long").asNondeterministic()
    chunk, order, start = fresh(df, "_chunk", "_order", "_start")
    out = df.withColumn(order, F.xxhash64(F.lit(seed), F.monotonically_increasing_id())).withColumn("shard", label(F.spark_partition_id()).cast("int"))
    out = out.withColumn(chunk, F.pmod(F.shiftrightunsigned(order, 32), F.lit(per_shard)))
    before = F.sum("k").over(Window.partitionBy("shard").orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1))  # one row a chunk
    starts = out.groupBy("shard", chunk).agg(F.count(F.lit(1)).alias("k")).select("shard", chunk, F.coalesce(before, F.lit(0)).alias(start))
    starts = scratch_table(starts, "shards-starts")
    rank = F.row_number().over(Window.partitionBy("shard", chunk).orderBy(order))
    out = out.join(starts, ["shard", chunk])
    return out.withColumn("slot", (F.col(start) + rank - 1).cast("long")).select(*df.columns, "shard", "slot")
