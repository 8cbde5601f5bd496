"""Places within groups when a group may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kontor.scratch import scratch_table


def rank_in_groups(rows: DataFrame, group: str, order: list[Column], name: str = "rank") -> DataFrame:
    """``rows`` plus each one's place in its group, from 0: ranges of (group, order) over all tasks, numbered within, plus the sizes of the ranges before.

    What one task adds up is a row for each range of a group. Equal rows are numbered in any order; the rows are written to the scratch folder once.
    """
    keys = [f"_o{i}" for i in range(len(order))]
    dealt = rows.withColumns(dict(zip(keys, order, strict=True))).repartitionByRange(F.col(group), *keys).sortWithinPartitions(group, *keys)
    dealt = scratch_table(dealt.drop(*keys).withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "ranges")
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = dealt.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_k"))
    starts = starts.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), (F.coalesce(F.sum("_k").over(before), F.lit(0)) - F.col("_first")).alias("_start"))
    placed = dealt.join(starts, dealt[group].eqNullSafe(F.col("_g")) & (dealt["_part"] == F.col("_p")))
    return placed.withColumn(name, F.col("_at") + F.col("_start")).drop("_at", "_part", "_g", "_p", "_start")
