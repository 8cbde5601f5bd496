"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kontor.llm.common import fresh, scratch_table


def cyclic_weights(sources: DataFrame, source: str, cycle: tuple[float, ...]) -> DataFrame:
    """``sources`` with ``weight``: the values of ``cycle`` dealt in code-point order of the source, null last.

    The table has one row per distinct source.
    """
    rank = F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1
    return sources.withColumn("weight", F.get(F.array(*[F.lit(float(x)) for x in cycle]), rank % len(cycle)))


def water_fill(sources: DataFrame, *, budget: float, max_epochs: float) -> DataFrame:
    """``sources`` (``source_size``, ``weight``) with ``target``: the budget shared by weight, no source above ``max_epochs`` times its size.

    Sources above their cap are clamped and what they give up is shared again by weight until no source is above; each
    round is one aggregate, and only its totals come to the driver. Where all caps together are below the budget, every source gets its cap.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    open_level, level, clamped = None, 0.0, -1
    while True:
        # a source is clamped if it was above its share in some round; the level only rises, so the last round's test holds for all
        hit = F.lit(False) if open_level is None else F.col("weight") * F.lit(open_level) >= cap
        r = sources.agg(
            F.coalesce(F.sum(F.when(hit, cap)), F.lit(0.0)).alias("kept"), F.coalesce(F.sum(F.when(~hit, F.col("weight"))), F.lit(0.0)).alias("weight"), F.count(F.when(hit, 1)).alias("n")
        ).first()
        if r["n"] == clamped or r["weight"] <= 0:
            break
        clamped, level = r["n"], max(0.0, (budget - r["kept"]) / r["weight"])
        open_level = level
    full = F.lit(float("inf")) if r["weight"] <= 0 else F.col("weight") * F.lit(level)
    return sources.withColumn("target", F.when(full >= cap, cap).otherwise(full))


def last_taken(slim: DataFrame, plan: DataFrame, keys: tuple[str, str], source: str, size: str, few: int) -> DataFrame:
    """(``source``, cut_key, cut_place): the last row that each source takes once more, in order of ``keys`` (63 bits each), so that what is taken comes nearest to ``rest``.

    The end is narrowed down 16 bits of the order at a time, by sums of sizes, until what is left of every source is ``few`` rows at most;
    these alone are put in order.
    """
    rows, state = slim, plan.where("rest > 0").select(source, "rest", F.lit(0).cast("long").alias("before"))
    for key, shift in [(k, s) for k in keys for s in (47, 31, 15, 0)]:
        part = F.shiftright(key, shift)
        sums = rows.groupBy(source, part.alias("part")).agg(F.sum(size).alias("s"), F.count(F.lit(1)).alias("n")).join(state, source)
        upto = F.col("before") + F.sum("s").over(Window.partitionBy(source).orderBy("part"))  # 65,536 rows a source at most
        found = sums.withColumn("upto", upto).where(F.col("upto") >= F.col("rest")).groupBy(source).agg(F.min_by(F.struct("part", "rest", (F.col("upto") - F.col("s")).alias("before"), "n"), "part").alias("x"))
        state = scratch_table(found.select(source, "x.*"), "mix-cut")
        rows = rows.join(state.select(F.col(source).alias("_of"), F.col("part").alias("_part")), (F.col(source) == F.col("_of")) & (part == F.col("_part"))).drop("_of", "_part")
        most = state.agg(F.max("n")).first()[0]
        state = state.select(source, "rest", "before")
        if not most or most <= few:
            break
    order = Window.partitionBy(source).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(state, source).withColumn("run", F.col("before") + F.sum(size).over(order))
    taken = F.col("run") - F.col(size) / F.lit(2.0) <= F.col("rest")
    none = F.struct((F.min(keys[0]) - 1).alias("k"), F.lit(2**63 - 1).alias("p"))  # all rows before the first of these
    last = rows.groupBy(source).agg(F.max(F.when(taken, F.struct(F.col(keys[0]).alias("k"), F.col(keys[1]).alias("p")))).alias("last"), none.alias("none"), F.min(F.struct(*keys)).alias("first"))
    # of rows of one key, those before the first of these are taken
    same = F.struct(F.col(f"first.{keys[0]}").alias("k"), (F.col(f"first.{keys[1]}") - 1).alias("p"))
    return last.select(source, F.coalesce("last", F.when(F.col(f"first.{keys[1]}") > 0, same).otherwise(F.col("none"))).alias("c")).select(source, F.col("c.k").alias("cut_key"), F.col("c.p").alias("cut_place"))


def mix_sources(
    df: DataFrame, size: Column, *, source: str = "source", cycle: tuple[float, ...] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0, key: tuple[str, ...] = ("doc_id",), seed: int = 0, few: int = 50_000, stable_input: bool = False
) -> DataFrame:
    """All rows and columns of ``df`` plus ``size``, ``source_size``, ``target`` (its source's) and ``repeats`` (how often the mix takes the row).

    A source whose target is r times its size gives every row floor(r) times, and rows of a seeded order once more until
    the rest of the target is met, to half a row's size. Where that order ends is found by sums over parts of it, ``few`` rows of a source
    at most are sorted, and the rows themselves are neither shuffled nor sorted: each is compared with its source's end.

    Reruns agree: the order depends on ``key``, the size and ``seed``; rows that agree in those follow each other by their place in the input.
    ``stable_input``: ``df`` reads files, and each partition gives the same rows again; else it is written to the shared scratch folder first.

    Edge cases: a null source is a source; rows of size 0 count nothing and are taken floor(r)
    times, or once more if they fall before the end; a source of size 0 has target 0 and no repeats; an empty table gives
    no rows; existing columns of the four names are replaced.
    """
    df = df.withColumn("size", size).drop("source_size", "target", "repeats")
    if not stable_input:
        df = scratch_table(df, "mix-input")
    order, place, source_key = fresh(df, "_order", "_place", "_source")
    columns = df.columns
    # an explicit key for null, so that sources join by equality
    df = df.withColumn(source_key, F.concat(F.when(F.col(source).isNull(), "1").otherwise("0"), F.coalesce(F.col(source), F.lit(""))))
    df = df.withColumn(order, F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key, F.col("size")), 1)).withColumn(place, F.monotonically_increasing_id())
    slim = scratch_table(df.select(source_key, order, place, "size"), "mix-order")
    sources = scratch_table(cyclic_weights(slim.groupBy(source_key).agg(F.sum("size").alias("source_size")), source_key, cycle), "mix-sources")
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    plan = water_fill(sources, budget=share * total, max_epochs=max_epochs).drop("weight")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.withColumn("whole", F.floor(ratio).cast("int")).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    plan = scratch_table(plan, "mix-plan")
    cuts = last_taken(slim, plan, (order, place), source_key, "size", few)
    ends = scratch_table(plan.join(cuts, source_key, "left").select(F.col(source_key).alias("_of"), *[F.col(c).alias(f"_{c}_of") for c in ("source_size", "target", "whole", "cut_key", "cut_place")]), "mix-ends")
    names = fresh(df, *ends.columns)
    out = df.join(ends.toDF(*names), F.col(source_key) == F.col(names[0]))
    _, all_size, target, whole, cut_key, cut_place = (F.col(c) for c in names)
    extra = F.when((F.col(order) < cut_key) | ((F.col(order) == cut_key) & (F.col(place) <= cut_place)), 1).otherwise(0)
    return out.select(*columns, all_size.alias("source_size"), target.alias("target"), (whole + extra).alias("repeats"))
