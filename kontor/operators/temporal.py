"""Features from a row's own history: earlier rows of the same vendor or account.

Rows without a vendor have null or zero features; they are set aside before any window, as together they would be one
window of the whole table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kontor.scratch import scratch_table


def by_day(rows: DataFrame, key: str, *sums) -> DataFrame:  # noqa: ANN002
    """One row for a key and date, with its number of rows ``n`` and the ``sums``: what windows over a key's history run over, however many rows a day has."""
    return rows.groupBy(key, "date").agg(F.count(F.lit(1)).alias("n"), *sums).withColumn("day", F.datediff("date", F.lit("1970-01-01").cast("date")))


def days_before(n: int, key: str) -> Column:
    """Rows on strictly earlier dates, at most ``n`` days back (all, if 0), over the days of a key."""
    w = Window.partitionBy(key).orderBy("day").rangeBetween(-n if n else Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("n").over(w), F.lit(0))


def vendor_history(tx: DataFrame) -> DataFrame:
    """(id, days_since_prev, z, n30, n90, n365) of rows with a vendor.

    The gap and the z-score look at rows before in order of date and id, the same day included; the counts at earlier dates only.
    """
    rows = tx.where("vendor <> ''").select("id", "vendor", "date", F.abs("cents").alias("a"))
    a = F.col("a").cast("double")
    days = by_day(rows, "vendor", F.sum("a").alias("s"), F.sum(a * a).alias("q"))
    order = Window.partitionBy("vendor").orderBy("day")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    earlier = {c: F.coalesce(F.sum(x).over(before), F.lit(0)) for c, x in (("k0", "n"), ("s0", "s"), ("q0", "q"))}
    days = days.select("vendor", "date", F.lag("date").over(order).alias("prev"), *[c.alias(k) for k, c in earlier.items()], *[days_before(n, "vendor").alias(f"n{n}") for n in (30, 90, 365)])
    # rows of the same day before this one
    same = Window.partitionBy("vendor", "date").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumns({"k1": F.count(F.lit(1)).over(same), "s1": F.coalesce(F.sum("a").over(same), F.lit(0)), "q1": F.coalesce(F.sum(a * a).over(same), F.lit(0.0))}).join(days, ["vendor", "date"])
    k = F.col("k0") + F.col("k1")
    mean, square = (F.col("s0") + F.col("s1")) / k, (F.col("q0") + F.col("q1")) / k
    spread = square - mean * mean
    z = F.when(k < 2, None).when(spread <= 0, 0.0).otherwise((a - mean) / F.sqrt(spread))
    gap = F.when(F.col("k1") > 0, 0).otherwise(F.datediff("date", "prev"))
    return out.select("id", gap.alias("days_since_prev"), z.alias("z"), "n30", "n90", "n365")


#: Logarithmic buckets of ratio 1.1 in a band: what is within ten percent of an amount lies at most two buckets away.
BAND = 8


def first_within(first: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of ``first[low:high]`` for each pair of bounds, a large number where there is nothing, by tables of the least over runs of two, four and more."""
    tables = [first]
    while 2 << (len(tables) - 1) <= len(first):
        half = 1 << (len(tables) - 1)
        tables.append(np.minimum(tables[-1][:-half], tables[-1][half:]))
    out = np.full(len(low), np.iinfo(np.int64).max)
    some = np.flatnonzero(high > low)
    level = np.frexp((high - low)[some])[1] - 1
    for k in np.unique(level):
        at = some[level == k]
        out[at] = np.minimum(tables[k][low[at]], tables[k][high[at] - (1 << k)])
    return out


def sweep(a: np.ndarray, day: np.ndarray, asks: np.ndarray) -> np.ndarray:
    """For distinct (amount, day) of one vendor, in that order: months with earlier rows within ten percent, those of them not over a year back, and whether one of these rows has another amount.

    One pass by amount: the window of similar amounts moves up, and keeps as bits which days and which months it has. Rows that do not ``ask`` stay 0.
    """
    amounts, at = np.unique(a, return_index=True)
    low = np.searchsorted(amounts, amounts - amounts // 10)
    high = np.searchsorted(amounts, amounts + amounts // 10, side="right")
    ends = np.append(at[1:], len(a))
    first, index = np.minimum.reduceat(day, at), np.arange(len(amounts))
    other = np.repeat(np.minimum(first_within(first, low, index), first_within(first, index + 1, high)), ends - at) < day
    month_of = lambda d: d.astype("datetime64[D]").astype("datetime64[M]").astype(np.int64)
    day_of = lambda m: m.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    month, back = month_of(day), day - 365
    edge = month_of(back)
    zero, none = int(back.min()), int(edge.min())
    # days and months counted from the first that matters: of the row, of its month's begin, a year back, and of what is left of that month
    d, m, begin, b, e, left_of = (x.tolist() for x in (day - zero, month - none, day_of(month) - zero, back - zero, edge - none, day_of(edge + 1) - back))
    n_day, n_month, days, months, left, right = {}, {}, 0, 0, 0, 0
    out = np.zeros((len(a), 3), np.int64)
    for i in range(len(amounts)):
        for r in range(at[right] if right < len(at) else len(a), ends[high[i] - 1]):
            n_day[d[r]], n_month[m[r]] = n_day.get(d[r], 0) + 1, n_month.get(m[r], 0) + 1
            days, months = days | 1 << d[r], months | 1 << m[r]
        right = high[i]
        for r in range(at[left], at[low[i]]):
            n_day[d[r]] -= 1
            n_month[m[r]] -= 1
            days, months = days & ~(int(not n_day[d[r]]) << d[r]), months & ~(int(not n_month[m[r]]) << m[r])
        left = low[i]
        for r in range(at[i], ends[i]):
            if asks[r]:
                own = int((days & (1 << d[r]) - 1) >> max(begin[r], 0) != 0)
                earlier = months & (1 << m[r]) - 1
                late = (earlier >> e[r] + 1).bit_count() + int(days >> b[r] & (1 << left_of[r]) - 1 != 0)
                out[r] = earlier.bit_count() + own, late + own, other[r]
    return out


def sweep_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (vendor, band, a, day, asks) in order: each band of a vendor once all of it has come."""
    held: list[pa.RecordBatch] = []

    def done(part: pa.Table) -> Iterator[pa.RecordBatch]:
        if not len(part):
            return
        part = part.combine_chunks()
        v, band = part["vendor"].dictionary_encode().combine_chunks().indices.to_numpy(), part["band"].to_numpy()
        a, day, asks = (part[c].to_numpy() for c in ("a", "day", "asks"))
        cuts = np.append(np.flatnonzero(np.diff(v, prepend=-1) | np.diff(band, prepend=band[0])), len(v))
        found = np.concatenate([sweep(a[i:j], day[i:j], asks[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)])
        some = np.flatnonzero(found[:, 0])
        rows = part.select(["vendor", "a", "day"]).take(pa.array(some)).combine_chunks()
        yield pa.RecordBatch.from_arrays([*[c.combine_chunks() for c in rows.columns], *[pa.array(found[some, i]) for i in range(3)]], ["vendor", "a", "day", "n_months", "n_months_12", "other"])

    for b in batches:
        if not len(b):
            continue
        last = (b["vendor"][-1], b["band"][-1])
        if held and (held[-1]["vendor"][-1], held[-1]["band"][-1]) == last and (b["vendor"][0], b["band"][0]) == last:
            held.append(b)
            continue
        size = len(b)
        same = np.flatnonzero((b["band"].to_numpy() != last[1].as_py()) | (pc.not_equal(b["vendor"], last[0]).to_numpy(zero_copy_only=False)))
        cut = int(same[-1]) + 1 if len(same) else 0
        if cut or held:
            yield from done(pa.Table.from_batches([*held, b.slice(0, cut)]))
        held = [b.slice(cut, size - cut)]
    if held:
        yield from done(pa.Table.from_batches(held))


def similar_amounts(tx: DataFrame) -> DataFrame:
    """(id, n_months, n_months_12, all_exact) over earlier rows of the vendor within ten percent of the amount.

    What asks and what answers are a vendor's distinct (amount, day), however many rows it has. Bands of eight logarithmic buckets, each with two more buckets on
    either side, part a vendor's amounts, and each band is gone through once in order of the amount (:func:`sweep`), which is linear in its distinct rows.
    """
    rows = tx.where("vendor <> '' and cents <> 0").select("id", "vendor", F.datediff("date", F.lit("1970-01-01").cast("date")).cast("long").alias("day"), F.abs("cents").alias("a")).where("day is not null")
    rows = scratch_table(rows, "similar-rows")
    bucket = F.floor(F.log(F.col("a").cast("double")) / F.log(F.lit(1.1)))
    bands = [F.floor((F.col("b") + k) / BAND).cast("int") for k in (-2, 0, 2)]
    told = rows.select("vendor", "a", "day").distinct().withColumn("b", bucket).withColumn("band", F.explode(F.array_distinct(F.array(*bands)))).select("vendor", "band", "a", "day", (F.col("band") == bands[1]).alias("asks"))
    found = told.repartition("vendor", "band").sortWithinPartitions("vendor", "band", "a", "day").mapInArrow(sweep_bands, "vendor string, a long, day long, n_months long, n_months_12 long, other long")
    return rows.join(found, ["vendor", "a", "day"]).select("id", "n_months", "n_months_12", (1 - F.col("other")).cast("int").alias("all_exact"))


def iban_history(tx: DataFrame) -> DataFrame:
    """(id, n_iban): rows of the same IBAN on earlier dates."""
    rows = tx.where("iban <> ''").select("id", "iban", "date")
    days = by_day(rows, "iban").select("iban", "date", days_before(0, "iban").alias("n_iban"))
    return rows.join(days, ["iban", "date"]).select("id", "n_iban")


VENDOR_FEATURES = ("days_since_prev_same_cp", "count_same_cp_30d", "count_same_cp_90d", "count_same_cp_365d", "amount_zscore_within_cp")
SIMILAR_FEATURES = ("is_likely_recurring", "recurring_months_12", "recurring_is_exact_amount")
IBAN_FEATURES = ("iban_count_before",)
FEATURES = VENDOR_FEATURES + SIMILAR_FEATURES + IBAN_FEATURES


def temporal_features(tx: DataFrame, ids: DataFrame | None = None, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """The history ``features`` of every row, or of ``ids`` (their history is still the whole table's), all by default. What they are made of is written once and read by all; histories that none of them needs are not made."""
    if unknown := set(features) - set(FEATURES):
        raise ValueError(f"unknown features {sorted(unknown)}")
    zero = F.lit(0).cast("long")
    tx = scratch_table(tx.select("id", "vendor", "iban", "date", "cents"), "history-facts")
    out = tx.select("id")
    for history, has in ((vendor_history, VENDOR_FEATURES), (similar_amounts, SIMILAR_FEATURES), (iban_history, IBAN_FEATURES)):
        if set(has) & set(features):
            out = out.join(history(tx), "id", "left")
    made = {
        "days_since_prev_same_cp": F.col("days_since_prev"), **{f"count_same_cp_{n}d": F.coalesce(f"n{n}", zero) for n in (30, 90, 365)}, "amount_zscore_within_cp": F.col("z"),
        "is_likely_recurring": (F.coalesce("n_months", zero) >= 3).cast("int"), "recurring_months_12": F.coalesce("n_months_12", zero), "recurring_is_exact_amount": F.coalesce("all_exact", F.lit(0)), "iban_count_before": F.coalesce("n_iban", zero),
    }
    out = out.select("id", *[made[f].alias(f) for f in features])
    return out if ids is None else out.join(ids.select("id"), "id", "left_semi")
