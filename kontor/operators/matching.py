"""Matching with a second source: one-to-one by amount and nearest date, and names by likeness."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kontor.functions import text
from kontor.operators import likeness
from kontor.scratch import scratch_table


def decide_days(days: pd.DataFrame, window: int) -> pd.DataFrame:
    """One run of days of one amount: candidates in order of date and id each take the only nearest unused record within ``window`` days; where there are several they take none and mark them.

    ``days``: day, ``ids`` (the first few candidates, in order) and ``n_records``, one row a day. A day of several records can never be used, as its records always tie, so that a
    day has one free record, none, or ever as many as it has.
    """
    days = days.sort_values("day")
    left = {int(d): int(n) for d, n in zip(days["day"], days["n_records"], strict=True) if n}
    found, tied = [], set()
    for day, ids in zip(days["day"], days["ids"], strict=True):
        for id_ in ids:
            near = next(([d for d in {day - off, day + off} if left.get(d)] for off in range(window + 1) if left.get(day - off) or left.get(day + off)), [])
            if sum(left[d] for d in near) != 1:
                tied.update(near)
                break  # nothing has changed for the next candidate of the day
            left[near[0]] = 0
            found.append((near[0], int(id_), abs(int(near[0]) - int(day))))
    out = pd.DataFrame(found, columns=["day", "id", "days"]).assign(outcome="matched")
    ties = pd.DataFrame({"day": sorted(tied), "id": pd.NA, "days": pd.NA, "outcome": "ambiguous"})
    return pd.concat([out, ties]).assign(a=days["a"].iloc[0]).astype({"day": "int64", "id": "Int64", "days": "Int32"})[["a", "day", "id", "days", "outcome"]]


def match_secondary(tx: DataFrame, records: DataFrame, window: int = 5) -> DataFrame:
    """(id, ref, days, outcome): matches of ``tx`` (id, date, cents) with ``records`` (ref, txn_date, cents), and the records left over.

    Only equal absolute amounts meet. However many rows have an amount, a day of it is decided by at most 2 * ``window`` + 2 candidates, as each but the last uses up a record in reach, and by
    how many records it has; so what is decided in order is a table of a few candidates a day, in runs of days none of which is more than ``window`` from the next. A run whose one
    candidate meets one record is decided by built-in functions. Records learn from their day what became of them. A record that tied and was matched later counts in both.
    """
    day = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date")).cast("long")
    c = tx.select(F.abs("cents").alias("a"), "id", day("date").alias("day")).where("day is not null")
    r = scratch_table(records.select(F.abs("cents").alias("a"), "ref", day("txn_date").alias("day")), "match-records")
    per_day = r.where("day is not null").groupBy("a", "day").agg(F.count(F.lit(1)).alias("n_records"))
    turn = F.row_number().over(Window.partitionBy("a", "day").orderBy("id"))
    first = c.join(r.select("a").distinct(), "a", "left_semi").withColumn("turn", turn).where(F.col("turn") <= 2 * window + 2)
    ids = first.groupBy("a", "day").agg(F.array_sort(F.collect_list("id")).alias("ids"))  # a few
    days = per_day.join(ids, ["a", "day"], "full").withColumns({"n_records": F.coalesce("n_records", F.lit(0)), "ids": F.coalesce("ids", F.array().cast("array<long>"))})
    order = Window.partitionBy("a").orderBy("day")  # days of an amount
    new = (F.col("day") - F.lag("day").over(order) > window).cast("int")
    runs = days.withColumn("new", F.coalesce(new, F.lit(1))).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("new")
    of_run = Window.partitionBy("a", "run")
    runs = scratch_table(runs.withColumns({"n_c": F.sum(F.size("ids")).over(of_run), "n_r": F.sum("n_records").over(of_run)}).where("n_c > 0 and n_r > 0"), "match-runs")
    single = runs.where("n_c = 1 and n_r = 1").groupBy("a", "run").agg(F.max(F.when(F.col("n_records") == 1, F.col("day"))).alias("day"), F.max(F.get("ids", F.lit(0))).alias("id"), F.max(F.when(F.size("ids") == 1, F.col("day"))).alias("own"))
    single = single.withColumn("days", F.abs(F.col("day") - F.col("own")).cast("int")).where(F.col("days") <= window).select("a", "day", "id", "days", F.lit("matched").alias("outcome"))
    contested = runs.where("n_c + n_r > 2").select("a", "run", "day", "ids", "n_records")
    decided = contested.groupBy("a", "run").applyInPandas(lambda d: decide_days(d, window), "a long, day long, id long, days int, outcome string").unionByName(single)
    said = decided.groupBy("a", "day").agg(F.collect_set(F.struct("id", "days", "outcome")).alias("said"))  # two at most
    rest = F.struct(F.lit(None).cast("long").alias("id"), F.lit(None).cast("int").alias("days"), F.lit("unmatched").alias("outcome"))
    return r.join(said, ["a", "day"], "left").select("ref", F.explode(F.coalesce("said", F.array(rest))).alias("s")).select("s.id", "ref", "s.days", "s.outcome")


def match_report(matches: DataFrame) -> DataFrame:
    n = lambda o: F.count(F.when(F.col("outcome") == o, 1)).alias(o)
    return matches.agg(n("matched"), n("ambiguous"), n("unmatched"))


def letters(c: Column) -> Column:
    """How often each of 31 kinds of characters is in a text, by code."""
    kinds = F.transform(F.split(c, ""), lambda x: F.pmod(F.ascii(x), F.lit(31)))
    return F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: F.size(F.filter(kinds, lambda x: x == k)))


#: A word that very many names share is dealt out over as many tasks.
SALTS = 16


def best_name_match(names: DataFrame, known: DataFrame, column: str = "vendor", *, shared_word: bool = True) -> DataFrame:
    """(name, match, score): for each name the most alike of ``known``, ties to the first by alphabet. ``shared_word``: only known names that share a word with it count, and a name that shares none with any is left out.

    Known names are their own best match and never joined, and a name that contains a known one, or is contained in one, has 100 with the first of these. The others meet the known ones
    through shared words, and only pairs that can be the best are scored (:func:`candidate_pairs`); then, unless a shared word is asked for, all known names that share none (:func:`likeness.against_all`).
    """
    a, b = scratch_table(names.select(F.col(column).alias("name")).distinct(), "names-all"), scratch_table(known.select(F.col(column).alias("match")).distinct(), "names-known")
    same = a.join(shuffled(b), a.name == b.match).select("name", "match", F.lit(100.0).alias("score"))
    rest = scratch_table(a.join(shuffled(b), a.name == b.match, "left_anti"), "names")
    inside = scratch_table(contained(rest, b), "names-contained")
    asked = rest.join(shuffled(inside), "name", "left_anti")
    best = best_of(candidate_pairs(asked, b))
    if not shared_word:
        best = likeness.against_all(asked.join(shuffled(best), "name", "left"), b)
    return same.unionByName(inside.withColumn("score", F.lit(100.0))).unionByName(best)


def shuffled(df: DataFrame) -> DataFrame:
    """Joined by a shuffle: tables of names are small as files, and many times that in the driver's memory."""
    return df.hint("merge")


def best_of(pairs: DataFrame) -> DataFrame:
    scored = pairs.withColumn("score", F.floor(text.token_set_ratio(F.col("name"), F.col("match"))).cast("double"))
    return scored.groupBy("name").agg(F.min_by(F.struct("match", "score"), F.struct(-F.col("score"), "match")).alias("m")).select("name", "m.match", "m.score")


def words_of(df: DataFrame, c: str) -> DataFrame:
    return df.select(c, F.array_distinct(F.filter(F.split(c, r"\s+"), lambda x: x != "")).alias(f"words_{c}"))


def by_word(df: DataFrame, c: str, other: DataFrame, o: str) -> DataFrame:
    """(c, words, word, k, rarest): a row for each word, with the number of rows of ``other`` that have it (0: none), and whether none of the row's words that ``other`` has is rarer."""
    counts = other.select(F.explode(f"words_{o}").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("k"))
    each = df.withColumn("word", F.explode(f"words_{c}")).join(shuffled(counts), "word", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    least = each.where("k > 0").groupBy(c).agg(F.min(F.struct("k", "word")).alias("_least"))
    return each.join(shuffled(least), c).withColumn("rarest", F.col("word") == F.col("_least.word")).drop("_least")


def contained(names: DataFrame, known: DataFrame) -> DataFrame:
    """(name, match): the first by alphabet of the known names of which a name has all words, or which have all of its words. Whichever is inside meets the other in its rarest word."""
    x, y = words_of(names, "name"), words_of(known, "match")
    sides, met = {"name": x, "match": y}, None
    for c, o in (("name", "match"), ("match", "name")):
        small = by_word(sides[c], c, sides[o], o).where("rarest").drop("k", "rarest")
        pairs = small.join(shuffled(sides[o].withColumn("word", F.explode(f"words_{o}"))), "word").where(F.size(F.array_except(f"words_{c}", f"words_{o}")) == 0).select("name", "match")
        met = pairs if met is None else met.unionByName(pairs)
    return met.groupBy("name").agg(F.min("match").alias("match"))


def candidate_pairs(names: DataFrame, known: DataFrame) -> DataFrame:
    """(name, match) of the pairs that share a word and may be a name's best.

    What a pair shares bounds its score from both sides: the shared words are a common subsequence, and no common subsequence has more of any letter than either name. First, a name meets the
    known ones that have its rarest word; of these pairs, those whose upper bound is below the best lower bound of the name go, and the others are scored. Known names that have
    other words of it alone must reach that score: they are compared by length and letters, once for all names and all known names that are alike in these.
    """

    def described(df: DataFrame, c: str) -> DataFrame:
        joined = F.array_join(f"words_{c}", " ")
        return words_of(df, c).select(c, f"words_{c}", F.length(joined).alias(f"n_{c}"), letters(joined).alias(f"l_{c}"))

    x, y = scratch_table(described(names, "name"), "names-described"), scratch_table(described(known, "match"), "known-described")
    words = scratch_table(by_word(x, "name", y, "match").where("k > 0"), "names-words")
    known_words = y.withColumn("word", F.explode("words_match"))
    n, m = F.col("n_name"), F.col("n_match")
    common = F.aggregate(F.zip_with("l_name", "l_match", lambda p, q: F.least(p, q)), F.lit(0), lambda s, v: s + v)
    against_either = lambda both: F.greatest(2 * both / (both + n), 2 * both / (both + m))

    met = words.where("rarest").join(shuffled(known_words), "word").withColumn("in_both", F.array_intersect("words_name", "words_match"))
    k = F.size("in_both")
    both = F.length(F.array_join("in_both", " "))
    inside = (k == F.size("words_name")) | (k == F.size("words_match"))
    # exactly: the shared words are where either begins; beside them, the blank behind them is common
    low = F.when(inside, 100.0).otherwise(100.0 * F.greatest(against_either(both), 2 * (both + 1) / (n + m)))
    high = F.when(inside, 100.0).otherwise(100.0 * F.greatest(against_either(both), 2 * common / (n + m)))
    pairs = scratch_table(met.select("name", "match", F.floor(low - 1e-9).alias("low"), F.floor(high + 1e-9).alias("high")), "name-pairs")
    pairs = pairs.join(shuffled(pairs.groupBy("name").agg(F.max("low").alias("least"))), "name").where(F.col("high") >= F.col("least")).select("name", "match")

    # known names without the rarest word: at most all other words are shared
    reach = words.where("not rarest").groupBy("name").agg((F.sum(F.length("word")) + F.count(F.lit(1)) - 1).alias("most"))
    other = words.where("not rarest").join(shuffled(reach), "name").join(shuffled(best_of(pairs).select("name", F.col("score").alias("least"))), "name")
    other = scratch_table(other.select("name", "word", "n_name", "l_name", "most", "least"), "names-other")
    kinds = other.select("word", "n_name", "l_name", "most", "least").distinct().withColumn("salt", F.pmod(F.xxhash64("n_name", "l_name", "most", "least"), F.lit(SALTS)))
    known_kinds = known_words.select("word", "n_match", "l_match").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    either, enough = against_either(F.least("most", "n_name", "n_match")), lambda high: F.floor(100.0 * high + 1e-9) >= F.col("least")
    alike = kinds.join(shuffled(known_kinds), ["word", "salt"]).where(enough(F.greatest(either, 2 * F.least(n, m) / (n + m)))).where(enough(F.greatest(either, 2 * common / (n + m))))
    alike = scratch_table(alike.drop("salt"), "names-alike")
    more = other.join(shuffled(alike), ["word", "n_name", "l_name", "most", "least"]).join(shuffled(known_words.select("word", "n_match", "l_match", "match")), ["word", "n_match", "l_match"]).select("name", "match")
    return pairs.unionByName(more).distinct()
