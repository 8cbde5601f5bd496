"""Jaccard join of word n-gram sets by rare-first prefix filtering.

Sets that are equal form a class, and only classes are joined, each by the text of one of its rows. A class' n-grams are
ordered from rare to frequent; of two sets that are similar enough, the first n-gram that they share stands among the first few of both
(the prefix; a shorter one suffices for the smaller set). Pairs that meet there pass a length filter, a positional filter
(what can still follow on both sides) and a suffix filter (how far apart the sets' counts in 64 ranges of hashes are),
and are then verified once by their whole sets.

Groups of near copies are not expanded into pairs. First, in a few rounds, all classes that meet in an n-gram of their prefixes are verified
against one of them, and what is linked is one component from then on. That one is the class in whose prefix the n-gram comes first: it has
fewest rarer n-grams, and so is nearest to what the others have in common. The join proper leaves out pairs within a component and
those verified before. So the result is components, not all links: a link between two classes that are connected anyway is neither
verified nor returned.

Rarity is the n-gram's count over all classes in a table indexed by hash, a byte for NGRAMS_PER_COUNT n-grams up to 2**MOST_BITS
bytes, beyond which counts only tell the more frequent n-grams apart. Any order gives the same result; this one keeps frequent n-grams out of the prefixes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kontor.llm.common import bucketed_table, drop_scratch, fresh, scratch_table, shuffles_go
from kontor.llm.components import connected_components
from kontor.llm.words import GOLDEN, Words, cut_words, gram_hashes, mix64

LEAST_BITS, MOST_BITS, BLOCK_BITS = 16, 25, 16
NGRAMS_PER_COUNT = 8
RANGES = 64
STARS = 2
WORDS_PER_GROUP = 200_000
NGRAMS_PER_BUCKET, MOST_BUCKETS = 4_000_000, 100_000


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of ``n`` words; of rows with fewer words, of all their words."""
    grams, at = gram_hashes(w, n)
    cuts = w.rows()
    size = np.diff(cuts)
    short = np.flatnonzero((size > 0) & (size < n))
    if not len(short):
        return grams, w.row[at]
    whole = np.zeros(len(short), np.uint64)
    for j in range(n - 1):
        has = size[short] > j
        whole[has] = mix64(whole[has] + w.hash[cuts[short[has]] + j] + np.uint64(j + 1))
    return np.concatenate([grams, whole]), np.concatenate([w.row[at], short])


def distinct_by_row(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' sets, in order of row and hash."""
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    keep = np.ones(len(rows), bool)
    keep[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[keep], rows[keep]


def class_ids(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each set; ``first``: where the sets begin in ``hashes``."""
    return mix64(np.add.reduceat(mix64(hashes ^ GOLDEN), first)).view(np.int64)


def describe_sets(df: DataFrame, id_: str, key: str, text: str, n: int) -> DataFrame:
    """(id, key, class, n, ranges) of each row: its class (null: no words), set size and range counts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in cut_words(batch.column(2), fold=True):
                h, row = distinct_by_row(*shingles(w, n))
                size = np.bincount(row, minlength=w.n_rows)
                full = np.flatnonzero(size)
                first = np.concatenate([[0], np.cumsum(size[full])[:-1]]).astype(np.int64) if len(full) else np.zeros(0, np.int64)
                cls = np.zeros(w.n_rows, np.int64)
                if len(full):
                    cls[full] = class_ids(h, first)
                ranges = np.bincount(row * RANGES + (h >> np.uint64(58)).astype(np.int64), minlength=w.n_rows * RANGES)
                ranges = np.minimum(ranges, 255).astype(np.uint8).tobytes()
                part = [batch.column(c).slice(w.first, w.n_rows) for c in (0, 1)]
                ranges = pa.array([ranges[i * RANGES : (i + 1) * RANGES] for i in range(w.n_rows)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part, pa.array(cls, mask=size == 0), pa.array(size.astype(np.int32)), ranges], names=["id", "key", "class", "n", "ranges"])

    key_type = df.schema[key].dataType
    fields = [("id", T.LongType()), ("key", key_type), ("class", T.LongType()), ("n", T.IntegerType()), ("ranges", T.BinaryType())]
    return df.select(id_, key, text).mapInArrow(scan, T.StructType([T.StructField(a, b) for a, b in fields]))


def frequency_table(reps: DataFrame, n: int, bits: int) -> np.ndarray:
    """In how many rows of ``reps`` (class, text) n-grams of each hash remainder occur, up to 255: 2**``bits`` counts, added up block by block."""
    size, full = 1 << BLOCK_BITS, 255

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for w in cut_words(batch.column(0), fold=True):
                h, _ = distinct_by_row(*shingles(w, n))
                at, more = np.unique(h & np.uint64((1 << bits) - 1), return_counts=True)
                total = np.zeros(1 << bits, np.uint8) if total is None else total
                at = at.astype(np.int64)
                total[at] = np.minimum(total[at] + np.minimum(more, full), full)
        if total is not None:
            for i, block in enumerate(total.reshape(-1, size)):
                some = np.flatnonzero(block)
                dense = 3 * len(some) > size
                places = b"" if dense else some.astype(np.uint16).tobytes()
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([places], pa.binary()), pa.array([(block if dense else block[some]).tobytes()], pa.binary())], names=["block", "places", "counts"])

    def add(part: pa.Table) -> pa.Table:
        total = np.zeros(size, np.int64)
        for places, counts in zip(part["places"].to_pylist(), part["counts"].to_pylist(), strict=True):
            total[np.frombuffer(places, np.uint16) if places else slice(None)] += np.frombuffer(counts, np.uint8)
        return pa.table({"block": part["block"][:1], "places": pa.array([b""], pa.binary()), "counts": pa.array([np.minimum(total, full).astype(np.uint8).tobytes()], pa.binary())})

    schema = "block long, places binary, counts binary"
    ways = math.isqrt(reps.rdd.getNumPartitions()) + 1  # tables are added up in two steps, each of the root of their number
    parts = reps.select("text").mapInArrow(count, schema).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(ways)))
    parts = parts.groupBy("block", "part").applyInArrow(add, schema)
    out = np.zeros((1 << bits) // size * size, np.uint8).reshape(-1, size)
    for r in parts.groupBy("block").applyInArrow(add, schema).collect():
        out[r["block"]] = np.frombuffer(r["counts"], np.uint8)
    return out.ravel()


def prefixes(reps: DataFrame, n: int, percent: int, often: np.ndarray, bits: int) -> DataFrame:
    """(class, n, at, token) of each row of ``reps``: its prefix from rare to frequent."""
    shared = reps.sparkSession.sparkContext.broadcast(often)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in cut_words(batch.column(1), fold=True):
                h, row = distinct_by_row(*shingles(w, n))
                size = np.bincount(row, minlength=w.n_rows)
                count = shared.value[(h & np.uint64((1 << bits) - 1)).astype(np.int64)]
                by = np.lexsort((h, count, row))
                place = np.arange(len(h)) - np.repeat(np.concatenate([[0], np.cumsum(size)[:-1]]), size)
                prefix = size - (-(-percent * size // 100)) + 1
                take, at = by[place < prefix[row]], place[place < prefix[row]]
                cls = batch.column(0).slice(w.first, w.n_rows).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(cls[row[take]]), pa.array(size[row[take]].astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(h[take].view(np.int64))], names=["class", "n", "at", "token"])

    return reps.mapInArrow(scan, "class long, n int, at int, token long")


def enough(n1: Column, n2: Column, percent: int) -> Column:
    """The overlap that two sets of these sizes need."""
    return F.ceil((n1 + n2) * percent / F.lit(100 + percent) - F.lit(1e-9))


def verify(pairs: DataFrame, classes: DataFrame, reps: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b: classes, once each) whose sets are similar enough. The text of ``a`` is cut once for all its ``b``, up to WORDS_PER_GROUP n-grams of these."""
    slim = classes.select("class", "n", "ranges")
    near = pairs.join(slim.toDF("a", "na", "ra"), "a").join(slim.toDF("b", "nb", "rb"), "b")
    near = near.where((F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent))

    def suffix_filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ra, rb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, RANGES).astype(np.int16) for c in ("ra", "rb"))
            na, nb = (batch.column(c).to_numpy().astype(np.int64) for c in ("na", "nb"))
            apart = na + nb - 2 * -(-percent * (na + nb) // (100 + percent))  # what two such sets may differ by
            keep = np.flatnonzero(np.abs(ra - rb).sum(axis=1) <= apart)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep)) for c in ("a", "b", "nb")], names=["a", "b", "nb"])

    near = scratch_table(near.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(suffix_filter, "a long, b long, nb int"), "ngram-pairs")
    load = scratch_table(near.groupBy("a").agg(F.ceil(F.sum("nb") / WORDS_PER_GROUP).cast("int").alias("groups")), "ngram-load")
    right = near.join(load, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("salt"))
    right = scratch_table(right, "ngram-salted")  # written out, so that its size is known when it is joined
    right = right.join(reps, F.col("b") == F.col("class")).select(F.col("a").alias("of"), F.col("salt").alias("part"), "b", F.col("text").alias("other"))
    left = load.join(reps, F.col("a") == F.col("class")).select("a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("salt"), "text")

    def compare(one: pa.Table, others: pa.Table) -> pa.Table:
        one, others, keep = one.combine_chunks(), others.combine_chunks(), []
        if len(one) and len(others):
            mine = np.concatenate([distinct_by_row(*shingles(w, n))[0] for w in cut_words(one["text"], fold=True)])
            for w in cut_words(others["other"], fold=True):
                h, row = distinct_by_row(*shingles(w, n))
                size = np.bincount(row, minlength=w.n_rows)
                at = np.minimum(np.searchsorted(mine, h), len(mine) - 1)
                both = np.bincount(row[mine[at] == h], minlength=w.n_rows)
                keep.append(w.first + np.flatnonzero(100 * both >= percent * (size + len(mine) - both)))
        keep = pa.array(np.concatenate(keep) if keep else np.zeros(0, np.int64))
        return pa.table({"a": others["of"].take(keep), "b": others["b"].take(keep)})

    return scratch_table(left.groupBy("a", "salt").cogroup(right.groupBy("of", "part")).applyInArrow(compare, "a long, b long"), "ngram-links")


def component_of(df: DataFrame, known: DataFrame) -> DataFrame:
    """``df`` (class) plus ``component``; ``known`` has the classes that are linked, others are their own."""
    return df.join(known, "class", "left").withColumn("component", F.coalesce("component", "class"))


def contract(known: DataFrame, links: DataFrame) -> DataFrame:
    """``known`` (class, component) with the components that ``links`` (a, b: classes) connect made one."""
    ends = links.select("a", "b", F.explode(F.array("a", "b")).alias("class"))
    named = scratch_table(component_of(ends, known), "ngram-ends")
    of = named.groupBy("a", "b").agg(F.min("component").alias("u"), F.max("component").alias("v")).select("u", "v").where("u <> v").distinct()
    parts = connected_components(of, "u", "v").toDF("component", "low")
    every = known.unionByName(named.select("class", "component")).distinct()
    return scratch_table(every.join(parts, "component", "left").select("class", F.coalesce("low", "component").alias("component")), "ngram-known")


def meetings(tokens: DataFrame, known: DataFrame | None) -> DataFrame:
    """``tokens`` with their classes' components, of those tokens that two components have; without ``known``, each class is one."""
    if known is None:
        mixed = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    else:
        tokens = component_of(tokens, known)
        mixed = tokens.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    met = tokens.join(mixed.select("token").hint("merge"), "token", "left_semi")  # one plan at every size
    return scratch_table(met if known is not None else met.withColumn("component", F.col("class")), "ngram-met")


def may_link(x: str, y: str, percent: int) -> Column:
    """Length and positional filter of two sets that share a token first at their places ``at``; neither has more than the other's size allows."""
    nx, ny, ax, ay = (F.col(f"{t}.{c}") for c in ("n", "at") for t in (x, y))
    return (F.least(nx, ny) * 100 >= F.greatest(nx, ny) * percent) & (F.least(nx - ax, ny - ay) >= enough(nx, ny, percent))


def star_pairs(met: DataFrame, turn: int, percent: int) -> DataFrame:
    """(a, b): the classes that meet in a token, against one of them: that with the fewest rarer n-grams, as it has least of its own (ties by a seeded hash)."""
    pick = F.min_by(F.struct("class", "component", "n", "at"), F.struct("at", F.xxhash64(F.lit(turn), "class")))
    x, y = met.groupBy("token").agg(pick.alias("pick")).select("token", "pick.*").alias("x"), met.alias("y")
    on = (F.col("x.token") == F.col("y.token")) & (F.col("x.component") != F.col("y.component")) & may_link("x", "y", percent)
    return x.join(y, on).select(F.col("x.class").alias("a"), F.col("y.class").alias("b")).distinct()


def prefix_pairs(met: DataFrame, percent: int) -> DataFrame:
    """(a, b): all classes of different components that meet in a prefix and pass the length and positional filters."""
    # the smaller set of a pair (of equals, that of the smaller class) needs the shorter prefix
    x, y = met.alias("x"), met.where(F.col("at") <= F.col("n") - enough(F.col("n"), F.col("n"), percent)).alias("y")
    smaller = (F.col("y.n") < F.col("x.n")) | ((F.col("y.n") == F.col("x.n")) & (F.col("y.class") < F.col("x.class")))
    on = (F.col("x.token") == F.col("y.token")) & (F.col("x.component") != F.col("y.component")) & smaller & may_link("x", "y", percent)
    return x.join(y, on).select(F.col("x.class").alias("a"), F.col("y.class").alias("b")).distinct()


def jaccard_components(df: DataFrame, *, key: str = "doc_id", text: str = "text", n: int = 4, percent: int = 85, stable_input: bool = False, keep: tuple[str, ...] | None = None) -> DataFrame:
    """All rows of ``df`` with its columns (or those of ``keep``) plus ``n_shingles`` (long), ``component_id`` and ``first_in_component``.

    A row's set: the distinct runs of ``n`` words (between ASCII spaces, A-Z folded); with fewer words, all of them as one.
    Rows are linked where intersection / union is at least ``percent`` / 100; ``component_id`` is the smallest ``key`` that links reach,
    the row's own included, and ``first_in_component`` marks one row of each component. Runs and sets are told apart by 64-bit hashes.
    Links themselves are not returned: within a component only as many are verified as connect it.

    ``stable_input``: ``df`` reads files, and each partition gives the same rows again; else it is written to the shared scratch folder first.

    Edge cases: rows without words, or with null text, have size 0, are linked with nothing (not with each other either)
    and are first in a component of their own; repeated rows are linked like others; null keys count only where a component has no
    other; an empty table gives no rows; existing columns of the three names are replaced, and any other names are kept.
    """
    df = df.drop("n_shingles", "component_id", "first_in_component")
    with shuffles_go(df.sparkSession):
        if not stable_input:
            df = scratch_table(df, "ngram-input")
        (id_,) = fresh(df, "_row")
        rows = df.withColumn(id_, F.monotonically_increasing_id())
        described = scratch_table(describe_sets(rows, id_, key, text, n), "ngram-sets")
        some = described.where("class is not null")
        classes = scratch_table(some.groupBy("class").agg(F.min(F.struct("id", "n", "ranges")).alias("s")).select("class", "s.*"), "ngram-classes")
        (first,) = fresh(rows, "_first")
        of_class = classes.select("class", F.col("id").alias(first)).hint("merge")  # one plan at every size
        reps = rows.select(F.col(id_).alias("_id"), F.col(text).alias("text")).join(of_class, F.col("_id") == F.col(first)).select("class", "text")
        total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        reps = bucketed_table(reps, "ngram_texts", "class", min(MOST_BUCKETS, max(8, int(total) // NGRAMS_PER_BUCKET)))
        bits = min(MOST_BITS, max(LEAST_BITS, (int(total) // NGRAMS_PER_COUNT).bit_length()))
        tokens = scratch_table(prefixes(reps, n, percent, frequency_table(reps, n, bits), bits), "ngram-prefixes")
        known = classes.select("class", F.col("class").alias("component")).limit(0)
        both = [f("a", "b").alias(c) for f, c in ((F.least, "a"), (F.greatest, "b"))]
        met, tested = meetings(tokens, None), None
        drop_scratch(tokens)
        for turn in range(STARS):
            pairs = scratch_table(star_pairs(met, turn, percent), "ngram-stars")
            tested = pairs.select(*both) if tested is None else tested.unionByName(pairs.select(*both))
            known = contract(known, verify(pairs, classes, reps, n, percent))
            before, met = met, meetings(met.drop("component"), known)
            drop_scratch(before)
        pairs = prefix_pairs(met, percent).select(*both).join(tested, ["a", "b"], "left_anti")
        known = contract(known, verify(scratch_table(pairs, "ngram-candidates"), classes, reps, n, percent))
        drop_scratch(reps, met)
        member = component_of(described.select("id", "key", "class", "n"), known)
        named = scratch_table(member.where("class is not null").groupBy("component").agg(F.min("key").alias("least"), F.min("id").alias("lead")), "ngram-components")
    columns = [c for c in df.columns if keep is None or c in keep]
    own = fresh(rows, "_n", "_component", "_lead")
    result = member.join(named, "component", "left").select(
        F.col("id").alias(id_), F.col("n").cast("long").alias(own[0]), F.when(F.col("class").isNull(), F.col("key")).otherwise(F.col("least")).alias(own[1]), (F.coalesce("lead", "id") == F.col("id")).alias(own[2])
    )
    out = rows.select(*columns, id_).join(result, id_)
    return out.select(*columns, F.col(own[0]).alias("n_shingles"), F.col(own[1]).alias("component_id"), F.col(own[2]).alias("first_in_component"))
