"""Toxicity by class-conditional Kneser-Ney models.

Both classes have an interpolated model of four levels: a word after the one before it, the word, its first
7 bytes, its first 4 bytes. Of the first level the class' documents are counted, in which it occurs; of each level below, as Kneser and Ney have it, the different
expressions of the level above that the class has and that back off to it. Each level is discounted and backs off to the next; below the last there are the shared
counts of both classes, in whose units all probabilities are held. Rare expressions are smoothed through shared counts twice: by the discount,
and because a class' own estimate counts only k / (k + ``strength``), k being the documents of both classes together.

The two log-likelihoods are compared per word. Of each word's log ratio only what exceeds ``margin`` on either side
counts: neutral words scatter around 0, and over a long text their sum would drown the few that tell. The difference, divided by the number of words, is
calibrated by a logistic curve over its inverse hyperbolic sine (logarithmic far out, linear near 0) on labelled documents that were not counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kontor.llm.common import fresh, scratch_table
from kontor.llm.words import ALNUM_OR_HIGH, BASE, Words, cut_words, mix64

FILTER_BITS = 20
LEVELS = 4  # first 4 bytes, first 7 bytes, word, pair
BEGINNINGS = (4, 7)


def expressions(w: Words) -> list[np.ndarray]:
    """Hash of each word's expression at each level, 0 where it has none."""
    before = np.zeros(len(w.hash), np.uint64)
    before[1:] = np.where(w.row[1:] == w.row[:-1], w.hash[:-1], np.uint64(0))
    return [*(w.beginnings(n) for n in BEGINNINGS), w.hash, mix64(before * np.uint64(BASE) + w.hash + np.uint64(1))]


@dataclass
class ToxicityModel:
    """``keys``: sorted hashes of expressions; ``gain``: their log ratios beyond the margin; score = logistic(slope * asinh(z / scale) + offset)."""

    keys: np.ndarray
    gain: np.ndarray
    slope: float
    offset: float
    scale: float = 1.0

    def __post_init__(self) -> None:
        self.seen = np.zeros(1 << FILTER_BITS, bool)
        self.seen[(self.keys & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True

    def replace(self, out: np.ndarray, hashes: np.ndarray) -> None:
        """``out`` with the gains of those expressions that the model has."""
        maybe = np.flatnonzero(self.seen[(hashes & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.keys, hashes[maybe]), len(self.keys) - 1)
            same = self.keys[at] == hashes[maybe]
            out[maybe[same]] = self.gain[at[same]]

    def difference(self, texts: pa.Array) -> np.ndarray:
        """z of each text: the log-likelihoods' difference per word; 0 without words."""
        z = np.zeros(len(texts))
        for w in cut_words(texts, ALNUM_OR_HIGH, fold=True):
            gain = np.zeros(len(w.hash))
            for hashes in expressions(w):  # the longest that is known decides
                self.replace(gain, hashes)
            n = np.bincount(w.row, minlength=w.n_rows)
            z[w.first : w.first + w.n_rows] = np.bincount(w.row, weights=gain, minlength=w.n_rows) / np.maximum(1, n)
        return z


def fit_logistic(z: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset by Newton steps, with a small penalty on the slope of the scaled z."""
    scale = float(np.std(z)) or 1.0
    x = np.stack([z / scale, np.ones(len(z))], axis=1)
    prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    b = np.array([0.0, np.log(prior / (1 - prior))])
    penalty = np.array([ridge * len(z), 1e-6])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (y - p) - penalty * b)
        size = np.abs(step).max()
        b = b + step * min(1.0, 2.0 / max(size, 1e-12))
        if size < 1e-8:
            break
    return float(b[0] / scale), float(b[1])


COUNTS = T.StructType([T.StructField(n, t) for n, t in (("level", T.IntegerType()), ("key", T.LongType()), ("parent", T.LongType()), ("before", T.LongType()), ("toxic", T.LongType()), ("other", T.LongType()))])


def count_expressions(sample: DataFrame) -> DataFrame:
    """In how many toxic and other documents of ``sample`` (text, toxic) each expression occurs; ``parent``: what it backs off to (0: nothing), ``before``: a pair's first word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for w in cut_words(batch.column(0), ALNUM_OR_HIGH, fold=True):
                levels = expressions(w)
                before = np.zeros(len(w.hash), np.uint64)
                before[1:] = np.where(w.row[1:] == w.row[:-1], w.hash[:-1], np.uint64(0))
                none, parent = np.zeros(len(w.hash), np.uint64), np.zeros(len(w.hash), np.uint64)
                for level, key in enumerate(levels):
                    order = np.lexsort((key, w.row))
                    order = order[key[order] != 0]
                    once = order[np.concatenate([[True], (key[order[1:]] != key[order[:-1]]) | (w.row[order[1:]] != w.row[order[:-1]])])[: len(order)]]
                    values, first, which = np.unique(key[once], return_index=True, return_inverse=True)
                    is_toxic = toxic[w.first + w.row[once]]
                    n, n_toxic = np.bincount(which, minlength=len(values)), np.bincount(which, weights=is_toxic, minlength=len(values)).astype(np.int64)
                    at = once[first]
                    longs = (values, parent[at], (before if level == LEVELS - 1 else none)[at])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), level, np.int32)), *(pa.array(x.view(np.int64)) for x in longs), pa.array(n_toxic), pa.array(n - n_toxic)], names=COUNTS.names)
                    parent = np.where(key != 0, key, parent)

    rows = sample.select("text", F.col("toxic").cast("boolean")).mapInArrow(count, COUNTS)
    return rows.groupBy("level", "key", "parent", "before").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def continued(counts: DataFrame) -> DataFrame:
    """``counts`` with ``documents``, those of both classes, and below the first level the classes' numbers of expressions that back off to each in place of documents (1, if it has documents but none of these)."""
    docs = counts.withColumn("documents", F.col("toxic") + F.col("other"))
    above = counts.where("parent <> 0").groupBy(F.col("parent").alias("key")).agg(*[F.count(F.when(F.col(c) > 0, 1)).alias(f"above_{c}") for c in ("toxic", "other")])
    kinds = {c: F.greatest(F.coalesce(f"above_{c}", F.lit(0)), F.least(F.col(c), F.lit(1))) for c in ("toxic", "other")}
    lower = docs.where(F.col("level") < LEVELS - 1).join(above, "key", "left").withColumns(kinds).select(*docs.columns)
    return lower.unionByName(docs.where(F.col("level") == LEVELS - 1))


def expression_gains(counts: DataFrame, *, strength: float, margin: float) -> DataFrame:
    """(key, gain) of the expressions whose gain is not that of what they back off to."""
    counts = continued(counts)
    totals = counts.groupBy("level").agg(
        F.sum("toxic").alias("toxic"), F.sum("other").alias("other"), F.count(F.when(F.col("toxic") > 0, 1)).alias("toxic_kinds"), F.count(F.when(F.col("other") > 0, 1)).alias("other_kinds"),
        F.count(F.when(F.col("toxic") + F.col("other") == 1, 1)).alias("ones"), F.count(F.when(F.col("toxic") + F.col("other") == 2, 1)).alias("twos"),
    )
    t = {r["level"]: r for r in totals.collect()}
    known = None
    for level, r in sorted(t.items()):
        d = r["ones"] / max(1, r["ones"] + 2 * r["twos"]) if r["ones"] else 0.5
        rows = counts.where(F.col("level") == level)
        if level < LEVELS - 1:
            rows = rows.withColumns({f"{s}{name}": F.lit(float(r[f"{s}{of}"])) for s in ("toxic", "other") for name, of in (("_total", ""), ("_kinds", "_kinds"))})
        else:
            context = rows.groupBy("before").agg(*[F.sum(s).cast("double").alias(f"{s}_total") for s in ("toxic", "other")], *[F.count(F.when(F.col(s) > 0, 1)).alias(f"{s}_kinds") for s in ("toxic", "other")])
            rows = rows.join(context, "before")
        if known is None:
            rows = rows.withColumns({"up_toxic": F.lit(1.0), "up_other": F.lit(1.0)})
        else:
            up = known.select(F.col("key").alias("parent"), F.col("p_toxic").alias("up_toxic"), F.col("p_other").alias("up_other"))
            rows = rows.join(up, "parent", "left").na.fill(1.0, ["up_toxic", "up_other"])
        k = F.col("documents")
        shared = (F.col("toxic") + F.col("other")) / (F.col("toxic_total") + F.col("other_total"))

        def smoothed(side: str, k: Column = k, shared: Column = shared, d: float = d) -> Column:
            total, up = F.col(f"{side}_total"), F.col(f"up_{side}")
            own = F.greatest(F.col(side) - d, F.lit(0.0)) / total / shared + d * F.col(f"{side}_kinds") / total * up
            return F.when(total > 0, k / (k + strength) * own + strength / (k + strength) * up).otherwise(up)

        rows = rows.select("level", "key", "up_toxic", "up_other", smoothed("toxic").alias("p_toxic"), smoothed("other").alias("p_other"))
        known = rows if known is None else known.unionByName(rows)
    if known is None or not t[2]["toxic"] or not t[2]["other"]:
        return counts.select("key", F.lit(0.0).alias("gain")).limit(0)

    def beyond(toxic: str, other: str) -> Column:
        ratio = F.log(F.col(toxic) / F.col(other))
        return F.signum(ratio) * F.greatest(F.abs(ratio) - margin, F.lit(0.0))

    return known.select("key", beyond("p_toxic", "p_other").alias("gain"), beyond("up_toxic", "up_other").alias("up")).where("gain <> up").select("key", "gain")


def fit_toxicity(df: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", max_documents: int = 4000, strength: float = 10.0, margin: float = 1.5, fold: int = 0) -> ToxicityModel:
    """A model from ``labels`` (``key``, ``toxic`` 0 or 1; null: none) over the texts of ``df``.

    Learns from a bounded sample: of each class at most ``max_documents`` labelled documents to count expressions, and at most
    twice as many others, whatever their class, to calibrate; documents are dealt to both uses by a hash of their key. One
    row per key is taken. The sample is broadcast; of the expressions only those whose gain differs from what they back off to come to the driver.

    Rows of ``labels`` without a document are left out. Without documents of both classes there is no evidence, and every
    score is the share of toxic labels (0 without any).
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("h", F.xxhash64(F.lit(fold), F.col(key))).withColumn("calibrate", F.pmod(F.col("h"), F.lit(4)) == 0)
    some = known.where("calibrate").orderBy("h", key).limit(2 * max_documents)
    for toxic in (0, 1):
        some = some.unionByName(known.where(~F.col("calibrate") & (F.col("toxic") == toxic)).orderBy("h", key).limit(max_documents))
    some = some.select(key, "toxic", "calibrate")
    rows = df.select(key, text).join(F.broadcast(some), key).groupBy(key).agg(F.min(F.struct(F.col(text).alias("text"), "toxic", "calibrate")).alias("r")).select("r.*")
    rows = rows.persist()
    try:
        gains = expression_gains(scratch_table(count_expressions(rows.where("not calibrate")), "toxicity-counts"), strength=strength, margin=margin).toPandas()
        order = np.argsort(gains["key"].to_numpy(np.int64).view(np.uint64))
        model = ToxicityModel(gains["key"].to_numpy(np.int64).view(np.uint64)[order], gains["gain"].to_numpy(float)[order], 0.0, -500.0)
        seen = add_difference(rows.where("calibrate"), model, "text", "z").select("z", "toxic").toPandas()
    finally:
        rows.unpersist()
    y = seen["toxic"].to_numpy(float)
    if len(y) and 0 < y.sum() < len(y) and len(gains):
        z = seen["z"].to_numpy(float)
        model.scale = max(1e-4, float(np.quantile(np.abs(z[y == 0]), 0.95)))
        model.slope, model.offset = fit_logistic(np.arcsinh(z / model.scale), y)
    elif len(y) and y.sum():
        model.offset = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    return model


def add_difference(df: DataFrame, model: ToxicityModel, text: str, name: str) -> DataFrame:
    """``df`` plus the model's z of each text."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])
    names = schema.names

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.difference(batch.column(names.index(text))))], names=names)

    return df.mapInArrow(scan, schema)


def score_toxicity(df: DataFrame, model: ToxicityModel, *, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """All rows and columns of ``df`` plus ``score`` (0 to 1, higher: more likely toxic) and ``predicted`` (1 from ``threshold`` on).

    Only the text decides; equal texts have equal scores. One pass without a shuffle. Null and empty texts, and texts of
    none of the model's expressions, have z = 0 and the score of that; an empty table gives no rows; existing columns ``score`` and ``predicted`` are replaced.
    """
    (z,) = fresh(df, "_z")
    out = add_difference(df.drop("score", "predicted"), model, text, z)
    exponent = F.lit(-model.slope) * F.asinh(F.col(z) / F.lit(model.scale)) - model.offset
    out = out.withColumn("score", 1 / (1 + F.exp(F.least(F.greatest(exponent, F.lit(-500.0)), F.lit(500.0)))))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int")).drop(z)
