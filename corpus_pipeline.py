"""A corpus pipeline: five of the training-data operators one after another over ``documents``.

Each stage takes (spark, docs, sf_dir), where ``docs`` reads a written table, and works on all rows that the stage
before kept. Columns of ``docs`` that clash with an operator's own are set aside meanwhile and come back unchanged.

In every stage null and empty texts are documents without words: no stage before mixing removes them, and mixing repeats them as
their source's other documents. Repeated rows are documents like others, of which the near-duplicate stage keeps one (those without words,
which are alike to nothing, all stay); null keys and ties change nothing but the order; an empty table passes through empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kontor.llm.common import drop_scratch, fresh, n_words, read_table, scratch_table
from kontor.llm.decontaminate import find_benchmark, remove_spans
from kontor.llm.mixing import mix_sources
from kontor.llm.ngram_join import jaccard_components
from kontor.llm.sharding import shuffle_into_shards
from kontor.llm.toxicity import fit_toxicity, score_toxicity

N_SHARDS = 24


def set_aside(docs: DataFrame, own: tuple[str, ...], f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``f(docs)`` with docs' columns of the names in ``own`` renamed meanwhile; returns docs' columns alone."""
    clash = [c for c in docs.columns if c.lower() in own]
    names = dict(zip(clash, fresh(docs, *[f"_{c}_aside" for c in clash]), strict=True))
    out = f(docs.withColumnsRenamed(names))
    return out.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents predicted toxic. Learns from the labels outside the held-out fold."""
    labels = read_table(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    model = fit_toxicity(docs.select("doc_id", "text"), labels)
    return set_aside(docs, ("score", "predicted"), lambda d: score_toxicity(d, model).where("predicted = 0"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by a Jaccard similarity of 0.8 or more of runs of five words."""
    own = ("n_shingles", "component_id", "first_in_component")
    return set_aside(docs, own, lambda d: jaccard_components(d, n=5, percent=80, stable_input=True).where("first_in_component"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of the benchmark out of the texts; documents of which no word is left go."""

    def cut(d: DataFrame) -> DataFrame:
        out = remove_spans(find_benchmark(d, read_table(spark, sf_dir, "benchmark"), window=10))
        hit = F.size("contamination.byte_spans") > 0
        left = F.col("contamination.n_words") > F.col("contamination.n_hit")
        out = out.where(~hit | left)
        return out.withColumn("n_chars", F.when(hit, F.length("text").cast("long")).otherwise(F.col("n_chars"))) if "n_chars" in d.columns else out

    return set_aside(docs, ("contamination",), cut)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that sources come to their targets."""

    def mix(d: DataFrame) -> DataFrame:
        (text_hash, copy) = fresh(d, "_text_hash", "_copy")
        mixed = mix_sources(d.withColumn(text_hash, F.xxhash64("text")), n_words(F.col("text")), key=("doc_id", text_hash), seed=6, stable_input=True)
        return mixed.where("repeats > 0").withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("repeats"))))

    return set_aside(docs, ("size", "source_size", "target", "repeats"), mix)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A uniform shuffle into shards of equal numbers of rows: adds ``shard`` and ``slot``."""
    return shuffle_into_shards(docs, N_SHARDS, seed=1, stable_input=True)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: Most stages are not SQL's: a fitted model, a seeded sample and a random order. tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


SHUFFLES_GO = "spark.sql.shuffleDependency.fileCleanup.enabled"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each but the last is written to the shared scratch folder and read back.

    Meanwhile the shuffle files of a query go as it ends: else they stay until the driver happens to collect garbage, those of the stages before beside those of the one that runs.
    """
    docs, setting = read_table(spark, sf_dir, "documents"), spark.conf.get(SHUFFLES_GO)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        for i, (name, stage) in enumerate(STAGES):
            before, docs = docs, stage(spark, docs, sf_dir)
            if i < len(STAGES) - 1:
                docs = scratch_table(docs, f"pipeline-{name}")
                drop_scratch(before)
    finally:
        spark.conf.set(SHUFFLES_GO, setting)
    return docs
