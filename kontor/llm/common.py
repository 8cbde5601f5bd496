"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The alphabets that the operators fold.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
SPACE_WORD = "[^\\x20\\x09-\\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for tables that cut lineage: ``spark.checkpoint.dir``; where it is unset, a local one for a local master, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="kontor-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later plans start from files that survive lost executors."""
    path = f"{scratch_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    WRITTEN[id(out)] = path
    weakref.finalize(out, WRITTEN.pop, id(out), None)
    return out


def bucketed_table(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """``df`` written to the shared folder in buckets of ``key``: joins on it move the other side alone."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    path = f"{scratch_root(spark)}/{table}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).format("parquet").option("compression", "zstd").option("path", path).saveAsTable(table)
    out = spark.table(table)
    WRITTEN[id(out)], TABLES[id(out)] = path, table
    weakref.finalize(out, WRITTEN.pop, id(out), None)
    weakref.finalize(out, TABLES.pop, id(out), None)
    return out


def forget_name(table: DataFrame) -> DataFrame:
    """``table``, in buckets, without its name in the catalogue: its files stay, and plans made from it read them."""
    table.sparkSession.sql(f"DROP TABLE IF EXISTS {TABLES.pop(id(table))}")
    return table


#: Where the tables that are still in use were written, and the catalogue's names of those in buckets.
TABLES: dict[int, str] = {}
WRITTEN: dict[int, str] = {}


def drop_scratch(*tables: DataFrame) -> None:
    """Deletes scratch tables that no later plan reads."""
    for t in tables:
        path, table = WRITTEN.pop(id(t), None), TABLES.pop(id(t), None)
        if table is not None:
            t.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
        if path is not None:
            where = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of a query go as it ends: else they stay until the driver happens to collect garbage, all stages' together. The session's own setting comes back afterwards."""
    name = "spark.sql.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, setting)


def fold_ascii(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def n_words(c: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+`` (null: 0)."""
    return F.coalesce(F.regexp_count(c, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names for working columns that clash with none of ``df``, whatever extra columns it has."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out
