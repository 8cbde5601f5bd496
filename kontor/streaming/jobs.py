"""Streaming forms: ingest of export files as they arrive, spend by calendar windows, and vendor anomalies in event order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from kontor.operators import jobs
from kontor.scratch import scratch_path
from kontor.sources import files

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


class keyed_state:  # noqa: N801
    """Streams started within keep their state in RocksDB, which holds more than memory does and looks up single keys; the session's own setting comes back afterwards."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.before = spark, spark.conf.get(STATE_STORE, None)

    def __enter__(self) -> None:
        self.spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def __exit__(self, *_: object) -> None:
        if self.before is None:
            self.spark.conf.unset(STATE_STORE)
        else:
            self.spark.conf.set(STATE_STORE, self.before)


def continuous_ingest(source: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Appends rows of a stream (with ``dedup_hash``) that ``store`` has not, once each; what is there is processed and the query ends.

    Each batch has a folder of its own, named by the checkpoint and the batch's number: one that is run again after a failure overwrites
    its own folder and nothing else, and a query with a new checkpoint adds to what others have stored. The folders are partitioned by
    the first two digits of the hash, so that a batch reads only those parts of the store that its rows can be in. Where one stream is all that writes, :func:`ingest_exports` does without reading the store.
    """
    spark = source.sparkSession
    writer = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    root = spark._jvm.org.apache.hadoop.fs.Path(store)
    root.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(root)

    def append(batch: DataFrame, number: int) -> None:
        part = F.substring(F.sha2(F.col("dedup_hash").cast("string"), 256), 1, 2)
        new = batch.dropDuplicates(["dedup_hash"]).withColumn("part", part)
        me = f"{writer}-{number:08d}"
        schema = T.StructType([*new.drop("part").schema.fields, T.StructField("batch", T.StringType()), T.StructField("part", T.StringType())])
        old = batch.sparkSession.read.schema(schema).parquet(store).where(F.col("batch") != me).select("dedup_hash", "part")
        new = new.join(old, ["dedup_hash", "part"], "left_anti").select(*batch.columns, "part", F.lit(me).alias("batch"))
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "part").parquet(store)

    return source.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@dataclass
class Landing:
    """Where a stream of exports lands: parsed rows, rejects, the store of derived rows, and the checkpoints."""

    root: str

    def __getattr__(self, name: str) -> str:
        if name in ("parsed", "rejects", "store", "parse_checkpoint", "store_checkpoint"):
            return f"{self.root}/{name}"
        raise AttributeError(name)


def ingest_exports(spark: SparkSession, path: str, landing: Landing, own: DataFrame, *, files_per_trigger: int = 1000) -> None:
    """Bank exports that have arrived under ``path`` since the last call, into ``landing``: each content once, whichever file and call it comes with.

    Two streams. The first reads new files, a bounded number a trigger, and parses them; a trigger that runs again after a failure writes its own folder anew. The second reads
    parsed rows and keeps the hashes that it has seen as keyed state, so that a trigger looks up its own hashes and never reads the store; what is new gets its derived columns and is appended.
    """
    arrived = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(path)
    for folder in (landing.parsed, landing.rejects):
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)

    def parse(batch: DataFrame, number: int) -> None:
        texts = batch.where("length > 0").select(F.col("path").alias("file"), files.decode(F.col("content")).alias("content"))
        good, bad = files.bank_rows(texts)
        jobs.with_dedup_hash(good).write.mode("overwrite").parquet(f"{landing.parsed}/batch={number}")
        bad.write.mode("overwrite").parquet(f"{landing.rejects}/batch={number}")

    arrived.writeStream.foreachBatch(parse).option("checkpointLocation", landing.parse_checkpoint).trigger(availableNow=True).start().awaitTermination()
    empty = files.bank_rows(spark.createDataFrame([], "file string, content string"))[0]
    rows = spark.readStream.schema(jobs.with_dedup_hash(empty).schema).parquet(landing.parsed)
    with keyed_state(spark):
        new = jobs.derive(rows.dropDuplicates(["dedup_hash"]), own)
        new.writeStream.format("parquet").option("path", landing.store).option("checkpointLocation", landing.store_checkpoint).trigger(availableNow=True).start().awaitTermination()


class MonthSpend(StatefulProcessor):
    """Sum and number of a month's rows, given when the watermark has passed its end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("spend", "cents long, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        cents, n = self.state.get() if self.state.exists() else (0, 0)
        for part in rows:
            cents, n = cents + int(part["cents"].sum()), n + len(part)
        self.state.update((cents, n))
        self.handle.registerTimer(int((pd.Timestamp(key[0]) + pd.offsets.MonthBegin(1)).timestamp() * 1000) - 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        cents, n = self.state.get()
        self.state.clear()
        yield pd.DataFrame({"start": [pd.Timestamp(key[0])], "event_type": [key[1]], "cents": [cents], "n": [n]})

    def close(self) -> None:
        pass


def running_spend(events: DataFrame, unit: str = "day", late: str = "2 days") -> DataFrame:
    """(start, event_type, cents, n) of every calendar ``day``, ``week`` (from Monday) or ``month`` and type, once, when no row of it is awaited any longer; rows later than ``late`` are left out.

    Days and weeks are Spark's windows; months, which are not of one length, are keyed state with a timer at their end (UTC).
    """
    rows = events.withWatermark("ts", late).withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    if unit == "month":
        keyed = rows.select(F.date_format(F.date_trunc("month", "ts"), "yyyy-MM-dd").alias("month"), "event_type", "ts", "cents")
        return keyed.groupBy("month", "event_type").transformWithStateInPandas(MonthSpend(), "start timestamp, event_type string, cents long, n long", "Append", "EventTime")
    window = {"day": F.window("ts", "1 day"), "week": F.window("ts", "7 days", startTime="4 days")}[unit]
    out = rows.groupBy(window.alias("w"), "event_type").agg(F.sum("cents").alias("cents"), F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), "event_type", "cents", "n")


class VendorAnomalies(StatefulProcessor):
    """Holds a vendor's rows until the watermark has passed them, then judges them in order of time: rows whose value is ``z`` deviations above what came before.

    State: number, sum and sum of squares of the judged rows, and the rows that wait, of which there are as many as come within the watermark's delay. A timer stands at the first of them.
    """

    def __init__(self, z: float = 3.0, least: int = 5) -> None:
        self.z, self.least = z, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stats = handle.getValueState("stats", "n long, s double, q double")
        self.waiting = handle.getListState("waiting", "ms long, event_id long, value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        first = None
        for part in rows:
            if len(part):
                part = part.sort_values(["ms", "event_id"])
                self.waiting.appendList([(int(a), int(b), float(c)) for a, b, c in zip(part["ms"], part["event_id"], part["value"], strict=True)])
                first = int(part["ms"].iloc[0]) if first is None else min(first, int(part["ms"].iloc[0]))
        if first is not None:
            self.handle.registerTimer(first)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        held = pd.DataFrame(list(self.waiting.get()) if self.waiting.exists() else [], columns=["ms", "event_id", "value"]).sort_values(["ms", "event_id"])
        ready, later = held[held["ms"] < now], held[held["ms"] >= now]
        if len(ready):
            n, s, q = self.stats.get() if self.stats.exists() else (0, 0.0, 0.0)
            x = ready["value"].to_numpy(float)
            k, before, square = n + np.arange(len(x)), s + np.cumsum(x) - x, q + np.cumsum(x * x) - x * x
            mean = before / np.maximum(k, 1)
            spread = square / np.maximum(k, 1) - mean * mean
            score = np.where((k >= self.least) & (spread > 0), (x - mean) / np.sqrt(np.where(spread > 0, spread, 1.0)), -np.inf)
            hit = score > self.z
            self.stats.update((n + len(x), s + float(x.sum()), q + float((x * x).sum())))
            if len(later):
                self.waiting.put([(int(a), int(b), float(c)) for a, b, c in zip(later["ms"], later["event_id"], later["value"], strict=True)])
                self.handle.registerTimer(int(later["ms"].iloc[0]))
            else:
                self.waiting.clear()
            yield pd.DataFrame({"event_id": ready["event_id"].to_numpy()[hit], "user_id": np.full(hit.sum(), int(key[0])), "value": x[hit], "zscore": score[hit]})

    def close(self) -> None:
        pass


def vendor_anomalies(events: DataFrame, z: float = 3.0, least: int = 5, late: str = "2 days") -> DataFrame:
    """(event_id, user_id, value, zscore), in whatever order and triggers the rows arrive; rows later than ``late`` are left out, and rows that the watermark has not passed are still to come."""
    rows = events.withWatermark("ts", late).select("user_id", "event_id", "value", "ts", F.unix_millis("ts").alias("ms"))
    return rows.groupBy("user_id").transformWithStateInPandas(VendorAnomalies(z, least), "event_id long, user_id long, value double, zscore double", "Append", "EventTime")


def finish(stream: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """Runs a bounded stream to its end and reads what it wrote."""
    out, checkpoint = scratch_path(spark, name), scratch_path(spark, f"{name}-checkpoint")
    with keyed_state(spark):
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
