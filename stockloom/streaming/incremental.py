"""Structured Streaming twins of the batch operators (D1, D7, D15) and event-time windows, run with Trigger.AvailableNow.

Each writes to the shared folder and returns what was written; the same functions serve a continuous trigger.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import delta
from ..operators.graph import shared_dir
from . import stateful


def _place(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stockloom-stream-{uuid.uuid4().hex}"


def events(spark: SparkSession, sf_dir: str, files_per_batch: int | None = None) -> DataFrame:
    """The event log as a stream of files: events.parquet is one file, or a folder of part files.  Without `files_per_batch` a micro-batch has
    all files that are there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    s = spark.readStream.schema(spark.read.parquet(str(path)).schema)
    s = s.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else s
    # a file source reads folders: a single file is named by the glob of its folder's files
    return s.parquet(str(path)) if folder else s.option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def drained(stream: DataFrame, spark: SparkSession, at: str | None = None) -> DataFrame:
    """Runs a stream to its present end into Parquet and reads that.  A named folder `at` holds checkpoint and rows, so a later call goes on
    where the last one ended."""
    at = at or _place(spark)
    with stateful.keyed_state(spark):
        q = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{at}/check").trigger(availableNow=True).start(f"{at}/out")
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def stream_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The append-only log, read incrementally."""
    return drained(events(spark, sf_dir).select("event_id", "ts", "user_id", "event_type"), spark)


def stream_first_seen(spark: SparkSession, sf_dir: str, within: str = "10 days") -> DataFrame:
    """One row for each key while its state lives; state older than the watermark is dropped."""
    s = events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).select("props", "ts")
    return drained(s.withWatermark("ts", within).dropDuplicatesWithinWatermark(["props"]), spark)


def stream_windows(spark: SparkSession, sf_dir: str, files_per_batch: int | None = None) -> DataFrame:
    """Extension: daily counts by event time.  A micro-batch writes its own partial counts and keeps no state; the counts of a day are the sums of its
    partial ones, whenever late events come."""
    at = _place(spark)
    s = events(spark, sf_dir, files_per_batch).withColumn("day", F.date_trunc("day", F.col("ts").cast("timestamp_ntz")).cast("timestamp_ntz"))

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy("day", "event_type").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    s.select("day", "event_type").writeStream.option("checkpointLocation", f"{at}/check").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema("day timestamp_ntz, event_type string, n long").parquet(f"{at}/out").groupBy("day", "event_type").agg(F.sum("n").alias("n"))


def stream_health(spark: SparkSession, sf_dir: str, files_per_batch: int | None = None, at: str | None = None) -> DataFrame:
    """The health, breaker and alert rows of each source (a user's events are its runs; every fourth is of discovery)."""
    s = events(spark, sf_dir, files_per_batch).select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source_key"),
        F.col("event_id").alias("run_id"),
        F.col("ts").cast("timestamp").alias("at"),
        F.when(F.col("event_id") % 4 == 0, "discover").otherwise("scrape").alias("phase"),
        (F.col("event_type") != "error").alias("ok"),
        F.lit("warning").alias("severity"),
        F.concat(F.lit("run "), F.col("event_id").cast("string")).alias("message"),
    )
    return drained(stateful.source_health(s), spark, at)


def stream_window_of_ids(spark: SparkSession, sf_dir: str, cap: int, trim: int | None = None, touch: bool = False, files_per_batch: int | None = None, at: str | None = None) -> DataFrame:
    """Whether each event's payload is among the last ones of its type, by a bounded window.  Rows and windows are written by batch number: a repeated batch
    reads the same windows and overwrites its own."""
    at, schema = at or _place(spark), f"{stateful.SEEN}, window array<string>"
    s = events(spark, sf_dir, files_per_batch).select(F.col("event_type").alias("origin"), F.col("event_id").alias("order"), F.col("props").alias("id"))

    def write(batch: DataFrame, number: int) -> None:
        held = spark.read.schema(schema).parquet(f"{at}/out/batch={number - 1}").where("window is not null") if number else None
        stateful.bounded_window(batch, held, cap, trim, touch).write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    s.writeStream.option("checkpointLocation", f"{at}/check").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{at}/out").where("window is null").select("origin", "order", "id", "seen", "held")


def stream_reconcile(spark: SparkSession, old: DataFrame, new: DataFrame, key: Sequence[str], order: str, at: str | None = None) -> DataFrame:
    """D1 as a stream: every micro-batch is a snapshot, reconciled with the state that the batch before it left.  `new` is appended to the
    stream's input folder.  A named folder `at` holds input, checkpoint, state and events, so a later call (or a restart) goes on where the last one
    ended; without a name each call is a stream of its own.  Events and states are written by batch number: a repeated batch reads the
    same state and overwrites its own."""
    at, columns = at or _place(spark), old.columns
    new.write.mode("append").parquet(f"{at}/in")

    def state(number: int) -> DataFrame:
        return spark.read.schema(old.schema).parquet(f"{at}/state/batch={number}") if number >= 0 else old

    def reconcile(batch: DataFrame, number: int) -> None:
        before = state(number - 1)
        delta.reconcile(before, batch, key, order).write.mode("overwrite").parquet(f"{at}/out/batch={number}")
        delta.apply_snapshot(before, batch, key, order).select(*columns).write.mode("overwrite").parquet(f"{at}/state/batch={number}")

    s = spark.readStream.schema(new.schema).parquet(f"{at}/in")
    s.writeStream.option("checkpointLocation", f"{at}/check").trigger(availableNow=True).foreachBatch(reconcile).start().awaitTermination()
    return spark.read.parquet(f"{at}/out")
