"""Streams of readings: counts by event time, tables of latest rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger


def _folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the session's shared folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root.rstrip('/')}/cairn-{name}-{uuid.uuid4().hex}"


def read(spark: SparkSession, sf_dir: str, table: str = "events") -> DataFrame:
    """A stored table as a stream of its files, event time as a timestamp, which watermarks need."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/{table}.parquet*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def daily_counts(spark: SparkSession, sf_dir: str, late: str = "40 days") -> DataFrame:
    """day, n, errors: windows of a day; a window's state is dropped once the watermark has passed it."""
    counted = read(spark, sf_dir).withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"))
    counted = counted.agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    out = _folder(spark, "daily")

    def keep(batch: DataFrame, number: int) -> None:
        batch.select(F.to_date("w.start").alias("day"), "n", "errors", F.lit(number).alias("batch")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = counted.writeStream.outputMode("update").option("checkpointLocation", _folder(spark, "state")).foreachBatch(keep)
    stream.trigger(availableNow=True).start().awaitTermination()
    log = spark.read.schema("day date, n long, errors long, batch int").parquet(out)
    return ledger.latest(log, ["day"], "batch").select("day", "n", "errors")


def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, event_type, event_id, value: each batch reduced to its latest rows and appended; reading takes the latest of those.

    A batch that is retried overwrites its own folder, so it counts once.
    """
    out = _folder(spark, "latest")

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch.select("user_id", "event_type", "event_id", "value")
        ledger.latest(rows, ["user_id", "event_type"], "event_id").write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = read(spark, sf_dir).writeStream.option("checkpointLocation", _folder(spark, "state")).foreachBatch(merge)
    stream.trigger(availableNow=True).start().awaitTermination()
    log = spark.read.schema("user_id long, event_type string, event_id long, value double").parquet(out)
    return ledger.latest(log.select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")
