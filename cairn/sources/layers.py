"""Layers of optional inputs: what could be read is told apart from what is empty; sinks that a rerun leaves whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def dated_files(spark: SparkSession, folder: str) -> DataFrame:
    """Day, body of the files in a folder whose names, or whose own folder's, end in a day (``...20240105.kml``), each file whole. Others are left out."""
    read = spark.read.text(folder, wholetext=True, recursiveFileLookup=True)
    digits = F.regexp_extract(F.col("_metadata.file_path"), r"([0-9]{8})[^/0-9]*\.[A-Za-z]+(?:/|$)", 1)
    return read.select(F.try_to_date(F.nullif(digits, F.lit("")), "yyyyMMdd").alias("day"), F.col("value").alias("body")).filter("day is not null")


def latest_analysis(shapes: DataFrame, today: str) -> DataFrame:
    """The shapes (day, ...) of today, or of the day before if today has none; none of either leaves no rows."""
    recent = shapes.filter(F.datediff(F.lit(today).cast("date"), "day").between(0, 1))
    newest = recent.agg(F.max("day").alias("newest"))  # one row
    return recent.join(F.broadcast(newest), F.col("day") == F.col("newest")).drop("newest")


def availability(attempts: DataFrame, smoke: DataFrame, today: str) -> DataFrame:
    """One row (issued_for, fires_available, smoke_available, smoke_date).

    ``attempts``: source, day, ok, what was tried; fires are there if today's attempt went well, however many there are. Smoke is
    there if ``latest_analysis`` has shapes. Neither is an error, raised when the row is read.
    """
    day = F.lit(today).cast("date")
    fires = attempts.filter((F.col("source") == "fires") & (F.col("day") == day)).agg(F.coalesce(F.max("ok"), F.lit(False)).alias("fires_available"))
    clouds = smoke.agg(F.max("day").alias("smoke_date"))
    both = fires.crossJoin(clouds)  # a row each
    there = F.col("fires_available") | F.col("smoke_date").isNotNull()
    checked = F.when(there, day).otherwise(F.raise_error(F.lit("neither fire perimeters nor smoke could be read")).cast("date"))
    return both.select(checked.alias("issued_for"), "fires_available", F.col("smoke_date").isNotNull().alias("smoke_available"), "smoke_date")


def fire_layer(places: DataFrame, nearest: DataFrame, over: DataFrame, state: DataFrame) -> DataFrame:
    """Slug, fire, miles, smoke, and the flags of ``availability``, for each place.

    ``nearest``: slug, fire, miles; ``over``: slug, smoke. What comes from a source that is not available is null with its flag
    false, which is not the same as nothing near.
    """
    told = places.select(F.col("key").alias("slug")).join(nearest, "slug", "left").join(over, "slug", "left").join(F.broadcast(state))
    fires, smoke = F.col("fires_available"), F.col("smoke_available")
    return told.select(
        "slug", F.when(fires, F.col("fire")).alias("fire"), F.when(fires, F.col("miles")).alias("miles"), F.when(smoke, F.col("smoke")).alias("smoke"),
        "fires_available", "smoke_available", "smoke_date", "issued_for",
    )


def put_statuses(verdicts: DataFrame, path: str, run: int) -> None:
    """Verdicts (slug, eval_date, ...) as JSON with their status, a partition a date; a rerun replaces the dates that it holds and no others."""
    body = F.to_json(F.struct(*(c for c in verdicts.columns if c not in ("slug", "eval_date"))))
    rows = verdicts.select("slug", body.alias("result"), F.lit(run).alias("run"), "eval_date")
    rows.repartition("eval_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("eval_date").parquet(path)


def statuses(spark: SparkSession, path: str) -> DataFrame:
    """slug, eval_date, result, run of a table that ``put_statuses`` wrote; a filter on eval_date reads its partitions only."""
    return spark.read.schema("slug long, result string, run int, eval_date date").parquet(path)


def stale(spark: SparkSession, path: str, key: str, written: DataFrame) -> DataFrame:
    """Keys (as text) and files of documents in folders ``key=...`` that are not among those written (a column of that name).

    The listing is read as a table of paths, contents unread, so it is as distributed as the files are.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    found = listed.select(F.regexp_extract("path", rf"/{key}=([^/]*)/", 1).alias(key), "path").filter(F.col(key) != "")
    return found.join(written.select(F.col(key).cast("string").alias(key)).distinct(), key, "left_anti")
