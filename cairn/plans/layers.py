"""Queries of layers with optional inputs, and of sinks that are written again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import feeds, roads
from ..sources import layers as L
from ..streaming.ingest import _folder
from . import conditions as P
from .inputs import DATES, Tables
from .registry import query

_PLUMES = "n_nationkey % 9 > 0 AND n_nationkey % 2 = 1"


def _landed(t: Tables) -> str:
    """Two days' smoke files: the day before has a placemark for each odd nation, today's none yet."""
    folder = _folder(t.spark, "smoke")
    key = F.col("n_nationkey")
    mark = F.concat(
        F.when(key % 9 == 0, "<!DOCTYPE x>").otherwise(""), F.lit("<Placemark><description>Density: "), F.when(key % 4 == 1, "Heavy").otherwise("Light"),
        F.lit(" Start Time: 2024021 0130 UTC End Time: 2024021 2200 UTC</description><coordinates>"), F.format_string("%d,1,0 %d,2,0 %d,3,0", key, key, key + 1), F.lit("</coordinates></Placemark>"),
    )
    t.nation.filter(key % 2 == 1).select(mark.alias("value")).repartition(2).write.text(f"{folder}/raw")
    whole = t.spark.read.text(f"{folder}/raw").agg(F.array_join(F.array_sort(F.collect_list("value")), "\n").alias("value"))
    for day, body in (("20240121", whole), ("20240122", whole.select(F.lit("<kml></kml>").alias("value")))):
        body.coalesce(1).write.text(f"{folder}/feed/smoke{day}.kml")
    return f"{folder}/feed"


def _smoke(t: Tables, today: str) -> DataFrame:
    files = L.dated_files(t.spark, _landed(t))
    marks = files.select("day", F.explode(F.regexp_extract_all("body", F.lit("(?s)(?:<!DOCTYPE x>)?<Placemark>.*?</Placemark>"), F.lit(0))).alias("body"))
    shapes = roads.plumes(marks.withColumn("id", F.xxhash64("day", "body")))
    dated = shapes.join(marks.select(F.xxhash64("day", "body").alias("id"), "day"), "id")
    return L.latest_analysis(dated, today)


@query(
    f"SELECT CASE WHEN n_nationkey % 4 = 1 THEN 'heavy' ELSE 'light' END AS density, DATE '2024-01-21' AS day, count(*) AS n FROM nation WHERE {_PLUMES} GROUP BY ALL"
)
def smoke_fallback(t: Tables) -> DataFrame:
    """today's file holds no polygons, so the day before's analysis counts."""
    return _smoke(t, "2024-01-22").groupBy("density", "day").agg(F.count("*").alias("n"))


_NEAREST = "SELECT key AS slug, 'Fire ' || key % 7 AS fire, key % 40 / 2e0 AS miles FROM $places p WHERE key % 3 = 0"
_OVER = "SELECT key AS slug, CASE WHEN key % 4 = 0 THEN 'heavy' ELSE 'light' END AS smoke FROM $places p WHERE key % 2 = 0"


@query(
    f"""SELECT r.label, p.key AS slug, CASE WHEN fires THEN n.fire END AS fire, CASE WHEN fires THEN n.miles END AS miles, CASE WHEN smoke_ok THEN o.smoke END AS smoke, fires AS fires_available, smoke_ok AS smoke_available, CASE WHEN smoke_ok THEN DATE '2024-01-21' END AS smoke_date, issued AS issued_for
FROM $places p CROSS JOIN (VALUES ('both', DATE '2024-01-22', true, true), ('no fires', DATE '2024-01-21', false, true), ('old smoke', DATE '2024-01-23', true, false)) r(label, issued, fires, smoke_ok)
LEFT JOIN ({_NEAREST}) n ON n.slug = p.key LEFT JOIN ({_OVER}) o ON o.slug = p.key"""
)
def fire_layers(t: Tables) -> DataFrame:
    """The layer on three days: both sources read, fires failed, smoke too old. Attempts are rows of orders."""
    places, key = t.places, F.col("key")
    nearest = places.filter(key % 3 == 0).select(key.alias("slug"), F.concat(F.lit("Fire "), (key % 7).cast("string")).alias("fire"), (key % 40 / F.lit(2.0)).alias("miles"))
    over = places.filter(key % 2 == 0).select(key.alias("slug"), F.when(key % 4 == 0, "heavy").otherwise("light").alias("smoke"))
    attempts = t.orders.select(F.lit("fires").alias("source"), F.date_add(F.lit("2024-01-21").cast("date"), (F.col("o_orderkey") % 3).cast("int")).alias("day"), (F.col("o_orderkey") % 3 > 0).alias("ok"))
    shapes = t.nation.filter("n_nationkey % 2 = 1").select(F.lit("2024-01-21").cast("date").alias("day"), "n_nationkey")
    layers = []
    for label, today in (("both", "2024-01-22"), ("no fires", "2024-01-21"), ("old smoke", "2024-01-23")):
        state = L.availability(attempts, L.latest_analysis(shapes, today), today)
        layers.append(L.fire_layer(places, nearest, over, state).select(F.lit(label).alias("label"), "*"))
    return reduce(DataFrame.unionByName, layers)


_RERUN = DATES[1]


@query(
    f"""SELECT slug, eval_date, CASE WHEN eval_date = DATE '{_RERUN}' THEN 'rerun' ELSE status END AS status, CASE WHEN eval_date = DATE '{_RERUN}' THEN 2 ELSE 1 END AS run FROM ({P._SHOWN}) f
WHERE eval_date <> DATE '{_RERUN}' OR slug % 2 = 0"""
)
def status_sink(t: Tables) -> DataFrame:
    """Verdicts written by date, then one date again for half of the places: that date holds the rerun alone, others what they held."""
    path = _folder(t.spark, "statuses")
    L.put_statuses(P.verdicts(t).drop("worst"), path, 1)
    again = L.statuses(t.spark, path).filter((F.col("eval_date") == F.lit(_RERUN)) & (F.col("slug") % 2 == 0))
    L.put_statuses(again.select("slug", "eval_date", F.lit("rerun").alias("status")), path, 2)
    status = F.get_json_object("result", "$.status")
    return L.statuses(t.spark, path).select("slug", "eval_date", status.alias("status"), "run")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS slug FROM supplier WHERE s_suppkey % 3 = 0")
def stale_documents(t: Tables) -> DataFrame:
    """Documents of stations that left, by an anti join of the listing and of what was written."""
    path = _folder(t.spark, "documents")
    station = t.supplier.select(F.col("s_suppkey").alias("slug"), "s_name")
    feeds.write_documents(station, "slug", path)
    return L.stale(t.spark, path, "slug", station.filter("slug % 3 > 0")).select("slug").distinct()
