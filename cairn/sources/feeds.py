"""Raw payloads, landed as text, read into rows by schema. Live fetching is left to whoever lands them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import fire_name, local_date

NETWORK = "array<struct<station:string,data:array<struct<element:string,values:array<struct<date:string,value:double>>>>>>"
PERIMETERS = "struct<features:array<struct<properties:struct<name:string,acres:double,gis_acres:double,category:string,out:string,discovered:double,current:double,modified:double>,geometry:struct<type:string,coordinates:string>>>>"


def station_values(payloads: DataFrame) -> DataFrame:
    """Station, element, day, value of JSON ``payloads`` (body); nulls and days that are no dates are left out."""
    opened = payloads.select(F.inline(F.from_json("body", NETWORK)))
    elements = opened.select("station", F.inline("data"))
    values = elements.select("station", "element", F.inline("values"))
    day = F.try_to_date("date", "yyyy-MM-dd")
    return values.select("station", "element", day.alias("day"), "value").filter("value is not null and day is not null")


def sensor_rows(payloads: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Station, kind, day, value: JSON arrays of (station, sensor, date, value); faults go, the last row of a day wins."""
    opened = payloads.select(F.posexplode(F.from_json("body", "array<struct<station:string,sensor:string,date:string,value:double>>")).alias("ord", "r")).select("ord", "r.*")
    kind = F.element_at(F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair)), F.col("sensor"))
    parts = F.split(F.substring_index("date", " ", 1), "-")
    day = F.try_to_date(F.concat_ws("-", parts[0], F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0")), "yyyy-MM-dd")
    rows = opened.select("station", kind.alias("kind"), day.alias("day"), "value", "ord").filter("kind is not null and day is not null and value >= 0")
    return rows.groupBy("station", "kind", "day").agg(F.max_by("value", "ord").alias("value"))


def tab_sites(spark: SparkSession, path: str, agency: str, without: str) -> DataFrame:
    """A tab-separated directory with ``#`` comments; rows of other agencies (the width line) and names that match ``without`` go."""
    rows = spark.read.csv(path, sep="\t", comment="#", header=True)
    return rows.filter((F.col("agency_cd") == agency) & ~F.upper("station_nm").rlike(without))


def placemarks(spark: SparkSession, path: str) -> DataFrame:
    """S12 in part: density and ring (lon lat pairs, closed) of the placemarks of KML files."""
    schema = "description string, styleUrl string, Polygon struct<outerBoundaryIs:struct<LinearRing:struct<coordinates:string>>>"
    rows = spark.read.schema(schema).option("rowTag", "Placemark").xml(path)
    density = F.coalesce(F.nullif(F.regexp_extract("description", r"(?i)density:\s*(\w+)", 1), F.lit("")), F.regexp_extract("styleUrl", r"(\w+)$", 1))
    pairs = F.filter(F.split(F.trim("Polygon.outerBoundaryIs.LinearRing.coordinates"), r"\s+"), lambda p: p != "")
    ring = F.transform(pairs, lambda p: F.struct(F.split(p, ",")[0].cast("double").alias("lon"), F.split(p, ",")[1].cast("double").alias("lat")))
    closed = F.when(F.get(ring, F.lit(0)) == F.get(ring, F.size(ring) - 1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))
    return rows.select(F.lower(density).alias("density"), closed.alias("ring")).filter(F.size("ring") >= 4)


def perimeters(payloads: DataFrame) -> DataFrame:
    """Name, acres, discovered, updated, rings of GeoJSON pages (body); a feature in several pages counts once.

    Fires that are out, of other categories, nameless or no polygon go, and rings of fewer than four points.
    """
    p = F.col("f.properties")
    each = payloads.select(F.explode(F.from_json("body", PERIMETERS)["features"]).alias("f")).distinct()
    kept = each.filter("f.properties.out is null and coalesce(f.properties.category in ('WF', 'CX'), true) and f.geometry.type in ('Polygon', 'MultiPolygon') and trim(f.properties.name) <> ''")
    one, many = "array<array<array<double>>>", "array<array<array<array<double>>>>"
    shape = F.col("f.geometry.coordinates")
    polygons = F.when(F.col("f.geometry.type") == "Polygon", F.array(F.from_json(shape, one))).otherwise(F.from_json(shape, many))
    points = lambda ring: F.transform(ring, lambda q: F.struct(q[0].alias("lon"), q[1].alias("lat")))
    rings = F.transform(F.filter(F.flatten(polygons), lambda r: F.size(r) >= 4), points)
    local = lambda ms: local_date(ms.cast("long"))
    rows = kept.select(
        fire_name(p["name"]).alias("name"), F.round(F.coalesce(p["acres"], p["gis_acres"])).cast("long").alias("acres"), local(p["discovered"]).alias("discovered"),
        local(F.greatest(p["current"], p["modified"])).alias("updated"), rings.alias("rings"),
    )
    return rows.filter(F.size("rings") > 0)


def directory(fresh: DataFrame, snapshot: DataFrame, least: float = 0.9, age_days: int | None = None, most_days: int = 7) -> DataFrame:
    """A snapshot that is fresh enough, else a live directory of at least ``least`` of its size, else the snapshot.

    ``age_days``: the snapshot's age, if known. No data at all is an error.
    """
    held = snapshot.count()
    if held and age_days is not None and age_days <= most_days:
        return snapshot
    live = fresh.count()
    if not held and not live:
        raise ValueError("a directory without any data")
    return fresh if live and live >= least * held else snapshot


def write_documents(rows: DataFrame, key: str, path: str) -> None:
    """One JSON document a key, in folders by key; folders of keys that are no longer there go with the overwrite.

    A file takes its time whatever its size, so keys are dealt out over as many tasks as can run, though their rows be few.
    """
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    rows.repartition(tasks, key).select(F.col(key), F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def append_raw(payloads: DataFrame, path: str) -> None:
    """Landed payloads (source, url, body), appended by source with a digest of the body."""
    payloads.withColumn("sha256", F.sha2("body", 256)).write.mode("append").partitionBy("source").parquet(path)
