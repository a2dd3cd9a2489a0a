"""Spatial joins of places and stations, with bands that keep them equi joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import KM_PER_DEGREE, haversine_km, in_ring, ring_km
from ..functions.rows import dealt


def within(left: DataFrame, right: DataFrame, radius_km: float, on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of (key, lat, lon) rows within a radius: lkey, rkey, km (0.1 km), other columns of ``right``.

    Columns named by ``on`` are those of both sides, and equal in a pair.

    Each right row is copied to its own cell of latitude and longitude and those around it, so the join
    is one on the cell; cells are two radii wide at the equator, and further north a row goes to more of
    them. Longitude rules out most other pairs before the sines.
    """
    band = radius_km / KM_PER_DEGREE
    wide = lambda lat: band / F.greatest(F.cos(F.radians(lat)), F.lit(0.2)) * 1.1
    cell = lambda c, size: F.floor(F.col(c) / size)
    a = left.select(*on, F.col("key").alias("lkey"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), cell("lat", band).alias("row"), cell("lon", 2 * band).alias("col"))
    off = F.ceil(wide(F.abs("lat") + band) / (2 * band))
    b = right.withColumnRenamed("key", "rkey").withColumn("row", F.explode(F.sequence(cell("lat", band) - 1, cell("lat", band) + 1)))
    b = b.withColumn("col", F.explode(F.sequence(cell("lon", 2 * band) - off, cell("lon", 2 * band) + off)))
    near = F.abs(F.col("lon") - F.col("lon1")) <= wide(F.col("lat1"))
    km = F.round(haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat"), F.col("lon")), 1)
    return a.join(b, ["row", "col", *on]).filter(near).withColumn("km", km).filter(F.col("km") <= radius_km).drop("row", "col", "lat1", "lon1")


def met(left: DataFrame, right: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Each position of ``left`` once, keyed by itself, and of each position of ``right`` the k least keys."""
    spots = left.select("lat", "lon").filter("lat is not null and lon is not null").distinct()
    by_key = Window.partitionBy("lat", "lon").orderBy("key")
    least = right.select("key", "lat", "lon").withColumn("n", F.row_number().over(by_key)).filter(F.col("n") <= k).drop("n")
    return spots.withColumn("key", F.struct("lat", "lon")), least


def nearest_k(left: DataFrame, right: DataFrame, radius_km: float, k: int) -> DataFrame:
    """lkey, rkey, km, rank: the k nearest within the radius, ties by rkey.

    Rows of one position have the same neighbours, so positions are searched once and, as ties go by key,
    only the k least keys of one are met; each left row then takes what its position found.
    """
    spots, least = met(left, right, k)
    order = Window.partitionBy("lkey").orderBy("km", "rkey")
    found = within(spots, least, radius_km).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    found = found.groupBy("lkey").agg(F.collect_list(F.struct("rkey", "km", "rank")).alias("found")).select("lkey.*", "found")
    rows = left.select(F.col("key").alias("lkey"), "lat", "lon").join(found, ["lat", "lon"])
    return rows.select("lkey", F.explode("found").alias("f")).select("lkey", "f.rkey", "f.km", "f.rank")


def word_runs(text: Column) -> Column:
    """Every run of whole words of a text, split at single spaces, once."""
    words = F.split(text, " ")
    runs = F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.transform(F.sequence(i, F.size(words)), lambda j: F.array_join(F.slice(words, i, j - i + 1), " ")))
    return F.array_distinct(F.flatten(runs))


def road_links(places: DataFrame, roads: DataFrame, near_km: float = 8, named_km: float = 40, cap: int = 4) -> DataFrame:
    """Roads near a place, or that carry its whole name of two words or more further out; active, then named, then near first.

    Near ones are searched by position, ``cap`` roads of each, as no others can be among a place's; named ones
    by the runs of words in their locations, so that only pairs that share the name are met.
    """
    first, spot = [F.desc("active"), "km", "rkey"], ["lat", "lon"]
    spots = places.select(*spot).filter("lat is not null and lon is not null").distinct().withColumn("key", F.struct(*spot))
    own = Window.partitionBy(*spot).orderBy(F.desc("active"), "key")
    least = roads.select("key", *spot, "active").withColumn("n", F.row_number().over(own)).filter(F.col("n") <= cap).drop("n")
    found = within(spots, least, near_km).withColumn("n", F.row_number().over(Window.partitionBy("lkey").orderBy(*first))).filter(F.col("n") <= cap)
    found = found.groupBy("lkey").agg(F.collect_list(F.struct("rkey", "km", "active")).alias("found")).select("lkey.*", "found")
    near = places.select(F.col("key").alias("lkey"), *spot).join(found, spot).select("lkey", F.explode("found").alias("f")).select("lkey", "f.*", F.lit(False).alias("named"))
    known = places.withColumn("name", F.lower("name")).filter(F.size(F.split("name", " ")) >= 2)
    carried = roads.select("key", *spot, "active", F.explode(word_runs(F.lower("location"))).alias("name")).filter(F.contains("name", F.lit(" ")))
    named = within(known, carried, named_km, ("name",)).select("lkey", "rkey", "km", "active", F.lit(True).alias("named"))
    pairs = near.unionByName(named).groupBy("lkey", "rkey").agg(F.first("km").alias("km"), F.first("active").alias("active"), F.max("named").alias("named"))
    order = Window.partitionBy("lkey").orderBy(F.desc("active"), F.desc("named"), "km", "rkey")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cap).select("lkey", "rkey", "km", "named", "active", "rank")


def zone_of(points: DataFrame, zones: DataFrame) -> DataFrame:
    """key, zone: of the rings that hold a point the one of the least box. Zones: (zone, ring, west, south, east, north)."""
    size = (F.col("east") - F.col("west")) * (F.col("north") - F.col("south"))
    return zones_of(points, zones).groupBy("key").agg(F.min_by("zone", F.struct(size, "zone")).alias("zone"))


def zones_of(points: DataFrame, zones: DataFrame) -> DataFrame:
    """key, zone and box of every ring that holds a point.

    Each zone is copied to the degree cells that its box touches, so the join is one on
    the cell; boxes, then the ray cast, rule out the rest.
    """
    cells = points.select("key", "lat", "lon", F.floor("lat").alias("row"), F.floor("lon").alias("col"))
    boxed = cells.join(_celled(zones, F.lit(0.0), F.lit(0.0)), ["row", "col"])
    boxed = boxed.filter(F.col("lon").between(F.col("west"), F.col("east")) & F.col("lat").between(F.col("south"), F.col("north")))
    return boxed.filter(in_ring(F.col("lon"), F.col("lat"), F.col("ring"))).select("key", "zone", "west", "south", "east", "north")


def _celled(zones: DataFrame, by_lat, by_lon) -> DataFrame:
    """A row of each zone for each degree cell of its box, grown by so many degrees."""
    rows = F.sequence(F.floor(F.col("south") - by_lat), F.floor(F.col("north") + by_lat))
    cols = F.sequence(F.floor(F.col("west") - by_lon), F.floor(F.col("east") + by_lon))
    return zones.withColumn("row", F.explode(rows)).withColumn("col", F.explode(cols))


def nearest_ring(points: DataFrame, zones: DataFrame, radius_km: float) -> DataFrame:
    """key, zone, km: the zone whose edge is nearest within the radius, 0 km inside; ties to the lesser zone.

    Points of one position have the same zone, so positions are searched once, by many tasks though they be few.
    """
    degrees = radius_km / KM_PER_DEGREE
    spots = dealt(points.select("lat", "lon"), "lat", "lon").filter("lat is not null and lon is not null").distinct()
    cells = spots.select("lat", "lon", F.floor("lat").alias("row"), F.floor("lon").alias("col"))
    wide = degrees / F.greatest(F.cos(F.radians(F.greatest(F.abs("north"), F.abs("south")) + degrees)), F.lit(0.2)) * 1.1
    met = cells.join(_celled(zones, F.lit(degrees), wide), ["row", "col"])
    km = F.when(in_ring(F.col("lon"), F.col("lat"), F.col("ring")), F.lit(0.0)).otherwise(ring_km(F.col("lon"), F.col("lat"), F.col("ring")))
    near = met.withColumn("km", km).filter(F.col("km") <= radius_km).withColumn("km", F.round("km", 2))
    found = near.groupBy("lat", "lon").agg(F.min(F.struct("km", "zone")).alias("m"))
    return points.select("key", "lat", "lon").join(found, ["lat", "lon"]).select("key", "m.zone", "m.km")
