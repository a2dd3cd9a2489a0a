"""Queries of fire perimeters, samples inside zones, modelled cover."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import shapes
from ..sources import feeds
from .conditions import _linked
from .evidence import _SENSOR_LINKS
from .inputs import Tables
from .places import _ZONES, _zones
from .registry import query


def _pages(t: Tables) -> DataFrame:
    """GeoJSON pages of nations as fires, which overlap by a feature."""
    key = F.col("n_nationkey")
    corner = lambda x, y: F.array((key % 10 - 120 + x).cast("double"), (key % 7 + 40 + y).cast("double"))
    ring = F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1), corner(0, 0))
    short = F.array(corner(0, 0), corner(1, 0), corner(0, 0))
    shape = F.when(key % 2 == 0, F.to_json(F.array(ring, short))).otherwise(F.to_json(F.array(F.array(ring), F.array(short))))
    ms = lambda days: (F.lit(1704103200000) + days.cast("long") * 86400000).cast("double")
    props = F.struct(
        F.concat(F.lit("RIDGE "), F.char(65 + key)).alias("name"), F.when(key % 3 > 0, key * 10.4).alias("acres"), (key * 7.0).alias("gis_acres"), F.when(key % 4 == 0, "WF").when(key % 4 == 1, "CX").when(key % 4 == 2, "RX").alias("category"),
        F.when(key % 6 == 0, "1").alias("out"), ms(key).alias("discovered"), ms(key + 1).alias("current"), F.when(key % 2 == 0, ms(key + 3)).alias("modified"),
    )
    feature = F.struct(props.alias("properties"), F.struct(F.when(key % 2 == 0, "Polygon").otherwise("MultiPolygon").alias("type"), shape.alias("coordinates")).alias("geometry"))
    paged = t.nation.select(F.explode(F.array(F.floor(key / 8), F.floor((key + 1) / 8))).alias("page"), feature.alias("f")).distinct()
    return paged.groupBy("page").agg(F.to_json(F.struct(F.collect_list("f").alias("features"))).alias("body"))


@query(
    """SELECT 'Ridge ' || chr(65 + n_nationkey) || ' Fire' AS name, CAST(round(CASE WHEN n_nationkey % 3 > 0 THEN n_nationkey * 10.4e0 ELSE n_nationkey * 7e0 END) AS BIGINT) AS acres, DATE '2024-01-01' + n_nationkey AS discovered,
  DATE '2024-01-01' + n_nationkey + CASE WHEN n_nationkey % 2 = 0 THEN 3 ELSE 1 END AS updated, 1 AS rings, 5 AS points FROM nation WHERE n_nationkey % 4 <> 2 AND n_nationkey % 6 > 0"""
)
def fire_perimeters(t: Tables) -> DataFrame:
    """Perimeters of several pages, each fire once."""
    out = feeds.perimeters(_pages(t))
    return out.select("name", "acres", "discovered", "updated", F.size("rings").alias("rings"), F.size(F.get("rings", F.lit(0))).alias("points"))


@query()
def thinned_rings(t: Tables) -> DataFrame:
    """wavy rings thinned to 60 m. No SQL: what is kept depends on what was kept before."""
    turn = lambda i: 2 * 3.141592653589793 * i / 90
    wave = F.sequence(F.lit(0), F.lit(90))
    half = 0.02 + (F.col("n_nationkey") % 5) / 200.0
    ring = F.transform(wave, lambda i: F.struct((-120 + F.cos(turn(i)) * half * (1 + F.sin(turn(i) * 9) / 20)).alias("lon"), (40 + F.sin(turn(i)) * half).alias("lat")))
    return shapes.thinned(t.nation.select("n_nationkey", ring.alias("ring")))


@query(
    f"""SELECT zone, round(snow / nullif(clear, 0), 3) AS cover, round(cloudy / n, 3) AS cloud, n FROM (SELECT zone, count(*) AS n, count(*) FILTER (WHERE key % 4 = 0) AS cloudy, count(*) FILTER (WHERE key % 4 > 0) AS clear, count(*) FILTER (WHERE key % 4 > 0 AND (key % 10) / 10e0 >= 0.4) AS snow
FROM $places p JOIN {_ZONES} z ON lon >= west AND lon < east AND lat >= south AND lat < north GROUP BY zone) x WHERE cloudy / n <= 0.4"""
)
def sampled_cover(t: Tables) -> DataFrame:
    """The share of snow among the clear samples inside each zone."""
    samples = t.places.select("key", "lat", "lon", ((F.col("key") % 10) / F.lit(10.0)).alias("index"), (F.col("key") % 4 == 0).alias("cloudy"))
    return shapes.sampled_cover(samples, _zones(t))


@query(
    f"""WITH n AS (SELECT slug, arg_min(station, (km, station)) AS station, arg_min(gap_ft, (km, station)) AS gap_ft FROM (SELECT lkey AS slug, rkey AS station, km, gap_ft FROM ({_SENSOR_LINKS}) l WHERE rkey IN (SELECT station FROM $snowpack q)) x GROUP BY slug),
s AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY day) AS turn FROM $snowpack r)
SELECT slug, day, round(least(1e0, (value + CASE WHEN value > 0.5 THEN bonus WHEN value > 0 THEN bonus * value / 5e-1 ELSE 0e0 END) / 2e1), 3) AS cover, station FROM (SELECT *, greatest(gap_ft / 1e3, 0e0) * 4 AS bonus FROM s JOIN n USING (station)) y
WHERE (turn - 1) % 3 = 0 AND value <= 14 AND NOT (gap_ft > 300 AND value < 0.5) AND NOT ('0x' || substr(sha256(slug || ':' || day), 1, 2))::INTEGER % 10 < 3"""
)
def modelled_cover(t: Tables) -> DataFrame:
    """Cover of a place modelled from its nearest station, every third reading."""
    return shapes.modelled_scenes(t.snowpack, _linked(t).select("slug", "station", "km", "gap_ft"), t.snowpack.filter("value > 14").select("station", "day"))
