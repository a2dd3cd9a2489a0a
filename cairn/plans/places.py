"""Queries of positions: radius and name joins, zones, edges, compass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import links, rollup
from .inputs import Tables
from .registry import query

_KM = "round(2 * 6371 * asin(sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))), 1)"


@query(
    f"""SELECT lkey, rkey, km, gain_ft FROM (SELECT p.key AS lkey, s.key AS rkey, {_KM.format(a="p", b="s")} AS km, p.elevation_ft - s.elevation_ft AS gain_ft,
  row_number() OVER (PARTITION BY p.key ORDER BY km, s.key) AS r FROM $places p, $stations s WHERE km <= 32) x WHERE r <= 4"""
)
def radius_access(t: Tables) -> DataFrame:
    """The four nearest within 32 km, and the climb from there."""
    near = links.nearest_k(t.places, t.stations, 32, 4)
    here = t.places.select(F.col("key").alias("lkey"), F.col("elevation_ft").alias("here"))
    there = t.stations.select(F.col("key").alias("rkey"), F.col("elevation_ft").alias("there"))
    return near.join(here, "lkey").join(there, "rkey").select("lkey", "rkey", "km", (F.col("here") - F.col("there")).alias("gain_ft"))


@query(
    f"""SELECT lkey, rkey, km, named, active, rank FROM (SELECT p.key AS lkey, s.key AS rkey, {_KM.format(a="p", b="s")} AS km, contains(' ' || lower(location) || ' ', ' ' || lower(p.name) || ' ') AS named, active,
  row_number() OVER (PARTITION BY p.key ORDER BY active DESC, named DESC, km, s.key) AS rank FROM $named_places p, $roads s WHERE km <= 8 OR (named AND km <= 40)) x WHERE rank <= 4"""
)
def road_link_theta(t: Tables) -> DataFrame:
    """Roads that are near, or named and not far."""
    return links.road_links(t.named_places, t.roads)


@query("SELECT key FROM $places p WHERE EXISTS (SELECT 1 FROM $stations s WHERE " + _KM.format(a="p", b="s") + " <= 12)")
def near_a_place(t: Tables) -> DataFrame:
    """Places with a station within 12 km."""
    return links.within(t.places, t.stations, 12).select(F.col("lkey").alias("key")).distinct()


@query("SELECT key FROM $places p WHERE NOT EXISTS (SELECT 1 FROM $stations s WHERE " + _KM.format(a="p", b="s") + " <= 12)")
def far_from_stations(t: Tables) -> DataFrame:
    """The others."""
    near = links.within(t.places, t.stations, 12).select(F.col("lkey").alias("key"))
    return t.places.select("key").join(near, "key", "left_anti")


def _zones(t: Tables) -> DataFrame:
    """A square round each nation's position."""
    lat, lon = 32 + (F.col("n_nationkey") * 637) % 1700 / F.lit(1e2), -124 + (F.col("n_nationkey") * 353) % 1000 / F.lit(1e2)
    half = 1 + F.col("n_nationkey") % 4 / F.lit(4.0)
    boxed = t.nation.select(F.col("n_nationkey").alias("zone"), (lon - half).alias("west"), (lat - half).alias("south"), (lon + half).alias("east"), (lat + half).alias("north"))
    corners = [("west", "south"), ("east", "south"), ("east", "north"), ("west", "north"), ("west", "south")]
    ring = F.array(*(F.struct(F.col(x).alias("lon"), F.col(y).alias("lat")) for x, y in corners))
    return boxed.withColumn("ring", ring)


_ZONES = """(SELECT zone, lon - half AS west, lat - half AS south, lon + half AS east, lat + half AS north FROM (SELECT n_nationkey AS zone, 32 + (n_nationkey * 637) % 1700 / 1e2 AS lat,
  -124 + (n_nationkey * 353) % 1000 / 1e2 AS lon, 1 + n_nationkey % 4 / 4e0 AS half FROM nation) z)"""


@query(f"SELECT key, arg_min(zone, ((east - west) * (north - south), zone)) AS zone FROM $places p JOIN {_ZONES} z ON lon >= west AND lon < east AND lat >= south AND lat < north GROUP BY key")
def point_in_zone(t: Tables) -> DataFrame:
    """The least zone that holds a place."""
    return links.zone_of(t.places, _zones(t))


@query(f"SELECT zone, round((east - west) * 111.320 * cos(radians(south)) * (north - south) * 110.574, 3) AS km2 FROM {_ZONES} z")
def zone_area(t: Tables) -> DataFrame:
    """Shoelace area."""
    return _zones(t).select("zone", F.round(geo.ring_area_km2(F.col("ring")), 3).alias("km2"))


@query(f"SELECT zone, west, south, east, north FROM {_ZONES} z")
def zone_bounds(t: Tables) -> DataFrame:
    """The box of a ring."""
    return _zones(t).select("zone", geo.ring_bounds(F.col("ring")).alias("b")).select("zone", "b.*")


@query(
    f"""WITH d AS (SELECT key, zone, sqrt(pow(greatest(west - lon, 0, lon - east) * 111.320 * cos(radians(lat)), 2) + pow(greatest(south - lat, 0, lat - north) * 110.574, 2)) AS km FROM $places p, {_ZONES} z)
SELECT key, zone, round(km, 2) AS km FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY round(km, 2), zone) AS r FROM d WHERE km <= 50) x WHERE r = 1"""
)
def nearest_zone(t: Tables) -> DataFrame:
    """The nearest edge within 50 km, 0 inside."""
    return links.nearest_ring(t.places, _zones(t), 50)


@query("SELECT key, ['north','northeast','east','southeast','south','southwest','west','northwest'][CAST(round_even(((key * 37) % 720 + 0.0) % 360 / 45, 0) AS INTEGER) % 8 + 1] AS facing FROM $places p")
def compass_words(t: Tables) -> DataFrame:
    """F05."""
    return t.places.select("key", geo.compass((F.col("key") * 37) % 720 + F.lit(0.0)).alias("facing"))


@query(
    """WITH f AS (SELECT o_custkey % 50 AS slug, o_orderdate AS s, o_orderdate + INTERVAL 1 HOUR * (6 + o_orderkey % 60) AS e, o_totalprice AS v FROM orders),
d AS (SELECT slug, s, e, v, CAST(unnest(generate_series(date_trunc('day', s), e, INTERVAL 1 DAY)) AS TIMESTAMP) AS day FROM f),
x AS (SELECT slug, CAST(day AS DATE) AS day, v, CAST(epoch(least(e, day + INTERVAL 1 DAY)) - epoch(greatest(s, day)) AS BIGINT) AS secs, CAST(epoch(e) - epoch(s) AS BIGINT) AS total FROM d)
SELECT slug, day, max(v) AS highest, min(v) AS lowest, CAST(sum(CAST(round(v * 100) AS BIGINT) * secs // total) AS BIGINT) AS hundredths FROM x WHERE secs > 0 GROUP BY slug, day"""
)
def forecast_rollup(t: Tables) -> DataFrame:
    """Intervals split over whole days in UTC, amounts by their share of each."""
    end = F.col("o_orderdate") + F.make_dt_interval(hours=(6 + F.col("o_orderkey") % 60).cast("int"))
    spans = t.orders.select((F.col("o_custkey") % 50).alias("slug"), F.col("o_orderdate").alias("start"), end.alias("end"), F.col("o_totalprice").alias("value"))
    return rollup.by_day(spans)


@query("SELECT day, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors FROM (SELECT CAST(ts AS DATE) AS day, event_type FROM events) e GROUP BY day")
def stream_daily_counts(t: Tables) -> DataFrame:
    """Counts by event time under a watermark, read as a stream to its end."""
    from ..streaming import ingest

    return ingest.daily_counts(t.spark, t.sf_dir)


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def stream_upsert(t: Tables) -> DataFrame:
    """Micro-batches merged into a table of latest rows."""
    from ..streaming import ingest

    return ingest.upserted(t.spark, t.sf_dir)


@query("SELECT user_id, count(*) AS n, sum(CASE WHEN event_type <> before THEN 1 ELSE 0 END) AS changes FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) e GROUP BY user_id")
def stream_watch(t: Tables) -> DataFrame:
    """Changes against the state kept for each key."""
    from ..streaming import watch

    return watch.changes(t.spark, t.sf_dir)
