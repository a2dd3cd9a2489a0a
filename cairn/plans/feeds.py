"""Queries of agencies' feeds: payloads are made of the stored tables, landed as text, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import links
from ..sources import roads as S
from .inputs import Tables
from .registry import query


def _s(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _landed(rows: DataFrame, groups: int, *columns: Column) -> DataFrame:
    """JSON arrays of rows (key, ...), one per group of keys: ord, body."""
    one = F.struct(F.col("key"), F.struct(*columns).alias("r"))
    packed = rows.groupBy(F.floor(F.col("key") / groups).alias("ord")).agg(F.array_sort(F.collect_list(one)).alias("a"))
    return packed.select("ord", F.to_json(F.transform("a", lambda x: x["r"])).alias("body"))


def _flat(lines: str) -> Column:
    return F.array_join(F.transform(lines, lambda x: F.concat_ws("|", F.coalesce(x["label"], F.lit("-")), F.coalesce(x["code"], F.lit("-")), x["text"])), "; ").alias("lines")


@query(
    """WITH r AS (SELECT s.key, 'SR ' || (s.key // 2) % 40 AS road, 'Gate ' || s.key // 4 AS location, s.lat, s.lon, CASE s.key % 3 WHEN 0 THEN 'R-0' WHEN 1 THEN 'R-2' ELSE 'HT' END AS code, 'text ' || s.key % 5 AS text, CASE WHEN s.key % 2 = 0 THEN 'North' ELSE '-' END AS label,
  '2024-01-' || lpad(CAST(1 + s.key % 28 AS VARCHAR), 2, '0') || 'T08:00:00' AS updated FROM $stations s WHERE s.key % 7 > 0 AND s.key % 11 > 0 AND lat BETWEEN 30 AND 50 AND lon BETWEEN -126 AND -113)
SELECT road, location, arg_min(round(lat, 5), key) AS lat, arg_min(round(lon, 5), key) AS lon, bool_or(code <> 'R-0') AS active, max(updated) AS updated, array_to_string(list_sort(list(DISTINCT CASE WHEN label = '-' THEN ' ' ELSE label END || '|' || code || '|' || text)), '; ') AS lines FROM r GROUP BY road, location"""
)
def chain_controls(t: Tables) -> DataFrame:
    """Chain-control points, the directions at one place merged."""
    key = F.col("key")
    at = F.struct(F.concat(F.lit("Gate "), _s(F.floor(key / 4))).alias("locationName"), F.concat(F.lit("SR "), _s(F.floor(key / 2) % 40)).alias("route"), F.when(key % 2 == 0, "North").otherwise("*").alias("direction"), _s("lat").alias("latitude"), _s("lon").alias("longitude"))
    stamp = F.struct(F.format_string("2024-01-%02d", 1 + key % 28).alias("statusDate"), F.lit("08:00:00").alias("statusTime"))
    code = F.when(key % 11 == 0, "none?").when(key % 3 == 0, "R-0").when(key % 3 == 1, "R-2").otherwise("HT")
    status = F.struct(code.alias("status"), F.concat(F.lit("text "), _s(key % 5)).alias("statusDescription"), stamp.alias("statusTimestamp"))
    landed = _landed(t.stations, 50, F.struct(F.when(key % 7 > 0, "true").otherwise("false").alias("inService"), at.alias("location"), status.alias("statusData")).alias("cc"))
    out = S.controls(landed)
    line = F.array_join(F.array_sort(F.transform("lines", lambda x: F.concat_ws("|", F.coalesce(x["label"], F.lit(" ")), x["code"], x["text"]))), "; ")
    return out.withColumn("lines", line)


@query(
    """SELECT 'Pass ' || key || ' SR ' || key % 90 AS location, 'SR ' || key % 90 AS road, round(lat, 5) AS lat, round(lon, 5) AS lon, key % 3 = 0 AS active, CASE WHEN key % 5 > 0 THEN strftime(TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 HOUR * (key % 600) - INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S') || '-08:00' END AS updated,
  'Road|-|bare ' || key % 4 || CASE WHEN key % 2 = 0 THEN '; Weather|-|snow' ELSE '' END || CASE key % 3 WHEN 0 THEN '; East|-|Chains required' WHEN 1 THEN '; East|-|No restrictions.' ELSE '' END AS lines FROM $stations s WHERE key % 9 > 0"""
)
def mountain_pass_reports(t: Tables) -> DataFrame:
    """Pass reports with dates in milliseconds and their offset."""
    key = F.col("key")
    ms = F.lit(1704067200000) + (key % 600) * 3600000
    limit = F.struct(F.lit("East").alias("TravelDirection"), F.when(key % 3 == 0, "Chains required").when(key % 3 == 1, "No restrictions.").otherwise(" ").alias("RestrictionText"))
    landed = _landed(
        t.stations, 40, F.concat(F.lit("Pass "), _s("key"), F.lit(" SR "), _s(key % 90)).alias("MountainPassName"), F.when(key % 9 > 0, F.col("lat")).otherwise(0.0).alias("Latitude"), F.col("lon").alias("Longitude"),
        F.concat(F.lit("bare "), _s(key % 4)).alias("RoadCondition"), F.when(key % 2 == 0, "snow").otherwise("").alias("WeatherCondition"),
        F.when(key % 5 > 0, F.concat(F.lit("/Date("), _s(ms), F.lit("-0800)/"))).otherwise("soon").alias("DateUpdated"), limit.alias("RestrictionOne"),
    )
    out = S.pass_reports(landed)
    return out.select("location", "road", "lat", "lon", "active", "updated", _flat("lines"))


@query(
    """SELECT 'Site ' || key AS location, CASE WHEN key % 4 > 0 THEN 'OR' || key % 30 END AS road, round(lat, 5) AS lat, round(lon, 5) AS lon, key % 5 = 2 AS active, CASE WHEN key % 3 > 0 THEN round((key % 3) * 10 / 2.54, 1) END AS new_snow_in,
  array_to_string(list_filter([CASE WHEN key % 6 < 4 THEN 'Road|-|road ' || key % 6 END, CASE WHEN key % 7 < 3 THEN 'Weather|-|weather ' || key % 7 END, CASE WHEN key % 5 = 2 THEN 'Restriction|2|limit 2' WHEN key % 5 = 1 THEN 'Restriction|1|None.' END, CASE WHEN key % 8 = 0 THEN 'Crew comment|-|plowed' END], lambda x: x IS NOT NULL), '; ') AS lines
FROM $stations s WHERE key % 6 < 4 OR key % 7 < 3 OR key % 5 IN (1, 2) OR key % 8 = 0"""
)
def road_weather_reports(t: Tables) -> DataFrame:
    """Reports whose ids are explained by the agency's table."""
    key = F.col("key")
    landed = _landed(
        t.stations, 60, F.concat(F.lit("Site "), _s("key")).alias("name"), F.when(key % 4 > 0, F.concat(F.lit("OR"), _s(key % 30))).otherwise(" ").alias("route"), _s("lat").alias("lat"), _s("lon").alias("lon"),
        F.concat(_s(key % 6), F.lit(".0")).alias("road"), _s(key % 7).alias("weather"), _s(key % 5).alias("limit"), F.when(key % 8 == 0, " plowed ").alias("comments"), ((key % 3) * 10.0).alias("snow_cm"),
    )
    table = [("road", i, f"road {i}") for i in range(4)] + [("weather", f"{i}.0", f"weather {i}") for i in range(3)] + [("limit", 1, "None."), ("limit", 2, "limit 2"), ("limit", 3, " ")]
    words = t.spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(str(i)).alias("id"), F.lit(w).alias("words")) for k, i, w in table))))
    out = S.id_reports(landed, words)
    return out.select("location", "road", "lat", "lon", "active", "new_snow_in", _flat("lines"))


@query("SELECT 'A' || lpad(CAST(key % 100 AS VARCHAR), 2, '0') AS station_id, 'North ' || key || ' Peak' AS name, round(lon, 3) AS lon, round(lat, 3) AS lat, CASE WHEN key % 5 > 0 THEN elevation_ft END AS elevation_ft FROM $stations s WHERE key % 7 > 0 AND key % 6 > 0 AND key < 1000")
def station_search(t: Tables) -> DataFrame:
    """A station search page, an HTML table."""
    key = F.col("key")
    cells = [F.when(key % 7 > 0, F.format_string("A%02d", key % 100)).otherwise("no id"), F.concat(F.lit("<a href='x'>NORTH "), _s("key"), F.lit(" PEAK</a>")), F.lit("basin"), F.lit("county")]
    cells += [F.when(key % 6 > 0, F.format_string("%.3f", "lon")).otherwise("n/a"), F.format_string("%.3f", "lat"), F.when(key % 5 > 0, F.format_number("elevation_ft", 0)).otherwise("")]
    row = F.concat(F.lit("<TR class='r'>"), *(F.concat(F.lit("<td>"), c, F.lit("</td>\n")) for c in cells), F.lit("</TR>"))
    pages = t.stations.filter("key < 1000").groupBy((key % 3).alias("page")).agg(F.concat(F.lit("<table>"), F.array_join(F.collect_list(row), "\n"), F.lit("</table>")).alias("body"))
    out = S.search_page(pages)
    return out.withColumn("elevation_ft", F.col("elevation_ft").cast("long"))


@query("SELECT key || ':CA:SNTL' AS triplet, name, round(lat, 4) AS lat, elevation_ft FROM $stations s")
def station_directories(t: Tables) -> DataFrame:
    """Directories of several states, which overlap, as one."""
    fields = (F.concat(_s("key"), F.lit(":CA:SNTL")).alias("stationTriplet"), F.col("name"), F.round("lat", 4).alias("latitude"), F.col("lon").alias("longitude"), F.col("elevation_ft").cast("double").alias("elevation"))
    landed = _landed(t.stations, 30, *fields).unionByName(_landed(t.stations.filter("key % 4 = 0"), 40, *fields))
    return S.directories(landed).select(F.col("stationTriplet").alias("triplet"), "name", F.col("latitude").alias("lat"), F.col("elevation").cast("long").alias("elevation_ft"))


@query(
    """SELECT CAST(n_nationkey AS VARCHAR) AS id, r_name AS unit, n_name AS title, 'Closed at ' || n_nationkey AS text, DATE '2024-01-01' + n_nationkey AS day, CASE WHEN n_nationkey % 3 = 0 THEN 'https://www.parks.example/a' WHEN n_nationkey % 3 = 1 THEN 'https://parks.example/b' END AS url
FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 8 > 0"""
)
def official_alerts(t: Tables) -> DataFrame:
    """Alerts of parks that are known by their codes."""
    key = F.col("n_nationkey")
    url = F.when(key % 3 == 0, "https://www.parks.example/a").when(key % 3 == 1, "https://parks.example/b").otherwise("https://notparks.example/c")
    day = F.when(key % 8 > 0, F.concat(_s(F.date_add(F.lit("2024-01-01").cast("date"), key)), F.lit(" 00:00:00.0"))).otherwise("unknown")
    row = F.struct(_s(key).alias("id"), url.alias("url"), F.col("n_name").alias("title"), F.concat(F.lit("P"), _s("n_regionkey")).alias("parkCode"), F.concat(F.lit("Closed at "), _s(key)).alias("description"), day.alias("lastIndexedDate"))
    landed = t.nation.agg(F.to_json(F.struct(F.collect_list(row).alias("data"))).alias("body"))
    parks = t.region.select(F.concat(F.lit("p"), _s("r_regionkey")).alias("code"), F.col("r_name").alias("unit"))
    return S.alerts(landed, parks, "parks.example")


@query(
    """SELECT page_id, 'Unit ' || page_id AS place, 'line one' || CASE WHEN page_id % 3 > 0 THEN chr(10) || 'line two' ELSE '' END AS text, DATE '2024-01-01' + CAST(page_id % 9 AS INTEGER) AS day FROM pages WHERE page_id % 5 > 0 AND page_id % 7 > 0 AND DATE '2024-01-01' + CAST(page_id % 9 AS INTEGER) <= DATE '2024-01-05'"""
)
def report_records(t: Tables) -> DataFrame:
    """Reports with place, text and a day not after the one on which they were fetched (02:00 UTC of the 6th is the 5th in the west)."""
    key = F.col("page_id")
    found = t.pages.select(
        "page_id", F.when(key % 5 > 0, F.concat(F.lit("Unit "), _s(key))).otherwise(" ").alias("place"), F.array(F.when(key % 7 > 0, "line one").otherwise(" "), F.when((key % 3 > 0) & (key % 7 > 0), "line two").otherwise("")).alias("lines"),
        F.date_add(F.lit("2024-01-01").cast("date"), (key % 9).cast("int")).alias("day"), F.lit("2024-01-06 02:00:00").cast("timestamp").alias("fetched_at"),
    )
    return S.official_reports(found).select("page_id", "place", "text", "day")


@query("SELECT user_id AS site, CAST(ts AS DATE) AS day, round((max(value) - min(value)) / avg(value) * 100, 1) AS swing FROM events GROUP BY user_id, CAST(ts AS DATE) HAVING count(*) >= 3")
def quarter_hour_swings(t: Tables) -> DataFrame:
    """The swing of days with enough readings (three, for these tables)."""
    return S.daily_swings(t.events.select(F.col("user_id").alias("site"), F.col("ts").cast("date").alias("day"), "value", "event_id"), 3, "event_id")


@query("SELECT 'O' || key % 4 AS office, CAST(floor(lon) AS BIGINT) AS x, CAST(floor(lat) AS BIGINT) AS y, bool_or(key % 10 = 0) AS featured, max(elevation_ft) FILTER (WHERE (key % 10 = 0) = f) AS elevation_ft FROM (SELECT *, bool_or(key % 10 = 0) OVER (PARTITION BY key % 4, floor(lon), floor(lat)) AS f FROM $places p) q GROUP BY 1, 2, 3")
def grid_cell_order(t: Tables) -> DataFrame:
    """Grid cells in the order in which they are read."""
    points = t.places.select(F.concat(F.lit("O"), _s(F.col("key") % 4)).alias("office"), F.floor("lon").alias("x"), F.floor("lat").alias("y"), (F.col("key") % 10 == 0).alias("featured"), "elevation_ft")
    return S.cell_order(points)


@query("SELECT s_suppkey AS key, DATE '2024-01-20' + CAST(s_suppkey % 4 AS INTEGER) AS issued_for FROM supplier WHERE DATE '2024-01-22' - (DATE '2024-01-20' + CAST(s_suppkey % 4 AS INTEGER)) <= 1")
def fresh_layers(t: Tables) -> DataFrame:
    """Layers of today and yesterday."""
    rows = t.supplier.select(F.col("s_suppkey").alias("key"), F.date_add(F.lit("2024-01-20").cast("date"), (F.col("s_suppkey") % 4).cast("int")).alias("issued_for"))
    return S.fresh_layer(rows, "2024-01-22")


_SMOKE = "(SELECT n_nationkey AS id, 32 + (n_nationkey * 637) % 1700 / 1e2 AS lat, -124 + (n_nationkey * 353) % 1000 / 1e2 AS lon, CASE n_nationkey % 4 WHEN 0 THEN 'light' WHEN 1 THEN 'heavy' ELSE 'medium' END AS density FROM nation WHERE n_nationkey % 9 > 0)"


def _plumes(t: Tables, digits: int | None = 3) -> DataFrame:
    """Squares of two degrees round each nation's position, as KML placemarks; corners are written in full."""
    key = F.col("n_nationkey")
    lat, lon = 32 + (key * 637) % 1700 / F.lit(1e2), -124 + (key * 353) % 1000 / F.lit(1e2)
    corner = lambda x, y: F.concat_ws(",", (lon + x).cast("string"), (lat + y).cast("string"), F.lit("0"))
    ring = F.concat_ws(" ", corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1))
    density = F.when(key % 4 == 0, "Light").when(key % 4 == 1, "Heavy").otherwise("")
    told = F.concat(F.when(density != "", F.concat(F.lit("Density: "), density)).otherwise(""), F.format_string(" Start Time: 2024%03d 0%d30 UTC End Time: 2024%03d 2200 UTC", 1 + key, key % 10, 1 + key))
    body = F.concat(F.when(key % 9 == 0, "<!DOCTYPE x>").otherwise(""), F.lit("<Placemark><description>"), told, F.lit("</description><styleUrl>#Smoke_Medium</styleUrl><coordinates>"), ring, F.lit("</coordinates></Placemark>"))
    return S.plumes(t.nation.select(key.alias("id"), body.alias("body")), digits)


@query(f"SELECT id, density, strftime(DATE '2024-01-01' + id, '%Y-%m-%d') || 'T0' || id % 10 || ':30Z' AS start, strftime(DATE '2024-01-01' + id, '%Y-%m-%d') || 'T22:00Z' AS end, CAST(5 AS INTEGER) AS corners FROM {_SMOKE} s")
def smoke_plumes(t: Tables) -> DataFrame:
    """Smoke polygons with their times, rings closed."""
    return _plumes(t).select("id", "density", "start", "end", F.size("ring").alias("corners"))


@query(
    f"""SELECT p.key, list_extract(['light', 'medium', 'heavy'], CAST(max(CASE density WHEN 'light' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END) AS INTEGER)) AS density FROM $places p JOIN {_SMOKE} s ON p.lon >= s.lon - 1 AND p.lon < s.lon + 1 AND p.lat >= s.lat - 1 AND p.lat < s.lat + 1 GROUP BY p.key"""
)
def smoke_over_places(t: Tables) -> DataFrame:
    """The heaviest smoke over each place, by cells of a degree, boxes and the ray cast."""
    box = lambda f, c: f(F.transform("ring", lambda p: p[c]))
    zones = _plumes(t, None).select(  # as written: a place on an edge lies in or out by the last digit
        F.col("id").alias("zone"), "density", "ring", box(F.array_min, "lon").alias("west"), box(F.array_min, "lat").alias("south"), box(F.array_max, "lon").alias("east"), box(F.array_max, "lat").alias("north")
    )
    held = links.zones_of(t.places, zones)
    rank = F.element_at(F.create_map(F.lit("light"), F.lit(1), F.lit("medium"), F.lit(2), F.lit("heavy"), F.lit(3)), F.col("density"))
    return held.join(zones.select("zone", "density"), "zone").groupBy("key").agg(F.max_by("density", rank).alias("density"))
