"""Queries of payloads that are landed as they came and read by schema; parts are made of the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import rules as R
from ..functions.rows import dealt
from ..sources import access, feeds
from ..streaming.ingest import _folder
from .inputs import Tables
from .registry import query


@query("SELECT 'S' || station AS station, 'WTEQ' AS element, day, value FROM $season s WHERE station % 9 > 0 AND day - DATE '1970-01-01' - (day - DATE '1970-01-01') // 7 * 7 > 0")
def network_values(t: Tables) -> DataFrame:
    """Daily values of a network's stations, a document a station and year; nulls and days that are none go."""
    null = F.pmod(F.unix_date("day"), F.lit(7)) == 0
    one = F.struct(F.when(F.col("station") % 9 == 0, "2024-13-01").otherwise(F.col("day").cast("string")).alias("date"), F.when(~null, F.col("value")).alias("value"))
    rows = t.season.groupBy("station", F.year("day").alias("year")).agg(F.collect_list(one).alias("values"))
    data = F.struct(F.concat(F.lit("S"), F.col("station").cast("string")).alias("station"), F.array(F.struct(F.lit("WTEQ").alias("element"), "values")).alias("data"))
    return feeds.station_values(rows.select(F.to_json(F.array(data), {"ignoreNullFields": "false"}).alias("body")))


@query(
    """SELECT 'C' || user_id AS station, CASE event_type WHEN 'view' THEN 'swe_in' ELSE 'snow_depth_in' END AS kind, CAST(ts AS DATE) AS day, arg_max(value - 5, event_id) AS value FROM events
WHERE event_type IN ('view', 'click') AND value - 5 >= 0 GROUP BY ALL"""
)
def sensor_values(t: Tables) -> DataFrame:
    """Rows of sensors by number with dates of one or two figures; faults below nothing go, and the last of a day counts."""
    number = F.when(F.col("event_type") == "view", "3").when(F.col("event_type") == "click", "18").otherwise("99")
    date = F.concat_ws("-", F.year("ts"), F.month("ts"), F.concat(F.dayofmonth("ts").cast("string"), F.lit(" 00:00")))
    one = F.struct("event_id", F.struct(F.concat(F.lit("C"), F.col("user_id").cast("string")).alias("station"), number.alias("sensor"), date.alias("date"), (F.col("value") - 5).alias("value")).alias("r"))
    packed = t.events.groupBy((F.col("user_id") % 20).alias("g")).agg(F.array_sort(F.collect_list(one))["r"].alias("rows"))
    return feeds.sensor_rows(packed.select(F.to_json("rows").alias("body")), {"3": "swe_in", "18": "snow_depth_in"})


@query("SELECT CAST(s_suppkey AS VARCHAR) AS site_no, CASE WHEN s_suppkey % 5 = 0 THEN 'Mill Ditch' ELSE s_name END AS station_nm FROM supplier WHERE s_suppkey % 5 > 0 AND s_suppkey % 3 > 0")
def site_directory(t: Tables) -> DataFrame:
    """A tab-separated directory with comments and a line of widths; other agencies and ditches go."""
    path = _folder(t.spark, "sites")
    key = F.col("s_suppkey")
    line = F.concat_ws("\t", F.when(key % 3 > 0, "USGS").otherwise("OTHER"), key.cast("string"), F.when(key % 5 == 0, "Mill Ditch").otherwise(F.col("s_name")))
    head = t.region.filter("r_regionkey < 3").select(F.col("r_regionkey").alias("ord"), F.element_at(F.array(F.lit("# a comment"), F.lit("agency_cd\tsite_no\tstation_nm"), F.lit("5s\t15s\t50s")), F.col("r_regionkey") + 1).alias("value"))
    rows = head.unionByName(t.supplier.select((key + 3).cast("int").alias("ord"), line.alias("value")))
    rows.repartition(1).sortWithinPartitions("ord").select("value").write.text(path)
    return feeds.tab_sites(t.spark, path, "USGS", "DITCH|CANAL").select("site_no", "station_nm")


@query(
    """SELECT CASE WHEN p_size % 2 = 0 THEN 'a' ELSE 'b' END AS source, count(*) * 2 AS landed, count(DISTINCT p_name) AS bodies, min(sha256(p_name)) AS least FROM part GROUP BY ALL"""
)
def raw_landing(t: Tables) -> DataFrame:
    """Payloads appended by source with a digest, twice; what came twice is told by its digest."""
    path = _folder(t.spark, "raw")
    rows = t.part.select(F.when(F.col("p_size") % 2 == 0, "a").otherwise("b").alias("source"), F.lit("u").alias("url"), F.col("p_name").alias("body"))
    for _ in range(2):
        feeds.append_raw(rows, path)
    told = t.spark.read.parquet(path).groupBy(F.col("source").cast("string").alias("source"))
    return told.agg(F.count("*").alias("landed"), F.countDistinct("sha256").alias("bodies"), F.min("sha256").alias("least"))


@query(
    """SELECT 'shrunk' AS label, count(*) AS n, false AS live FROM supplier UNION ALL SELECT 'whole', count(*), true FROM supplier WHERE s_suppkey % 20 > 0 UNION ALL SELECT 'fresh', count(*), false FROM supplier UNION ALL SELECT 'first', count(*), true FROM supplier"""
)
def directory_choice(t: Tables) -> DataFrame:
    """A live directory that shrank by more than a tenth does not replace its snapshot; a fresh snapshot needs no live one."""
    rows = lambda live, keep: t.supplier.filter(keep).select("s_suppkey", F.lit(live).alias("live"))
    snapshot = rows(False, "true")
    chosen = {
        "shrunk": feeds.directory(rows(True, "s_suppkey % 2 = 0"), snapshot, age_days=30), "whole": feeds.directory(rows(True, "s_suppkey % 20 > 0"), snapshot, age_days=30),
        "fresh": feeds.directory(rows(True, "true"), snapshot, age_days=3), "first": feeds.directory(rows(True, "true"), snapshot.limit(0)),
    }
    told = [df.agg(F.lit(label).alias("label"), F.count("*").alias("n"), F.max("live").alias("live")) for label, df in chosen.items()]
    return told[0].unionByName(told[1]).unionByName(told[2]).unionByName(told[3])


@query(
    """SELECT key, CAST(u.i AS INTEGER) AS corner, round(lon + 250 * cos(u.i % 8 * pi() / 4) / (111320 * cos(radians(lat))), 9) AS lon, round(lat + 250 * sin(u.i % 8 * pi() / 4) / 111320, 9) AS lat FROM $places p, unnest(range(9)) u(i)"""
)
def place_buffers(t: Tables) -> DataFrame:
    """a ring of eight points round each place."""
    ring = t.places.select("key", F.posexplode(geo.octagon(F.col("lat"), F.col("lon"), 250.0)).alias("corner", "p"))
    return ring.select("key", "corner", F.round("p.lon", 9).alias("lon"), F.round("p.lat", 9).alias("lat"))


@query("SELECT p_partkey AS key, 'Mt. ' || p_name || ' is open. Go by Rd. ' || p_size || ' now!' || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ' ' || p_type || ' follows' END AS said FROM part")
def sentence_excerpts(t: Tables) -> DataFrame:
    """Whole sentences up to a length; short forms end none."""
    head = F.concat(F.lit("Mt. "), "p_name", F.lit(" is open. Go by Rd. "), F.col("p_size").cast("string"), F.lit(" now!"))
    more = F.concat(F.lit(" "), "p_type", F.lit(" follows"))
    rows = t.part.select(F.col("p_partkey").alias("key"), F.when(F.col("p_partkey") % 2 == 0, F.concat(head, F.lit(" ") , F.repeat(F.lit("z"), 300), F.lit("."))).otherwise(F.concat(head, more)).alias("text"))
    return dealt(rows, "key").select("key", R.excerpt(F.col("text"), 200).alias("said"))


_KIND = "CASE s_suppkey % 3 WHEN 0 THEN 'trailhead' WHEN 1 THEN 'campground' ELSE 'parking' END"
_PROBLEM = f"CASE WHEN s_suppkey % 11 = 0 THEN 'unreadable' WHEN s_suppkey % 7 = 0 THEN 'closed' WHEN s_suppkey % 13 = 0 THEN 'nowhere' WHEN {_KIND} = 'campground' AND s_suppkey % 5 = 0 THEN 'nameless' END"


@query(
    f"""SELECT {_KIND} AS kind, CASE WHEN {_PROBLEM} IS NULL THEN s_suppkey END AS osm_id, CASE WHEN {_PROBLEM} IS NULL THEN CASE WHEN s_suppkey % 5 > 0 THEN s_name WHEN {_KIND} = 'trailhead' THEN 'Trailhead' END END AS name,
CASE WHEN {_PROBLEM} IS NULL AND s_suppkey % 4 > 0 THEN CAST(round_even(s_suppkey * 10 * 3.28084, 0) AS INTEGER) END AS elevation_ft, CASE WHEN {_PROBLEM} IS NULL AND s_suppkey % 2 = 0 THEN true END AS fee,
CASE WHEN {_PROBLEM} IS NULL AND {_KIND} = 'campground' THEN CAST(s_suppkey % 40 AS INTEGER) END AS sites, {_PROBLEM} AS problem FROM supplier"""
)
def access_elements(t: Tables) -> DataFrame:
    """Map elements with tags of any kind; unreadable, closed, placeless and nameless ones are kept beside the good."""
    body = """CASE WHEN s_suppkey % 11 = 0 THEN concat('{"id":', s_suppkey, ',"lat":') ELSE concat('{"id":', s_suppkey, CASE WHEN s_suppkey % 13 = 0 THEN '' WHEN s_suppkey % 2 = 0 THEN ',"lat":38.5,"lon":-119.5' ELSE ',"center":{"lat":38.5,"lon":-119.5}' END,
      ',"tags":{"access":"', if(s_suppkey % 7 = 0, 'private', 'yes'), '","ele":"', if(s_suppkey % 4 = 0, 'high', CAST(s_suppkey * 10 AS STRING)), '","fee":"', if(s_suppkey % 2 = 0, 'yes', 'maybe'), '","capacity":"', s_suppkey % 40, '.9"', if(s_suppkey % 5 = 0, '', concat(',"name":"', s_name, '"')), ',"odd":"x"}}') END"""
    read = access.elements(t.supplier.selectExpr(f"{_KIND} AS kind", f"{body} AS body"))
    return read.select("kind", "osm_id", "name", "elevation_ft", "fee", "sites", "problem")


@query(
    """SELECT 'route' AS what, 'Route ' || n_name AS name, 'p' || n_nationkey AS passes FROM nation WHERE n_nationkey % 3 > 0 AND n_nationkey % 5 > 0
UNION ALL SELECT CASE n_nationkey % 2 WHEN 0 THEN 'trailhead' ELSE 'campground' END, n_name || ' Lake', 'p' || n_nationkey || ':' || (n_nationkey / 2e0) FROM nation WHERE n_nationkey % 7 > 0 AND n_nationkey % 4 > 0"""
)
def permissive_documents(t: Tables) -> DataFrame:
    """Routes and places of documents by whoever wrote them; malformed entries are skipped, not the document."""
    body = """concat('{"routes":[{"name":', if(n_nationkey % 3 = 0, '7', concat('"Route ', n_name, '"')), ',"passes":', if(n_nationkey % 5 = 0, '"p"', concat('["p', n_nationkey, '",3]')), ',"aliases":[1,"a"]},5,{}],"places":[{"name":"', n_name, ' Lake","kind":"',
      CASE WHEN n_nationkey % 7 = 0 THEN 'bar' WHEN n_nationkey % 2 = 0 THEN 'trailhead' ELSE 'campground' END, '","passes":[["p', n_nationkey, '",', if(n_nationkey % 4 = 0, '"far"', CAST(n_nationkey / 2D AS STRING)), '],["q"],4]},null]}')"""
    told = t.nation.selectExpr(f"{body} AS body")
    routes = access.routes(told).select(F.lit("route").alias("what"), F.col("route").alias("name"), F.array_join("passes", ",").alias("passes"))
    near = F.transform("passes", lambda p: F.concat(p["slug"], F.lit(":"), p["distance_mi"].cast("string")))
    places = access.places(told).select(F.col("kind").alias("what"), F.col("place").alias("name"), F.array_join(near, ",").alias("passes"))
    return routes.unionByName(places)
