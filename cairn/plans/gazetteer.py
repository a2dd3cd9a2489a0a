"""Queries of places brought together and of reports that name them; upkeep of stored windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import gazetteer as G
from ..operators import names, trips, upkeep
from .evidence import _links
from .inputs import Tables
from .places import _KM
from .registry import query

_NEAR = f"(SELECT * FROM (SELECT p.key AS slug, s.key AS station, s.lat, s.lon, s.elevation_ft, {_KM.format(a='p', b='s')} AS distance_km, row_number() OVER (PARTITION BY p.key ORDER BY {_KM.format(a='p', b='s')}, s.key) AS rk FROM $places p, $stations s WHERE {_KM.format(a='p', b='s')} <= 55) x WHERE rk <= 3)"
_SITE = "(2 * 6371 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))) <= 40 AND abs(a.elevation_ft - b.elevation_ft) <= 3000 AND a.station % 2 <> b.station % 2)"


@query(
    f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY station % 4 DESC, distance_km, station) AS r FROM {_NEAR} n),
a AS (SELECT * FROM s WHERE r = 1), b AS (SELECT b.* FROM s b JOIN a ON a.slug = b.slug WHERE b.r = 2 AND NOT {_SITE}),
k AS (SELECT * FROM a UNION ALL SELECT * FROM b), c AS (SELECT b.* FROM s b WHERE b.r = 3 AND NOT EXISTS (SELECT 1 FROM k a WHERE a.slug = b.slug AND {_SITE}))
SELECT slug, station FROM k UNION ALL SELECT slug, station FROM c"""
)
def sites_once(t: Tables) -> DataFrame:
    """The stations of a place, those of another network at the same site left out (40 km and 3000 ft, for these tables)."""
    here = t.stations.select(F.col("key").alias("rkey"), "lat", "lon", "elevation_ft")
    near = _links(t, t.stations, 55, 3).join(here, "rkey")
    rows = near.select(F.col("lkey").alias("slug"), F.col("rkey").alias("station"), (F.col("rkey") % 2).alias("network"), "lat", "lon", "elevation_ft", (F.col("rkey") % 4).alias("usable"), F.col("km").alias("distance_km"))
    return G.same_sites(rows, km=40, feet=3000)


_W1 = "split_part(p_name, ' ', 1)"
_FEATURED = f"(SELECT p_partkey AS key, {_W1} AS name, 32 + ((p_partkey * 91) % 1700) / 1e2 AS lat, -124 + ((p_partkey * 17) % 1000) / 1e2 AS lon, 3000 + ((p_partkey * 131) % 8000) AS elevation_ft FROM part WHERE p_partkey % 20 = 0)"
_NODES = f"(SELECT p_partkey AS key, {_W1} AS name, 32 + ((p_partkey * 91) % 1700) / 1e2 AS lat, -124 + ((p_partkey * 17) % 1000) / 1e2 AS lon, CASE WHEN p_partkey % 9 > 0 THEN 3000 + ((p_partkey * 131) % 8000) END AS elevation_ft FROM part WHERE p_partkey % 20 > 0)"


def _parts(t: Tables, featured: bool) -> DataFrame:
    rows = t.named_places.filter((F.col("key") % 20 == 0) if featured else (F.col("key") % 20 > 0)).withColumn("name", F.split_part("name", F.lit(" "), F.lit(1)))
    return rows if featured else rows.withColumn("elevation_ft", F.when(F.col("key") % 9 > 0, F.col("elevation_ft")))


@query(
    f"""SELECT f.key, m.node, m.km FROM {_FEATURED} f LEFT JOIN (SELECT key, node, km FROM (SELECT a.key, b.key AS node, {_KM.format(a='a', b='b')} AS km, row_number() OVER (PARTITION BY a.key ORDER BY {_KM.format(a='a', b='b')}, b.key) AS r
FROM {_FEATURED} a JOIN {_NODES} b ON lower(a.name) = lower(b.name) WHERE {_KM.format(a='a', b='b')} <= 60) x WHERE r = 1) m USING (key)"""
)
def featured_nodes(t: Tables) -> DataFrame:
    """The nearest node of the same name (within 60 km, for these tables)."""
    return G.namesakes(_parts(t, True), _parts(t, False), km=60)


@query(
    f"""WITH n AS (SELECT * FROM {_NODES} b WHERE elevation_ft IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {_FEATURED} a WHERE {_KM.format(a='b', b='a')} <= 60 AND (lower(a.name) = lower(b.name) AND {_KM.format(a='b', b='a')} < 60 OR {_KM.format(a='b', b='a')} < 5))),
r AS (SELECT key, lower(name) AS slug, row_number() OVER (PARTITION BY lower(name) ORDER BY key) AS r FROM n)
SELECT key, CASE WHEN r = 1 AND slug NOT IN (SELECT lower(name) FROM {_FEATURED} f) THEN slug ELSE slug || '-' || key END AS slug FROM r"""
)
def merged_nodes(t: Tables) -> DataFrame:
    """Nodes that are no duplicates, with slugs of their own."""
    return G.merged(_parts(t, True), _parts(t, False), near_km=5, same_km=60)


@query(
    f"""WITH n AS (SELECT s.key AS start, p.key AS place, p.key % 10 = 0 AS featured, {_KM.format(a='s', b='p')} AS km FROM $stations s, $places p WHERE s.key % 8 > 0 AND {_KM.format(a='s', b='p')} <= 40),
r AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY km, place) AS r, row_number() OVER (PARTITION BY start, featured ORDER BY km, place) AS f FROM n)
SELECT start, place, row_number() OVER (PARTITION BY start ORDER BY km, place) AS rank FROM r WHERE r <= 6 OR featured AND f <= 4"""
)
def place_index(t: Tables) -> DataFrame:
    """The places in reach of each start."""
    starts = t.stations.withColumn("name", F.when(F.col("key") % 8 > 0, F.col("name")).otherwise(" ")).select("key", "lat", "lon", "name")
    return G.inverted(starts, t.places.withColumn("featured", F.col("key") % 10 == 0), 40, 6)


_CAP = "upper(substr({0}, 1, 1)) || substr({0}, 2)"
_BULLETINS = f"""(SELECT p.p_partkey AS id, CASE WHEN p.p_partkey % 3 = 0 THEN 'At ' || {_CAP.format("split_part(p.p_name, ' ', 1)")} || '-' || {_CAP.format("split_part(p.p_name, ' ', 2)")} || ' Pass' ELSE 'Somewhere' END AS place,
  'Snow near ' || CASE q.p_partkey % 4 WHEN 0 THEN upper(q.p_name) || ' PASS' WHEN 1 THEN {_CAP.format("split_part(q.p_name, ' ', 1)")} || ' ' || {_CAP.format("split_part(q.p_name, ' ', 2)")} || ' Pass' WHEN 2 THEN q.p_name || ' pass' ELSE {_CAP.format("q.p_name")} || ' Pass camp' END || ' today.' AS text,
  'unit ' || p.p_partkey % 5 AS unit, DATE '2024-01-01' + CAST(p.p_partkey % 20 AS INTEGER) AS day, lower(p.p_name) AS own, lower(q.p_name) AS other, q.p_partkey % 4 AS form, 32 + ((p.p_partkey * 91) % 1700) / 1e2 AS lat, -124 + ((p.p_partkey * 17) % 1000) / 1e2 AS lon FROM part p JOIN part q ON q.p_partkey = p.p_partkey + 1)"""


@query(
    f"""WITH h AS (SELECT b.id, 0 AS o, n.key, b.own AS name FROM {_BULLETINS} b JOIN $named_places n ON lower(n.name) = b.own AND n.lat BETWEEN b.lat - 3 AND b.lat + 3 AND n.lon BETWEEN b.lon - 3 AND b.lon + 3 WHERE b.id % 3 = 0
  UNION ALL SELECT b.id, 1, n.key, b.other FROM {_BULLETINS} b JOIN $named_places n ON lower(n.name) = b.other AND n.lat BETWEEN b.lat - 3 AND b.lat + 3 AND n.lon BETWEEN b.lon - 3 AND b.lon + 3 WHERE b.form < 2),
u AS (SELECT id, o, min(key) AS slug FROM h GROUP BY id, o, name HAVING count(DISTINCT key) = 1), f AS (SELECT * FROM u WHERE o = 0 OR NOT EXISTS (SELECT 1 FROM u v WHERE v.id = u.id AND v.slug = u.slug AND v.o = 0)),
c AS (SELECT f.slug, b.day, arg_min(f.o, f.id) AS o, min(f.id) AS id FROM f JOIN {_BULLETINS} b ON b.id = f.id GROUP BY f.slug, b.unit, b.place, b.day, b.text)
SELECT slug, id, CASE WHEN o = 0 THEN 'place' ELSE 'text' END AS named_in, rank FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY o, day DESC, id) AS rank FROM c) x WHERE rank <= 4"""
)
def reports_naming_places(t: Tables) -> DataFrame:
    """Reports that name a pass within their bounds."""
    cap = lambda c: F.concat(F.upper(F.left(c, F.lit(1))), F.substr(c, F.lit(2)))
    word = lambda c, i: F.split_part(c, F.lit(" "), F.lit(i))
    next_ = t.part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"), (F.col("p_partkey") % 4).alias("form"))
    form = F.col("form")
    said = (
        F.when(form == 0, F.concat(F.upper("other"), F.lit(" PASS"))).when(form == 1, F.concat(cap(word("other", 1)), F.lit(" "), cap(word("other", 2)), F.lit(" Pass")))
        .when(form == 2, F.concat("other", F.lit(" pass"))).otherwise(F.concat(cap(F.col("other")), F.lit(" Pass camp")))
    )
    place = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("At "), cap(word("p_name", 1)), F.lit("-"), cap(word("p_name", 2)), F.lit(" Pass"))).otherwise("Somewhere")
    at = t.named_places.select(F.col("key").alias("p_partkey"), "lat", "lon")
    bounds = F.struct((F.col("lat") - 3).alias("south"), (F.col("lon") - 3).alias("west"), (F.col("lat") + 3).alias("north"), (F.col("lon") + 3).alias("east"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("p_partkey") % 20).cast("int"))
    reports = t.part.join(next_, "p_partkey").join(at, "p_partkey").select(
        F.col("p_partkey").alias("id"), place.alias("place"), F.concat(F.lit("Snow near "), said, F.lit(" today.")).alias("text"), F.concat(F.lit("unit "), (F.col("p_partkey") % 5).cast("string")).alias("unit"), day.alias("day"), bounds.alias("bounds")
    )
    places = t.named_places.select(F.col("key").alias("slug"), F.concat("name", F.lit(" Pass")).alias("name"), "lat", "lon")
    return G.naming(reports, places)


@query()
def resolved_names(t: Tables) -> DataFrame:
    """Texts resolved to places: by the whole, by a name inside, by likeness. No SQL: the last stage compares matching blocks."""
    key = F.col("p_partkey")
    text = F.when(key % 3 == 0, F.upper("p_name")).when(key % 3 == 1, F.concat(F.lit("up to "), "p_name", F.lit(" today"))).otherwise(F.concat(F.substring("p_name", 1, 4), F.substring("p_name", 6, 40)))
    known = t.part.select(F.concat(F.lit("p"), key.cast("string")).alias("slug"), F.col("p_name").alias("name"), key.alias("ord"))
    return names.resolve(t.part.filter(key % 5 == 0).select(key.alias("key"), text.alias("text")), known)


@query(
    """SELECT d.conv_id, d.turn, c.doc_id FROM conversations d JOIN (SELECT doc_id, sha256('v2:' || text) AS h FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT conv_id, sha256('v2:' || text) FROM conversations WHERE turn = 1) c ON c.h = sha256('v2:' || d.text)"""
)
def extraction_lookup(t: Tables) -> DataFrame:
    """Posts with what was extracted from the same words before, by a salted digest."""
    digest = R.hash_key(F.col("text"), salt="v2:")
    cache = t.documents.filter("doc_id % 2 = 0").select("doc_id", digest.alias("h")).unionByName(t.conversations.filter("turn = 1").select(F.col("conv_id").alias("doc_id"), digest.alias("h")))
    return t.conversations.select("conv_id", "turn", digest.alias("h")).join(cache, "h").select("conv_id", "turn", "doc_id")


#: Runs that read a window of a stream, some failed or empty.
_RUNS = [(1, "view", "2024-01-01", "2024-01-31", True), (2, "view", "2024-01-10", "2024-01-14", True), (3, "view", "2024-01-12", "2024-01-20", False), (1, "click", "2024-01-01", "2024-01-31", True), (4, "click", "2024-01-05", "2024-01-08", True)]
_RUN_SQL = "(VALUES " + ", ".join(f"({r}, '{s}', DATE '{a}', DATE '{b}', {str(ok).lower()})" for r, s, a, b, ok in _RUNS) + ") r(run, stream, \"begin\", \"end\", ok)"


@query(
    f"""WITH x AS (SELECT event_id, event_type AS stream, CAST(ts AS DATE) AS day, r.run FROM events JOIN {_RUN_SQL} ON r.stream = event_type AND CAST(ts AS DATE) BETWEEN r."begin" AND r."end" WHERE event_id % 4 <> r.run % 4)
SELECT event_id, stream, day, x.run FROM x WHERE EXISTS (SELECT 1 FROM {_RUN_SQL} WHERE r.run = x.run AND r.stream = x.stream AND r.ok) AND NOT EXISTS (SELECT 1 FROM {_RUN_SQL} WHERE r.ok AND r.stream = x.stream AND r.run > x.run AND x.day BETWEEN r."begin" AND r."end")"""
)
def window_replace(t: Tables) -> DataFrame:
    """What is left of several runs over overlapping windows: rows of the last good run that covers their day."""
    runs = t.spark.createDataFrame([(r, s, a, b, ok) for r, s, a, b, ok in _RUNS], "run int, stream string, begin string, end string, ok boolean")
    runs = runs.select("run", "stream", F.col("begin").cast("date").alias("begin"), F.col("end").cast("date").alias("end"), "ok")
    rows = t.events.select("event_id", F.col("event_type").alias("stream"), F.col("ts").cast("date").alias("day"))
    landed = rows.join(F.broadcast(runs.drop("ok")), "stream").filter(F.col("day").between(F.col("begin"), F.col("end")) & (F.col("event_id") % 4 != F.col("run") % 4)).drop("begin", "end")
    return upkeep.current_rows(landed, runs)


@query(
    """SELECT y AS year, CASE WHEN y = year(now) AND now < make_date(y, 4, 1) THEN make_date(y, 1, 1) ELSE make_date(y, 4, 1) END AS "begin", CASE WHEN y = year(now) THEN now ELSE make_date(y, 8, 31) END AS "end"
FROM (SELECT unnest(range(year(first), year(now) + 1)) AS y, now FROM (SELECT min(day) AS first, max(day) AS now FROM $season s) e) x"""
)
def season_windows(t: Tables) -> DataFrame:
    """A window per melt season since the first stored reading, the newest reading's year through it."""
    return upkeep.season_windows(t.season)


@query("""SELECT least(DATE '2024-01-31' - 10, min(latest) - 3) AS "begin", DATE '2024-01-31' AS "end" FROM (SELECT max(CAST(ts AS DATE)) AS latest FROM events WHERE event_id % 7 > 0 GROUP BY event_type) x""")
def daily_window(t: Tables) -> DataFrame:
    """The days to read again: ten back, or three before the laggard stream's newest day."""
    return upkeep.daily_window(t.events.filter("event_id % 7 > 0").select(F.col("event_type").alias("stream"), F.col("ts").cast("date").alias("day")), "2024-01-31")


_PASS = "CASE p_partkey % 3 WHEN 0 THEN ' pass' WHEN 1 THEN ' gap' ELSE ' peak' END"


def _trip_inputs(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Trips of customers, passes named like parts, routes of regions and places of suppliers."""
    passes = t.spark.sql(
        f"""SELECT concat('pass-', p_partkey) AS slug, concat(p_name, {_PASS}) AS name, CASE WHEN p_partkey % 4 = 0 THEN 'featured' ELSE 'osm' END AS tier, CASE WHEN p_partkey % 4 = 0 THEN array(concat('the pass after ', p_type, ' lakes')) END AS aliases,
        32 + (p_partkey * 91) % 1700 / 1e2 AS lat, -124 + (p_partkey * 17) % 1000 / 1e2 AS lon, CAST(p_partkey AS BIGINT) AS ord FROM {{part}}""", part=t.part,
    )
    trips = t.spark.sql(
        f"""SELECT c_custkey AS trip, concat_ws(' ', 'From', a.name, 'to', CASE WHEN c_custkey % 3 = 0 THEN concat(substr(b.name, 1, 3), substr(b.name, 5)) ELSE b.name END, CASE WHEN c_custkey % 5 = 0 THEN 'by the ASIA loop' END, CASE WHEN c_custkey % 4 = 1 THEN concat('near ', d.lake) END) AS text,
        CASE WHEN c_custkey % 2 = 0 THEN 40D END AS lat, CASE WHEN c_custkey % 2 = 0 THEN -120D END AS lon
        FROM {{customer}} JOIN {{passes}} a ON a.ord = 1 + c_custkey % 150 JOIN {{passes}} b ON b.ord = 1 + c_custkey * 7 % 170 JOIN (SELECT s_suppkey, concat('supplier ', s_suppkey, ' lake') AS lake FROM {{supplier}}) d ON d.s_suppkey = 1 + c_custkey % 10""",
        customer=t.customer, passes=passes, supplier=t.supplier,
    )
    routes = t.spark.sql("SELECT concat(r_name, ' loop') AS route, array(r_name) AS aliases, transform(sequence(1, 6), i -> concat('pass-', i * 11 + r_regionkey)) AS passes FROM {region}", region=t.region)
    places = t.spark.sql(
        """SELECT concat('Supplier ', s_suppkey, ' Lake ', CASE WHEN s_suppkey % 2 = 0 THEN 'Trailhead' ELSE 'Campground' END) AS place, CASE WHEN s_suppkey % 2 = 0 THEN 'trailhead' ELSE 'campground' END AS kind,
        transform(sequence(1, 7), i -> named_struct('slug', concat('pass-', (s_suppkey * 13 + i * 5) % 190), 'distance_mi', i * 7 % 5 + i / 1e1)) AS passes FROM {supplier}""", supplier=t.supplier,
    )
    return trips, passes, routes, places


@query()
def trip_candidates(t: Tables) -> DataFrame:
    """Forty passes at most that each typed trip may mean. No SQL: likeness is by matching blocks; a test fuses plainly."""
    return trips.candidates(*_trip_inputs(t))


@query(
    """WITH k AS (SELECT c_custkey AS k FROM customer), s AS (SELECT o_custkey AS k, list(DISTINCT o_orderkey % 50) AS held FROM orders GROUP BY o_custkey),
p AS (SELECT k, CASE WHEN k % 50 = k * 3 % 50 THEN [k % 50] ELSE [k % 50, k * 3 % 50] END AS ns FROM k),
h AS (SELECT k, list_filter(ns, lambda n: list_contains(coalesce(held, []), n)) AS ok, ns FROM p LEFT JOIN s USING (k))
SELECT h.k AS trip, array_to_string(list_transform(ok, lambda n: 'pass-' || n), ',') AS passes,
  CASE WHEN k % 4 = 0 AND k % 3 = 0 THEN least(DATE '2024-02-01' + CAST(k % 28 AS INTEGER), DATE '2024-02-10') WHEN k % 4 = 0 THEN DATE '2024-02-01' + CAST(k % 28 AS INTEGER) WHEN k % 3 = 0 THEN DATE '2024-02-10' END AS start,
  CASE WHEN k % 4 = 0 AND k % 3 = 0 THEN greatest(DATE '2024-02-01' + CAST(k % 28 AS INTEGER), DATE '2024-02-10') WHEN k % 4 = 0 THEN DATE '2024-02-01' + CAST(k % 28 AS INTEGER) WHEN k % 3 = 0 THEN DATE '2024-02-10' END AS end,
  CASE WHEN k % 2 = 1 THEN 'hiking' END AS activity, CAST(CASE k % 5 WHEN 0 THEN 3 WHEN 4 THEN 4 END AS INTEGER) AS party_size, 'Near the Lake' AS unplaced,
  array_to_string(list_transform(list_filter(ns, lambda n: NOT list_contains(ok, n)), lambda n: 'pass-' || n) || ['gone-' || k], ',') AS rejected FROM h"""
)
def trip_drafts(t: Tables) -> DataFrame:
    """What a model drafted of each customer's trip, checked against the candidates and the typed text."""
    drafts = t.customer.selectExpr(
        "c_custkey AS trip", "concat('Going near the lake with ', c_name) AS text",
        """concat('{"passes":["pass-', c_custkey % 50, '",7,"pass-', c_custkey % 50, '","pass-', c_custkey * 3 % 50, '","gone-', c_custkey, '"],"start_date":', CASE c_custkey % 4 WHEN 0 THEN concat('"2024-02-', lpad(1 + c_custkey % 28, 2, '0'), '"') WHEN 1 THEN 'null' WHEN 2 THEN '"2024-13-01"' ELSE '"2020-01-01"' END,
        ',"end_date":', if(c_custkey % 3 = 0, '"2024-02-10"', '20240210'), ',"activity":', if(c_custkey % 2 = 1, '"hiking"', '"flying"'), ',"party_size":', CASE c_custkey % 5 WHEN 0 THEN '3' WHEN 1 THEN '"3"' WHEN 2 THEN '2.5' WHEN 3 THEN '100' ELSE '4.0' END,
        ',"unplaced":["Near  the Lake","near the lake!","not typed",5,""]}') AS body""",
    )
    allowed = t.orders.select(F.col("o_custkey").alias("trip"), F.concat(F.lit("pass-"), (F.col("o_orderkey") % 50).cast("string")).alias("slug"))
    told = trips.understood(drafts, allowed, "2024-01-29")
    return told.select("trip", *(F.array_join(c, ",").alias(c) for c in ("passes", "unplaced", "rejected")), "start", "end", "activity", "party_size")
