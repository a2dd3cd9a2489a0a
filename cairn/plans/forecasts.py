"""Queries of forecast grids, landed as documents and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import forecast as W
from ..operators import trip_summary
from .inputs import Tables
from .registry import query

_TODAY = "1998-03-10"
#: A layer's value, six to sixty hours from an order's date on, of one of fifty places.
_VALUES = """(SELECT o_custkey % 50 AS slug, 1200 + (o_custkey % 50) * 10e0 AS elevation_m, o_orderdate + INTERVAL 1 HOUR * (o_orderkey % 24) AS s, 6 + o_orderkey % 54 AS hours, o_orderkey % 6 AS layer,
  CASE o_orderkey % 6 WHEN 0 THEN o_totalprice % 30 - 10 WHEN 1 THEN 1000 + o_totalprice % 2000 WHEN 3 THEN o_totalprice % 40 WHEN 5 THEN o_totalprice % 90 ELSE o_totalprice % 70 END AS value FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1998-03-01' AND TIMESTAMP '1998-03-20')"""
_SPLIT = f"""(SELECT slug, elevation_m, layer, value, day, (epoch(least(e, timezone('UTC', timezone('America/Los_Angeles', CAST(day + 1 AS TIMESTAMP))))) - epoch(greatest(s, timezone('UTC', timezone('America/Los_Angeles', CAST(day AS TIMESTAMP)))))) / (hours * 3600) AS share
  FROM (SELECT *, s + INTERVAL 1 HOUR * hours AS e, CAST(unnest(generate_series(CAST(timezone('America/Los_Angeles', timezone('UTC', s)) AS DATE), CAST(timezone('America/Los_Angeles', timezone('UTC', s + INTERVAL 1 HOUR * hours)) AS DATE), INTERVAL 1 DAY)) AS DATE) AS day FROM {_VALUES} v) x)"""
_DAYS = f"""SELECT slug, day, CAST(round(max(f)) AS BIGINT) AS high_f, CAST(round(min(f)) AS BIGINT) AS low_f, CAST(round(min(value) FILTER (WHERE layer = 1) * 3.28084 / 100) * 100 AS BIGINT) AS snow_level_ft,
  CAST(round(coalesce(max(value) FILTER (WHERE layer = 2), 0)) AS BIGINT) AS precip_chance, round(coalesce(sum(value * share) FILTER (WHERE layer = 3), 0) / 25.4, 1) AS snowfall_in,
  CAST(round(coalesce(max(value) FILTER (WHERE layer = 4), 0)) AS BIGINT) AS thunder_chance, CAST(round(coalesce(max(value) FILTER (WHERE layer = 5), 0) * 0.621371) AS BIGINT) AS gust_mph, any_value(elevation_ft) AS elevation_ft
FROM (SELECT *, CASE WHEN layer = 0 THEN value * 9 / 5 + 32 - (elevation_ft - elevation_m * 3.28084) / 1000 * 3.5 END AS f FROM (SELECT *, 5000 + slug * 60 AS elevation_ft FROM {_SPLIT} s) b WHERE share > 0 AND day - DATE '{_TODAY}' BETWEEN 0 AND 6) c GROUP BY slug, day"""


def grids(t: Tables) -> DataFrame:
    """Grid documents, one per place."""
    near = t.orders.filter("o_orderdate between timestamp_ntz'1998-03-01' and timestamp_ntz'1998-03-20'")
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    start = F.col("o_orderdate") + F.make_dt_interval(hours=(key % 24).cast("int"))
    hours = 6 + key % 54
    days, rest = F.floor(hours / 24), hours % 24
    lasting = F.concat(F.lit("P"), F.when(days > 0, F.concat(days.cast("string"), F.lit("D"))).otherwise(""), F.when(rest > 0, F.concat(F.lit("T"), rest.cast("string"), F.lit("H"))).otherwise(""))
    value = F.when(key % 6 == 0, price % 30 - 10).when(key % 6 == 1, 1000 + price % 2000).when(key % 6 == 3, price % 40).when(key % 6 == 5, price % 90).otherwise(price % 70)
    entry = F.struct(F.concat(F.date_format(start, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00/"), lasting).alias("validTime"), value.alias("value"))
    rows = near.select((F.col("o_custkey") % 50).alias("slug"), (key % 6).alias("layer"), entry.alias("e"))
    layers = rows.groupBy("slug").agg(*(F.collect_list(F.when(F.col("layer") == i, F.col("e"))).alias(n) for i, n in enumerate(W.LAYERS)))
    return layers.select("slug", F.to_json(F.struct(F.struct((1200 + F.col("slug") * 10.0).alias("value")).alias("elevation"), *(F.struct(F.col(n).alias("values")).alias(n) for n in W.LAYERS))).alias("doc"))


def _days(t: Tables) -> DataFrame:
    places = t.spark.range(50).select(F.col("id").alias("slug"), (5000 + F.col("id") * 60).alias("elevation_ft"))
    return W.by_day(W.layers(grids(t)), places, _TODAY)


@query(_DAYS)
def forecast_days(t: Tables) -> DataFrame:
    """Grid documents read, intervals split at local midnights, a row per place and day."""
    return _days(t)


@query(
    f"""WITH n AS (SELECT *, CASE day - DATE '{_TODAY}' WHEN 0 THEN 'today' WHEN 1 THEN 'tomorrow' ELSE strftime(day, '%A') END AS name FROM ({_DAYS}) d), p AS (SELECT DISTINCT slug FROM n),
s AS (SELECT slug, 'New snow possible ' || name || ': the forecast snow level drops to ' || format('{{:,}}', snow_level_ft) || ' ft, below the pass, with a ' || precip_chance || '% chance of precipitation' || CASE WHEN snowfall_in >= 0.5 THEN ', about ' || snowfall_in || ' in on the grid' ELSE '' END || '.' AS f
  FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY snow_level_ft, day) AS r FROM n WHERE snow_level_ft < elevation_ft AND precip_chance >= 30) x WHERE r = 1),
t AS (SELECT slug, 'Thunderstorms possible ' || name || ' (' || thunder_chance || '% chance); the pass is exposed terrain.' AS f FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY thunder_chance DESC, day) AS r FROM n WHERE thunder_chance >= 25) x WHERE r = 1),
w AS (SELECT slug, 'Strong wind ' || name || ', gusts near ' || gust_mph || ' mph.' AS f FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY gust_mph DESC, day) AS r FROM n WHERE gust_mph >= 45) x WHERE r = 1),
m AS (SELECT slug, 'No snow or storms in the forecast this week; highs near ' || CAST(round(avg(high_f)) AS BIGINT) || '°F at pass elevation.' AS f FROM n GROUP BY slug)
SELECT p.slug, CASE WHEN s.f IS NULL AND t.f IS NULL AND w.f IS NULL THEN coalesce(m.f, '') ELSE array_to_string(list_filter([s.f, t.f, w.f], lambda x: x IS NOT NULL)[1:2], ' ') END AS facts
FROM p LEFT JOIN s USING (slug) LEFT JOIN t USING (slug) LEFT JOIN w USING (slug) LEFT JOIN m USING (slug)"""
)
def forecast_headlines(t: Tables) -> DataFrame:
    """A24."""
    return W.headlines(_days(t), _TODAY)


@query(f"SELECT slug, min(day) AS \"from\", max(day) AS through, round(sum(snowfall_in), 1) AS total_in FROM ({_DAYS}) d WHERE day - DATE '{_TODAY}' BETWEEN 0 AND 2 GROUP BY slug HAVING round(sum(snowfall_in), 1) >= 0.5")
def forecast_snowfall(t: Tables) -> DataFrame:
    """A25."""
    return W.snowfall(_days(t), _TODAY)


_ISSUED = f"CASE WHEN slug % 7 > 0 THEN DATE '{_TODAY}' + CAST(slug % 5 - 2 AS INT) END"


@query(f"SELECT slug, day, issued_for, snow_level_ft FROM (SELECT *, {_ISSUED} AS issued_for FROM ({_DAYS}) d) x WHERE issued_for BETWEEN DATE '{_TODAY}' - 1 AND DATE '{_TODAY}' + 1 AND day >= DATE '{_TODAY}'")
def forecast_days_in_force(t: Tables) -> DataFrame:
    """C14: the days of forecasts that are current."""
    return W.in_force(_days(t).withColumn("issued_for", F.expr(_ISSUED)), _TODAY).select("slug", "day", "issued_for", "snow_level_ft")


_STOPS = f"""SELECT l_orderkey AS trip, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos, l_suppkey % 50 AS slug, s_name AS name, 3000 + (l_suppkey * 131) % 8000 AS elevation_ft, CASE l_returnflag WHEN 'A' THEN 'Open' WHEN 'N' THEN 'Traction advised' ELSE 'Snow caution' END AS label,
  CASE WHEN l_tax < 0.03 THEN 'high' ELSE 'low' END AS confidence, CASE WHEN l_orderkey % 3 = 0 AND l_linenumber > 2 THEN DATE '{_TODAY}' - 400 ELSE DATE '{_TODAY}' - CAST(l_orderkey % 2 AS INT) END AS as_of FROM {{lineitem}} JOIN {{supplier}} ON s_suppkey = l_suppkey"""


def _listed(x: str) -> str:
    return f"(CASE WHEN len({x}) <= 1 THEN array_to_string({x}, '') ELSE array_to_string({x}[:len({x}) - 1], ', ') || ' and ' || {x}[len({x})] END)"


def _label(d: str) -> str:
    return f"strftime({d}, '%a, %b %-d') || CASE WHEN year({d}) = {_TODAY[:4]} THEN '' ELSE strftime({d}, ', %Y') END"


def _kinds(field: str) -> str:
    return f"SELECT trip, list(n || ' ' || k ORDER BY p) AS l FROM (SELECT trip, {field} AS k, count(*) AS n, min(pos) AS p FROM s GROUP BY ALL) x GROUP BY trip"


def _worst(field: str) -> str:
    top = f"SELECT trip, {field} AS v, day FROM (SELECT *, row_number() OVER (PARTITION BY trip ORDER BY {field} DESC, pos, day) AS r FROM a WHERE {field} IS NOT NULL) x WHERE r = 1"
    return f"SELECT trip, any_value(v) AS v, any_value(day) AS day, list(name ORDER BY p) AS l FROM (SELECT t.trip, t.v, t.day, a.name, min(a.pos) AS p FROM ({top}) t JOIN a ON a.trip = t.trip AND a.day = t.day AND a.{field} = t.v GROUP BY ALL) y GROUP BY trip"


def _line(x: str, word: str) -> str:
    return f"""CASE WHEN {x}.v > 0 THEN 'Highest chance of {word} in the forecast for the trip''s days: ' || {x}.v || '% on ' || {_label(x + '.day')} || ' at ' || {_listed(x + '.l')} || '.'
  WHEN {x}.v <= 0 THEN 'The forecast for the trip''s days shows a 0% chance of {word} at every pass that has one.' END"""


@query(
    f"""WITH s AS ({_STOPS.format(lineitem='lineitem', supplier='supplier')}), a AS (SELECT s.trip, s.pos, s.name, d.day, d.precip_chance, d.thunder_chance FROM s JOIN ({_DAYS}) d USING (slug)),
n AS (SELECT trip, count(*) AS n, count(DISTINCT as_of) AS dates, min(as_of) AS as_of FROM s GROUP BY trip), k AS ({_kinds('lower(label)')}), c AS ({_kinds('confidence')}),
h AS (SELECT trip, name, elevation_ft FROM (SELECT *, row_number() OVER (PARTITION BY trip ORDER BY elevation_ft DESC, pos) AS r FROM s) x WHERE r = 1), p AS ({_worst('precip_chance')}), t AS ({_worst('thunder_chance')})
SELECT n.trip, n.n || CASE WHEN n.n = 1 THEN ' pass' ELSE ' passes' END || ' on this plan, ' || CASE WHEN dates = 1 THEN 'as of ' || {_label('as_of')} || CASE WHEN as_of = DATE '{_TODAY}' THEN ', today' ELSE '' END ELSE 'each as of the date shown on it' END || ': ' || {_listed('k.l')} || '. Confidence: ' || {_listed('c.l')} || '.' AS verdicts,
  CASE WHEN n.n > 1 THEN 'Highest pass: ' || h.name || ', ' || format('{{:,}}', CAST(h.elevation_ft AS BIGINT)) || ' ft.' END AS highest, {_line('p', 'precipitation')} AS precipitation, {_line('t', 'thunder')} AS thunder
FROM n JOIN k USING (trip) JOIN c USING (trip) JOIN h USING (trip) LEFT JOIN p USING (trip) LEFT JOIN t USING (trip)"""
)
def trip_summaries(t: Tables) -> DataFrame:
    """What a trip's stops come to: verdicts counted, the highest, the worst days of the forecast with all that tie."""
    stops = t.spark.sql(_STOPS, lineitem=t.lineitem, supplier=t.supplier)
    return trip_summary.summaries(stops, _days(t), _TODAY)
