"""Queries of new snow, stalled sensors, seasons against earlier ones and carried windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import conditions as C
from ..operators import season, season_record
from ..operators import snowfall as S
from .conditions import _RUNS, _linked
from .evidence import _DATES, _LINKS, _SENSOR_LINKS, _links
from .inputs import DATES, Tables
from .registry import ORACLES, query
from .sequences import _SUMMARY

_TODAY = "2024-01-22"
_DEPTHS = "(SELECT station, day, value, CASE WHEN station % 3 > 0 THEN value * 4 END AS depth FROM $snowpack s)"


def _depths(t: Tables) -> DataFrame:
    return t.snowpack.select("station", "day", "value", F.when(F.col("station") % 3 > 0, F.col("value") * 4).alias("depth"))


_CHANGES = f"""SELECT a.station, as_of, round(n.value - b.value, 2) AS water_24h, round(n.depth - b.depth) AS depth_24h, round(n.value - c.value, 2) AS water_72h, round(n.depth - c.depth) AS depth_72h
FROM (SELECT station, max(day) AS as_of FROM {_DEPTHS} x WHERE day <= DATE '{_TODAY}' GROUP BY station HAVING DATE '{_TODAY}' - max(day) <= 2) a JOIN {_DEPTHS} n ON n.station = a.station AND n.day = as_of
LEFT JOIN {_DEPTHS} b ON b.station = a.station AND b.day = as_of - 1 LEFT JOIN {_DEPTHS} c ON c.station = a.station AND c.day = as_of - 3"""


@query(_CHANGES)
def snow_changes(t: Tables) -> DataFrame:
    """What each station gained over one and three days."""
    return S.recent_changes(_depths(t), _TODAY)


_RISE = "CASE WHEN water_{0} BETWEEN 0.3 AND 10 * {1} THEN CASE WHEN depth_{0} IS NULL THEN 'pending' WHEN depth_{0} >= 2 THEN 'depth' END END"


@query(
    f"""WITH v AS (SELECT l.lkey AS slug, c.*, count(*) OVER (PARTITION BY l.lkey) AS checked, {_RISE.format('24h', 1)} AS v1, {_RISE.format('72h', 3)} AS v3 FROM ({_SENSOR_LINKS}) l JOIN ({_CHANGES}) c ON c.station = l.rkey),
o AS (SELECT *, coalesce(v1 = 'depth' OR v1 = 'pending' AND count(v1) OVER (PARTITION BY slug) > 1, false) AS ok1, coalesce(v3 = 'depth' OR v3 = 'pending' AND count(v3) OVER (PARTITION BY slug) > 1, false) AS ok3 FROM v)
SELECT slug, station, as_of, checked, CASE WHEN ok1 THEN CASE WHEN v1 = 'depth' THEN 'depth' ELSE 'nearby station' END WHEN v3 = 'depth' THEN 'depth' ELSE 'nearby station' END AS confirmed_by,
  CASE WHEN ok1 THEN water_24h END AS water_24h, CASE WHEN ok3 THEN water_72h END AS water_72h, CASE WHEN ok1 AND v1 = 'depth' THEN depth_24h END AS depth_24h, CASE WHEN ok3 AND v3 = 'depth' THEN depth_72h END AS depth_72h FROM o WHERE ok1 OR ok3"""
)
def new_snow(t: Tables) -> DataFrame:
    """New snow at the stations of a place, and what confirms it."""
    linked = _linked(t).select("slug", "station").join(S.recent_changes(_depths(t), _TODAY), "station")
    return S.new_snow(linked)


_GAIN = "water_{0} || ' in of {1}' || coalesce(' and ' || CAST(depth_{0} AS BIGINT) || ' in of {2}', '')"


@query(
    f"""WITH n AS (SELECT n.*, 'Station ' || n.station || ' (' || format('{{:,}}', CAST(s.elevation_ft AS BIGINT)) || ' ft, ' || round(l.km / 1.609344, 1) || ' mi away) gained ' AS head, strftime(as_of, '%b %-d') AS until
  FROM ({ORACLES['new_snow']}) n JOIN ({_SENSOR_LINKS}) l ON l.lkey = n.slug AND l.rkey = n.station JOIN $sensors s ON s.key = n.station)
SELECT slug, station, head || CASE WHEN water_24h IS NOT NULL THEN {_GAIN.format('24h', 'snow water', 'snow depth')} || ' in the 24 hours to ' || until || coalesce('; ' || {_GAIN.format('72h', 'water', 'depth')} || ' over 72 hours', '')
  ELSE {_GAIN.format('72h', 'snow water', 'snow depth')} || ' in the 72 hours to ' || until END || '.' AS text FROM n"""
)
def new_snow_told(t: Tables) -> DataFrame:
    """the new snow at the stations of a place in sentences."""
    near = _linked(t).select("slug", "station", "km", F.col("station_ft").alias("elevation_ft"))
    found = S.new_snow(near.select("slug", "station").join(S.recent_changes(_depths(t), _TODAY), "station")).join(near, ["slug", "station"])
    named = found.withColumn("name", F.concat(F.lit("Station "), F.col("station").cast("string"))).withColumn("miles", F.round(F.col("km") / season_record.KM_A_MILE, 1))
    return S.gains_told(named)


@query(
    f"""WITH f AS (SELECT *, count(*) OVER w = 2 AND round(max(value) OVER w - min(value) OVER w, 6) <= 4 AND value >= 1 AS flat FROM $snowpack s WINDOW w AS (PARTITION BY station ORDER BY day ROWS 1 PRECEDING)),
n AS (SELECT station, eval_date, arg_max(value, day) AS value, arg_max(flat, day) AS flat FROM f, {_DATES} e WHERE eval_date - day BETWEEN 0 AND 10 GROUP BY station, eval_date)
SELECT lkey AS slug, eval_date, list_sort(list(station)) AS stations FROM ({_SENSOR_LINKS}) l JOIN n ON n.station = l.rkey WHERE flat AND NOT (gap_ft > 300 AND value < 0.5) GROUP BY lkey, eval_date"""
)
def stalled_stations(t: Tables) -> DataFrame:
    """Voting stations whose last readings hardly moved (two within 4, for these tables)."""
    return S.stalled(t.snowpack, _linked(t).select("slug", "station", "gap_ft"), list(DATES), rows=2, tolerance=4.0)


#: Seasons of the stored series: bare below 1.5, on file wherever there is a reading.
_BARE = "(SELECT station, day, CASE WHEN value < 1.5 THEN 0.0 ELSE value END AS value FROM $season z)"
_MELTS = f"""SELECT station, year, since FROM (SELECT station, year(day) AS year, day, since, row_number() OVER (PARTITION BY station, year(day) ORDER BY day) AS r FROM (
  SELECT station, day, CASE WHEN arg_max(seen, o) OVER w OR day - max(o) OVER w >= 7 THEN max(o) OVER w END AS since, value, max(o) OVER w AS start FROM (
    SELECT *, CASE WHEN opens THEN day END AS o FROM (SELECT *, NOT coalesce(joined AND value < 0.5 AND before < 0.5, false) AS opens, coalesce(joined AND before >= 0.5, false) AS seen FROM (
      SELECT station, day, value, lag(value) OVER (PARTITION BY station ORDER BY day) AS before, coalesce(day - lag(day) OVER (PARTITION BY station ORDER BY day) <= 20 AND year(day) = year(lag(day) OVER (PARTITION BY station ORDER BY day)), false) AS joined FROM {_BARE} b) a) c) d
  WINDOW w AS (PARTITION BY station ORDER BY day ROWS UNBOUNDED PRECEDING)) x WHERE value < 0.5 AND since IS NOT NULL AND day - since >= 7) y WHERE r = 1"""
_SEASON_DAYS = f"""SELECT station, year, since, CASE WHEN since IS NULL THEN 'snow' WHEN since < make_date(year, 4, 1) THEN 'bare_at_start' ELSE 'melted' END AS status,
  CASE WHEN since IS NULL THEN 'inf'::DOUBLE WHEN since < make_date(year, 4, 1) THEN '-inf'::DOUBLE ELSE (since - make_date(year, 4, 1))::DOUBLE END AS day FROM (SELECT DISTINCT station, year(day) AS year FROM $season q) f LEFT JOIN ({_MELTS}) m USING (station, year)"""
_EARLIER = f"""SELECT station, year, status, since, CASE WHEN median IS NULL THEN NULL WHEN status = 'melted' THEN 'exact' WHEN status = 'bare_at_start' THEN 'before_record' ELSE 'still_snow' END AS comparison,
  CASE WHEN median IS NULL THEN NULL WHEN status = 'melted' THEN CAST(sign(day - median) * floor(abs(day - median) + 0.5) AS BIGINT) WHEN status = 'bare_at_start' THEN -CAST(sign(median) * floor(abs(median) + 0.5) AS BIGINT) - 1 END AS days_vs_earlier,
  CASE WHEN median IS NOT NULL THEN years END AS earlier_years
FROM (SELECT *, CASE WHEN len(e) >= 2 AND abs(e[(len(e) + 1) // 2]) < 'inf'::DOUBLE AND abs(e[len(e) // 2 + 1]) < 'inf'::DOUBLE THEN (e[(len(e) + 1) // 2] + e[len(e) // 2 + 1]) / 2 END AS median FROM (
  SELECT *, coalesce(list_sort(list(day) OVER w), []) AS e, coalesce(list(year) OVER w, []) AS years FROM ({_SEASON_DAYS}) d WINDOW w AS (PARTITION BY station ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) a) b"""


def _days(t: Tables) -> DataFrame:
    bare = t.season.withColumn("value", F.when(F.col("value") < 1.5, 0.0).otherwise(F.col("value")))
    on_file = t.season.select("station", F.year("day").alias("year")).distinct()
    return S.season_days(C.first_melt_outs(bare).select("station", "year", "since"), on_file)


@query(f"SELECT station, year, status, comparison, days_vs_earlier, earlier_years FROM ({_EARLIER}) e")
def melt_against_earlier(t: Tables) -> DataFrame:
    """Each season's melt-out against the median of earlier ones with open ends."""
    return S.against_earlier(_days(t))


_NEAR = _LINKS.format(right="$stations", radius=55, k=3)


def _near(t: Tables) -> DataFrame:
    return _links(t, t.stations, 55, 3).select(F.col("lkey").alias("slug"), F.col("rkey").alias("station"), "km", "gap_ft")


@query(
    f"""SELECT slug, year, seasons, n, lo, hi, hi - lo <= 21 AS agree FROM (SELECT *, row_number() OVER (PARTITION BY slug, year ORDER BY seasons DESC, n DESC, km, years DESC) AS r FROM (
  SELECT lkey AS slug, year, CAST(len(earlier_years) AS INTEGER) AS seasons, array_to_string(earlier_years, ',') AS years, count(*) AS n, min(km) AS km, min(days_vs_earlier) AS lo, max(days_vs_earlier) AS hi
  FROM ({_EARLIER}) e JOIN ({_NEAR}) l ON l.rkey = e.station WHERE comparison = 'exact' GROUP BY lkey, year, earlier_years) g) h WHERE r = 1"""
)
def baseline_choice(t: Tables) -> DataFrame:
    """The stations of a place that one baseline is named for."""
    return S.baseline(S.against_earlier(_days(t)), _near(t).select("slug", "station", "km"))


@query(
    f"""WITH r AS (SELECT station, year, CAST(rank() OVER (PARTITION BY station ORDER BY peak DESC) AS INTEGER) AS peak_rank, count(*) OVER (PARTITION BY station) AS n FROM ({_SUMMARY}) s)
SELECT slug, year, peak_rank, list_sort(list(station)) AS stations FROM (SELECT l.lkey AS slug, r.*, max(n) OVER (PARTITION BY l.lkey, year) AS longest FROM r JOIN ({_NEAR}) l ON l.rkey = r.station WHERE n > 2) x WHERE n = longest GROUP BY slug, year, peak_rank"""
)
def peak_facts(t: Tables) -> DataFrame:
    """The rank of a season's peak at the stations of a place with the longest record."""
    own = Window.partitionBy("station")
    ranked = season.summaries(t.season).select("station", "year", F.rank().over(own.orderBy(F.desc("peak"))).alias("peak_rank"), F.count("*").over(own).alias("of")).filter("of > 2")
    return S.peak_ranks(ranked, _near(t).select("slug", "station"))


@query(
    f"""WITH m AS (SELECT l.lkey AS slug, d.year, d.status, l.gap_ft, f.last, CASE WHEN d.status = 'melted' AND abs(l.gap_ft) <= 2500 THEN d.since + CAST(floor(least(l.gap_ft / 40e0, l.gap_ft / 1e2) - 21) AS INTEGER) END AS lo,
  CASE WHEN d.status = 'melted' AND abs(l.gap_ft) <= 2500 THEN d.since + CAST(ceil(greatest(l.gap_ft / 40e0, l.gap_ft / 1e2) + 21) AS INTEGER) END AS hi
  FROM ({_SEASON_DAYS}) d JOIN ({_NEAR}) l ON l.rkey = d.station JOIN (SELECT station, year(day) AS year, max(day) AS last FROM $season q GROUP BY ALL) f ON f.station = d.station AND f.year = d.year),
g AS (SELECT slug, year, list_sort(list(lo - DATE '1970-01-01') FILTER (WHERE lo IS NOT NULL)) AS a, list_sort(list(hi - DATE '1970-01-01') FILTER (WHERE hi IS NOT NULL)) AS b, max(lo) > min(hi) AS apart, max(last) FILTER (WHERE status = 'snow' AND gap_ft >= 0) AS fl FROM m GROUP BY slug, year),
w AS (SELECT slug, year, apart, fl, DATE '1970-01-01' + CAST(floor((a[(len(a) + 1) // 2] + a[len(a) // 2 + 1]) / 2) AS INTEGER) AS s, DATE '1970-01-01' + CAST(ceil((b[(len(b) + 1) // 2] + b[len(b) // 2 + 1]) / 2) AS INTEGER) AS e FROM g WHERE len(a) > 0),
z AS (SELECT *, CASE WHEN apart OR coalesce(fl > e, false) THEN 'disagree' WHEN year(e) <> year OR strftime(e, '%m-%d') > '10-15' THEN 'none' ELSE 'window' END AS state FROM w)
SELECT slug, year, state, CASE WHEN state = 'window' THEN greatest(s, fl) END AS start, CASE WHEN state = 'window' THEN e END AS end FROM z"""
)
def carried_windows(t: Tables) -> DataFrame:
    """When snow leaves each place, carried from its stations."""
    last = t.season.groupBy("station", F.year("day").alias("year")).agg(F.max("day").alias("last"))
    return S.windows(_days(t), _near(t).select("slug", "station", "gap_ft"), last)


_NOW = "1998-07-20"
_SEASONS = f"""WITH o AS (SELECT station * 10000 + year(day) AS k, day, CASE WHEN value < 1.5 THEN 0.0 ELSE value * 4 END AS value FROM $season z WHERE strftime(day, '%m-%d') BETWEEN '04-01' AND '08-31' AND day <= DATE '{_NOW}'),
n AS (SELECT *, lag(value) OVER w AS pv, lag(day) OVER w AS pd, lead(value) OVER w AS nv, lead(day) OVER w AS nd FROM o WINDOW w AS (PARTITION BY k ORDER BY day)),
s AS (SELECT k, day, value FROM n WHERE NOT coalesce(abs(pv - value) > 17 * (day - pd) AND abs(value - nv) > 17 * (nd - day) AND NOT abs(pv - nv) > 17 * (nd - pd), false)),
f AS (SELECT *, day - lag(day) OVER w AS gap, value - lag(value) OVER w AS step, value >= 0.5 AND value < 6.2 AS inside FROM s WINDOW w AS (PARTITION BY k ORDER BY day)),
g AS (SELECT *, sum(CASE WHEN inside THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY day ROWS UNBOUNDED PRECEDING) AS island FROM f),
i AS (SELECT k, max(day) FILTER (WHERE inside) - min(day) FILTER (WHERE inside) AS span, bool_or(coalesce(abs(step) > 17 * gap, false)) AS erratic, count(*) FILTER (WHERE gap = 1 AND step >= 0.3 AND value < 6.2) AS rises FROM g GROUP BY k, island),
b AS (SELECT k, bool_or(erratic) AS erratic, bool_or(coalesce(span > 28, false)) AS lingers, sum(rises) > 8 AS wanders FROM i GROUP BY k),
u AS (SELECT *, sum(CASE WHEN value >= 0.5 THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY day ROWS UNBOUNDED PRECEDING) AS island FROM s WHERE strftime(day, '%m-%d') >= '06-01'),
h AS (SELECT a.k, bool_or(e.day = (SELECT min(x.day) FROM u x WHERE x.k = a.k AND x.island = a.island AND x.value >= 0.5 AND x.day >= a.day - 28) AND a.day - e.day >= 26 AND e.value - a.value < 1) AS holds
  FROM u a JOIN u e ON e.k = a.k AND e.island = a.island AND e.value >= 0.5 AND e.day BETWEEN a.day - 28 AND a.day WHERE a.value >= 0.5 GROUP BY a.k),
r AS ({_RUNS.format(keys='k', source='s')}),
m AS (SELECT k, since, observed FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY day) AS i FROM r WHERE value < 0.5 AND day - since >= 7) x WHERE i = 1),
l AS (SELECT k, day AS last, value AS last_value, since AS end_since, observed AS end_observed FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY day DESC) AS i FROM r) x WHERE i = 1),
w AS (SELECT k, min(day) AS first, max(value) AS peak, arg_min(day, (-value, day)) AS peak_day, min(day) FILTER (WHERE value >= 0.5) AS snow_from FROM s GROUP BY k),
c AS (SELECT *, CASE WHEN erratic THEN 'erratic' WHEN lingers THEN 'residual' WHEN wanders THEN 'wandering' WHEN holds THEN 'stuck' END AS fault, least(make_date(k % 10000, 8, 31), DATE '{_NOW}') - last <= 10 AS current
  FROM w JOIN l USING (k) JOIN b USING (k) LEFT JOIN m USING (k) LEFT JOIN h USING (k)),
d AS (SELECT *, CASE WHEN fault IS NOT NULL THEN fault WHEN since IS NOT NULL THEN CASE WHEN observed THEN 'melted' WHEN snow_from < since THEN 'gap' ELSE 'bare_at_start' END
  WHEN last_value >= 0.5 THEN CASE WHEN current THEN 'snow' ELSE 'quiet' END WHEN current THEN 'unconfirmed' WHEN end_observed THEN 'melted' ELSE 'quiet' END AS outcome,
  fault IS NULL AND first - make_date(k % 10000, 4, 1) <= 7 AND NOT coalesce(NOT observed AND since = first, false) AS peaked FROM c)
SELECT k // 10000 AS station, CAST(k % 10000 AS INTEGER) AS year, CASE WHEN outcome IN ('melted', 'snow', 'bare_at_start') THEN outcome ELSE 'unusable' END AS status, CASE WHEN outcome NOT IN ('melted', 'snow', 'bare_at_start') THEN outcome END AS reason,
  CASE WHEN outcome = 'melted' THEN coalesce(since, end_since) END AS melt_out, CASE WHEN peaked THEN round(peak, 1) END AS peak, CASE WHEN peaked THEN peak_day END AS peak_day, last, round(last_value, 1) AS last_value FROM d"""


def _melting(t: Tables) -> DataFrame:
    """The stored series as water on the ground: bare below 1.5, else fourfold."""
    return t.season.withColumn("value", F.when(F.col("value") < 1.5, 0.0).otherwise(F.col("value") * 4))


@query(_SEASONS)
def station_seasons(t: Tables) -> DataFrame:
    """What each season of a station comes to, and why it has no date (17 a day is steep and 6.2 thin, for these tables)."""
    return season_record.station_seasons(_melting(t), _NOW, steep=17.0, thin=6.2)


@query()
def season_records(t: Tables) -> DataFrame:
    """The season of each place against earlier ones at its stations, its facts in sentences. No SQL: tested against ``station_seasons``."""
    here = t.stations.select(F.col("key").alias("station"), "name", (F.col("key") % 2).alias("network"), "lat", "lon", F.col("elevation_ft").cast("double").alias("elevation_ft"))
    linked = _near(t).select("slug", "station", F.col("km").alias("distance_km"), "gap_ft").join(here, "station")
    linked = linked.withColumn("place_ft", F.col("elevation_ft") + F.col("gap_ft")).drop("gap_ft")
    told = season_record.records(linked, _melting(t), _NOW, steep=17.0, thin=6.2)
    sentences = F.transform("facts", lambda f: F.concat(f["kind"], F.lit(": "), f["text"]))
    return told.select(
        "slug", "year", F.array_join(F.col("earlier_years").cast("array<string>"), ",").alias("earlier_years"), F.col("melt_out.kind").alias("kind"), "melt_out.min_days", "melt_out.max_days", "melt_out.agree",
        F.col("pass_window.state").alias("state"), F.col("pass_window.from").alias("start"), F.col("pass_window.through").alias("end"), F.col("chart.station").alias("charted"), F.array_join(sentences, "\n").alias("facts"),
    )
