"""Queries of all evidence about places as of dates: each component, and the fused verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import conditions as C
from ..operators import fusion, ledger, links, screen
from .evidence import _DATES, _SENSOR_LINKS, _links
from .inputs import DATES, Tables
from .registry import query

_D = list(DATES)

#: The ceiling of the stored tables' readings, which are not in inches.
CEILING = 14.0
#: Screening in SQL: the stored readings are of January, where no flat run is a fault, so the ceiling alone rejects.
_JUDGED = f"""(SELECT *, CASE WHEN value > 14 THEN 'rejected' WHEN last > 14 AND eval_date - day <= 10 THEN 'silent' ELSE 'believed' END AS state
  FROM (SELECT s.*, eval_date, arg_max(value, (day, ord)) OVER (PARTITION BY station, eval_date) AS last, day = max(day) OVER (PARTITION BY station, eval_date) AS newest FROM $snowpack s, {_DATES} e WHERE day <= eval_date) j)"""
_NEWEST = f"""SELECT station, eval_date, arg_max(day, (day, -ord)) AS day, arg_max(value, (day, -ord)) AS value, eval_date - max(day) AS age, min(day) AS first_day, arg_min(value, (day, ord)) AS first_value
FROM {_JUDGED} r WHERE state = 'believed' AND eval_date - day BETWEEN 0 AND 10 GROUP BY station, eval_date"""
_FAULTY = f"SELECT station, eval_date, value, 'ceiling' AS reason, day AS since FROM {_JUDGED} r WHERE newest AND state = 'rejected' AND eval_date - day <= 10"
_LINKED = f"""SELECT l.lkey AS slug, n.*, l.km, l.gap_ft, s.elevation_ft AS station_ft FROM ({_SENSOR_LINKS}) l JOIN ({_NEWEST}) n ON n.station = l.rkey JOIN $sensors s ON s.key = l.rkey"""
_BLIND = "(gap_ft > 300 AND value < 0.5)"
_W = "(1 / (1 + coalesce(nullif(km, 0.0), 20.0) / 10) / (1 + abs(gap_ft) / 3000))"
_SENSORS = f"""SELECT slug, eval_date, round(least(3.0, swe / 15.0 * 3), 2) AS severity, round(swe, 1) AS swe, round((swe - first) / span, 2) AS trend, age, 0.9 * pow(0.5, age / 4.0) AS weight, stations FROM (
  SELECT slug, eval_date, sum({_W} * value) / sum({_W}) AS swe, avg(first_value) AS first, greatest(max(day) - min(first_day), 1) AS span, min(age) AS age, list_sort(list(DISTINCT station)) AS stations
  FROM ({_LINKED}) x WHERE NOT {_BLIND} GROUP BY slug, eval_date) y"""
#: Runs by a recursive definition: a reading's run starts where no joined bare reading precedes it.
_RUNS = """SELECT {keys}, day, value, since, observed FROM (
  SELECT *,
    CASE WHEN value < 0.5 AND (arg_max(seen, CASE WHEN opens THEN day END) OVER w OR day - max(CASE WHEN opens THEN day END) OVER w >= 7) THEN max(CASE WHEN opens THEN day END) OVER w END AS since,
    CASE WHEN value < 0.5 AND (arg_max(seen, CASE WHEN opens THEN day END) OVER w OR day - max(CASE WHEN opens THEN day END) OVER w >= 7) THEN arg_max(seen, CASE WHEN opens THEN day END) OVER w END AS observed
  FROM (SELECT *, NOT coalesce(joined AND value < 0.5 AND before < 0.5, false) AS opens, coalesce(joined AND before >= 0.5, false) AS seen
    FROM (SELECT {keys}, day, value, lag(value) OVER (PARTITION BY {keys} ORDER BY day) AS before,
      coalesce(day - lag(day) OVER (PARTITION BY {keys} ORDER BY day) <= 20 AND year(day) = year(lag(day) OVER (PARTITION BY {keys} ORDER BY day)), false) AS joined FROM {source} s) a) b
  WINDOW w AS (PARTITION BY {keys} ORDER BY day ROWS UNBOUNDED PRECEDING)) c"""
_AS_OF = _RUNS.format(keys="station, eval_date", source=f"(SELECT * FROM {_JUDGED} j WHERE state = 'believed' AND year(day) = year(eval_date))")
_SNOW_LINES = f"""SELECT slug, eval_date, CAST(round(least(line, 14500.0) / 100) AS BIGINT) AS hundreds, station, since, observed, quiet_since, station_ft,
  CAST(round(CAST(CASE WHEN place_ft - line <= -500 THEN 0.0 WHEN place_ft - line <= 0 THEN 0.5 ELSE least(2e0, 5e-1 + (place_ft - line) / 1e3) END AS DECIMAL(12,6)), 2) AS DOUBLE) AS severity, 0.405 AS weight
FROM (SELECT *, row_number() OVER (PARTITION BY slug, eval_date ORDER BY line DESC, station) AS r FROM (
  SELECT l.lkey AS slug, eval_date, r.station, r.since, r.observed, s.elevation_ft + 40e0 * (eval_date - r.since) AS line, s.elevation_ft + l.gap_ft AS place_ft,
    CASE WHEN eval_date - r.day > 10 THEN r.day END AS quiet_since, s.elevation_ft AS station_ft
  FROM (SELECT *, row_number() OVER (PARTITION BY station, eval_date ORDER BY day DESC) AS back FROM ({_AS_OF}) o) r
  JOIN ({_SENSOR_LINKS}) l ON l.rkey = r.station JOIN $sensors s ON s.key = r.station
  WHERE back = 1 AND r.since IS NOT NULL AND CASE WHEN eval_date - r.day > 10 THEN r.value < 0.5 AND strftime(eval_date, '%m-%d') <= '10-15' ELSE l.gap_ft > 300 AND r.value < 0.5 END) x) y WHERE r = 1"""
_REJECTED = f"SELECT station, day, eval_date FROM {_JUDGED} q WHERE state = 'rejected'"
_SCENES = f"""SELECT slug, eval_date, round(cover * 3, 2) AS severity, cover, age, coalesce(modeled, false) AS modeled, 0.65 * pow(0.5, age / 3.0) AS weight FROM (
  SELECT s.*, eval_date, eval_date - day AS age, row_number() OVER (PARTITION BY slug, eval_date ORDER BY day DESC, cover DESC) AS r FROM $scenes s, {_DATES} e
  WHERE eval_date - day BETWEEN 0 AND 12 AND NOT EXISTS (SELECT 1 FROM ({_REJECTED}) t WHERE t.station = s.from_station AND t.day = s.day AND t.eval_date = e.eval_date)) x WHERE r = 1"""
_SAID = """SELECT * FROM (SELECT *, (coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT, 0) AS said FROM (
  SELECT slug, day, CASE snow WHEN 'none' THEN 0.0 WHEN 'patchy' THEN 1.0 WHEN 'continuous' THEN 2.0 WHEN 'deep' THEN 3.0 END::DOUBLE AS a,
    CASE traction WHEN 'none' THEN 0.0 WHEN 'microspikes' THEN 1.5 WHEN 'crampons' THEN 2.25 WHEN 'ice_axe' THEN 2.5 WHEN 'spikes_and_axe' THEN 2.75 END::DOUBLE AS b,
    CASE comfort WHEN 'relaxed' THEN 0.0 WHEN 'cautious' THEN greatest(0.0, 1.0 + off) WHEN 'sketchy' THEN 2.0 + off WHEN 'terrifying' THEN least(3.0, 3.0 + off) END::DOUBLE AS c
  FROM (SELECT *, CASE register WHEN 'first_timer' THEN -0.75 WHEN 'thru_hiker' THEN 0.5 WHEN 'experienced' THEN 0.25 ELSE 0.0 END AS off FROM $told t) u) v) w WHERE said IS NOT NULL"""
_REPORTS = f"""SELECT slug, eval_date, round(s, 2) AS severity, n_reports, age, 0.75 * pow(0.5, age / 5.0) * least(1.0, n_reports / 2.0) AS weight FROM (
  SELECT slug, eval_date, sum(said * pow(0.5, (eval_date - day) / 5.0)) / sum(pow(0.5, (eval_date - day) / 5.0)) AS s, count(*) AS n_reports, min(eval_date - day) AS age
  FROM ({_SAID}) t, {_DATES} e WHERE eval_date - day BETWEEN 0 AND 14 GROUP BY slug, eval_date) x"""
_WORST = f"""SELECT slug, eval_date, list_extract(['dry', 'low', 'knee_high', 'thigh_high', 'dangerous'], CAST(max(step) AS INTEGER)) AS worst FROM (
  SELECT slug, day, list_position(['dry', 'low', 'knee_high', 'thigh_high', 'dangerous'], crossing) AS step FROM $told t WHERE crossing IS NOT NULL) t, {_DATES} e WHERE eval_date - day BETWEEN 0 AND 14 GROUP BY slug, eval_date"""
_CREEKS = f"""SELECT slug, eval_date, flow, CASE WHEN n < 4 OR flow IS NULL THEN NULL WHEN flow < first * 0.92 THEN 'dropping' WHEN flow > first * 1.08 THEN 'rising' ELSE 'steady' END AS flow_trend, round(swing, 1) AS swing, coalesce(swing >= 35, false) AS active_melt FROM (
  SELECT slug, eval_date, arg_max(value, (day, ord)) FILTER (WHERE metric = 'discharge_cfs') AS flow, arg_min(value, (day, ord)) FILTER (WHERE metric = 'discharge_cfs') AS first, count(*) FILTER (WHERE metric = 'discharge_cfs') AS n,
    avg(value) FILTER (WHERE metric = 'diurnal_swing_pct' AND eval_date - day <= 7) AS swing
  FROM $gauges g, {_DATES} e WHERE eval_date - day BETWEEN 0 AND 10 GROUP BY slug, eval_date) x"""


def _linked(t: Tables) -> DataFrame:
    """Links of places with their three nearest stations: slug, station, km, gap_ft, station_ft."""
    there = t.sensors.select(F.col("key").alias("rkey"), F.col("elevation_ft").alias("station_ft"))
    return _links(t, t.sensors, 55, 3).join(there, "rkey").select(F.col("lkey").alias("slug"), F.col("rkey").alias("station"), "km", "gap_ft", "station_ft")


def _judged(t: Tables) -> DataFrame:
    return screen.judged_as_of(t.snowpack, _D, CEILING)


def _read(t: Tables) -> DataFrame:
    return _linked(t).join(C.newest(_judged(t)), "station")


def _rejected(t: Tables) -> DataFrame:
    return _judged(t).filter("state = 'rejected'").select("station", "eval_date", "day")


@query(f"SELECT station, eval_date, value, reason, since FROM ({_FAULTY}) f")
def faulty_stations(t: Tables) -> DataFrame:
    """Stations that a date's verdicts leave out, as their newest reading is rejected."""
    return C.faulty(_judged(t))


@query(f"SELECT slug, eval_date, severity, swe, trend, age, round(weight, 6) AS weight, stations FROM ({_SENSORS}) s")
def sensor_component(t: Tables) -> DataFrame:
    """Weighted water of the stations that see a place, and its trend."""
    return C.sensors(_read(t)).withColumn("weight", F.round("weight", 6))


@query(
    f"""SELECT slug, eval_date, CAST(count(*) AS INTEGER) AS blind, CAST(round(min(gap_ft)) AS BIGINT) AS min_gap_ft,
  list_aggregate(list_slice(list(station || ' (' || format('{{:,}}', station_ft) || ' ft)' ORDER BY station_ft DESC, station), 1, 3), 'string_agg', ', ') AS named FROM ({_LINKED}) x WHERE {_BLIND} GROUP BY slug, eval_date"""
)
def blind_stations(t: Tables) -> DataFrame:
    """A12, P04, K03."""
    return C.blind(_read(t))


@query(f"SELECT slug, eval_date, hundreds, station, since, observed, severity FROM ({_SNOW_LINES}) s")
def snow_line_estimate(t: Tables) -> DataFrame:
    """The snow line that melted-out stations imply."""
    return C.believed_lines(_linked(t), _judged(t)).drop("weight", "quiet_since", "station_ft")


@query(
    f"""SELECT station, year, since, observed FROM (SELECT station, year(day) AS year, since, observed, row_number() OVER (PARTITION BY station, year(day) ORDER BY day) AS r
FROM ({_RUNS.format(keys='station', source='(SELECT station, day, CASE WHEN value < 3 THEN 0.0 ELSE value END AS value FROM $season z)')}) x WHERE value < 0.5 AND day - since >= 7) y WHERE r = 1"""
)
def first_melt_out(t: Tables) -> DataFrame:
    """The earliest reading of a year at which a bare run has lasted a week."""
    return C.first_melt_outs(t.season.withColumn("value", F.when(F.col("value") < 3, 0.0).otherwise(F.col("value"))))


@query(f"SELECT slug, eval_date, severity, age, modeled, round(weight, 6) AS weight FROM ({_SCENES}) s")
def satellite_component(t: Tables) -> DataFrame:
    """The newest trusted scene."""
    return C.scenes(t.scenes, _D, _rejected(t)).drop("cover").withColumn("weight", F.round("weight", 6))


@query(f"SELECT slug, eval_date, severity, n_reports, age, round(weight, 6) AS weight FROM ({_REPORTS}) r")
def report_component(t: Tables) -> DataFrame:
    """Reports calibrated by their writers' experience, fresher ones weighing more."""
    return C.reports(t.told, _D).withColumn("weight", F.round("weight", 6))


@query(_WORST)
def worst_crossing(t: Tables) -> DataFrame:
    """A09."""
    return C.worst_crossings(t.told, _D)


@query(_CREEKS)
def creek_facts(t: Tables) -> DataFrame:
    """A10, A11."""
    return C.creeks(t.gauges, _D)


_S = {"sensor": "a", "snow_line": "b", "satellite": "c", "reports": "d"}
_NAME = {"a": "'Sensors'", "b": "'The snow line estimate'", "c": "CASE WHEN modeled THEN 'Modeled snow cover' ELSE 'Satellite' END", "d": "'Parties on the ground'"}
_VERB = {"a": ("suggest", "do"), "b": ("suggests", "does"), "c": ("suggests", "does"), "d": ("suggest", "do")}
_PAIRS = [(x, y) for i, x in enumerate("abcd") for y in "abcd"[i + 1 :]]


def _sentence(hi: str, lo: str) -> str:
    half = "format('{{:.1f}}', round_even({0}, 1))"
    return f"{_NAME[hi]} || ' {_VERB[hi][0]} more snow than ' || lower({_NAME[lo]}) || ' {_VERB[lo][1]} (severity ' || {half.format(hi)} || ' vs ' || {half.format(lo)} || ').'"


_CONFLICTS = ", ".join(f"CASE WHEN abs({x} - {y}) > 1.0 THEN CASE WHEN {x} < {y} THEN {_sentence(y, x)} ELSE {_sentence(x, y)} END END" for x, y in _PAIRS)
_DIFFER = "greatest(0.0, " + ", ".join(f"coalesce(abs({x} - {y}), 0.0)" for x, y in _PAIRS) + ")"
_EVIDENCE = f"""w AS (
  SELECT p.key AS slug, e.eval_date, s.severity AS a, CASE WHEN s.severity IS NULL THEN n.severity END AS b, c.severity AS c, h.severity AS d, s.weight AS wa, n.weight AS wb, c.weight AS wc, h.weight AS wd,
    s.age AS age_a, c.age AS age_c, c.modeled, h.n_reports, x.worst, k.flow
  FROM $places p CROSS JOIN {_DATES} e LEFT JOIN ({_SENSORS}) s ON s.slug = p.key AND s.eval_date = e.eval_date LEFT JOIN ({_SNOW_LINES}) n ON n.slug = p.key AND n.eval_date = e.eval_date
  LEFT JOIN ({_SCENES}) c ON c.slug = p.key AND c.eval_date = e.eval_date LEFT JOIN ({_REPORTS}) h ON h.slug = p.key AND h.eval_date = e.eval_date
  LEFT JOIN ({_WORST}) x ON x.slug = p.key AND x.eval_date = e.eval_date LEFT JOIN ({_CREEKS}) k ON k.slug = p.key AND k.eval_date = e.eval_date
)"""
_JUDGE = f"""v AS (
  SELECT *, (coalesce(a * wa, 0.0) + coalesce(b * wb, 0.0) + coalesce(c * wc, 0.0) + coalesce(d * wd, 0.0))
    / nullif(CASE WHEN a IS NULL THEN 0.0 ELSE wa END + CASE WHEN b IS NULL THEN 0.0 ELSE wb END + coalesce(wc, 0.0) + coalesce(wd, 0.0), 0.0) AS sev, {_DIFFER} AS differ FROM w
), g AS (
  SELECT *, CASE WHEN sev IS NULL THEN 0.0 ELSE CASE WHEN a IS NULL THEN 0.0 WHEN age_a <= 2 THEN 2.0 WHEN age_a <= 7 THEN 1.0 ELSE 0.5 END + CASE WHEN b IS NULL THEN 0.0 ELSE 0.5 END
    + CASE WHEN c IS NULL THEN 0.0 WHEN age_c <= 4 THEN 1.5 ELSE 0.75 END + CASE WHEN n_reports IS NULL THEN 0.0 ELSE least(3.0, n_reports) END + CASE WHEN flow IS NULL THEN 0.0 ELSE 1.0 END
    - CASE WHEN differ > 1.5 THEN 2.0 WHEN differ > 0.8 THEN 1.0 ELSE 0.0 END END AS points FROM v
)
"""
_SHOW = f"""SELECT {{keys}}, round(sev, 2) AS severity,
  CASE WHEN sev IS NULL THEN 'unknown' WHEN worst = 'dangerous' THEN 'not_recommended' WHEN worst = 'thigh_high' AND sev < 0.5 THEN 'snow_caution' WHEN sev < 0.5 THEN 'open' WHEN sev < 1.25 THEN 'snow_caution' WHEN sev < 2.1 THEN 'traction_advised' ELSE 'not_recommended' END AS status,
  array_to_string(list_filter([{_CONFLICTS}], lambda x: x IS NOT NULL), ' ') AS conflicts, CAST(round(points, 1) AS DOUBLE) AS score,
  CASE WHEN points >= 5 THEN 'high' WHEN points >= 2.5 THEN 'moderate' ELSE 'low' END AS confidence, worst FROM g"""


_VERDICT = f"WITH {_EVIDENCE}, {_JUDGE} " + _SHOW.replace("{keys}", "slug, eval_date")


def verdicts(t: Tables) -> DataFrame:
    lines, scenes = C.believed_lines(_linked(t), _judged(t)), C.scenes(t.scenes, _D, _rejected(t))
    return C.fused(t.places, _D, C.sensors(_read(t)), lines, scenes, C.reports(t.told, _D), C.worst_crossings(t.told, _D), C.creeks(t.gauges, _D))


@query(_VERDICT)
def place_verdict(t: Tables) -> DataFrame:
    """Four kinds of evidence, sensors screened first, fords and creeks, fused for each place at each date."""
    return verdicts(t)


_SHOWN = f"SELECT slug, eval_date, severity, status, conflicts, score, confidence FROM ({_VERDICT}) f"


@query(_SHOWN)
def fused_status(t: Tables) -> DataFrame:
    """The verdict as it is shown."""
    return verdicts(t).drop("worst")


_CODE = "CASE status WHEN 'open' THEN '0' WHEN 'snow_caution' THEN '1' WHEN 'traction_advised' THEN '2' WHEN 'not_recommended' THEN '3' ELSE '9' END"


@query(f"SELECT slug, string_agg({_CODE}, '' ORDER BY eval_date) AS codes FROM ({_SHOWN}) f GROUP BY slug")
def status_string(t: Tables) -> DataFrame:
    """A digit per date, 9 where nothing is known."""
    return fusion.status_strings(verdicts(t))


@query(f"SELECT eval_date, status, confidence, count(*) AS n FROM ({_SHOWN}) f GROUP BY eval_date, status, confidence")
def status_counts(t: Tables) -> DataFrame:
    """A37."""
    return verdicts(t).groupBy("eval_date", "status", "confidence").agg(F.count("*").alias("n"))


def _whole(n: str) -> str:
    return f"format('{{:,}}', CAST(round_even({n}, 0) AS BIGINT))"


_TOP = "hundreds * 100 >= 14500"
_FACTS = f"""WITH sensor AS ({_SENSORS}), line AS ({_SNOW_LINES}), scene AS ({_SCENES}), said AS ({_REPORTS}), worst AS ({_WORST}), creek AS ({_CREEKS}), blind AS (
  SELECT slug, eval_date, count(*) AS n, min(gap_ft) AS gap, array_to_string((list(station || ' (' || {_whole('station_ft')} || ' ft)' ORDER BY station_ft DESC, station))[1:3], ', ') AS named FROM ({_LINKED}) x WHERE {_BLIND} GROUP BY slug, eval_date
), fault AS (
  SELECT l.lkey AS slug, f.*, s.elevation_ft FROM ({_FAULTY}) f JOIN ({_SENSOR_LINKS}) l ON l.rkey = f.station JOIN $sensors s ON s.key = f.station
), every AS (
  SELECT p.key AS slug, e.eval_date, s.slug IS NOT NULL AS has_sensor, n.slug IS NOT NULL AND s.slug IS NULL AS has_line, b.slug IS NOT NULL AS has_blind, x.slug IS NOT NULL OR k.flow IS NOT NULL AS has_creek,
    s.slug IS NOT NULL OR n.slug IS NOT NULL OR c.slug IS NOT NULL OR h.slug IS NOT NULL AS present
  FROM $places p CROSS JOIN {_DATES} e LEFT JOIN sensor s ON s.slug = p.key AND s.eval_date = e.eval_date LEFT JOIN line n ON n.slug = p.key AND n.eval_date = e.eval_date
  LEFT JOIN scene c ON c.slug = p.key AND c.eval_date = e.eval_date LEFT JOIN said h ON h.slug = p.key AND h.eval_date = e.eval_date
  LEFT JOIN worst x ON x.slug = p.key AND x.eval_date = e.eval_date LEFT JOIN creek k ON k.slug = p.key AND k.eval_date = e.eval_date LEFT JOIN blind b ON b.slug = p.key AND b.eval_date = e.eval_date
), parts AS (
  SELECT slug, eval_date, 0 AS ord, 'none' AS stream, CASE WHEN has_creek THEN 'No recent snow evidence for this pass.' ELSE 'No recent evidence for this pass in any stream.' END AS text FROM every WHERE NOT present AND NOT has_blind
  UNION ALL SELECT slug, eval_date, 1, 'sensor', 'Nearby snow sensors read ' || swe || ' in of water in the snowpack' || CASE WHEN trend < -0.15 THEN ', melting fast' WHEN trend < -0.02 THEN ', melting steadily' ELSE '' END || ' (' || age || 'd old).' FROM sensor
  UNION ALL SELECT slug, eval_date, 2, 'satellite', CASE WHEN modeled THEN 'Modeled snow cover is ' || {_whole('cover * 100')} || '% in the pass bowl, worked out from a snow sensor reading ' || age || 'd ago; no satellite saw the pass.'
    ELSE 'Satellite shows ' || {_whole('cover * 100')} || '% snow cover in the pass bowl, last clear look ' || age || 'd ago.' END FROM scene
  UNION ALL SELECT slug, eval_date, 3, 'report', n_reports || CASE WHEN n_reports = 1 THEN ' party' ELSE ' parties' END || ' reported from this pass recently; calibrated read: '
    || CASE WHEN severity < 0.5 THEN 'little or no snow' WHEN severity < 1.25 THEN 'patchy snow' WHEN severity < 2.1 THEN 'continuous snow' ELSE 'deep snow or serious hazards' END || '.' FROM said
  UNION ALL SELECT slug, eval_date, 4, 'report', 'Worst reported crossing nearby: ' || replace(worst, '_', ' ') || '.' FROM worst
  UNION ALL SELECT slug, eval_date, 5, 'gauge', 'The nearest creek gauge reads ' || CAST(round_even(flow, 0) AS BIGINT) || ' cfs' || coalesce(' and ' || flow_trend, '') || '.'
    || CASE WHEN active_melt THEN ' Strong afternoon melt pulse: flow rises through the day.' ELSE '' END FROM creek WHERE flow IS NOT NULL
  UNION ALL SELECT slug, eval_date, 6, 'sensor', station || ' (' || {_whole('station_ft')} || ' ft) melted out ' || CASE WHEN observed THEN 'on' ELSE 'by' END || ' ' || since
    || CASE WHEN quiet_since IS NULL THEN '' WHEN quiet_since <= since THEN ' and stopped reporting' ELSE ' and has been quiet since ' || quiet_since END || '; at a typical 40 ft a day that puts the snowline estimate '
    || CASE WHEN {_TOP} THEN 'above the highest terrain' ELSE 'near ' || {_whole('hundreds * 100')} || ' ft' END
    || CASE WHEN severity = 0 THEN CASE WHEN {_TOP} THEN '' ELSE ', above the pass' END || ': likely melted out, though no sensor sees it directly.' WHEN severity <= 0.5 THEN ', close to the pass: expect lingering patches.' ELSE ', still below the pass: expect snow up high.' END
    FROM line l JOIN every USING (slug, eval_date) WHERE has_line
  UNION ALL SELECT slug, eval_date, CASE WHEN present THEN 7 ELSE 0 END, 'sensor', CASE WHEN n = 1 THEN 'The nearest snow sensor has' ELSE 'Snow sensors nearby have' END || ' melted out, but ' || named || CASE WHEN n = 1 THEN ' sits' ELSE ' sit' END
    || ' at least ' || {_whole('gap')} || ' ft below the pass: ' || CASE WHEN n = 1 THEN 'it cannot' ELSE 'they cannot' END || ' tell whether the pass still holds snow.' FROM blind JOIN every USING (slug, eval_date) WHERE NOT has_line
  UNION ALL SELECT slug, eval_date, 8, 'sensor', station || ' (' || {_whole('elevation_ft')} || ' ft) reports ' || round_even(value, 1) || ' in of water, more than any snowpack holds. It is left out as a sensor fault.' FROM fault
)
SELECT slug, eval_date, array_to_string(list(stream || ': ' || text ORDER BY ord, stream, text), chr(10)) AS facts FROM parts SEMI JOIN every USING (slug, eval_date) GROUP BY slug, eval_date"""


@query(_FACTS)
def place_facts(t: Tables) -> DataFrame:
    """What the verdict of a place rests on, in sentences; a line each."""
    linked, judged = _linked(t), _judged(t)
    broken = C.faulty(judged).join(linked.select("slug", "station", "station_ft"), "station")
    told = C.facts(
        t.places, _D, C.sensors(_read(t)), C.believed_lines(linked, judged), C.scenes(t.scenes, _D, _rejected(t)), C.reports(t.told, _D), C.worst_crossings(t.told, _D), C.creeks(t.gauges, _D), C.blind(_read(t)), broken,
    )
    return told.select("slug", "eval_date", F.array_join(F.transform("facts", lambda f: F.concat(f["stream"], F.lit(": "), f["text"])), "\n").alias("facts"))


@query(
    f"""WITH a AS (SELECT lkey AS slug, 'sensor' AS source, station AS id, day FROM ({_SENSOR_LINKS}) l JOIN $snowpack s ON s.station = l.rkey
  UNION ALL SELECT slug, 'satellite', slug, day FROM $scenes c UNION ALL SELECT slug, 'gauge', slug, day FROM $gauges g WHERE metric = 'discharge_cfs'),
w AS (SELECT slug, source, id, max(day) AS day FROM a GROUP BY slug, source, id, strftime(day, '%Y-%m'), (day(day) - 1) // 14)
SELECT DISTINCT slug, source, id, day FROM (SELECT *, row_number() OVER (PARTITION BY slug, source, eval_date ORDER BY day DESC, id) AS r FROM w, {_DATES} e WHERE eval_date - day BETWEEN 0 AND 29) x WHERE r <= 4
UNION ALL SELECT slug, 'report', id, day FROM $told t"""
)
def place_ledger(t: Tables) -> DataFrame:
    """The dated evidence that the statuses of each place rest on; its reports always."""
    entry = lambda df, source, id_: df.select("slug", F.lit(source).alias("source"), F.col(id_).alias("id"), "day")
    sensors = entry(_linked(t).join(t.snowpack, "station"), "sensor", "station")
    rest = entry(t.scenes, "satellite", "slug").unionByName(entry(t.gauges.filter("metric = 'discharge_cfs'"), "gauge", "slug"))
    return ledger.place_ledger(sensors.unionByName(rest), entry(t.told, "report", "id"), list(DATES))
