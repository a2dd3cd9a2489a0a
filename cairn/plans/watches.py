"""Queries of watches over exports, made of the stored places and dates."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import watches as W
from .inputs import DATES, Tables
from .registry import query

_LABELS = {"open": "Open", "snow_caution": "Snow caution", "traction_advised": "Traction advised", "not_recommended": "Not recommended"}
_STATUS = "CASE (key * 7 + d * d) % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'snow_caution' WHEN 2 THEN 'traction_advised' ELSE 'not_recommended' END"
_LABEL = "CASE status " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _LABELS.items()) + " END"
#: A row a place and date, with what its parts are made of; read alike by both engines.
_BASE = f"""(SELECT b.*, {_LABEL} AS label FROM (SELECT key, name, date, d, {_STATUS} AS status, (key + d) % 5 > 0 AS has_fire, (key + d) % 7 > 0 AS has_winter, concat('Fire ', key % 3) AS fire_name,
  CASE WHEN key % 11 > 0 THEN key * 13 % 5000 END AS acres, CASE WHEN key % 4 > 0 THEN key % 100 END AS contained, (key * 37 + d * 411) % 300 / 1e1 AS miles, CASE WHEN key % 17 > 0 THEN 'N' END AS direction,
  (key * 37 + d * 411) % 300 < 20 AS inside, CASE WHEN key % 13 > 0 THEN date - CAST((d + key) % 2 AS INT) END AS as_of, (key + d) % 4 / 2e0 AS depth, (key + d) % 3 / 4e0 AS swe, (key + d) % 3 > 0 AS active, (key * d) % 3 AS wording
  FROM {{places}} p CROSS JOIN {{dates}} e) b)"""


def _exports(t: Tables) -> DataFrame:
    dates = "(SELECT CAST(x.d AS DATE) AS date, CAST(x.i AS INT) AS d FROM VALUES " + ", ".join(f"('{d}', {i})" for i, d in enumerate(DATES)) + " AS x(d, i))"
    winter = """CASE WHEN has_winter THEN named_struct('issued_for', date, 'as_of', as_of,
      'stations', array(named_struct('name', concat('Station ', key), 'elevation_ft', CAST(7000 + key AS BIGINT), 'miles', 4.5D, 'as_of', as_of, 'swe', swe, 'depth', depth)),
      'roads', array(named_struct('agency', 'Agency', 'road', concat('SR ', key % 40), 'location', 'the gate', 'active', active, 'lines', array(named_struct('label', CAST(NULL AS STRING), 'code', 'R-2', 'text', concat('wording ', wording))), 'miles', 2D, 'named', true))) END"""
    fire = "CASE WHEN has_fire THEN named_struct('issued_for', date, 'name', fire_name, 'acres', CAST(acres AS BIGINT), 'contained', CAST(contained AS INT), 'miles', miles, 'direction', direction, 'inside', inside) END"
    rows = t.spark.sql(f"SELECT key AS slug, name, date, status, label, {fire} AS fire, {winter} AS winter FROM {_BASE.format(places='{places}', dates=dates)} r", places=t.places)
    return rows.selectExpr("slug", "name", "date", "status", "label", f"CAST(fire AS {W.FIRE}) AS fire", f"CAST(winter AS {W.WINTER}) AS winter")


_SQL_DATES = "(SELECT date, i AS d FROM (VALUES " + ", ".join(f"(DATE '{d}', {i})" for i, d in enumerate(DATES)) + ") x(date, i))"
_DAY = "strftime({0}, '%b %-d')"
_NUMBER = "regexp_replace(CAST({0} AS VARCHAR), '\\.0$', '')"
_MILES = "CASE WHEN {0} < 0.1 THEN 'less than 0.1 mi' WHEN {0} >= 10 THEN CAST(floor({0} + 0.5) AS BIGINT) || ' mi' ELSE " + _NUMBER + " || ' mi' END"
_SIZE = "concat_ws(', ', format('{{:,}}', acres) || CASE WHEN acres = 1 THEN ' acre' ELSE ' acres' END, coalesce(contained || '% contained', 'containment not reported'))"
_FIRED = f"""WITH b AS (SELECT * FROM {_BASE.format(places='$places', dates=_SQL_DATES)} r), p AS (
  SELECT *, lag(date) OVER w AS was_date, lag(status) OVER w AS was_status, lag(label) OVER w AS was_label, coalesce(lag(has_fire) OVER w, false) AS was_fire, lag(miles) OVER w AS was_miles, lag(inside) OVER w AS was_inside,
    CASE WHEN lag(has_winter) OVER w THEN lag(as_of) OVER w END AS was_as_of, coalesce(lag(has_winter) OVER w AND lag(active) OVER w, false) AS was_active, lag(wording) OVER w AS was_wording
  FROM b WINDOW w AS (PARTITION BY key ORDER BY date)
), s AS (
  SELECT key AS slug, date, status, CASE WHEN status <> was_status THEN name || ' reads ' || label || ' as of ' || {_DAY.format('date')} || '; on ' || {_DAY.format('was_date')} || ' it read ' || was_label || '.' END AS changed,
    CASE WHEN has_fire AND (NOT was_fire OR (inside AND NOT was_inside) OR (NOT inside AND NOT was_inside AND was_miles - miles >= 3)) THEN
      CASE WHEN inside OR direction IS NULL THEN name || ' is inside the mapped perimeter of the ' || fire_name || ', ' || {_SIZE} || ', as mapped on ' || {_DAY.format('date')} || '.'
      ELSE 'The ' || fire_name || ', ' || {_SIZE} || ', is ' || {_MILES.format('miles')} || ' to the ' || direction || ' of ' || name || ' as mapped on ' || {_DAY.format('date')}
        || CASE WHEN was_fire AND NOT was_inside AND was_miles - miles >= 3 THEN '; on ' || {_DAY.format('was_date')} || ' its edge was ' || {_MILES.format('was_miles')} || ' away.' ELSE '.' END END END AS fire,
    CASE WHEN has_winter AND as_of IS NOT NULL AND as_of IS DISTINCT FROM was_as_of AND (depth > 0 OR swe > 0) THEN 'Station ' || key || ' (' || format('{{{{:,}}}}', 7000 + key) || ' ft, 4.5 mi away) gained '
      || concat_ws(' and ', CASE WHEN swe > 0 THEN {_NUMBER.format('swe')} || ' in of snow water' END, CASE WHEN depth > 0 THEN {_NUMBER.format('depth')} || ' in of snow depth' END) || ' in the 24 hours to ' || {_DAY.format('as_of')} || '.' END AS snow,
    CASE WHEN has_winter AND active AND NOT (was_active AND wording = was_wording) THEN 'Agency' || CASE WHEN was_active THEN ' changed its report for ' ELSE ' reports on ' END || 'SR ' || key % 40 || ' at the gate as of ' || {_DAY.format('date')} || ': "R-2: wording ' || wording || '"'
      WHEN has_winter AND NOT active AND was_active THEN 'Agency no longer reports a restriction on SR ' || key % 40 || ' at the gate as of ' || {_DAY.format('date')} || '.' END AS road
  FROM p WHERE was_date IS NOT NULL
)
SELECT slug, date, kind, reason FROM (SELECT slug, date, unnest(['any_change', 'snow_free', 'new_snow', 'fire_nearby', 'road_restriction']) AS kind,
  unnest([coalesce(changed, fire, road, snow), CASE WHEN status = 'open' THEN changed END, snow, fire, road]) AS reason FROM s) k WHERE reason IS NOT NULL"""
_FIRED = _FIRED.replace("{{", "{").replace("}}", "}")


@query(_FIRED)
def fired_watches(t: Tables) -> DataFrame:
    """What fires between exports, by a window over each place's dates."""
    return W.fired(W.paired(_exports(t)))


@query(_FIRED)
def fired_watches_stream(t: Tables) -> DataFrame:
    """The same from a stream, with a typed state for each place; it stops and goes on once."""
    from ..streaming import watch

    return watch.watched(_exports(t), [DATES[1], DATES[-1]])
