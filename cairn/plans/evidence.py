"""Queries of readings as of dates, their fusion and their ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import quotient
from ..operators import asof, ledger, links
from .inputs import DATES, Tables
from .registry import query

_DATES = "(SELECT CAST(unnest(['" + "','".join(DATES) + "']) AS DATE) AS eval_date)"
_NEWEST = """SELECT * FROM (SELECT r.*, eval_date, eval_date - day AS age, row_number() OVER (PARTITION BY station, eval_date ORDER BY day DESC, ord) AS rn
  FROM $readings r, {dates} e WHERE kind = '{kind}' AND eval_date - day BETWEEN 0 AND {age}) x WHERE rn = 1"""


def _newest_sql(kind: str, age: int) -> str:
    return _NEWEST.format(dates=_DATES, kind=kind, age=age)


@query("SELECT event_id, ts, user_id, value FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-22'")
def obs_filter_scan(t: Tables) -> DataFrame:
    """Equality and a range of time, both pushed to the scan."""
    kept = t.events.filter("event_type = 'purchase' and ts >= timestamp_ntz'2024-01-08' and ts < timestamp_ntz'2024-01-22'")
    return kept.select("event_id", "ts", "user_id", "value")


@query("SELECT event_type, max(event_id) AS max_id, CAST(max(ts) AS DATE) AS latest, min(ts) < TIMESTAMP '2024-01-02' AS early FROM events GROUP BY event_type")
def stream_probes(t: Tables) -> DataFrame:
    """Greatest id, latest day and whether anything precedes a date, by stream."""
    early = F.min("ts") < F.expr("timestamp_ntz'2024-01-02'")
    return t.events.groupBy("event_type").agg(F.max("event_id").alias("max_id"), F.max("ts").cast("date").alias("latest"), early.alias("early"))


@query(f"SELECT station, eval_date, day, value, ord, age FROM ({_newest_sql('purchase', 10)}) n")
def asof_newest(t: Tables) -> DataFrame:
    """The newest reading of each station in each date's window."""
    return asof.newest(t.readings.filter("kind = 'purchase'"), list(DATES), 10)


@query(
    f"""WITH o AS (SELECT r.*, eval_date FROM $readings r, {_DATES} e WHERE kind = 'purchase' AND eval_date - day BETWEEN 0 AND 10)
SELECT station, eval_date, round((arg_max(value, (day, ord)) - arg_min(value, (day, ord))) / greatest(max(day) - min(day), 1), 6) AS per_day FROM o GROUP BY station, eval_date"""
)
def trend_in_window(t: Tables) -> DataFrame:
    """Newest minus oldest value of each station alone; the trend of a place (A02) is in ``sensor_component``."""
    return asof.trend(t.readings.filter("kind = 'purchase'"), list(DATES), 10)


@query(
    f"""WITH o AS (SELECT r.*, eval_date FROM $readings r, {_DATES} e WHERE kind = 'view' AND eval_date - day BETWEEN 0 AND 10),
g AS (SELECT station, eval_date, arg_max(value, (day, ord)) AS last, arg_min(value, (day, ord)) AS first, count(*) AS n FROM o GROUP BY station, eval_date)
SELECT station, eval_date, last, CASE WHEN n < 4 THEN NULL WHEN last / first < 0.92 THEN 'dropping' WHEN last / first > 1.08 THEN 'rising' ELSE 'steady' END AS trend FROM g"""
)
def flow_trend(t: Tables) -> DataFrame:
    """A10."""
    return asof.flow(t.readings.filter("kind = 'view'"), list(DATES))


@query(
    """SELECT station, day, round((max(value) - min(value)) / (CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) / count(*)) * 100, 1) AS swing
FROM $readings r WHERE kind = 'click' GROUP BY station, day HAVING count(*) >= 2"""
)
def diurnal_swing(t: Tables) -> DataFrame:
    """Range over mean of a day, in percent."""
    mean = F.sum(F.col("value").cast("decimal(12,2)")).cast("double") / F.count("*")
    days = t.readings.filter("kind = 'click'").groupBy("station", "day").agg(F.round(quotient(F.max("value") - F.min("value"), mean) * 100, 1).alias("swing"), F.count("*").alias("n"))
    return days.filter("n >= 2").drop("n")


@query(
    """WITH d AS (SELECT station, day, (max(value) - min(value)) / (CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) / count(*)) * 100 AS swing FROM $readings r WHERE kind = 'click' GROUP BY station, day)
SELECT station, eval_date, round(avg(swing), 4) AS mean_swing, avg(swing) >= 35 AS active FROM d, """
    + _DATES
    + """ e WHERE eval_date - day BETWEEN 0 AND 7 GROUP BY station, eval_date"""
)
def melt_activity(t: Tables) -> DataFrame:
    """Mean daily swing in the week before a date."""
    mean = F.sum(F.col("value").cast("decimal(12,2)")).cast("double") / F.count("*")
    days = t.readings.filter("kind = 'click'").groupBy("station", "day").agg((quotient(F.max("value") - F.min("value"), mean) * 100).alias("swing"))
    opened = asof.dates(days, list(DATES), 7)
    return opened.groupBy("station", "eval_date").agg(F.round(F.avg("swing"), 4).alias("mean_swing"), (F.avg("swing") >= 35).alias("active"))


KINDS = ("view", "signup", "error", "click", "purchase")


@query("SELECT station, day, " + ", ".join(f"arg_max(value, ord) FILTER (WHERE kind = '{k}') AS last_{k}" for k in KINDS) + " FROM $readings r GROUP BY station, day")
def stat_pivot(t: Tables) -> DataFrame:
    """A column per stream, the day's last value."""
    wide = t.readings.groupBy("station", "day").pivot("kind", list(KINDS)).agg(F.max_by("value", "ord"))
    return wide.select("station", "day", *(F.col(k).alias(f"last_{k}") for k in KINDS))


_LINKS = """SELECT lkey, rkey, km, rank, gap_ft FROM (
  SELECT p.key AS lkey, s.key AS rkey, round(2 * 6371 * asin(sqrt(pow(sin(radians(s.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - p.lon) / 2), 2))), 1) AS km,
         p.elevation_ft - s.elevation_ft AS gap_ft, row_number() OVER (PARTITION BY p.key ORDER BY km, s.key) AS rank
  FROM $places p, {right} s WHERE km <= {radius}) x WHERE rank <= {k}"""
_SENSOR_LINKS = _LINKS.format(right="$sensors", radius=55, k=3)


def _links(t: Tables, right: DataFrame, radius: float, k: int) -> DataFrame:
    near = links.nearest_k(t.places, right, radius, k)
    left = t.places.select(F.col("key").alias("lkey"), F.col("elevation_ft").alias("here_ft"))
    there = right.select(F.col("key").alias("rkey"), F.col("elevation_ft").alias("there_ft"))
    return near.join(left, "lkey").join(there, "rkey").select("lkey", "rkey", "km", "rank", (F.col("here_ft") - F.col("there_ft")).alias("gap_ft"))


@query(_LINKS.format(right="$stations", radius=55, k=3))
def links_nearest_k(t: Tables) -> DataFrame:
    """The three nearest stations within 55 km."""
    return _links(t, t.stations, 55, 3)


def _component(t: Tables, kind: str, age: int, half_life: float, prior: float) -> DataFrame:
    linked = _links(t, t.sensors, 55, 3).select(F.col("lkey").alias("slug"), F.col("rkey").alias("station"), "km", "gap_ft")
    newest = asof.newest(t.readings.filter(F.col("kind") == kind), list(DATES), age)
    return asof.weighted(linked.join(newest.select("station", "eval_date", "value", "age"), "station"), half_life, prior, full=300.0)


def _component_sql(kind: str, age: int, half_life: float, prior: float) -> str:
    return f"""SELECT lkey AS slug, eval_date, sum(w * value) / sum(w) AS value, min(age) AS age, count(*) AS stations,
  round(least(3.0, sum(w * value) / sum(w) / 300.0 * 3), 2) AS severity, {prior} * pow(0.5, min(age) / {half_life}.0) AS weight
FROM (SELECT l.lkey, n.eval_date, n.value, n.age, 1 / (1 + coalesce(nullif(l.km, 0.0), 20.0) / 10) / (1 + abs(l.gap_ft) / 3000) AS w FROM ({_SENSOR_LINKS}) l JOIN ({_newest_sql(kind, age)}) n ON n.station = l.rkey) v GROUP BY lkey, eval_date"""


_SENSOR = ("purchase", 10, 4, 0.9)


@query(f"SELECT slug, eval_date, round(value, 4) AS value, age, stations, severity, round(weight, 6) AS weight FROM ({_component_sql(*_SENSOR)}) c")
def weighted_reading(t: Tables) -> DataFrame:
    """Readings of a place's stations, nearer and of like elevation weighing more."""
    return _component(t, *_SENSOR).withColumn("value", F.round("value", 4)).withColumn("weight", F.round("weight", 6))


@query(
    f"""SELECT DISTINCT id, source, day FROM (SELECT event_id AS id, event_type AS source, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY eval_date, event_type ORDER BY CAST(ts AS DATE) DESC, event_id) AS r
FROM events, {_DATES} e WHERE eval_date - CAST(ts AS DATE) BETWEEN 0 AND 29) x WHERE r <= 4"""
)
def ledger_topk(t: Tables) -> DataFrame:
    """What the statuses of any date rest on."""
    entries = t.readings.select(F.col("ord").alias("id"), F.col("kind").alias("source"), "day")
    return ledger.ledger(entries, list(DATES))


@query("SELECT event_type AS value, count(*) AS n, CAST(max(ts) AS DATE) AS latest, arg_max(props, (CAST(ts AS DATE), event_id)) AS words FROM events GROUP BY event_type")
def tally(t: Tables) -> DataFrame:
    """A39."""
    rows = t.events.select(F.col("event_type").alias("value"), F.col("ts").cast("date").alias("day"), F.col("event_id").alias("ord"), F.col("props").alias("words"))
    return ledger.tally(rows)


@query("SELECT station, kind, day, value, ord FROM (SELECT *, row_number() OVER (PARTITION BY station, kind ORDER BY ord DESC) AS r FROM $readings x) y WHERE r = 1")
def upsert_latest(t: Tables) -> DataFrame:
    """An append-only log read as a table of upserts."""
    return ledger.latest(t.readings, ["station", "kind"], "ord")


@query("SELECT event_id, user_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) x WHERE r <= 50")
def newest_50(t: Tables) -> DataFrame:
    """A45."""
    rows = t.events.select("event_id", "user_id", "ts")
    return ledger.newest(rows, "user_id", [F.desc("ts"), F.desc("event_id")], 50)


@query("SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, count(*) >= 5 AS full FROM events GROUP BY user_id, CAST(ts AS DATE)")
def daily_cap(t: Tables) -> DataFrame:
    """Use counted by person and day, and whether the day's allowance is spent."""
    return t.events.groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"), (F.count("*") >= 5).alias("full"))


def _side(upto: str) -> str:
    return f"SELECT user_id AS key, count(*) AS value FROM events WHERE ts < TIMESTAMP '{upto}' AND event_type = 'error' GROUP BY user_id"


@query(
    f"""WITH l AS ({_side('2024-01-12')}), b AS ({_side('2024-01-09')}), s AS ({_side('2024-01-10')}),
a AS (SELECT key, l.value AS lv, b.value AS bv, s.value AS sv FROM (SELECT key FROM l UNION SELECT key FROM b UNION SELECT key FROM s) k LEFT JOIN l USING (key) LEFT JOIN b USING (key) LEFT JOIN s USING (key))
SELECT key, CASE WHEN lv IS NOT DISTINCT FROM sv THEN 'keep' WHEN sv IS NOT DISTINCT FROM bv THEN CASE WHEN lv IS NULL THEN 'delete_remote' ELSE 'push' END
  WHEN lv IS NOT DISTINCT FROM bv THEN CASE WHEN sv IS NULL THEN 'delete_local' ELSE 'pull' END WHEN lv IS NULL THEN 'pull' WHEN sv IS NULL THEN 'push' ELSE 'conflict' END AS action FROM a"""
)
def reconcile(t: Tables) -> DataFrame:
    """Three-way comparison."""
    side = lambda upto: t.events.filter(f"ts < timestamp_ntz'{upto}' and event_type = 'error'").groupBy(F.col("user_id").alias("key")).agg(F.count("*").alias("value"))
    return ledger.reconcile(side("2024-01-12"), side("2024-01-09"), side("2024-01-10"))


@query(
    """WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL)
SELECT coalesce(a.user_id, b.user_id) AS user_id, a.n AS before, b.n AS now, CASE WHEN a.n IS NULL THEN 'new' WHEN b.n IS NULL THEN 'cleared' WHEN a.n <> b.n THEN 'changed' ELSE 'same' END AS what
FROM (SELECT * FROM d WHERE day = DATE '2024-01-14') a FULL JOIN (SELECT * FROM d WHERE day = DATE '2024-01-15') b ON a.user_id = b.user_id"""
)
def day_over_day(t: Tables) -> DataFrame:
    """What is new, changed or cleared since the day before."""
    days = t.events.groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))
    a = days.filter("day = date'2024-01-14'").select("user_id", F.col("n").alias("before"))
    b = days.filter("day = date'2024-01-15'").select("user_id", F.col("n").alias("now"))
    what = F.when(F.col("before").isNull(), "new").when(F.col("now").isNull(), "cleared").when(F.col("before") != F.col("now"), "changed").otherwise("same")
    return a.join(b, "user_id", "full_outer").select("user_id", "before", "now", what.alias("what"))


@query(
    """WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase'), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND ts < TIMESTAMP '2024-01-10')
SELECT 'union' AS op, user_id FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'except', user_id FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'both', user_id FROM (SELECT * FROM a INTERSECT SELECT * FROM b)"""
)
def set_ops(t: Tables) -> DataFrame:
    """Union, difference and intersection of keys."""
    a = t.events.filter("event_type = 'purchase'").select("user_id").distinct()
    b = t.events.filter("event_type = 'error' and ts < timestamp_ntz'2024-01-10'").select("user_id").distinct()
    sets = {"union": a.union(b).distinct(), "except": a.subtract(b), "both": a.intersect(b)}
    named = [df.select(F.lit(op).alias("op"), "user_id") for op, df in sets.items()]
    return named[0].unionByName(named[1]).unionByName(named[2])
