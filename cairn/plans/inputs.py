"""The engine's logical inputs, as SQL over the stored tables.

Each input is one ANSI SELECT that Spark and another SQL engine read alike, so a query
and its SQL start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

DATES = ("2024-01-08", "2024-01-15", "2024-01-22", "2024-01-29")
_DAILY = "CAST(sum(CAST({0} AS DECIMAL(12,2))) AS DOUBLE)"


def _position(key: str, a: int, b: int, c: int, low: int) -> str:
    return f"32 + (({key} * {a}) % 1700) / 1e2 AS lat, -124 + (({key} * {b}) % 1000) / 1e2 AS lon, {low} + (({key} * {c}) % 8000) AS elevation_ft"


#: name -> (tables, SELECT with the tables in braces).
INPUTS = {
    "readings": "SELECT user_id AS station, CAST(ts AS DATE) AS day, value, event_id AS ord, event_type AS kind FROM {events}",
    "daily": f"SELECT user_id AS station, CAST(ts AS DATE) AS day, {_DAILY.format('value')} / 1e2 AS value FROM {{events}} WHERE event_type IN ('purchase', 'view') GROUP BY user_id, CAST(ts AS DATE)",
    "season": f"SELECT l_suppkey AS station, CAST(l_shipdate AS DATE) AS day, {_DAILY.format('l_quantity')} / 1e1 AS value FROM {{lineitem}} GROUP BY l_suppkey, CAST(l_shipdate AS DATE)",
    "sensors": f"SELECT key, {_position('key', 37, 53, 71, 4000)} FROM (SELECT DISTINCT user_id AS key FROM {{events}}) u",
    "stations": f"SELECT s_suppkey AS key, s_name AS name, {_position('s_suppkey', 37, 53, 71, 4000)} FROM {{supplier}}",
    "places": f"SELECT c_custkey AS key, c_name AS name, {_position('c_custkey', 91, 17, 131, 3000)} FROM {{customer}}",
    "named_places": f"SELECT p_partkey AS key, p_name AS name, {_position('p_partkey', 91, 17, 131, 3000)} FROM {{part}}",
    "roads": f"SELECT s_suppkey AS key, concat('near ', p_name, ' grade') AS location, s_acctbal > 0 AS active, {_position('s_suppkey', 37, 53, 71, 4000)} FROM {{supplier}} JOIN {{part}} ON p_partkey = s_suppkey",
    "snowpack": f"SELECT user_id AS station, CAST(ts AS DATE) AS day, CASE WHEN {_DAILY.format('value')} < 150 THEN 0.0 ELSE {_DAILY.format('value')} / 6e1 END AS value, max(event_id) AS ord FROM {{events}} WHERE event_type IN ('purchase', 'view') GROUP BY user_id, CAST(ts AS DATE)",
    "scenes": "SELECT user_id AS slug, CAST(ts AS DATE) AS day, max(value) / 5e2 AS cover, max(event_id) % 3 = 0 AS modeled, CASE WHEN max(event_id) % 3 = 0 THEN user_id % 50 END AS from_station FROM {events} WHERE event_type = 'signup' GROUP BY user_id, CAST(ts AS DATE)",
    "gauges": "SELECT user_id AS slug, CAST(ts AS DATE) AS day, 'discharge_cfs' AS metric, max(value) AS value, max(event_id) AS ord FROM {events} WHERE event_type = 'view' GROUP BY user_id, CAST(ts AS DATE) UNION ALL SELECT user_id AS slug, CAST(ts AS DATE) AS day, 'diurnal_swing_pct' AS metric, max(value) / 7e0 AS value, max(event_id) AS ord FROM {events} WHERE event_type = 'click' GROUP BY user_id, CAST(ts AS DATE)",
    "told": "SELECT doc_id AS id, 1 + doc_id % 150 AS slug, coalesce(CASE WHEN doc_id % 4 > 0 THEN DATE '2024-01-01' + CAST(doc_id % 27 AS INT) END, DATE '2024-01-03' + CAST(doc_id % 25 AS INT)) AS day, CASE n_chars % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'patchy' WHEN 2 THEN 'continuous' WHEN 3 THEN 'deep' END AS snow, CASE (n_chars + doc_id) % 7 WHEN 0 THEN 'none' WHEN 1 THEN 'microspikes' WHEN 2 THEN 'crampons' WHEN 3 THEN 'ice_axe' WHEN 4 THEN 'spikes_and_axe' WHEN 5 THEN 'sandals' END AS traction, CASE (n_chars * 3 + doc_id) % 6 WHEN 0 THEN 'relaxed' WHEN 1 THEN 'cautious' WHEN 2 THEN 'sketchy' WHEN 3 THEN 'terrifying' END AS comfort, CASE doc_id % 5 WHEN 0 THEN 'first_timer' WHEN 1 THEN 'thru_hiker' WHEN 2 THEN 'experienced' WHEN 3 THEN 'unknown' END AS register, CASE (n_chars + doc_id * 5) % 23 WHEN 0 THEN 'dry' WHEN 1 THEN 'low' WHEN 2 THEN 'knee_high' WHEN 3 THEN 'thigh_high' WHEN 4 THEN 'dangerous' END AS crossing FROM {documents}",
    "reports": "SELECT d.doc_id AS id, lang AS place, source AS author, DATE '2024-01-01' + CAST(d.doc_id % 20 AS INT) AS day, l.quality + l.toxic AS observed, CASE WHEN n_chars < 300 THEN 0 WHEN n_chars < 900 THEN 1 WHEN n_chars < 2500 THEN 2 ELSE 3 END AS engine, lang, source FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id",
}

INPUTS["posts"] = "SELECT id, slug, day, CASE WHEN id % 7 = 0 THEN ' ' WHEN id % 2 = 0 THEN 'Ann ' ELSE 'ann' END AS author, snow, traction, comfort, register, crossing FROM (" + INPUTS["told"] + ") t"


def sql_of(name: str) -> str:
    """The input as a subquery over plain table names."""
    return "(" + re.sub(r"\{(\w+)\}", r"\1", INPUTS[name]) + ")"


class Tables:
    """Stored tables and logical inputs of one folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in INPUTS:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        needed = {t: getattr(self, t) for t in re.findall(r"\{(\w+)\}", INPUTS[name])}
        return self.spark.sql(INPUTS[name], **needed)
