"""Queries of daily series: runs, screens, seasons, new snow, curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import islands, screen, season
from .inputs import Tables
from .registry import query


@query(
    """WITH x AS (SELECT *, lead(day) OVER (PARTITION BY station ORDER BY day) AS later FROM $daily d),
b AS (SELECT station, max(day) AS stop FROM x WHERE value >= 0.5 OR later - day > 20 GROUP BY station),
r AS (SELECT x.station, min(day) AS since, max(day) AS newest FROM x LEFT JOIN b ON x.station = b.station WHERE stop IS NULL OR day > stop GROUP BY x.station)
SELECT r.station, since, coalesce(x.value >= 0.5 AND coalesce(x.later - x.day, 0) <= 20, false) AS observed
FROM r LEFT JOIN b ON r.station = b.station LEFT JOIN x ON x.station = b.station AND x.day = b.stop
WHERE coalesce(x.value >= 0.5 AND coalesce(x.later - x.day, 0) <= 20, false) OR newest - since >= 6"""
)
def melt_out_run(t: Tables) -> DataFrame:
    """The run of bare days that ends each series."""
    return islands.melted_out(t.daily)


@query(
    """WITH n AS (SELECT *, lag(value) OVER w AS pv, lag(day) OVER w AS pd, lead(value) OVER w AS nv, lead(day) OVER w AS nd FROM $season s WINDOW w AS (PARTITION BY station ORDER BY day))
SELECT station, day, value FROM n WHERE NOT coalesce(abs(pv - value) > 1 * greatest(day - pd, 1) AND abs(value - nv) > 1 * greatest(nd - day, 1) AND NOT abs(pv - nv) > 1 * greatest(nd - pd, 1), false)"""
)
def stray_removal(t: Tables) -> DataFrame:
    """Readings too steep to both neighbours while the neighbours agree."""
    return islands.without_strays(t.season, steep=1)


@query(
    """WITH f AS (SELECT *, day - lag(day) OVER w AS gap, value - lag(value) OVER w AS step, value >= 0.5 AND value < 3.0 AS inside FROM $season s WINDOW w AS (PARTITION BY station ORDER BY day)),
g AS (SELECT *, sum(CASE WHEN inside THEN 0 ELSE 1 END) OVER (PARTITION BY station ORDER BY day ROWS UNBOUNDED PRECEDING) AS island FROM f),
r AS (SELECT station, island, max(day) FILTER (WHERE inside) - min(day) FILTER (WHERE inside) AS span, bool_or(coalesce(abs(step) > 10 * gap, false)) AS erratic,
  count(*) FILTER (WHERE gap = 1 AND step >= 0.3 AND value < 3.0) AS rises FROM g GROUP BY station, island)
SELECT station, bool_or(erratic) AS erratic, bool_or(coalesce(span > 28, false)) AS lingers, sum(rises) > 8 AS wanders FROM r GROUP BY station"""
)
def shape_flags(t: Tables) -> DataFrame:
    """Erratic, lingering and wandering series."""
    return islands.shape_flags(t.season)


@query(
    """WITH s AS (SELECT *, sum(CASE WHEN value >= 0.5 THEN 0 ELSE 1 END) OVER (PARTITION BY station, year(day) ORDER BY day ROWS UNBOUNDED PRECEDING) AS island
  FROM $season x WHERE strftime(day, '%m-%d') >= '06-01' AND strftime(day, '%m-%d') <= '08-31'),
c AS (SELECT a.station, a.day, a.value, (SELECT arg_min(b.value, b.day) FROM s b WHERE b.station = a.station AND year(b.day) = year(a.day) AND b.island = a.island AND b.value >= 0.5 AND b.day BETWEEN a.day - 28 AND a.day) AS first,
  (SELECT min(b.day) FROM s b WHERE b.station = a.station AND year(b.day) = year(a.day) AND b.island = a.island AND b.value >= 0.5 AND b.day BETWEEN a.day - 28 AND a.day) AS began FROM s a WHERE a.value >= 0.5)
SELECT station, year(day) AS year, bool_or(day - began >= 26 AND first - value < 1.0) AS holds FROM c GROUP BY station, year(day)"""
)
def holds_through_summer(t: Tables) -> DataFrame:
    """Whether a run above the ground loses less than an inch over four weeks of summer."""
    return islands.holds(t.season)


@query(
    """SELECT l.station, l.day, l.value, CASE WHEN d.value IS NULL THEN NULL ELSE greatest(round(l.value - d.value, 6), 0.0) END AS delta
FROM (SELECT station, max(day) AS day, arg_max(value, day) AS value FROM $daily a GROUP BY station) l LEFT JOIN $daily d ON d.station = l.station AND d.day = l.day - 3"""
)
def new_snow_delta(t: Tables) -> DataFrame:
    """Change over exactly three days, never below nothing."""
    return islands.change(t.daily, 3)


_VERDICT = """SELECT l.station, CASE WHEN greatest(round(l.value - d.value, 6), 0.0) BETWEEN 0.3 AND 30 THEN 'new' WHEN d.value IS NULL THEN 'unknown' ELSE 'none' END AS verdict
FROM (SELECT station, max(day) AS day, arg_max(value, day) AS value FROM $daily a GROUP BY station) l LEFT JOIN $daily d ON d.station = l.station AND d.day = l.day - 3"""


@query(f"SELECT station, grp, verdict, verdict = 'new' AND count(*) FILTER (WHERE verdict = 'new') OVER (PARTITION BY grp) > 1 AS confirmed FROM (SELECT v.*, station % 40 AS grp FROM ({_VERDICT}) v) g")
def neighbour_confirm(t: Tables) -> DataFrame:
    """New snow that another station of the group sees too."""
    delta = F.col("delta")
    verdict = F.when(delta.between(0.3, 30), "new").when(delta.isNull(), "unknown").otherwise("none")
    told = islands.change(t.daily, 3).select("station", (F.col("station") % 40).alias("grp"), verdict.alias("verdict"))
    new = F.col("verdict") == "new"
    others = F.count_if(new).over(Window.partitionBy("grp")) > 1
    return told.select("station", "grp", "verdict", (new & others).alias("confirmed"))


@query("SELECT station, count(*) AS readings, count(*) FILTER (WHERE value > 8) AS over FROM $daily d GROUP BY station")
def fault_ceiling(t: Tables) -> DataFrame:
    """Readings above a ceiling."""
    return screen.ceiling_counts(t.daily, 8)


@query()
def screened_series(t: Tables) -> DataFrame:
    """What to believe of each station as of its newest day. No SQL: each rejection moves the next one."""
    return screen.believed(t.season)


@query()
def screened_as_of(t: Tables) -> DataFrame:
    """What to believe of each station at several dates, faulty ones silent. No SQL, as above."""
    return screen.believed_as_of(t.season, ["1996-06-20", "1997-07-15", "1998-09-01", "2001-12-01"])


@query(
    """SELECT station, day, round(value, 1) AS value FROM (SELECT *, row_number() OVER (PARTITION BY station ORDER BY day) AS i, count(*) OVER (PARTITION BY station) AS n FROM $season s) x
WHERE (i - 1) % 3 = 0 OR i = n"""
)
def curve_thin(t: Tables) -> DataFrame:
    """Every third reading and the last."""
    return islands.thinned(t.season)


@query(
    """SELECT station, concat(strftime(day, '%Y-%m'), '-', CAST((day(day) - 1) // 14 AS VARCHAR)) AS fortnight, max(day) AS day, arg_max(value, day) AS value
FROM $season s GROUP BY 1, 2"""
)
def fortnight_latest(t: Tables) -> DataFrame:
    """W19."""
    return islands.fortnights(t.season)


_SUMMARY = """SELECT station, year(day) AS year, max(value) AS peak, arg_min(day, (-value, day)) - make_date(year(day), 4, 1) AS peak_day, count(*) AS days
FROM $season s WHERE strftime(day, '%m-%d') BETWEEN '04-01' AND '08-31' GROUP BY station, year(day)"""


@query(_SUMMARY)
def season_summary(t: Tables) -> DataFrame:
    """Each season's peak and its day."""
    return season.summaries(t.season)


@query(
    f"""SELECT station, year, peak, peak_day, rank() OVER (PARTITION BY station ORDER BY peak DESC) AS peak_rank,
CASE WHEN count(*) OVER w >= 2 THEN round(median(peak) OVER w, 6) END AS usual FROM ({_SUMMARY}) x WINDOW w AS (PARTITION BY station ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
)
def season_compare(t: Tables) -> DataFrame:
    """A season beside the earlier ones."""
    return season.compared(season.summaries(t.season))


@query(
    f"""WITH y AS (SELECT station, string_agg(year, ',' ORDER BY year) AS years, count(*) AS n, round(avg(peak), 6) AS mean FROM ({_SUMMARY}) s GROUP BY station)
SELECT years, CAST(max(n) AS BIGINT) AS seasons, count(*) AS stations, round(max(mean), 4) AS highest FROM y GROUP BY years"""
)
def baseline_groups(t: Tables) -> DataFrame:
    """Stations with the same years on file."""
    own = season.summaries(t.season).groupBy("station").agg(
        F.array_join(F.array_sort(F.collect_list("year")).cast("array<string>"), ",").alias("years"), F.count("*").alias("n"), F.round(F.avg("peak"), 6).alias("mean")
    )
    return own.groupBy("years").agg(F.max("n").alias("seasons"), F.count("*").alias("stations"), F.round(F.max("mean"), 4).alias("highest"))


@query(
    """WITH p AS (SELECT station, year(day) AS year, day - make_date(year(day), 4, 1) AS d, value, lead(value) OVER w AS nv, lead(day) OVER w AS nd, day FROM $season s
  WHERE strftime(day, '%m-%d') BETWEEN '04-01' AND '08-31' WINDOW w AS (PARTITION BY station, year(day) ORDER BY day))
SELECT station, year, round(CASE WHEN d = 60 THEN value ELSE value + (nv - value) * (60 - d) / (nd - day) END, 4) AS value FROM p WHERE d <= 60 AND (d = 60 OR d + (nd - day) > 60 AND nd - day <= 10)"""
)
def season_value_on(t: Tables) -> DataFrame:
    """A season's curve read at its sixtieth day, between readings ten days apart at most."""
    return season.value_on(t.season, 60)
