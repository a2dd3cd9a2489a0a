"""Queries that hold verdicts against what was observed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import backtest, screen, season
from ..operators import conditions as C
from . import conditions as P
from .evidence import _DATES
from .inputs import Tables
from .registry import query


@query("SELECT t.id AS target, count(r.id) AS n FROM $reports t LEFT JOIN $reports r ON r.place = t.place AND NOT (r.id = t.id OR (r.author = t.author AND r.day = t.day)) GROUP BY t.id")
def holdout_backtest(t: Tables) -> DataFrame:
    """What is left of a place's reports to judge one of them by."""
    return backtest.held_out(t.reports, t.reports)


def _wilson(sign: str) -> str:
    return f"(exact / n + (1.959964e0 * 1.959964e0) / (2 * n) {sign} 1.959964e0 * sqrt(exact / n * (1 - exact / n) / n + (1.959964e0 * 1.959964e0) / (4 * n * n))) / (1 + (1.959964e0 * 1.959964e0) / n)"


@query(
    f"""WITH c AS (SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' ELSE 'overall' END AS split, coalesce(lang, source) AS cell, count(*) AS n,
  count(*) FILTER (WHERE engine = observed) AS exact, count(*) FILTER (WHERE abs(engine - observed) <= 1) AS within_one, count(*) FILTER (WHERE engine > observed) AS more, count(*) FILTER (WHERE engine < observed) AS less
  FROM $reports r GROUP BY GROUPING SETS ((), (lang), (source)))
SELECT split, cell, n, exact, within_one, more, less, CASE WHEN n >= 10 THEN round(greatest({_wilson('-')}, 0.0), 6) END AS low, CASE WHEN n >= 10 THEN round(least({_wilson('+')}, 1.0), 6) END AS high FROM c"""
)
def outcome_sets(t: Tables) -> DataFrame:
    """Outcome counts by split in one pass, with intervals."""
    return backtest.outcome_sets(t.reports, ["lang", "source"])


@query("SELECT observed, " + ", ".join(f"count(*) FILTER (WHERE engine = {i}) AS engine_{i}" for i in range(4)) + " FROM $reports r GROUP BY observed")
def confusion(t: Tables) -> DataFrame:
    """A30."""
    return backtest.confusion(t.reports, [0, 1, 2, 3])


@query(
    """SELECT place, count(*) AS n, greatest((SELECT min(n) FROM range(1, 5000) t(n) WHERE 1.959964e0 * sqrt(0.25 / n + (1.959964e0 * 1.959964e0) / (4.0 * n * n)) / (1 + (1.959964e0 * 1.959964e0) / n) <= 0.05) - count(*), 0) AS more
FROM $reports r GROUP BY place"""
)
def reports_needed(t: Tables) -> DataFrame:
    """Reports of each place, and how many more its rate needs to be known to a twentieth either way."""
    needed = F.lit(backtest.reports_needed(0.05)).cast("long")
    return t.reports.groupBy("place").agg(F.count("*").alias("n")).select("place", "n", F.greatest(needed - F.col("n"), F.lit(0)).alias("more"))


@query("SELECT place, count(*) AS n, count(DISTINCT author) AS authors, min(day) AS first, max(day) AS last, count(*) FILTER (WHERE engine < observed) AS misses FROM $reports r GROUP BY place")
def corpus_facts(t: Tables) -> DataFrame:
    """A33."""
    misses = F.count_if(F.col("engine") < F.col("observed")).alias("misses")
    return t.reports.groupBy("place").agg(F.count("*").alias("n"), F.countDistinct("author").alias("authors"), F.min("day").alias("first"), F.max("day").alias("last"), misses)


@query("SELECT id, place, engine - observed AS steps, day FROM $reports r WHERE engine <> observed")
def misses(t: Tables) -> DataFrame:
    """What was missed, less first, by steps."""
    rows = t.reports.filter("engine <> observed").select("id", "place", (F.col("engine") - F.col("observed")).alias("steps"), "day")
    return rows.orderBy(F.col("steps") > 0, F.abs("steps").desc(), "day", "id")


@query("SELECT field, round(avg(CAST(hit AS INT)), 6) AS accuracy, count(*) AS n FROM (SELECT id, unnest(['exact', 'within_one']) AS field, unnest([engine = observed, abs(engine - observed) <= 1]) AS hit FROM $reports r) x GROUP BY field")
def field_accuracy(t: Tables) -> DataFrame:
    """The mean of each field's matches."""
    fields = F.array(F.struct(F.lit("exact").alias("field"), (F.col("engine") == F.col("observed")).alias("hit")), F.struct(F.lit("within_one").alias("field"), (F.abs(F.col("engine") - F.col("observed")) <= 1).alias("hit")))
    return t.reports.select(F.inline(fields)).groupBy("field").agg(F.round(F.avg(F.col("hit").cast("int")), 6).alias("accuracy"), F.count("*").alias("n"))


@query(
    """WITH p AS (SELECT p_size AS x, p_retailprice > 1400 AS up FROM part), e AS (SELECT x, (SELECT count(*) FROM p q WHERE (q.up AND q.x < t.x) OR (NOT q.up AND q.x >= t.x)) AS errors FROM (SELECT DISTINCT x FROM p) t)
SELECT x AS threshold, errors FROM e ORDER BY errors, x LIMIT 1"""
)
def best_split(t: Tables) -> DataFrame:
    """The elevation that misplaces fewest."""
    return season.best_split(t.part.select(F.col("p_size").alias("x"), (F.col("p_retailprice") > 1400).alias("up")))


#: The backtest in SQL fuses each place anew for each report, from a list of the other reports.
_STEP = "CASE snow WHEN 'none' THEN 0 WHEN 'patchy' THEN 1 WHEN 'continuous' THEN 2 WHEN 'deep' THEN 3 END"
_FLOOR = "CASE traction WHEN 'none' THEN 0 WHEN 'microspikes' THEN 2 WHEN 'crampons' THEN 3 WHEN 'ice_axe' THEN 3 WHEN 'spikes_and_axe' THEN 3 END"
_TARGETS = f"(SELECT *, day AS eval_date, CASE WHEN {_FLOOR} IS NULL THEN {_STEP} ELSE greatest({_STEP}, least({_FLOOR}, {_STEP} + 1)) END AS observed FROM $posts p WHERE {_STEP} IS NOT NULL)"
_OTHERS = f"""(SELECT t.id AS target, t.eval_date, o.* FROM {_TARGETS} t JOIN $posts o ON o.slug = t.slug AND o.id <> t.id AND NOT (o.day = t.day AND trim(o.author) <> '' AND lower(trim(o.author)) = lower(trim(t.author)))
  WHERE t.eval_date - o.day BETWEEN 0 AND 14)"""
_SAID = P._SAID.replace("SELECT slug, day, CASE snow", "SELECT target, eval_date, slug, day, CASE snow").replace("$told", _OTHERS)
_DAYS = f"(SELECT DISTINCT eval_date FROM {_TARGETS} d)"


def _on_days(sql: str) -> str:
    return sql.replace(_DATES, _DAYS)


_LEFT_OUT = f"""WITH said AS (
  SELECT target, round(sum(said * pow(0.5, (eval_date - day) / 5.0)) / sum(pow(0.5, (eval_date - day) / 5.0)), 2) AS severity, count(*) AS n_reports, min(eval_date - day) AS age FROM ({_SAID}) s GROUP BY target
), worst AS (
  SELECT target, list_extract(['dry', 'low', 'knee_high', 'thigh_high', 'dangerous'], CAST(max(list_position(['dry', 'low', 'knee_high', 'thigh_high', 'dangerous'], crossing)) AS INTEGER)) AS worst FROM {_OTHERS} o WHERE crossing IS NOT NULL GROUP BY target
), w AS (
  SELECT t.id, t.slug, t.eval_date, t.observed, s.severity AS a, CASE WHEN s.severity IS NULL THEN n.severity END AS b, c.severity AS c, h.severity AS d, s.weight AS wa, n.weight AS wb, c.weight AS wc,
    0.75 * pow(0.5, h.age / 5.0) * least(1.0, h.n_reports / 2.0) AS wd, s.age AS age_a, c.age AS age_c, c.modeled, h.n_reports, x.worst, k.flow
  FROM {_TARGETS} t LEFT JOIN ({_on_days(P._SENSORS)}) s ON s.slug = t.slug AND s.eval_date = t.eval_date LEFT JOIN ({_on_days(P._SNOW_LINES)}) n ON n.slug = t.slug AND n.eval_date = t.eval_date
  LEFT JOIN ({_on_days(P._SCENES)}) c ON c.slug = t.slug AND c.eval_date = t.eval_date LEFT JOIN said h ON h.target = t.id LEFT JOIN worst x ON x.target = t.id
  LEFT JOIN ({_on_days(P._CREEKS)}) k ON k.slug = t.slug AND k.eval_date = t.eval_date
), {P._JUDGE}, f AS ({P._SHOW.replace('{keys}', 'id, slug, eval_date, observed, c IS NOT NULL AS satellite, coalesce(n_reports, 0) AS others')}
), e AS (
  SELECT *, CASE status WHEN 'open' THEN 0 WHEN 'snow_caution' THEN 1 WHEN 'traction_advised' THEN 2 WHEN 'not_recommended' THEN 3 END AS engine FROM f
), near AS (
  SELECT DISTINCT l.lkey AS slug, d.eval_date FROM ({P._SENSOR_LINKS}) l JOIN $snowpack r ON r.station = l.rkey JOIN {_DAYS} d ON d.eval_date - r.day BETWEEN 0 AND 10 WHERE abs(l.gap_ft) <= 300
)
SELECT e.*, CASE WHEN engine IS NULL THEN 'no_verdict' WHEN engine = observed THEN 'exact' WHEN abs(engine - observed) = 1 THEN 'off_by_one' ELSE 'off_by_more' END AS outcome,
  CASE WHEN engine < observed THEN 'engine_less' WHEN engine > observed THEN 'engine_more' END AS direction, near.slug IS NOT NULL AS sensor_near
FROM e LEFT JOIN near ON near.slug = e.slug AND near.eval_date = e.eval_date"""


def _without(t: Tables) -> DataFrame:
    said = C.report_severity(F.col("snow"), F.col("traction"), F.col("comfort"), F.col("register"))
    posts = t.posts.select("id", "slug", "day", "author", said.alias("said"), "crossing", R.observed_step(F.col("snow"), F.col("traction")).alias("observed"))
    targets = backtest.left_out(posts)
    days = [str(r["day"]) for r in posts.filter("observed is not null and day is not null").select("day").distinct().orderBy("day").collect()]  # days of the calendar
    # Places that are asked about, their stations, and those their scenes are modelled on.
    of_asked = lambda df: df.join(targets.select("slug").distinct(), "slug", "left_semi")
    linked, seen_from_above = of_asked(P._linked(t)), of_asked(t.scenes)
    needed = linked.select("station").union(seen_from_above.select("from_station")).distinct()
    judged = screen.judged_as_of(t.snowpack.join(needed, "station", "left_semi"), days, P.CEILING)
    scenes = C.scenes(seen_from_above, days, judged.filter("state = 'rejected'").select("station", "eval_date", "day"))
    seen = linked.join(C.newest(judged), "station")
    out = backtest.judged_without(targets, C.sensors(seen), C.believed_lines(linked, judged), scenes, C.creeks(of_asked(t.gauges), days))
    near = backtest.near_in_height(linked, t.snowpack, targets).withColumn("near", F.lit(True))
    rows = backtest.classified(out).join(near, ["slug", "eval_date"], "left")
    return rows.withColumn("sensor_near", F.coalesce("near", F.lit(False))).drop("near")


@query(_LEFT_OUT)
def backtest_rows(t: Tables) -> DataFrame:
    """Every report that states a step, against the verdict of its place and day without it and its party's."""
    return _without(t)


_SEASON = "CASE WHEN month(eval_date) BETWEEN 4 AND 6 THEN 'early' WHEN month(eval_date) IN (7, 8) THEN 'midsummer' WHEN month(eval_date) IN (9, 10) THEN 'fall' ELSE 'winter' END"
_SPLITS = ["confidence", "season", "year", "satellite", "sensor_near", "others"]


@query(
    f"""WITH r AS (SELECT confidence, {_SEASON} AS season, year(eval_date)::VARCHAR AS year, satellite::VARCHAR AS satellite, sensor_near::VARCHAR AS sensor_near, (others > 0)::VARCHAR AS others, engine, observed FROM ({_LEFT_OUT}) x WHERE engine IS NOT NULL),
c AS (SELECT CASE {' '.join(f"WHEN grouping({c}) = 0 THEN '{c}'" for c in _SPLITS)} ELSE 'overall' END AS split, coalesce({', '.join(_SPLITS)}) AS cell, count(*) AS n, count(*) FILTER (WHERE engine = observed) AS exact,
  count(*) FILTER (WHERE abs(engine - observed) <= 1) AS within_one, count(*) FILTER (WHERE engine > observed) AS more, count(*) FILTER (WHERE engine < observed) AS less FROM r GROUP BY GROUPING SETS ((), {', '.join(f'({c})' for c in _SPLITS)}))
SELECT split, cell, n, exact, within_one, more, less, CASE WHEN n >= 10 THEN round(greatest({_wilson('-')}, 0.0), 6) END AS low, CASE WHEN n >= 10 THEN round(least({_wilson('+')}, 1.0), 6) END AS high FROM c"""
)
def backtest_report(t: Tables) -> DataFrame:
    """How often the verdicts of the backtest hold, overall and by what they rest on."""
    rows = _without(t).filter("engine is not null").withColumn("season", R.season_bucket(F.col("eval_date"))).withColumn("year", F.year("eval_date")).withColumn("others", F.col("others") > 0)
    return backtest.outcome_sets(rows.select("engine", "observed", *_SPLITS), _SPLITS)
