"""New snow, stalled sensors, seasons against earlier ones, and melt-out windows carried to a place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import asof
from .conditions import is_blind
from .season import middle, season_day

#: Least rise of water and depth (in), most water a day, days that a reading stays new, windows in days.
WATER, DEPTH, MOST, NEW = 0.3, 2.0, 10.0, 2
WINDOWS = {"24h": 1, "72h": 3}
#: Feet a day that a snow line climbs, slow and fast, days of scatter, feet between station and place, last day of a window.
SLOW, FAST, PAD, GAP, LAST = 40.0, 100.0, 21, 2500.0, "10-15"


def recent_changes(daily: DataFrame, today: str) -> DataFrame:
    """Station, as_of, and the change of water and depth over exactly one and three days to the newest reading.

    ``daily``: station, day, value (below zero counts as zero), depth or null. Only the few days that
    can matter are read and grouped once; a station without a reading of the last two days has no row.
    """
    now = F.lit(today).cast("date")
    near = daily.filter(F.datediff(now, F.col("day")).between(0, NEW + max(WINDOWS.values())))
    entry = F.struct("day", F.struct(F.greatest("value", F.lit(0.0)).alias("w"), F.when(F.col("depth") < 0, 0.0).otherwise(F.col("depth")).alias("d")))
    seen = near.groupBy("station").agg(F.max("day").alias("as_of"), F.map_from_entries(F.collect_list(entry)).alias("on"))
    seen = seen.filter(F.datediff(now, "as_of") <= NEW)

    def at(days: int) -> Column:
        return F.element_at("on", F.date_sub("as_of", days))

    out = []
    for label, days in WINDOWS.items():
        out.append(F.round(at(0)["w"] - at(days)["w"], 2).alias(f"water_{label}"))
        out.append(F.round(F.when(at(0)["d"].isNotNull() & at(days)["d"].isNotNull(), at(0)["d"] - at(days)["d"])).alias(f"depth_{label}"))
    return seen.select("station", "as_of", *out)


def rise(water: Column, depth: Column, days: int) -> Column:
    """Depth if the station's own depth confirms a rise, pending if it has none, null without a rise."""
    return F.when(water.between(WATER, MOST * days), F.when(depth.isNull(), "pending").when(depth >= DEPTH, "depth"))


def new_snow(linked: DataFrame) -> DataFrame:
    """The stations of a place with new snow: confirmed by their depth, or by a rise at another of its stations.

    ``linked``: slug, station and the columns of ``recent_changes``.
    """
    place = Window.partitionBy("slug")
    told = linked.withColumn("checked", F.count("*").over(place))
    confirmed = {}
    for label, days in WINDOWS.items():
        told = told.withColumn(f"v_{label}", rise(F.col(f"water_{label}"), F.col(f"depth_{label}"), days))
        v = F.col(f"v_{label}")
        others = F.count(v).over(place) - 1
        told = told.withColumn(f"ok_{label}", F.coalesce((v == "depth") | ((v == "pending") & (others > 0)), F.lit(False)))
        confirmed[label] = F.col(f"ok_{label}")
    by = [F.when(confirmed[w], F.when(F.col(f"v_{w}") == "depth", "depth").otherwise("nearby station")) for w in WINDOWS]
    columns = [F.when(confirmed[w], F.col(f"water_{w}")).alias(f"water_{w}") for w in WINDOWS]
    columns += [F.when(confirmed[w] & (F.col(f"v_{w}") == "depth"), F.col(f"depth_{w}")).alias(f"depth_{w}") for w in WINDOWS]
    return told.filter(confirmed["24h"] | confirmed["72h"]).select("slug", "station", "as_of", "checked", F.coalesce(*by).alias("confirmed_by"), *columns)


def gains_told(found: DataFrame) -> DataFrame:
    """slug, station, text: what each station gained, in a sentence.

    ``found``: the columns of ``new_snow``, with name, elevation_ft (null or 0: not told) and miles. The gain of one day is told first,
    with that of three days behind it; a depth that confirms nothing is null and not told.
    """

    def gain(label: str, water: str, depth: str) -> Column:
        deep = F.concat(F.lit(" and "), F.col(f"depth_{label}").cast("long").cast("string"), F.lit(f" in of {depth}"))
        return F.concat(F.col(f"water_{label}").cast("string"), F.lit(f" in of {water}"), F.coalesce(deep, F.lit("")))

    feet = F.when(F.col("elevation_ft") != 0, F.concat(F.format_number(F.col("elevation_ft").cast("double"), 0), F.lit(" ft, ")))
    head = F.concat(F.col("name"), F.lit(" ("), F.coalesce(feet, F.lit("")), F.col("miles").cast("string"), F.lit(" mi away) gained "))
    until = F.date_format("as_of", "MMM d")
    three = F.coalesce(F.concat(F.lit("; "), gain("72h", "water", "depth"), F.lit(" over 72 hours")), F.lit(""))
    day = F.concat(head, gain("24h", "snow water", "snow depth"), F.lit(" in the 24 hours to "), until, three, F.lit("."))
    longer = F.concat(head, gain("72h", "snow water", "snow depth"), F.lit(" in the 72 hours to "), until, F.lit("."))
    return found.select("slug", "station", F.coalesce(day, longer).alias("text"))


def stalled(daily: DataFrame, linked: DataFrame, dates: list[str], rows: int = 7, tolerance: float = 0.02, least: float = 1.0) -> DataFrame:
    """Slug, eval_date, stations that vote and whose last ``rows`` readings hardly moved.

    ``linked``: slug, station, gap_ft. The spread of the last readings depends on the past
    alone: one pass over the series serves every date.
    """
    last = Window.partitionBy("station").orderBy("day").rowsBetween(-(rows - 1), 0)
    spread = F.max("value").over(last) - F.min("value").over(last)
    flat = (F.count("*").over(last) == rows) & (F.round(spread, 6) <= tolerance) & (F.col("value") >= least)
    flagged = daily.select("station", "day", "value", flat.alias("flat"))
    newest = asof.dates(flagged, dates, 10).groupBy("station", "eval_date").agg(F.max_by(F.struct("value", "flat"), "day").alias("r"))
    voting = linked.join(newest, "station").filter(F.col("r.flat") & ~is_blind(F.col("r.value"), F.col("gap_ft")))
    return voting.groupBy("slug", "eval_date").agg(F.array_sort(F.collect_list("station")).alias("stations"))


def season_days(melts: DataFrame, seasons: DataFrame) -> DataFrame:
    """station, year, status, day: melted on a day of the season, bare_at_start (-inf) or snow (+inf).

    ``melts``: station, year, since; ``seasons``: station, year, every season on file.
    """
    day = season_day(F.col("since")).cast("double")
    status = F.when(F.col("since").isNull(), "snow").when(day < 0, "bare_at_start").otherwise("melted")
    value = F.when(F.col("since").isNull(), float("inf")).when(day < 0, float("-inf")).otherwise(day)
    return seasons.join(melts, ["station", "year"], "left").select("station", "year", "since", status.alias("status"), value.alias("day"))


def against_earlier(days: DataFrame, least: int = 2) -> DataFrame:
    """Each season's day against the median of earlier ones, whose ends may be open; null if it falls outside the record."""
    before = Window.partitionBy("station").orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    told = days.withColumn("earlier", F.collect_list("day").over(before)).withColumn("years", F.collect_list("year").over(before))
    median = F.when(F.size("earlier") >= least, middle(F.col("earlier")))
    told = told.withColumn("median", median)
    whole = lambda c: F.signum(c) * F.floor(F.abs(c) + 0.5)
    kind = F.when(F.col("median").isNull(), None).when(F.col("status") == "melted", "exact").when(F.col("status") == "bare_at_start", "before_record").otherwise("still_snow")
    shift = F.when(F.col("status") == "melted", whole(F.col("day") - F.col("median"))).when(F.col("status") == "bare_at_start", -(whole(F.col("median")) + 1))
    return told.select("station", "year", "status", kind.alias("comparison"), F.when(kind.isNotNull(), shift).cast("long").alias("days_vs_earlier"), F.when(kind.isNotNull(), F.col("years")).alias("earlier_years"))


def baseline(compared: DataFrame, linked: DataFrame) -> DataFrame:
    """Of each place and year the stations that share the fullest set of earlier years: most years, most stations, nearest.

    ``linked``: slug, station, km. A place has a handful of stations, so its groups are small.
    """
    exact = compared.filter("comparison = 'exact'").join(linked, "station")
    groups = exact.groupBy("slug", "year", "earlier_years").agg(F.count("*").alias("n"), F.min("km").alias("km"), F.min("days_vs_earlier").alias("lo"), F.max("days_vs_earlier").alias("hi"))
    order = F.struct(F.size("earlier_years"), F.col("n"), -F.col("km"), F.array_join(F.col("earlier_years").cast("array<string>"), ","))
    best = groups.groupBy("slug", "year").agg(F.max_by(F.struct("earlier_years", "n", "lo", "hi"), order).alias("b"))
    return best.select("slug", "year", F.size("b.earlier_years").alias("seasons"), "b.n", "b.lo", "b.hi", (F.col("b.hi") - F.col("b.lo") <= 21).alias("agree"))


def peak_ranks(ranked: DataFrame, linked: DataFrame) -> DataFrame:
    """Of each place and year the stations with the longest record of peaks, grouped by the rank of this one.

    ``ranked``: station, year, peak_rank, of.
    """
    near = ranked.join(linked, "station")
    longest = F.max("of").over(Window.partitionBy("slug", "year"))
    kept = near.withColumn("longest", longest).filter("of = longest")
    return kept.groupBy("slug", "year", "peak_rank").agg(F.array_sort(F.collect_list("station")).alias("stations"))


def middle_day(days: Column, up: bool) -> Column:
    """The middle of days as numbers; between two, down or up."""
    ordered = F.array_sort(days)
    n = F.size(ordered)
    half = (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2
    return F.date_from_unix_date((F.ceil(half) if up else F.floor(half)).cast("int"))


def windows(days: DataFrame, linked: DataFrame, last_readings: DataFrame) -> DataFrame:
    """Slug, year, state, start, end: when snow leaves a place, carried from its stations by their height.

    ``linked``: slug, station, gap_ft; ``last_readings``: station, year, last. Stations further than GAP
    feet off do not count; one at or below the place that still holds snow puts off the start.
    """
    near = days.join(linked, "station").join(last_readings, ["station", "year"])
    slow, fast = F.col("gap_ft") / SLOW, F.col("gap_ft") / FAST
    melted = (F.col("status") == "melted") & (F.abs("gap_ft") <= GAP)
    lo = F.unix_date("since") + F.floor(F.least(slow, fast) - PAD)
    hi = F.unix_date("since") + F.ceil(F.greatest(slow, fast) + PAD)
    out = near.groupBy("slug", "year").agg(
        F.collect_list(F.when(melted, lo)).alias("lows"), F.collect_list(F.when(melted, hi)).alias("highs"),
        F.max(F.when((F.col("status") == "snow") & (F.col("gap_ft") >= 0), F.col("last"))).alias("floor"),
    ).filter(F.size("lows") > 0)
    start, end = middle_day(F.col("lows"), False), middle_day(F.col("highs"), True)
    out = out.select("slug", "year", start.alias("start"), end.alias("end"), "floor", (F.array_max("lows") > F.array_min("highs")).alias("apart"))
    late = (F.year("end") != F.col("year")) | (F.date_format("end", "MM-dd") > LAST)
    state = F.when(F.col("apart") | F.coalesce(F.col("floor") > F.col("end"), F.lit(False)), "disagree").when(late, "none").otherwise("window")
    given = state == "window"
    return out.select("slug", "year", state.alias("state"), F.when(given, F.greatest("start", "floor")).alias("start"), F.when(given, F.col("end")).alias("end"))
