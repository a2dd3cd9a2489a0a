"""The melt season of a place against the seasons on file at its stations, told in sentences.

``station_seasons`` says what each season of a station comes to, ``standings`` lays it beside the
station's earlier seasons, and ``records`` assembles a row for each place that has something to tell.
A place has a handful of stations and a station a handful of seasons, so a place's record is one array;
everything before it is keyed by station and season.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import plain_station
from . import islands
from .conditions import BARE, WINDOW, first_melt_outs, looked_up, melt_outs
from .gazetteer import one_per_site
from .season import in_season, middle, season_day
from .snowfall import FAST, GAP, LAST, PAD, SLOW, middle_day

#: Most water that is believed (in), days after 1 April by which a record must begin to hold a peak, days that stations may differ by.
MOST_WATER, LATE_START, DISAGREE = 150.0, 7, 21
KM_A_MILE = 1.609344
#: Why a season has no date.
REASONS = {
    "no data": "no readings on file",
    "erratic": "readings jump by more than snow can",
    "residual": "the sensor kept a reading on bare ground",
    "wandering": "the sensor drifted on bare ground",
    "stuck": "the reading held through the summer",
    "quiet": "stopped reporting before melt-out",
    "gap": "a hole in the record hides the melt-out",
    "unconfirmed": "bare for less than a week so far",
}
#: Numbers in words.
NUMBERS = {2: "two", 3: "three", 4: "four", 5: "five", 6: "six", 7: "seven", 8: "eight"}
ORDINALS = {2: "second", 3: "third", 4: "fourth", 5: "fifth", 6: "sixth", 7: "seventh"}


def _season_of(today: str) -> int:
    return int(today[:4]) - (today[5:] < "04-01")


def station_seasons(daily: DataFrame, today: str, steep: float = 10.0, thin: float = 3.0) -> DataFrame:
    """station, year, status, reason, melt_out, peak, peak_day, last, last_value of each season with readings up to ``today``.

    Status: melted (on a day), snow (at the end of the record), bare_at_start (since before 1 April) or unusable, with
    the first reason that holds. ``daily``: station, day, value, one row a day; values that no pack holds and nulls are passed over.
    A season bare at its start, or on file only from later than LATE_START days into April, has no peak.
    """
    now = F.lit(today).cast("date")
    own = daily.filter(in_season(F.col("day")) & (F.col("day") <= now) & F.col("value").between(0.0, MOST_WATER))
    # A season is a series of its own: its first and last readings have no neighbours in other years.
    own = own.select(F.struct("station", F.year("day").alias("year")).alias("station"), "day", "value")
    series = islands.without_strays(own, steep)
    whole = series.groupBy("station").agg(
        F.min("day").alias("first"), F.max("day").alias("last"), F.max_by("value", "day").alias("last_value"),
        F.max("value").alias("peak"), F.max_by("day", F.struct("value", -F.unix_date("day"))).alias("peak_day"),
        F.min(F.when(F.col("value") >= BARE, F.col("day"))).alias("snow_from"),
    )
    ended = melt_outs(series).groupBy("station").agg(F.max_by(F.struct("since", "observed"), "day").alias("ended"))
    melts = first_melt_outs(series).select("station", "since", "observed")
    flags = islands.shape_flags(series, steep=steep, low=BARE, high=thin)
    held = islands.holds(series).select("station", "holds")
    told = whole.join(ended, "station").join(flags, "station").join(melts, "station", "left").join(held, "station", "left")
    fault = F.when(F.col("erratic"), "erratic").when(F.col("lingers"), "residual").when(F.col("wanders"), "wandering").when(F.col("holds"), "stuck")
    until = F.least(F.make_date("station.year", F.lit(8), F.lit(31)), now)
    current = F.datediff(until, "last") <= WINDOW["sensor"]
    snowy = F.col("last_value") >= BARE
    after = F.when(snowy, F.when(current, "snow").otherwise("quiet")).when(current, "unconfirmed")
    after = after.when(F.coalesce(F.col("ended.observed"), F.lit(False)), "melted").otherwise("quiet")
    melted = F.when(F.col("observed"), "melted").when(F.col("snow_from") < F.col("since"), "gap").otherwise("bare_at_start")
    outcome = F.coalesce(fault, F.when(F.col("since").isNotNull(), melted), after)
    usable = outcome.isin("melted", "snow", "bare_at_start")
    bare = F.coalesce(~F.col("observed") & (F.col("since") == F.col("first")), F.lit(False))
    peaked = fault.isNull() & (season_day(F.col("first")) <= LATE_START) & ~bare
    date = F.when(outcome == "melted", F.coalesce("since", F.col("ended.since")))
    return told.select(
        "station.station", "station.year", F.when(usable, outcome).otherwise("unusable").alias("status"), F.when(~usable, outcome).alias("reason"), date.alias("melt_out"),
        F.when(peaked, F.round("peak", 1)).alias("peak"), F.when(peaked, F.col("peak_day")).alias("peak_day"), "last", F.round("last_value", 1).alias("last_value"),
    )


def _whole(x: Column) -> Column:
    return (F.signum(x) * F.floor(F.abs(x) + 0.5)).cast("int")


def _nice(day: Column) -> Column:
    return F.date_format(day, "MMMM d")


def _inches(x: Column) -> Column:
    return F.format_string("%.1f in", x)


def _feet(x: Column) -> Column:
    return F.format_number(x.cast("double"), 0)


def _and(parts: Column) -> Column:
    """Parts in a row, the last after an and."""
    n = F.size(parts)
    return F.when(n <= 2, F.array_join(parts, " and ")).otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(1))), ", "), F.lit(" and "), F.get(parts, n - 1)))


def _days(n: Column) -> Column:
    return F.concat(n.cast("string"), F.when(F.abs(n) == 1, " day").otherwise(" days"))


def _shift(n: Column) -> Column:
    return F.concat(_days(F.abs(n)), F.when(n > 0, " later").otherwise(" earlier"))


def _number(n: Column) -> Column:
    return F.coalesce(looked_up(n, NUMBERS), n.cast("string"))


def seasons_phrase(used: Column, on_file: Column, kind: str) -> Column:
    """How many seasons something rests on, of how many on file, and which: both are ordered arrays of years."""
    n, first, last = F.size(used), F.get(used, F.lit(0)), F.get(used, F.size(used) - 1)
    span = F.when((n >= 3) & (last - first == n - 1), F.concat(first.cast("string"), F.lit(" to "), last.cast("string"))).otherwise(_and(used.cast("array<string>")))
    of = F.when(used == on_file, F.concat(F.lit("the "), _number(n))).otherwise(F.concat(_number(n), F.lit(" of the "), _number(F.size(on_file))))
    return F.concat(of, F.lit(f" {kind} on file ("), span, F.lit(")"))


def standings(linked: DataFrame, seasons: DataFrame, first_years: DataFrame, today: str, earlier: int = 2) -> DataFrame:
    """Each station of a place beside its own earlier seasons, with the words for it.

    ``linked``: slug, station, name, network, lat, lon, elevation_ft, distance_km, place_ft; ``first_years``: station, first_year of
    all its readings. Years that a place knows of and a station has no readings in count as seasons without data. A median that falls
    before or after the record is none; so is a comparison with fewer than ``earlier`` seasons.
    """
    season = _season_of(today)
    known = linked.join(first_years, "station")
    known = known.withColumn("opens", F.least(F.min("first_year").over(Window.partitionBy("slug")), F.lit(season)))
    years = known.select("slug", "station", F.explode(F.sequence("opens", F.lit(season))).alias("year"))
    row = F.struct(
        "year", F.coalesce("status", F.lit("unusable")).alias("status"), F.when(F.col("status").isNull(), "no data").otherwise(F.col("reason")).alias("reason"),
        "melt_out", "peak", "peak_day", "last", "last_value",
    )
    lists = years.join(seasons, ["station", "year"], "left").groupBy("slug", "station").agg(F.array_sort(F.collect_list(row)).alias("seasons"))
    told = known.drop("first_year", "opens").join(lists, ["slug", "station"])
    told = told.withColumn("now", F.element_at("seasons", -1)).withColumn("past", F.filter("seasons", lambda s: s["year"] < season))
    told = told.withColumn("used", F.filter("past", lambda s: s["status"] != "unusable"))
    place = lambda s: F.when(s["status"] == "melted", season_day(s["melt_out"]).cast("double")).when(s["status"] == "snow", float("inf")).otherwise(float("-inf"))
    told = told.withColumn("median", F.when(F.size("used") >= earlier, middle(F.transform("used", place))))
    has, status = F.col("median").isNotNull(), F.col("now.status")
    comparison = F.when(~has | (status == "unusable"), None).when(status == "melted", "exact").when(status == "snow", "still_snow").otherwise("before_record")
    shift = F.when(status == "melted", _whole(season_day(F.col("now.melt_out")) - F.col("median"))).when(status == "snow", _whole(season_day(F.col("now.last")) - F.col("median")))
    told = told.withColumn("comparison", comparison).withColumn("days", F.when(F.col("comparison").isNotNull(), shift.otherwise(-(_whole(F.col("median")) + 1))))
    peaks = F.filter("seasons", lambda s: s["peak"].isNotNull())
    told = told.withColumn("peaks", F.when(F.col("now.peak").isNotNull() & (F.size(peaks) > earlier), peaks))
    rank = F.size(F.filter("peaks", lambda s: s["peak"] > F.col("now.peak"))) + 1

    when = lambda s: F.when(s["status"] == "melted", _nice(s["melt_out"])).when(s["status"] == "snow", F.concat(F.lit("after "), _nice(s["last"]))).otherwise("before April 1")
    year = lambda s: F.concat(F.lit(" ("), s["year"].cast("string"), F.lit(")"))
    used = F.array_join(F.transform("used", lambda s: F.concat(when(s), year(s))), ", ")
    out = F.transform(F.filter("past", lambda s: s["status"] == "unusable"), lambda s: F.concat(s["year"].cast("string"), F.lit(": "), looked_up(s["reason"], REASONS)))
    notes = F.concat(F.lit("earlier seasons: "), F.array_join(F.concat(F.array(used), out), "; "))
    before = F.array_join(F.transform(F.filter("peaks", lambda s: s["year"] != season), lambda s: F.concat(_inches(s["peak"]), year(s))), ", ")

    gap = F.col("place_ft") - F.col("elevation_ft")
    carried = (F.col("now.status") == "melted") & (F.abs(gap) <= GAP)
    ways = (gap / SLOW, gap / FAST)
    name = plain_station(F.coalesce("name", F.col("station").cast("string")))
    feet = F.round("elevation_ft").cast("long")
    return told.select(
        "slug", "station", "network", "lat", "lon", "place_ft", F.coalesce("distance_km", F.lit(float("inf"))).alias("distance_km"),
        F.size(F.filter("seasons", lambda s: s["status"] != "unusable")).alias("usable"), feet.alias("elevation_ft"), name.alias("name"),
        F.round(F.col("distance_km") / KM_A_MILE, 1).alias("miles"), F.coalesce(F.concat(name, F.lit(" ("), _feet(feet), F.lit(" ft)")), name).alias("label"),
        "seasons", "now", "comparison", "days", F.when(has, F.transform("used", lambda s: s["year"])).alias("earlier_years"), F.when(has, _whole(F.col("median"))).alias("median_day"),
        F.when(F.col("peaks").isNotNull(), rank).alias("peak_rank"), F.transform("peaks", lambda s: s["year"]).alias("peak_years"), notes.alias("notes"),
        F.concat(_inches(F.col("now.peak")), F.lit(" on "), _nice(F.col("now.peak_day")), F.lit("; earlier seasons: "), before).alias("peak_detail"), gap.cast("double").alias("gap_ft"),
        F.when(carried, F.date_add("now.melt_out", F.floor(F.least(*ways) - PAD).cast("int"))).alias("lo"),
        F.when(carried, F.date_add("now.melt_out", F.ceil(F.greatest(*ways) + PAD).cast("int"))).alias("hi"),
        F.when((F.col("now.status") == "snow") & (gap >= 0), F.col("now.last")).alias("holds_on"),
    )


def _evidence(group: Column, detail) -> Column:
    return F.transform(group, lambda s: F.struct(s["station"].alias("station"), s["name"].alias("name"), s["elevation_ft"].alias("elevation_ft"), s["miles"].alias("distance_mi"), detail(s).alias("detail")))


def _labels(group: Column) -> Column:
    return F.transform(group, lambda s: s["label"])


def _who(group: Column) -> Column:
    return F.when(F.size(group) <= 2, _and(_labels(group))).otherwise(F.concat(F.size(group).cast("string"), F.lit(" nearby stations")))


def _fact(kind: str, given: Column, text: Column, evidence: Column, estimate: Column | None = None, disagree: Column | None = None) -> Column:
    """The fact, or null where it is not given or its sentence is null."""
    flags = [F.lit(False) if c is None else c for c in (estimate, disagree)]
    return F.when(given & text.isNotNull(), F.struct(F.lit(kind).alias("kind"), text.alias("text"), flags[0].alias("estimate"), flags[1].alias("disagree"), evidence.alias("evidence")))


def records(linked: DataFrame, daily: DataFrame, today: str, steep: float = 10.0, thin: float = 3.0, km: float = 1.5, feet: float = 500) -> DataFrame:
    """Slug, as_of, year, earlier_years, melt_out, pass_window, chart, facts, stations of each place that has a fact.

    Facts, in order: when snow left the stations against earlier seasons, where it still lies, how the highest water ranks, and when snow
    leaves the place itself, carried from its stations by their height. Every fact names its seasons and stations and holds their evidence.
    Stations with the same earlier seasons speak together: those with most seasons, then most stations, then the nearest. One site counts
    once (see ``one_per_site``). Places without stations, or with nothing to compare, have no row.
    """
    season, this_year, now = _season_of(today), _season_of(today) == int(today[:4]), F.lit(today).cast("date")
    firsts = daily.filter((F.col("day") <= now) & F.col("value").isNotNull()).groupBy("station").agg(F.min(F.year("day")).alias("first_year"))
    told = standings(linked, station_seasons(daily, today, steep, thin), firsts, today)
    ahead = ("distance_km", "station")
    row = F.struct((-F.col("usable")).alias("u"), *ahead, *(c for c in told.columns if c not in ("slug", *ahead)))
    sites = one_per_site(F.col("all"), km, feet)
    near = told.groupBy("slug").agg(F.array_sort(F.collect_list(row)).alias("all")).select("slug", sites.alias("sites"))
    ranked = F.transform("sites", lambda s: F.struct(s["distance_km"].alias("d"), s["u"].alias("u"), s["station"].alias("k"), s.alias("s")))
    p = near.select("slug", F.transform(F.array_sort(ranked), lambda x: x["s"]).alias("st"))
    years = F.flatten(F.transform("st", lambda s: F.transform(F.filter(s["seasons"], lambda y: (y["year"] < season) & (F.coalesce(y["reason"], F.lit("")) != "no data")), lambda y: y["year"])))
    p = p.withColumn("on_file", F.array_sort(F.array_distinct(years)))
    for kind in ("exact", "before_record", "still_snow"):
        p = p.withColumn(kind, F.filter("st", lambda s: s["comparison"] == kind))

    # When snow left.
    same = lambda s: F.filter("exact", lambda o: o["earlier_years"] == s["earlier_years"])
    best = F.array_max(F.transform("exact", lambda s, i: F.struct(F.size(s["earlier_years"]).alias("y"), F.size(same(s)).alias("n"), (-s["distance_km"]).alias("d"), (-i).alias("i"), s["earlier_years"].alias("years"))))
    p = p.withColumn("base", best["years"]).withColumn("group", F.coalesce(F.filter("exact", lambda s: s["earlier_years"] == F.col("base")), F.array()))
    p = p.withColumn("min_days", F.array_min(F.transform("group", lambda s: s["days"]))).withColumn("max_days", F.array_max(F.transform("group", lambda s: s["days"])))
    lo, hi, when = F.col("min_days"), F.col("max_days"), "this year" if this_year else f"in {season}"
    agree = hi - lo <= DISAGREE
    average = lambda years: F.concat(F.when(F.size(years) == 2, "the midpoint of ").otherwise("the median of "), seasons_phrase(years, F.col("on_file"), "earlier seasons"))
    lone = lambda c: F.get(c, F.lit(0))
    each = F.transform("group", lambda s: F.concat(s["label"], F.lit(" "), _shift(s["days"])))
    step = F.when(lo == hi, _shift(lo)).when(lo == 0, F.concat(F.lit("up to "), _shift(hi))).when(hi == 0, F.concat(F.lit("up to "), _shift(lo)))
    step = step.when((lo < 0) & (hi > 0), F.concat(F.lit("between "), _shift(lo), F.lit(" and "), _shift(hi)))
    ends = (F.least(F.abs(lo), F.abs(hi)).cast("string"), F.greatest(F.abs(lo), F.abs(hi)).cast("string"))
    step = step.otherwise(F.concat(ends[0], F.lit(" to "), ends[1], F.when(lo > 0, " days later").otherwise(" days earlier")))
    left = (
        F.when(~agree, F.concat(F.lit(f"The nearby stations disagree about {'this year' if this_year else season}: snow left "), _and(each), F.lit(" than "), average(F.col("base")), F.lit(".")))
        .when((lo == 0) & (hi == 0), F.concat(F.lit("Snow left "), _who(F.col("group")), F.lit(f" {when} on the same day as "), average(F.col("base")), F.lit(".")))
        .otherwise(F.concat(F.lit("Snow left "), _who(F.col("group")), F.lit(" "), step, F.lit(f" {when} than "), average(F.col("base")), F.lit(".")))
    )
    early = lone(F.col("before_record"))
    gone = F.concat(
        F.lit("Snow had already left "), early["label"], F.lit(f" when {'this year' + chr(39) + 's' if this_year else f'the {season}'} record begins on April 1, at least "),
        _days(-early["days"]), F.lit(" earlier than "), average(early["earlier_years"]), F.lit("."),
    )
    exact, bound = F.size("group") > 0, F.size("before_record") > 0
    ids = lambda group: F.transform(group, lambda s: s["station"])
    summary = F.when(
        exact,
        F.struct(F.lit("exact").alias("kind"), agree.alias("agree"), (hi - lo).alias("spread_days"), lo.alias("min_days"), hi.alias("max_days"), F.col("base").alias("earlier_years"), ids("group").alias("stations")),
    ).when(
        bound,
        F.struct(
            F.lit("before_record").alias("kind"), F.lit(True).alias("agree"), F.lit(0).alias("spread_days"), early["days"].alias("min_days"), early["days"].alias("max_days"),
            early["earlier_years"].alias("earlier_years"), ids(F.slice("before_record", 1, 1)).alias("stations"),
        ),
    )
    facts = [
        _fact("melt_out", exact, left, _evidence(F.col("group"), lambda s: F.concat(F.lit("left "), _nice(s["now"]["melt_out"]), F.lit("; "), s["notes"])), disagree=~agree),
        _fact("melt_out", ~exact & bound, gone, _evidence(F.slice("before_record", 1, 1), lambda s: F.concat(F.lit("already bare on April 1; "), s["notes"]))),
    ]

    # Where it still lies.
    held = lone(F.col("still_snow"))
    dates = F.concat(F.when(F.size(held["earlier_years"]) == 2, "midpoint of the melt-out dates of ").otherwise("median melt-out date of "), seasons_phrase(held["earlier_years"], F.col("on_file"), "earlier seasons"))
    head = F.concat(F.lit("Snow was still on the ground at "), held["label"], F.lit(" on "), _nice(held["now"]["last"]), F.lit("" if this_year else f", {season}"))
    usual = F.date_add(F.lit(f"{season}-04-01").cast("date"), held["median_day"])
    lies = F.when(held["days"] > 0, F.concat(head, F.lit(", "), _days(held["days"]), F.lit(" past the "), dates, F.lit("."))).otherwise(
        F.concat(head, F.lit(". The "), dates, F.lit(" there is "), _nice(usual), F.lit("."))
    )
    depth = lambda s: F.concat(_inches(s["now"]["last_value"]), F.lit(" of snow water on "), _nice(s["now"]["last"]), F.lit("; "), s["notes"])
    facts.append(_fact("still_snow", F.size("still_snow") > 0, lies, _evidence(F.slice("still_snow", 1, 1), depth)))

    # How its highest water ranks: the nearest of the fullest records names the seasons.
    p = p.withColumn("high", F.filter("st", lambda s: s["peak_rank"].isNotNull()))
    fullest = F.array_max(F.transform("high", lambda s, i: F.struct(F.size(s["peak_years"]).alias("n"), (-i).alias("i"), s["peak_years"].alias("years"))))
    p = p.withColumn("peak_years", fullest["years"]).withColumn("peaks", F.coalesce(F.filter("high", lambda s: s["peak_years"] == F.col("peak_years")), F.array()))
    p = p.withColumn("ranks", F.array_sort(F.array_distinct(F.transform("peaks", lambda s: s["peak_rank"]))))
    spoken = "this year's highest snow water on or after April 1" if this_year else f"the highest snow water on or after April 1 in {season}"
    phrase = lambda r, of: F.when(r == 1, "the highest").when(r == of, "the lowest").otherwise(F.concat(F.lit("the "), F.coalesce(looked_up(r, ORDINALS), F.concat(F.lit("number "), r.cast("string"))), F.lit(" highest")))
    seasons = seasons_phrase(F.col("peak_years"), F.concat("on_file", F.array(F.lit(season))), "seasons")
    of = F.size("peak_years")
    one = lone(F.col("peaks"))
    single = F.concat(F.lit("At "), one["label"], F.lit(f", {spoken} was "), _inches(one["now"]["peak"]), F.lit(", "), phrase(one["peak_rank"], of), F.lit(" of "), seasons, F.lit("."))
    whose = lambda r: F.filter("peaks", lambda s: s["peak_rank"] == r)
    where = lambda r: F.when((F.size("ranks") == 1) & (F.size("peaks") > 2), F.concat(F.lit("all "), F.size("peaks").cast("string"), F.lit(" nearby stations"))).otherwise(_and(_labels(whose(r))))
    parts = F.transform("ranks", lambda r, i: F.concat(phrase(r, of), F.when(i == 0, F.concat(F.lit(" of "), seasons)).otherwise(""), F.lit(" at "), where(r)))
    many = F.concat(F.lit(f"{spoken[0].upper()}{spoken[1:]} was "), _and(parts), F.lit("."))
    facts.append(_fact("peak", F.size("peaks") > 0, F.when(F.size("peaks") == 1, single).otherwise(many), _evidence(F.col("peaks"), lambda s: s["peak_detail"])))
    p = p.withColumn("summary", summary).withColumn("told", F.array_compact(F.array(*facts)))

    # When it leaves the place itself.
    p = p.withColumn("carried", F.filter("st", lambda s: s["lo"].isNotNull())).withColumn("floor", F.array_max(F.transform("st", lambda s: s["holds_on"])))
    lows, highs = F.transform("carried", lambda s: F.unix_date(s["lo"])), F.transform("carried", lambda s: F.unix_date(s["hi"]))
    p = p.withColumn("start", middle_day(lows, False)).withColumn("end", middle_day(highs, True)).withColumn("apart", F.array_max(lows) > F.array_min(highs))
    any_, above = F.size("carried") > 0, F.coalesce(F.col("floor") > F.col("end"), F.lit(False))
    differ = any_ & (F.col("apart") | above)
    over = (F.year("end") != season) | (F.date_format("end", "MM-dd") > LAST)
    given = any_ & ~differ & ~over
    p = p.withColumn("start", F.greatest("start", "floor")).withColumn("given", given).withColumn("differ", differ)
    past = F.col("end") < now
    verb, year = F.when(past, "left").otherwise("leaves"), "" if this_year else f" in {season}"
    points = lambda s: F.concat(F.lit("points to "), _nice(s["lo"]), F.lit(" to "), _nice(s["hi"]))
    told_each = F.transform("carried", lambda s: F.concat(s["label"], F.lit(" "), points(s)))
    holding = F.filter("st", lambda s: s["holds_on"] == F.col("floor"))
    snow = F.when(~F.col("apart") & F.col("floor").isNotNull(), F.slice(holding, 1, 1)).otherwise(F.slice("st", 1, 0))
    told_each = F.concat(told_each, F.transform(snow, lambda s: F.concat(F.lit("snow was still on the ground at "), s["label"], F.lit(" on "), _nice(s["holds_on"]))))
    clash = F.concat(F.lit("The nearby stations disagree about when snow "), verb, F.lit(f" the pass itself{year}, so no window is given: "), _and(told_each), F.lit("."))
    guess = F.concat(
        F.lit("An estimate: snow "), verb, F.lit(" the pass itself between "), _nice(F.col("start")), F.lit(" and "), _nice(F.col("end")), F.lit(f"{year}, carried from the melt-out "),
        F.when(F.size("carried") == 1, "date").otherwise("dates"), F.lit(" at "), _who(F.col("carried")), F.lit(" to the pass elevation."), F.when(past, "").otherwise(" Today falls inside that window."),
    )
    gap = lambda s: F.when(F.abs(s["gap_ft"]) < 50, "at the pass elevation").otherwise(F.concat(_feet(F.abs(F.bround(s["gap_ft"], 0))), F.when(s["gap_ft"] > 0, " ft below the pass").otherwise(" ft above the pass")))
    seen = _evidence(F.col("carried"), lambda s: F.concat(F.lit("melted out "), _nice(s["now"]["melt_out"]), F.lit(", "), gap(s), F.lit("; "), points(s)))
    still = _evidence(snow, lambda s: F.concat(F.lit("still under snow on "), _nice(s["holds_on"])))
    window_fact = F.coalesce(
        _fact("pass_window", F.col("differ"), clash, F.concat(seen, still), disagree=F.lit(True)),
        _fact("pass_window", F.col("given"), guess, seen, estimate=F.lit(True)),
    )
    window = F.when(F.col("given"), F.struct(F.when(past, "melted").otherwise("underway").alias("state"), F.col("start").alias("from"), F.col("end").alias("through"), ids("carried").alias("stations")))
    record = F.struct(
        now.alias("as_of"), F.lit(season).alias("year"), F.col("on_file").alias("earlier_years"), F.col("summary").alias("melt_out"), window.alias("pass_window"), _chart().alias("chart"),
        F.concat("told", F.array_compact(F.array(window_fact))).alias("facts"), F.transform("st", lambda s: F.struct(*(s[c].alias(c) for c in STATION))).alias("stations"),
    )
    # Not a filter: that would be pushed below every column above, with all they are made of written out in it each time.
    return p.select("slug", F.inline(F.when(F.size("told") > 0, F.array(record))))


STATION = ("station", "name", "elevation_ft", "miles", "seasons", "comparison", "days", "earlier_years", "median_day", "peak_rank", "peak_years")


def _chart() -> Column:
    """The nearest station by the best comparison it has, with the seasons worth drawing."""
    brief = lambda day: F.date_format(day, "MMM d")
    note = lambda y: (
        F.when(y["status"] == "melted", brief(y["melt_out"])).when(y["status"] == "bare_at_start", "before Apr 1").when(y["status"] == "snow", F.concat(F.lit("snow on "), brief(y["last"])))
        .otherwise(F.concat(F.lit("no date: "), looked_up(y["reason"], REASONS)))
    )
    ranked = F.filter("st", lambda s: s["comparison"].isNull() & s["peak_rank"].isNotNull())
    first = F.get(F.concat("exact", "still_snow", "before_record", ranked), F.lit(0))
    drawn = F.filter(first["seasons"], lambda y: ~F.coalesce(y["reason"], F.lit("")).isin("no data", "erratic"))
    seasons = F.transform(drawn, lambda y: F.struct(y["year"].alias("year"), y["melt_out"].alias("melt_out"), note(y).alias("note"), y["peak"].alias("peak")))
    return F.when(first.isNotNull(), F.struct(first["station"].alias("station"), first["name"].alias("name"), first["elevation_ft"].alias("elevation_ft"), F.lit(MOST_WATER).alias("most"), seasons.alias("seasons")))
