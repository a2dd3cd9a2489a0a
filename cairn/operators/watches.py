"""Watches: which of five kinds fire between one day's export of a place and the one before, and why.

An export is a row (slug, name, date, status, label, fire, winter) of ``EXPORT``. Exports are paired
with the one before by ``paired`` (a window) or by the stream in ``streaming.watch`` (a state per place);
``fired`` tells of pairs, whoever made them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rows import dealt

#: The kinds in order, miles that a fire must come nearer, the longest quotation.
KINDS = ("any_change", "snow_free", "new_snow", "fire_nearby", "road_restriction")
CLOSER, QUOTED = 3.0, 160
FIRE = "struct<issued_for:date,name:string,acres:long,contained:int,miles:double,direction:string,inside:boolean>"
STATION = "struct<name:string,elevation_ft:long,miles:double,as_of:date,swe:double,depth:double>"
ROAD = "struct<agency:string,road:string,location:string,active:boolean,lines:array<struct<label:string,code:string,text:string>>,miles:double,named:boolean>"
WINTER = f"struct<issued_for:date,as_of:date,stations:array<{STATION}>,roads:array<{ROAD}>>"
EXPORT = f"slug long, name string, date date, status string, label string, fire {FIRE}, winter {WINTER}"
FIELDS = ("slug", "name", "date", "status", "label", "fire", "winter")


def paired(exports: DataFrame) -> DataFrame:
    """(now, was): each export with the one of its place's date before; the first ones have none and are left out.

    A date that comes again counts once: of its rows the one that sorts last by status and label.
    """
    whole = F.struct(*FIELDS)
    # Dealt by place first: exports are wide, and grouping sorts them, so what one task holds must not grow with them.
    once = dealt(exports, "slug").groupBy("slug", "date").agg(F.max_by(whole, F.struct("status", "label", "name")).alias("now"))
    was = F.lag("now").over(Window.partitionBy("slug").orderBy("date"))
    return once.withColumn("was", was).filter("was is not null").select("now", "was")


def _short(day: Column) -> Column:
    return F.date_format(day, "MMM d")


def _number(x: Column) -> Column:
    """As written: without a fraction of nothing."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def _miles(x: Column) -> Column:
    return F.when(x < 0.1, "less than 0.1 mi").when(x >= 10, F.concat(F.floor(x + 0.5).cast("string"), F.lit(" mi"))).otherwise(F.concat(_number(x), F.lit(" mi")))


def _fire(now: Column, was: Column) -> Column:
    fire, before, name = now["fire"], was["fire"], now["name"]
    same = F.coalesce(before["name"] == fire["name"], F.lit(False))
    reached = fire["inside"] & ~(same & F.coalesce(before["inside"], F.lit(False)))
    closer = same & ~fire["inside"] & ~before["inside"] & (before["miles"] - fire["miles"] >= CLOSER)
    acres = F.concat(F.format_number(fire["acres"], 0), F.when(fire["acres"] == 1, " acre").otherwise(" acres"))
    size = F.concat_ws(", ", acres, F.coalesce(F.concat(fire["contained"].cast("string"), F.lit("% contained")), F.lit("containment not reported")))
    mapped = F.concat(F.lit("as mapped on "), _short(fire["issued_for"]))
    inside = F.concat(name, F.lit(" is inside the mapped perimeter of the "), fire["name"], F.lit(", "), size, F.lit(", "), mapped, F.lit("."))
    where = F.concat(F.lit("The "), fire["name"], F.lit(", "), size, F.lit(", is "), _miles(fire["miles"]), F.lit(" to the "), fire["direction"], F.lit(" of "), name, F.lit(" "), mapped)
    nearer = F.concat(where, F.lit("; on "), _short(before["issued_for"]), F.lit(" its edge was "), _miles(before["miles"]), F.lit(" away."))
    text = F.when(fire["inside"] | fire["direction"].isNull(), inside).when(closer, nearer).otherwise(F.concat(where, F.lit(".")))
    return F.when(fire["name"].isNotNull() & (~same | reached | F.coalesce(closer, F.lit(False))), text)


def _snow(now: Column, was: Column) -> Column:
    snow, zero = now["winter"], F.lit(0.0)
    deep, water = lambda s: F.coalesce(s["depth"], zero), lambda s: F.coalesce(s["swe"], zero)
    risen = F.filter(snow["stations"], lambda s: (deep(s) > 0) | (water(s) > 0))
    ranked = F.array_sort(F.transform(risen, lambda s, i: F.struct((-deep(s)).alias("d"), (-water(s)).alias("w"), s["miles"].alias("m"), i.alias("i"), s.alias("s"))))
    top = F.get(ranked, F.lit(0))["s"]
    height = F.coalesce(F.concat(F.format_number(top["elevation_ft"], 0), F.lit(" ft, ")), F.lit(""))
    gained = F.concat_ws(" and ", F.when(water(top) > 0, F.concat(_number(top["swe"]), F.lit(" in of snow water"))), F.when(deep(top) > 0, F.concat(_number(top["depth"]), F.lit(" in of snow depth"))))
    text = F.concat(top["name"], F.lit(" ("), height, _number(top["miles"]), F.lit(" mi away) gained "), gained, F.lit(" in the 24 hours to "), _short(top["as_of"]), F.lit("."))
    return F.when(snow["as_of"].isNotNull() & ~snow["as_of"].eqNullSafe(was["winter"]["as_of"]) & top["name"].isNotNull(), text)


def _road(now: Column, was: Column) -> Column:
    key = lambda r: F.lower(F.concat_ws("|", r["agency"], F.coalesce(r["road"], F.lit("")), r["location"]))
    line = lambda x: F.array_join(F.filter(F.array(x["label"], x["code"], x["text"]), lambda w: F.coalesce(w, F.lit("")) != ""), " ")
    words = lambda r: F.array_join(F.transform(r["lines"], line), " / ")
    earlier = F.coalesce(was["winter"]["roads"], F.array().cast(f"array<{ROAD}>"))
    marked = F.transform(
        now["winter"]["roads"],
        lambda r, i: F.struct(
            (~r["named"]).alias("far"), r["miles"].alias("m"), i.alias("i"), r.alias("r"),
            F.get(F.reverse(F.filter(earlier, lambda e: key(e) == key(r))), F.lit(0)).alias("e"),
        ),
    )
    ranked = F.array_sort(marked)
    stood = lambda x: F.coalesce(x["e"]["active"], F.lit(False))
    told = F.get(F.filter(ranked, lambda x: x["r"]["active"] & ~(stood(x) & (words(x["e"]) == words(x["r"])))), F.lit(0))
    over = F.get(F.filter(ranked, lambda x: ~x["r"]["active"] & stood(x)), F.lit(0))["r"]
    place = lambda r: F.coalesce(F.concat(r["road"], F.lit(" at "), r["location"]), r["location"])
    day, road = _short(now["winter"]["issued_for"]), told["r"]
    coded = F.filter(road["lines"], lambda x: F.coalesce(x["code"], F.lit("")) != "")
    said = F.coalesce(F.get(coded, F.lit(0)), F.get(road["lines"], F.lit(0)))
    quote = F.trim(F.regexp_replace(F.array_join(F.filter(F.array(said["code"], said["text"]), lambda w: F.coalesce(w, F.lit("")) != ""), ": "), r"\s+", " "))
    quote = F.when(F.length(quote) <= QUOTED, quote).otherwise(F.concat(F.regexp_replace(F.left(quote, F.lit(QUOTED)), r"\s+\S*$", ""), F.lit("...")))
    verb = F.when(stood(told), " changed its report for ").otherwise(" reports on ")
    ending = F.when(F.coalesce(quote, F.lit("")) != "", F.concat(F.lit(': "'), quote, F.lit('"'))).otherwise(".")
    new = F.concat(road["agency"], verb, place(road), F.lit(" as of "), day, ending)
    gone = F.concat(over["agency"], F.lit(" no longer reports a restriction on "), place(over), F.lit(" as of "), day, F.lit("."))
    return F.when(road["agency"].isNotNull(), new).when(over["agency"].isNotNull(), gone)


def fired(pairs: DataFrame) -> DataFrame:
    """Slug, date, kind, reason of what fires between ``was`` and ``now``, kinds in their order; nothing unless now's date is later.

    A fire or winter part that is null was not read that day, which isn't the same as none: it fires nothing, and what
    follows it is told as new.
    """
    now, was = F.col("now"), F.col("was")
    turned = now["status"] != was["status"]
    verdict = F.concat(now["name"], F.lit(" reads "), now["label"], F.lit(" as of "), _short(now["date"]), F.lit("; on "), _short(was["date"]), F.lit(" it read "), was["label"], F.lit("."))
    told = pairs.filter(now["date"] > was["date"]).select(
        now["slug"].alias("slug"), now["date"].alias("date"), now["status"].alias("status"),
        F.when(turned, verdict).alias("changed"), _fire(now, was).alias("fire"), _snow(now, was).alias("snow"), _road(now, was).alias("road"),
    )
    reasons = {
        "any_change": F.coalesce("changed", "fire", "road", "snow"), "snow_free": F.when(F.col("status") == "open", F.col("changed")), "new_snow": F.col("snow"),
        "fire_nearby": F.col("fire"), "road_restriction": F.col("road"),
    }
    every = F.array(*(F.struct(F.lit(k).alias("kind"), reasons[k].alias("reason")) for k in KINDS))
    return told.select("slug", "date", F.inline(F.filter(every, lambda x: x["reason"].isNotNull())))
