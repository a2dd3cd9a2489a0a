"""Forecast grids: intervals of layers split over local days, a row per place and day, and what stands out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import ZONE, interval

#: Layers of a grid document.
LAYERS = ("temperature", "snowLevel", "probabilityOfPrecipitation", "snowfallAmount", "probabilityOfThunder", "windGust")
#: Degrees F a thousand feet, least chances of snow and thunder (%), least gust (mph), days ahead.
LAPSE, SNOWY, THUNDER, WINDY, DAYS = 3.5, 30, 25, 45, 7
M_FT, MM_IN, KMH_MPH = 3.28084, 1 / 25.4, 0.621371


def layers(grids: DataFrame) -> DataFrame:
    """Slug, elevation_m, layer, valid, value out of grid documents (slug, doc); null values are left out."""
    values = "struct<values:array<struct<validTime:string,value:double>>>"
    doc = F.from_json("doc", f"elevation struct<value:double>, {', '.join(f'{n} {values}' for n in LAYERS)}")
    parsed = grids.select("slug", doc.alias("d"))
    each = F.array(*(F.struct(F.lit(n).alias("layer"), F.col(f"d.{n}.values").alias("values")) for n in LAYERS))
    flat = parsed.select("slug", F.coalesce("d.elevation.value", F.lit(0.0)).alias("elevation_m"), F.inline(each)).select("slug", "elevation_m", "layer", F.inline("values"))
    return flat.select("slug", "elevation_m", "layer", F.col("validTime").alias("valid"), "value").filter("value is not null")


def split_by_day(values: DataFrame, zone: str = ZONE) -> DataFrame:
    """Each interval opened into local days, with the share of it that falls on each; empty intervals are left out."""
    start, end = interval(F.col("valid"))
    local = lambda c: F.to_date(F.from_utc_timestamp(c, zone))
    spans = values.withColumn("start", start).withColumn("end", end).filter(F.col("end") > F.col("start"))
    opened = spans.withColumn("day", F.explode(F.sequence(local(F.col("start")), local(F.col("end")))))
    midnight = lambda d: F.to_utc_timestamp(d.cast("timestamp"), zone)
    seconds = lambda a, b: F.unix_micros(a) - F.unix_micros(b)
    held = seconds(F.least("end", midnight(F.date_add("day", 1))), F.greatest("start", midnight(F.col("day"))))
    return opened.withColumn("share", held / seconds(F.col("end"), F.col("start"))).filter("share > 0").drop("start", "end")


def by_day(values: DataFrame, places: DataFrame, today: str) -> DataFrame:
    """A row per place and day of the week ahead. ``values``: as ``layers`` gives; ``places``: slug, elevation_ft."""
    now = F.lit(today).cast("date")
    near = split_by_day(values).filter(F.datediff("day", now).between(0, DAYS - 1)).join(places, "slug")
    lapse = (F.col("elevation_ft") - F.col("elevation_m") * M_FT) / 1000 * LAPSE
    warmth = F.col("value") * 9 / 5 + 32 - lapse

    def of(layer: str, c: Column) -> Column:
        return F.when(F.col("layer") == layer, c)

    out = near.groupBy("slug", "day").agg(
        F.round(F.max(of("temperature", warmth))).cast("long").alias("high_f"), F.round(F.min(of("temperature", warmth))).cast("long").alias("low_f"),
        (F.round(F.min(of("snowLevel", F.col("value"))) * M_FT / 100) * 100).cast("long").alias("snow_level_ft"),
        F.round(F.coalesce(F.max(of("probabilityOfPrecipitation", F.col("value"))), F.lit(0.0))).cast("long").alias("precip_chance"),
        F.round(F.coalesce(F.sum(of("snowfallAmount", F.col("value") * F.col("share"))), F.lit(0.0)) * MM_IN, 1).alias("snowfall_in"),
        F.round(F.coalesce(F.max(of("probabilityOfThunder", F.col("value"))), F.lit(0.0))).cast("long").alias("thunder_chance"),
        F.round(F.coalesce(F.max(of("windGust", F.col("value"))), F.lit(0.0)) * KMH_MPH).cast("long").alias("gust_mph"),
        F.first("elevation_ft").alias("elevation_ft"),
    )
    return out


def headlines(days: DataFrame, today: str) -> DataFrame:
    """At most two facts about the week at each place: snow down to it, thunder, wind; else how warm it stays."""
    now = F.lit(today).cast("date")
    ahead = F.datediff("day", now)
    named = days.withColumn("name", F.when(ahead == 0, "today").when(ahead == 1, "tomorrow").otherwise(F.date_format("day", "EEEE")))
    snowy = (F.col("snow_level_ft") < F.col("elevation_ft")) & (F.col("precip_chance") >= SNOWY)
    row = F.struct("name", "day", "snow_level_ft", "precip_chance", "snowfall_in", "thunder_chance", "gust_mph")

    def least(when: Column, by: Column) -> Column:
        return F.min_by(row, F.when(when, F.struct(by, F.col("day"))))

    seen = named.groupBy("slug").agg(
        least(F.coalesce(snowy, F.lit(False)), F.col("snow_level_ft")).alias("s"), least(F.col("thunder_chance") >= THUNDER, -F.col("thunder_chance")).alias("t"),
        least(F.col("gust_mph") >= WINDY, -F.col("gust_mph")).alias("w"), F.round(F.avg("high_f")).cast("long").alias("warm"),
    )
    text = lambda c: F.col(c).cast("string")
    amount = F.when(F.col("s.snowfall_in") >= 0.5, F.concat(F.lit(", about "), text("s.snowfall_in"), F.lit(" in on the grid"))).otherwise("")
    snow = F.concat(F.lit("New snow possible "), F.col("s.name"), F.lit(": the forecast snow level drops to "), F.format_number("s.snow_level_ft", 0), F.lit(" ft, below the pass, with a "), text("s.precip_chance"), F.lit("% chance of precipitation"), amount, F.lit("."))
    storm = F.concat(F.lit("Thunderstorms possible "), F.col("t.name"), F.lit(" ("), text("t.thunder_chance"), F.lit("% chance); the pass is exposed terrain."))
    wind = F.concat(F.lit("Strong wind "), F.col("w.name"), F.lit(", gusts near "), text("w.gust_mph"), F.lit(" mph."))
    facts = F.slice(F.array_compact(F.array(F.when(F.col("s").isNotNull(), snow), F.when(F.col("t").isNotNull(), storm), F.when(F.col("w").isNotNull(), wind))), 1, 2)
    mild = F.concat(F.lit("No snow or storms in the forecast this week; highs near "), text("warm"), F.lit("°F at pass elevation."))
    return seen.select("slug", F.array_join(F.when(F.size(facts) > 0, facts).otherwise(F.array_compact(F.array(mild))), " ").alias("facts"))


def snowfall(days: DataFrame, today: str, ahead: int = 3, least: float = 0.5) -> DataFrame:
    """Snow that is forecast for today and the two days after, if it is half an inch or more."""
    near = days.filter(F.datediff("day", F.lit(today).cast("date")).between(0, ahead - 1))
    total = near.groupBy("slug").agg(F.min("day").alias("from"), F.max("day").alias("through"), F.round(F.sum("snowfall_in"), 1).alias("total_in"))
    return total.filter(F.col("total_in") >= least)


def in_force(days: DataFrame, today: str) -> DataFrame:
    """C14: the days from ``today`` on of forecasts issued (``issued_for``) at most a day before or after it; none of those without a date."""
    now = F.lit(today).cast("date")
    return days.filter((F.abs(F.datediff("issued_for", now)) <= 1) & (F.col("day") >= now))
