"""Seasons side by side: a season's days, medians with open ends, ranks, the best split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def season_day(day: Column) -> Column:
    """Days since 1 April of the day's own year."""
    return F.datediff(day, F.make_date(F.year(day), F.lit(4), F.lit(1)))


def in_season(day: Column) -> Column:
    return F.date_format(day, "MM-dd").between("04-01", "08-31")


def summaries(daily: DataFrame) -> DataFrame:
    """station, year, peak, peak_day, days of the season (1 April to 31 August)."""
    own = daily.filter(in_season(F.col("day"))).withColumn("year", F.year("day"))
    order = F.struct(F.col("value"), -season_day(F.col("day")))
    return own.groupBy("station", "year").agg(F.max("value").alias("peak"), season_day(F.max_by("day", order)).alias("peak_day"), F.count("*").alias("days"))


def compared(seasons: DataFrame, earlier: int = 2) -> DataFrame:
    """Each season with its rank by peak in its station's record, and the middle of earlier peaks if there are ``earlier`` of them."""
    before = Window.partitionBy("station").orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    peaks = F.array_sort(F.collect_list("peak").over(before))
    n = F.size("peaks")
    low, high = F.get("peaks", F.floor((n - 1) / 2).cast("int")), F.get("peaks", F.floor(n / 2).cast("int"))
    rank = F.rank().over(Window.partitionBy("station").orderBy(F.desc("peak")))
    out = seasons.withColumn("peaks", peaks).withColumn("peak_rank", rank)
    return out.select("station", "year", "peak", "peak_day", "peak_rank", F.when(n >= earlier, F.round((low + high) / 2, 6)).alias("usual"))


def middle(values: Column) -> Column:
    """Median of an array that may hold infinities: null if it falls on one, or between one and another."""
    ordered = F.array_sort(values)
    n = F.size(ordered)
    low, high = F.get(ordered, F.floor((n - 1) / 2).cast("int")), F.get(ordered, F.floor(n / 2).cast("int"))
    finite = (F.abs(low) < float("inf")) & (F.abs(high) < float("inf"))
    return F.when(finite, (low + high) / 2)


def best_split(points: DataFrame) -> DataFrame:
    """The threshold of ``x`` that misplaces fewest points if those at or above it should be ``up``: threshold, errors.

    Points of equal x are counted together before the running sums, which go over
    distinct values; the first least one wins.
    """
    steps = points.groupBy("x").agg(F.sum(F.col("up").cast("long")).alias("ups"), F.sum((~F.col("up")).cast("long")).alias("downs"))
    total = points.agg(F.sum((~F.col("up")).cast("long")).alias("all_downs"))
    below = Window.orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    lost = F.coalesce(F.sum("ups").over(below), F.lit(0))
    kept = F.coalesce(F.sum("downs").over(below), F.lit(0))
    ranked = steps.select("x", lost.alias("lost"), kept.alias("kept")).join(F.broadcast(total))
    errors = F.col("lost") + F.col("all_downs") - F.col("kept")
    return ranked.agg(F.min(F.struct(errors.alias("errors"), F.col("x").alias("threshold"))).alias("m")).select("m.threshold", "m.errors")


def value_on(daily: DataFrame, day_of_season: int, widest: int = 10) -> DataFrame:
    """station, year, value: each season's series at a day of it, on the line between readings at most ``widest`` days apart."""
    w = Window.partitionBy("station", "year").orderBy("day")
    own = daily.filter(in_season(F.col("day"))).withColumn("year", F.year("day"))
    own = own.select("station", "year", season_day(F.col("day")).alias("d"), "value", F.lead("value").over(w).alias("nv"), (F.datediff(F.lead("day").over(w), "day")).alias("gap"))
    on = F.col("d") == day_of_season
    between = (F.col("d") < day_of_season) & (F.col("d") + F.col("gap") > day_of_season) & (F.col("gap") <= widest)
    value = F.when(on, F.col("value")).otherwise(F.col("value") + (F.col("nv") - F.col("value")) * (day_of_season - F.col("d")) / F.col("gap"))
    return own.filter(on | between).select("station", "year", F.round(value, 4).alias("value"))
