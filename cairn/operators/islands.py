"""Runs in daily series: gaps and islands, strays, wandering and lingering, changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by_day() -> Window:
    return Window.partitionBy("station").orderBy("day")


def melted_out(daily: DataFrame, bare: float = 0.5, gap: int = 20, least: int = 7) -> DataFrame:
    """station, since, observed: the run of bare days at the end of each series.

    Backwards from the newest day the run goes on until a gap of more than ``gap`` days or a
    value of ``bare`` or more. If such a value ended it, its start was observed; else
    it must have lasted ``least`` days.
    """
    back = Window.partitionBy("station").orderBy(F.desc("day"))
    broken = (F.col("value") >= bare) | (F.datediff(F.col("later"), F.col("day")) > gap)
    run = daily.withColumn("later", F.lag("day").over(back)).withColumn("stop", F.sum(F.coalesce(broken, F.lit(False)).cast("int")).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    first = run.groupBy("station").agg(
        F.min(F.when(F.col("stop") == 0, F.col("day"))).alias("since"),
        F.max(F.when(F.col("stop") == 0, F.col("day"))).alias("newest"),
        F.max_by(F.struct("value", F.datediff("later", "day").alias("g")), F.when(F.col("stop") > 0, F.col("day"))).alias("end"),
    )
    seen = F.coalesce((F.col("end.value") >= bare) & (F.coalesce("end.g", F.lit(0)) <= gap), F.lit(False))
    kept = first.filter(F.col("since").isNotNull() & (seen | (F.datediff("newest", "since") >= least - 1)))
    return kept.select("station", "since", seen.alias("observed"))


def without_strays(daily: DataFrame, steep: float = 10) -> DataFrame:
    """Readings but those too steep to both neighbours (by day) while the neighbours agree."""

    def too_steep(a: str, b: str, da: str, db: str) -> Column:
        return F.abs(F.col(a) - F.col(b)) > steep * F.greatest(F.datediff(db, da), F.lit(1))

    near = daily.select(
        "*", *(f(c).over(_by_day()).alias(f"{n}_{c}") for n, f in (("p", F.lag), ("n", F.lead)) for c in ("value", "day"))
    )
    stray = too_steep("p_value", "value", "p_day", "day") & too_steep("value", "n_value", "day", "n_day") & ~too_steep("p_value", "n_value", "p_day", "n_day")
    return near.filter(~F.coalesce(stray, F.lit(False))).select(*daily.columns)


def shape_flags(daily: DataFrame, steep: float = 10, low: float = 0.5, high: float = 3.0, linger: int = 28, rises: int = 8) -> DataFrame:
    """station, erratic, lingers, wanders: steps too steep; runs inside [low, high) of more than ``linger`` days; too many small rises."""
    w = _by_day()
    gap = F.datediff("day", F.lag("day").over(w))
    step = F.col("value") - F.lag("value").over(w)
    inside = F.col("value").between(low, high) & (F.col("value") < high)
    flags = daily.withColumn("step", step).withColumn("gap", gap).withColumn("inside", inside)
    flags = flags.withColumn("island", F.sum((~F.col("inside")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = flags.groupBy("station", "island").agg(
        F.max(F.when(F.col("inside"), F.col("day"))).alias("to"),
        F.min(F.when(F.col("inside"), F.col("day"))).alias("from"),
        F.max(F.coalesce(F.abs("step") > steep * F.col("gap"), F.lit(False))).alias("erratic"),
        F.sum(((F.col("gap") == 1) & (F.col("step") >= 0.3) & (F.col("value") < high)).cast("int")).alias("rises"),
    )
    return runs.groupBy("station").agg(
        F.max("erratic").alias("erratic"),
        F.max(F.coalesce(F.datediff("to", "from") > linger, F.lit(False))).alias("lingers"),
        (F.coalesce(F.sum("rises"), F.lit(0)) > rises).alias("wanders"),
    )


def change(daily: DataFrame, days: int) -> DataFrame:
    """station, day, value, delta: newest value minus that of exactly ``days`` earlier, not below 0; null if that day is missing."""
    last = daily.groupBy("station").agg(F.max("day").alias("day"), F.max_by("value", "day").alias("value"))
    before = daily.select("station", F.date_add("day", days).alias("day"), F.col("value").alias("earlier"))
    delta = F.greatest(F.round(F.col("value") - F.col("earlier"), 6), F.lit(0.0))
    return last.join(before, ["station", "day"], "left").select("station", "day", "value", F.when(F.col("earlier").isNotNull(), delta).alias("delta"))


def thinned(daily: DataFrame, every: int = 3) -> DataFrame:
    """Every third row of a station's series, from the first, and the last."""
    w = _by_day()
    n = F.count("*").over(Window.partitionBy("station"))
    row = daily.withColumn("i", F.row_number().over(w)).withColumn("n", n)
    return row.filter((F.pmod(F.col("i") - 1, F.lit(every)) == 0) | (F.col("i") == F.col("n"))).select("station", "day", F.round("value", 1).alias("value"))


def fortnights(daily: DataFrame) -> DataFrame:
    """The newest row of each station in each half of 14 days of a month."""
    key = F.concat(F.date_format("day", "yyyy-MM"), F.lit("-"), F.floor((F.dayofmonth("day") - 1) / 14).cast("string"))
    return daily.groupBy("station", key.alias("fortnight")).agg(F.max("day").alias("day"), F.max_by("value", "day").alias("value"))


def holds(daily: DataFrame, bare: float = 0.5, days: int = 28, least: int = 26, loss: float = 1.0) -> DataFrame:
    """station, year, holds: from June to August, whether a run of at least ``bare`` loses less than ``loss`` over ``days`` days."""
    summer = daily.filter(F.date_format("day", "MM-dd").between("06-01", "08-31")).withColumn("year", F.year("day"))
    by_day = Window.partitionBy("station", "year").orderBy("day")
    island = F.sum((F.col("value") < bare).cast("int")).over(by_day.rowsBetween(Window.unboundedPreceding, 0))
    runs = summer.withColumn("island", island).filter(F.col("value") >= bare)
    number = F.unix_date("day")
    span = Window.partitionBy("station", "year", "island").orderBy(number).rangeBetween(-days, 0)
    kept = (F.datediff("day", F.first("day").over(span)) >= least) & (F.first("value").over(span) - F.col("value") < loss)
    return runs.withColumn("kept", kept).groupBy("station", "year").agg(F.max("kept").alias("holds"))
