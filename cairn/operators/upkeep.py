"""Upkeep of stored windows: what is current after several runs, and which days to read again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def current_rows(landed: DataFrame, runs: DataFrame) -> DataFrame:
    """The landed rows (stream, day, run, ...) that later good runs have not replaced.

    ``runs``: run, stream, begin, end, ok: a control table of a few rows a day, sent to every task. A run that failed, or
    found nothing, is not ok: its own rows do not show, and it replaces none.
    """
    good = runs.filter("ok").groupBy("stream").agg(F.collect_list(F.struct("run", "begin", "end")).alias("good"))
    told = landed.join(F.broadcast(good), "stream")
    covers = F.filter("good", lambda r: F.col("day").between(r["begin"], r["end"]))
    last = F.array_max(F.transform(covers, lambda r: r["run"]))
    return told.filter(F.col("run") == last).select(*landed.columns)


def season_windows(stored: DataFrame) -> DataFrame:
    """year, begin, end: a window for each year from the first stored ``day`` on, April to August; the year of the newest day runs through it, and opens in January if it has not come to April."""
    ends = stored.agg(F.year(F.min("day")).alias("first"), F.max("day").alias("now")).filter("now is not null")
    years = ends.select("now", F.explode(F.sequence("first", F.year("now"))).alias("year"))
    now = F.col("now")
    begin, end = F.make_date("year", F.lit(4), F.lit(1)), F.make_date("year", F.lit(8), F.lit(31))
    own = F.col("year") == F.year(now)
    return years.select(F.col("year").cast("long").alias("year"), F.when(own & (now < begin), F.make_date("year", F.lit(1), F.lit(1))).otherwise(begin).alias("begin"), F.when(own, now).otherwise(end).alias("end"))


def daily_window(rows: DataFrame, today: str, back: int = 10, slack: int = 3) -> DataFrame:
    """begin, end of the days to read again: ``back`` days, or ``slack`` before the newest day of the stream that lags most."""
    now = F.lit(today).cast("date")
    latest = rows.groupBy("stream").agg(F.max("day").alias("latest"))
    return latest.agg(F.least(F.date_sub(now, back), F.date_sub(F.min("latest"), slack)).alias("begin")).select("begin", now.alias("end"))
