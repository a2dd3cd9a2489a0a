"""Intervals rolled up by day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_day(spans: DataFrame) -> DataFrame:
    """slug, day, highest, lowest, hundredths: ``spans`` (slug, start, end, value) split at midnights, amounts by share of time.

    Amounts are whole hundredths, each part rounded down, so sums do not depend on the order of rows. An interval that ends at midnight has no part in the next day; an empty one has none in any.
    """
    days = F.sequence(F.to_date("start"), F.to_date("end"))
    opened = spans.filter("start < end").withColumn("day", F.explode(days))
    seconds = lambda c: F.unix_timestamp(c)
    midnight = lambda c: F.unix_timestamp(c.cast("timestamp_ntz"))
    from_, to = F.greatest(seconds("start"), midnight(F.col("day"))), F.least(seconds("end"), midnight(F.date_add("day", 1)))
    whole = F.round(F.col("value") * 100).cast("long")
    cut = opened.select("slug", "day", "value", whole.alias("whole"), (to - from_).alias("part"), (seconds("end") - seconds("start")).alias("total")).filter("part > 0")
    amount = F.sum(F.expr("whole * part div total")).alias("hundredths")
    return cut.groupBy("slug", "day").agg(F.max("value").alias("highest"), F.min("value").alias("lowest"), amount)
