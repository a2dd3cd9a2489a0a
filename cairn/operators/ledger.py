"""Evidence kept by date and source, tallies, caps, latest-wins tables, differences between days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ledger(entries: DataFrame, eval_dates: list[str], days: int = 30, cap: int = 4) -> DataFrame:
    """Entries (id, source, day) that are among a source's newest ``cap`` in the ``days`` up to any of the dates."""
    every = F.array(*(F.lit(d).cast("date") for d in eval_dates))
    age = lambda d: F.datediff(d, F.col("day"))
    opened = entries.withColumn("eval_date", F.explode(F.filter(every, lambda d: (age(d) >= 0) & (age(d) < days))))
    order = Window.partitionBy("eval_date", "source").orderBy(F.desc("day"), "id")
    return opened.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= cap).select("id", "source", "day").distinct()


def place_ledger(readings: DataFrame, reports: DataFrame, eval_dates: list[str], days: int = 30, cap: int = 4) -> DataFrame:
    """Slug, source, id, day of what the statuses of a place rest on, at any of the dates.

    ``readings``: slug, source, id (what they are of), day. Of each half of 14 days of a month the newest reading of an id counts;
    of those the newest ``cap`` of a source in the ``days`` up to a date are kept, equal days by id. ``reports`` (slug, source, id, day)
    are always kept. A date is laid over the few readings that its window holds, never over all, and places spread the rows.
    """
    half = F.concat(F.date_format("day", "yyyy-MM"), F.lit("-"), F.floor((F.dayofmonth("day") - 1) / 14).cast("string"))
    newest_of = readings.groupBy("slug", "source", "id", half.alias("half")).agg(F.max("day").alias("day"))
    every = F.array(*(F.lit(d).cast("date") for d in eval_dates))
    age = lambda d: F.datediff(d, F.col("day"))
    opened = newest_of.withColumn("eval_date", F.explode(F.filter(every, lambda d: (age(d) >= 0) & (age(d) < days))))
    order = Window.partitionBy("slug", "source", "eval_date").orderBy(F.desc("day"), "id")
    kept = opened.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= cap).select("slug", "source", "id", "day").distinct()
    return kept.unionByName(reports.select("slug", "source", "id", "day"))


def tally(rows: DataFrame) -> DataFrame:
    """value, count, latest day, words of the latest: rows (value, day, ord, words)."""
    return rows.groupBy("value").agg(F.count("*").alias("n"), F.max("day").alias("latest"), F.max_by("words", F.struct("day", "ord")).alias("words"))


def newest(rows: DataFrame, by: str, order: list, n: int) -> DataFrame:
    """The first ``n`` of each group in an order."""
    return rows.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("r") <= n).drop("r")


def latest(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key: an append-only log read as a table of upserts."""
    others = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("r")).select(*keys, "r.*")


def reconcile(local: DataFrame, base: DataFrame, server: DataFrame) -> DataFrame:
    """key, action of a three-way comparison of values: what changed since the base, where, and what to do.

    A change on one side goes to the other; equal changes need nothing; different ones
    are a conflict, unless one is a removal, which yields to the change.
    """
    named = [df.select("key", F.col("value").alias(n), F.lit(True).alias(f"in_{n}")) for n, df in (("local", local), ("base", base), ("server", server))]
    all_ = named[0].join(named[1], "key", "full_outer").join(named[2], "key", "full_outer")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    action = (
        F.when(same("local", "server"), "keep")
        .when(same("server", "base"), F.when(F.col("in_local").isNull(), "delete_remote").otherwise("push"))
        .when(same("local", "base"), F.when(F.col("in_server").isNull(), "delete_local").otherwise("pull"))
        .when(F.col("in_local").isNull(), "pull")
        .when(F.col("in_server").isNull(), "push")
        .otherwise("conflict")
    )
    return all_.select("key", action.alias("action"))
