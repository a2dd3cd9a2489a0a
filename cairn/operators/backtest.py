"""Verdicts held against what was observed: hold-outs, outcome cells, intervals, confusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import asof, conditions

Z = 1.959964


def held_out(targets: DataFrame, reports: DataFrame) -> DataFrame:
    """target, n: reports at the target's place but those of the same id, or of the same author on the same day.

    Counted without listing pairs: all at the place, less all of the author's on the day
    (the target is among them, having an id of its own).
    """
    at_place = reports.groupBy("place").agg(F.count("*").alias("there"))
    same = reports.groupBy("place", "author", "day").agg(F.count("*").alias("own"))
    joined = targets.join(at_place, "place", "left").join(same, ["place", "author", "day"], "left")
    return joined.select(F.col("id").alias("target"), (F.coalesce("there", F.lit(0)) - F.coalesce("own", F.lit(0))).alias("n"))


def party(author: Column, id: Column) -> Column:
    """Who wrote a report, trimmed and in lower case; one without an author is a party of its own."""
    name = F.lower(F.trim(F.coalesce(author.cast("string"), F.lit(""))))
    return F.when(name != "", name).otherwise(F.concat(F.lit("\n"), id.cast("string")))


def left_out(posts: DataFrame) -> DataFrame:
    """Of each target what the other reports of its place say on its day: id, slug, eval_date, reports_severity, reports_weight, reports_age, n_reports, worst.

    ``posts``: id (distinct), slug, day, author, said (severity), crossing, observed (step; targets have one). Left
    out are the target and its party's other reports of that day. Nothing is fused anew for that: all of them are of age
    0, so sums at age 0 are kept apart and the party's own are taken off again. Severities are quarters, or means of two or three of them, so in 24ths these
    sums are whole numbers and taking off is exact; the worst ford is found from counts of each kind.
    """
    step = F.array_position(F.array(*map(F.lit, conditions.CROSSINGS)), F.col("crossing"))
    told = posts.filter("day is not null").select(
        "id", "slug", "day", party(F.col("author"), F.col("id")).alias("party"), "said", step.cast("int").alias("step"), "observed", F.round(F.col("said") * 24).cast("long").alias("units")
    )
    steps = range(1, len(conditions.CROSSINGS) + 1)
    sums = (F.coalesce(F.sum("units"), F.lit(0)).alias("units"), F.count("units").alias("n"), *(F.count_if(F.col("step") == k).alias(f"c{k}") for k in steps))
    same_day = told.groupBy("slug", "day").agg(*sums)
    own = told.groupBy("slug", "day", "party").agg(*(c.alias(f"own_{name}") for c, name in zip(sums, ("units", "n", *(f"c{k}" for k in steps)), strict=True)))
    targets = told.filter("observed is not null").select("id", "slug", F.col("day").alias("eval_date"), "party", "observed")
    # A report counts on its own day and the days of its window after that.
    later = F.explode(F.sequence(F.date_add("day", 1), F.date_add("day", conditions.WINDOW["report"]))).alias("eval_date")
    older = told.select("slug", "day", "said", "step", later).join(targets.select("slug", "eval_date").distinct(), ["slug", "eval_date"], "left_semi")
    age = F.datediff("eval_date", "day")
    w = F.when(F.col("said").isNotNull(), asof.decay(age, conditions.HALF_LIFE["report"]))
    rest = older.groupBy("slug", "eval_date").agg(
        F.sum(w).alias("rest_w"), F.sum(w * F.col("said")).alias("rest_s"), F.count(w).alias("rest_n"), F.min(F.when(w.isNotNull(), age)).alias("rest_age"), F.max("step").alias("rest_step")
    )
    day = F.col("day").alias("eval_date")
    joined = targets.join(same_day.select("*", day).drop("day"), ["slug", "eval_date"]).join(own.select("*", day).drop("day"), ["slug", "eval_date", "party"])
    joined = joined.join(rest, ["slug", "eval_date"], "left")
    zero = F.lit(0.0)
    n0 = F.col("n") - F.col("own_n")
    n = F.coalesce("rest_n", F.lit(0)) + n0
    total = F.coalesce("rest_s", zero) + (F.col("units") - F.col("own_units")) / 24
    severity = F.round(total / F.nullif(F.coalesce("rest_w", zero) + n0, zero), 2)
    fresh = F.when(n0 > 0, 0).otherwise(F.col("rest_age"))
    weight = conditions.PRIOR["report"] * asof.decay(fresh, conditions.HALF_LIFE["report"]) * F.least(F.lit(1.0), n / 2.0)
    worst = F.greatest("rest_step", *(F.when(F.col(f"c{k}") > F.col(f"own_c{k}"), k) for k in steps))
    some = n > 0
    return joined.select(
        "id", "slug", "eval_date", "observed",
        F.when(some, severity).alias("reports_severity"), F.when(some, weight).alias("reports_weight"), F.when(some, fresh).alias("reports_age"), F.when(some, n).alias("n_reports"),
        F.when(worst > 0, F.element_at(F.array(*map(F.lit, conditions.CROSSINGS)), worst)).alias("worst"),
    )


def judged_without(targets: DataFrame, sensor: DataFrame, snow_line: DataFrame, satellite: DataFrame, creek: DataFrame) -> DataFrame:
    """``targets`` as ``left_out`` gives them, each with the verdict that its place would have had without it."""
    at = ["slug", "eval_date"]

    def part(df: DataFrame, kind: str, *more: str) -> DataFrame:
        age = F.col("age") if "age" in df.columns else F.lit(None).cast("int")
        return df.select(*at, F.col("severity").alias(f"{kind}_severity"), F.col("weight").alias(f"{kind}_weight"), age.alias(f"{kind}_age"), *more)

    wide = targets
    for own in (part(sensor, "sensor"), part(snow_line, "snow_line"), part(satellite, "satellite", "modeled"), creek.select(*at, "flow")):
        wide = wide.join(own, at, "left")
    wide = wide.withColumn("satellite", F.col("satellite_severity").isNotNull()).withColumn("others", F.coalesce("n_reports", F.lit(0)).cast("long"))
    out = conditions.verdict(wide, "id", *at, "observed", "satellite", "others")
    engine = F.array_position(F.array(*map(F.lit, conditions.STATUSES)), F.col("status")).cast("int") - 1
    return out.withColumn("engine", F.when(engine >= 0, engine))


def classified(rows: DataFrame) -> DataFrame:
    """``rows`` (engine, observed) with outcome and direction of the miss; without a verdict there is no direction."""
    gap = F.col("engine") - F.col("observed")
    outcome = F.when(gap.isNull(), "no_verdict").when(gap == 0, "exact").when(F.abs(gap) == 1, "off_by_one").otherwise("off_by_more")
    return rows.withColumn("outcome", outcome).withColumn("direction", F.when(gap < 0, "engine_less").when(gap > 0, "engine_more"))


def near_in_height(linked: DataFrame, daily: DataFrame, asked: DataFrame, within: float = 300.0, window: int = 10) -> DataFrame:
    """The asked (slug, eval_date) at which a linked station within ``within`` feet of the place's height has a reading in the window."""
    days = daily.select("station", F.explode(F.sequence("day", F.date_add("day", window))).alias("eval_date")).distinct()
    near = linked.filter(F.abs("gap_ft") <= within).select("slug", "station")
    return near.join(days, "station").join(asked.select("slug", "eval_date").distinct(), ["slug", "eval_date"], "left_semi").select("slug", "eval_date").distinct()


def wilson(successes: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """The 95 % interval of a share."""
    p, square = successes / n, z * z
    centre = (p + square / (2 * n)) / (1 + square / n)
    half = z * F.sqrt(p * (1 - p) / n + square / (4 * n * n)) / (1 + square / n)
    return F.greatest(centre - half, F.lit(0.0)), F.least(centre + half, F.lit(1.0))


def outcome_sets(rows: DataFrame, by: list[str], least: int = 10) -> DataFrame:
    """Counts of exact, within one, more and less, for all rows and by each of ``by``, with the interval of the exact share.

    ``rows``: observed and engine (steps), and the columns ``by``. One pass: grouping sets
    of single columns. Cells of fewer than ``least`` rows have no interval.
    """
    off = F.col("engine") - F.col("observed")
    marked = rows.select(*(F.col(c).cast("string").alias(c) for c in by), off.alias("off"))
    sets = [[], *([F.col(c)] for c in by)]
    counted = marked.groupingSets(sets, *(F.col(c) for c in by)).agg(
        F.count("*").alias("n"),
        F.sum((F.col("off") == 0).cast("long")).alias("exact"),
        F.sum((F.abs("off") <= 1).cast("long")).alias("within_one"),
        F.sum((F.col("off") > 0).cast("long")).alias("more"),
        F.sum((F.col("off") < 0).cast("long")).alias("less"),
        F.grouping_id().alias("g"),
    )
    low, high = wilson(F.col("exact"), F.col("n"))
    enough = F.col("n") >= least
    name, bits = F.lit("overall"), len(by)
    for i, c in enumerate(by):
        name = F.when(F.col("g") == (1 << bits) - 1 - (1 << (bits - 1 - i)), c).otherwise(name)
    return counted.select(
        name.alias("split"), F.coalesce(*by).alias("cell"), "n", "exact", "within_one", "more", "less",
        F.when(enough, F.round(low, 6)).alias("low"), F.when(enough, F.round(high, 6)).alias("high"),
    )


def confusion(rows: DataFrame, steps: list[int]) -> DataFrame:
    """A row per observed step, a column per engine step."""
    table = rows.groupBy("observed").pivot("engine", steps).count().fillna(0)
    return table.select("observed", *(F.col(str(s)).alias(f"engine_{s}") for s in steps))


def reports_needed(half_width: float, z: float = Z) -> int:
    """The least sample whose interval for a share of one half is no wider than 2 * ``half_width``."""
    square = z * z
    n = 1
    while z * ((0.25 / n + square / (4 * n * n)) ** 0.5) / (1 + square / n) > half_width:
        n += 1
    return n
