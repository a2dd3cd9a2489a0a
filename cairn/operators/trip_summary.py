"""What a planned trip comes to, in lines: verdicts counted, the highest stop, the worst days of its forecast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places whose worst days are sent to every task (some hundred bytes each); more are shuffled.
BROADCAST_PLACES = 100_000


def listed(parts: Column) -> Column:
    """Parts in a row, the last after an and."""
    n = F.size(parts)
    return F.when(n <= 1, F.array_join(parts, "")).otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(1))), ", "), F.lit(" and "), F.get(parts, n - 1)))


def _label(day: Column, today: str) -> Column:
    return F.concat(F.date_format(day, "EEE, MMM d"), F.when(F.year(day) == int(today[:4]), "").otherwise(F.date_format(day, ", yyyy")))


def summaries(stops: DataFrame, days: DataFrame, today: str) -> DataFrame:
    """trip, verdicts, highest, precipitation, thunder: a sentence each, null where there is nothing to tell.

    ``stops``: trip, pos, slug, name, elevation_ft, label, confidence, as_of; ``days``: slug, day, precip_chance, thunder_chance.
    Labels and grades stand in the order in which they come up. The highest of several stops is the first of those that tie. A worst day is
    that of the first stop that has the worst value, its first such day; all stops with that value on that day are named, once each. A trip
    has a bounded list of stops, so one row holds it. The worst value of a trip is the worst of some stop's place, so a stop
    carries only its place's worst values and their days, not its forecast, and stops are dealt by trip once.
    """
    chances = {"precipitation": "precip_chance", "thunder": "thunder_chance"}
    most = days.filter("slug is not null").groupBy("slug").agg(*(F.max(c).alias(f"most_{c}") for c in chances.values()))
    ahead = days.join(most, "slug").groupBy("slug").agg(
        *(F.array_sort(F.collect_set(F.when(F.col(c) == F.col(f"most_{c}"), F.struct(F.col(c).alias("value"), "day")))).alias(c) for c in chances.values())
    )
    if most.count() <= BROADCAST_PLACES:
        ahead = F.broadcast(ahead)
    entry = F.struct("pos", "name", "elevation_ft", "label", "confidence", "as_of", *chances.values())
    trips = stops.filter("trip is not null").join(ahead, "slug", "left").groupBy("trip").agg(F.array_sort(F.collect_list(entry)).alias("stops"))

    def counted(field: str, word) -> Column:
        kinds = F.array_distinct(F.transform("stops", lambda s: s[field]))
        return listed(F.transform(kinds, lambda k: F.concat(F.size(F.filter("stops", lambda s: s[field].eqNullSafe(k))).cast("string"), F.lit(" "), word(F.coalesce(k, F.lit("unknown"))))))

    n = F.size("stops")
    dates = F.array_distinct(F.transform("stops", lambda s: s["as_of"]))
    first = F.get(dates, F.lit(0))
    one = F.concat(F.lit("as of "), _label(first, today), F.when(first == F.lit(today).cast("date"), ", today").otherwise(""))
    when = F.when(F.size(dates) == 1, one).otherwise("each as of the date shown on it")
    verdicts = F.concat(
        n.cast("string"), F.when(n == 1, " pass").otherwise(" passes"), F.lit(" on this plan, "), when, F.lit(": "), counted("label", F.lower),
        F.lit(". Confidence: "), counted("confidence", lambda c: c), F.lit("."),
    )
    top = F.array_max(F.transform("stops", lambda s: F.struct(s["elevation_ft"].alias("feet"), (-s["pos"]).alias("p"), s["name"].alias("name"))))
    highest = F.when(n > 1, F.concat(F.lit("Highest pass: "), top["name"], F.lit(", "), F.format_number(top["feet"].cast("double"), 0), F.lit(" ft.")))
    told = []
    for word, c in chances.items():
        seen = F.filter("stops", lambda s: F.size(s[c]) > 0)  # noqa: B023
        worst = F.array_max(F.transform(seen, lambda s: F.struct(s[c][0]["value"].alias("value"), (-s["pos"]).alias("p"), (-F.unix_date(s[c][0]["day"])).alias("d"))))  # noqa: B023
        trips = trips.withColumn(f"{c}_top", worst)
        value, day = F.col(f"{c}_top.value"), F.date_from_unix_date(-F.col(f"{c}_top.d"))
        same = F.filter("stops", lambda s: F.exists(s[c], lambda x: (x["value"] == value) & (x["day"] == day)))  # noqa: B023
        names = F.array_distinct(F.transform(same, lambda s: s["name"]))
        some = F.concat(F.lit(f"Highest chance of {word} in the forecast for the trip's days: "), value.cast("string"), F.lit("% on "), _label(day, today), F.lit(" at "), listed(names), F.lit("."))
        told.append(F.when(value > 0, some).when(value <= 0, f"The forecast for the trip's days shows a 0% chance of {word} at every pass that has one.").alias(word))
    return trips.select("trip", verdicts.alias("verdicts"), highest.alias("highest"), *told)
