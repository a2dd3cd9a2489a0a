"""Literal cases: new snow in sentences, forecasts in force, the ledger of a place, bounds of rings, trips summed up."""

from datetime import date, timedelta

from cairn.functions import geo
from cairn.operators import forecast, ledger, snowfall, trip_summary
from pyspark.sql import functions as F


def test_new_snow_in_sentences(spark):
    rows = [
        ("a", "Adin Mtn", 6190, 4.3, 1.2, 2.0, 10, 16),
        ("b", "Adin Mtn", 6190, 4.3, 0.6, None, None, None),
        ("c", "Adin Mtn", None, 12.0, None, 1.1, None, 9),
        ("d", "Adin Mtn", 0, 12.0, 0.5, 0.9, 4, None),
    ]
    found = spark.createDataFrame(rows, "slug string, name string, elevation_ft int, miles double, water_24h double, water_72h double, depth_24h int, depth_72h int")
    found = found.withColumn("station", F.lit(1)).withColumn("as_of", F.lit("2026-02-03").cast("date"))
    assert {r["slug"]: r["text"] for r in snowfall.gains_told(found).collect()} == {
        "a": "Adin Mtn (6,190 ft, 4.3 mi away) gained 1.2 in of snow water and 10 in of snow depth in the 24 hours to Feb 3; 2.0 in of water and 16 in of depth over 72 hours.",
        "b": "Adin Mtn (6,190 ft, 4.3 mi away) gained 0.6 in of snow water in the 24 hours to Feb 3.",
        "c": "Adin Mtn (12.0 mi away) gained 1.1 in of snow water and 9 in of snow depth in the 72 hours to Feb 3.",
        "d": "Adin Mtn (12.0 mi away) gained 0.5 in of snow water and 4 in of snow depth in the 24 hours to Feb 3; 0.9 in of water over 72 hours.",
    }


def test_forecasts_in_force(spark):
    today = date(2026, 2, 3)
    rows = [(off, today + timedelta(off) if off is not None else None, today + timedelta(d)) for off in (-2, -1, 0, 1, 2, None) for d in (-1, 0, 5)]
    days = spark.createDataFrame(rows, "off int, issued_for date, day date")
    got = sorted((r["off"], (r["day"] - today).days) for r in forecast.in_force(days, "2026-02-03").collect())
    assert got == [(off, d) for off in (-1, 0, 1) for d in (0, 5)]


def test_ledger_of_a_place(spark):
    d = date(2024, 1, 29)
    rows = [("p", "sensor", i, d - timedelta(n)) for i in range(3) for n in range(40)] + [("q", "sensor", 1, d + timedelta(1)), ("q", "gauge", 1, d - timedelta(30)), ("r", "gauge", 1, d - timedelta(29))]
    readings = spark.createDataFrame(rows, "slug string, source string, id int, day date")
    reports = spark.createDataFrame([("q", "report", 7, date(2020, 1, 1)), ("p", "report", 8, None)], "slug string, source string, id int, day date")
    got = {(r["slug"], r["source"], r["id"], r["day"]) for r in ledger.place_ledger(readings, reports, [str(d)]).collect()}
    # Halves end on 14, 28 and 31 January: three readings of the 29th, then the first by id of the 28th.
    want = {("p", "sensor", i, d) for i in range(3)} | {("p", "sensor", 0, date(2024, 1, 28)), ("r", "gauge", 1, date(2023, 12, 31)), ("q", "report", 7, date(2020, 1, 1)), ("p", "report", 8, None)}
    assert got == want


def test_bounds(spark):
    point = "array<struct<lon:double,lat:double>>"
    rings = spark.createDataFrame([([(-120.0, 38.0), (-119.0, 38.5), (-119.5, 37.0), (-120.0, 38.0)],), ([],), (None,)], f"ring {point}")
    got = [r["b"] for r in rings.select(geo.ring_bounds(F.col("ring")).alias("b")).collect()]
    assert tuple(got[0]) == (-120.0, 37.0, -119.0, 38.5) and got[1:] == [None, None]


def test_what_a_trip_comes_to(spark):
    day = lambda n: date(2026, 2, n)
    stops = [
        ("t", 0, 1, "Muir", 11955, "Open", "high", day(3)), ("t", 1, 2, "Pinchot", 12130, "Snow caution", "low", day(3)), ("t", 2, 3, "Glen", 11978, "Open", "high", day(3)), ("t", 3, 4, "Mather", 12130, None, "high", day(3)),
        ("one", 0, 1, "Muir", 11955, "Open", "high", day(1)), ("none", 0, 9, "Far", 9000, "Open", "low", day(3)), ("none", 1, 9, "Far", 9000, "Open", "low", day(2)),
    ]
    days = [(1, day(4), 40, 0), (1, day(5), 60, None), (2, day(5), 60, 0), (3, day(6), 60, 0), (4, day(5), 60, 0), (2, day(4), None, 0)]
    stops = spark.createDataFrame(stops, "trip string, pos int, slug int, name string, elevation_ft int, label string, confidence string, as_of date")
    days = spark.createDataFrame(days, "slug int, day date, precip_chance int, thunder_chance int")
    got = {r["trip"]: tuple(r)[1:] for r in trip_summary.summaries(stops, days, "2026-02-03").collect()}
    dry = "The forecast for the trip's days shows a 0% chance of thunder at every pass that has one."
    assert got == {
        "t": (
            "4 passes on this plan, as of Tue, Feb 3, today: 2 open, 1 snow caution and 1 unknown. Confidence: 3 high and 1 low.", "Highest pass: Pinchot, 12,130 ft.",
            "Highest chance of precipitation in the forecast for the trip's days: 60% on Thu, Feb 5 at Muir, Pinchot and Mather.", dry,
        ),
        "one": ("1 pass on this plan, as of Sun, Feb 1: 1 open. Confidence: 1 high.", None, "Highest chance of precipitation in the forecast for the trip's days: 60% on Thu, Feb 5 at Muir.", dry),
        "none": ("2 passes on this plan, each as of the date shown on it: 2 open. Confidence: 2 low.", "Highest pass: Far, 9,000 ft.", None, None),
    }
