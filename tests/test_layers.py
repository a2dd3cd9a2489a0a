"""Optional layers and sinks: literal cases."""

import datetime as dt

import pytest
from cairn.sources import layers
from pyspark.sql import functions as F

D = dt.date


def test_files_are_dated_by_their_names(spark, tmp_path):
    for name, body in (("hms_smoke20240105.kml", "a\nb"), ("smoke20240106.kml", ""), ("smoke20241399.kml", "x"), ("readme.txt", "y")):
        (tmp_path / name).write_text(body)
    assert {(r["day"], r["body"]) for r in layers.dated_files(spark, str(tmp_path)).collect()} <= {(D(2024, 1, 5), "a\nb"), (D(2024, 1, 6), "")}
    assert (D(2024, 1, 5), "a\nb") in {(r["day"], r["body"]) for r in layers.dated_files(spark, str(tmp_path)).collect()}


def test_today_else_the_day_before(spark):
    shapes = spark.createDataFrame([(D(2024, 1, 5), 1), (D(2024, 1, 4), 2), (D(2024, 1, 3), 3)], "day date, id int")
    ids = lambda today: {r["id"] for r in layers.latest_analysis(shapes, today).collect()}
    assert ids("2024-01-05") == {1} and ids("2024-01-06") == {1} and ids("2024-01-07") == set() and ids("2024-01-04") == {2}


@pytest.fixture
def attempts(spark):
    return spark.createDataFrame([("fires", D(2024, 1, 5), True), ("fires", D(2024, 1, 6), False), ("roads", D(2024, 1, 6), True)], "source string, day date, ok boolean")


def test_failed_is_not_empty(spark, attempts):
    shapes = spark.createDataFrame([(D(2024, 1, 5), 1)], "day date, id int")
    places = spark.createDataFrame([(1,), (2,)], "key long")
    near = spark.createDataFrame([(1, "Elk Fire", 3.0)], "slug long, fire string, miles double")
    over = spark.createDataFrame([(2, "heavy")], "slug long, smoke string")

    def layer(today, smoke=shapes):
        state = layers.availability(attempts, layers.latest_analysis(smoke, today), today)
        return {r["slug"]: (r["fire"], r["smoke"], r["fires_available"], r["smoke_available"]) for r in layers.fire_layer(places, near, over, state).collect()}

    assert layer("2024-01-05") == {1: ("Elk Fire", None, True, True), 2: (None, "heavy", True, True)}
    assert layer("2024-01-06") == {1: (None, None, False, True), 2: (None, "heavy", False, True)}
    assert layer("2024-01-05", shapes.limit(0)) == {1: ("Elk Fire", None, True, False), 2: (None, None, True, False)}
    with pytest.raises(Exception, match="neither fire perimeters nor smoke"):
        layer("2024-01-07")


def test_a_rerun_replaces_its_dates_only(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = spark.createDataFrame([(s, D(2024, 1, d), "open") for s in (1, 2) for d in (1, 2)], "slug long, eval_date date, status string")
    layers.put_statuses(rows, path, 1)
    again = rows.filter("slug = 1 and eval_date = '2024-01-02'").withColumn("status", F.lit("closed"))
    for run in (2, 3):
        layers.put_statuses(again, path, run)
    got = sorted((r["slug"], r["eval_date"].day, r["result"], r["run"]) for r in layers.statuses(spark, path).collect())
    assert got == [(1, 1, '{"status":"open"}', 1), (1, 2, '{"status":"closed"}', 3), (2, 1, '{"status":"open"}', 1)]
    plan = layers.statuses(spark, path).filter("eval_date = '2024-01-01'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(eval_date" in plan
