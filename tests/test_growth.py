"""Steps that grow with their rows, not with groups or pairs of them."""

import datetime as dt

import numpy as np
from cairn.operators import gazetteer, screen, trips
from cairn.sources import feeds
from pyspark.sql import functions as F


def test_series_are_screened_together(spark):
    """Not one call of Python for each station; series cut by batches, and stations and days unknown, come out as in a plain walk."""
    rng = np.random.default_rng(7)
    rows = []
    for station in [None, *range(40)]:
        value, day = 5.0, dt.date(2024, 5, 20)
        for i in range(int(rng.integers(1, 60))):
            value = float(rng.choice([value, value, value, value + 0.1, value - 0.4, 250.0, 0.5])) if value < 201 else 5.0
            day += dt.timedelta(days=int(rng.integers(0, 3)))
            rows.append((station, day, value if rng.random() < 0.97 else None, i))
    rows.append((3, None, 4.0, 0))
    daily = spark.createDataFrame(rows, "station long, day date, value double, ord long")
    dates, expected = ["2024-05-19", "2024-06-10", "2024-07-01", "2024-09-01"], []
    for station in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == station and r[1]), key=lambda r: (r[1], r[3]))
        values = [float("nan") if r[2] is None else r[2] for r in mine]
        for when in map(dt.date.fromisoformat, dates):
            n = sum(r[1] <= when for r in mine)
            told, i = {}, n - 1
            while i >= 0:
                flat = i
                while flat > 0 and all(1 <= v <= 200 for v in values[flat - 1 : i + 1]) and max(values[flat - 1 : i + 1]) - min(values[flat - 1 : i + 1]) <= 0.25:
                    flat -= 1
                if values[i] > 200:
                    told[i] = ("ceiling", mine[i][1])
                elif values[i] >= 1 and sum(6 <= r[1].month <= 9 for r in mine[flat : i + 1]) >= 7:
                    told |= dict.fromkeys(range(flat, i + 1), ("stuck", mine[flat][1]))
                    i = flat
                i -= 1
            for j in range(n):
                state = "rejected" if j in told else "silent" if n - 1 in told and (when - mine[j][1]).days <= 10 else "believed"
                expected.append((station, when, mine[j][1], mine[j][2], mine[j][3], state, *told.get(j, (None, None)), j == n - 1))
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = screen.judged_as_of(daily, dates)
        assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected, key=repr)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert {r[5] for r in expected} == {"rejected", "silent", "believed"} and {r[6] for r in expected} == {"stuck", "ceiling", None}


def test_names_within_bounds_meet_cells_of_namesakes(spark):
    """Bounds of all widths, edges included, find what comparing all pairs finds; of many namesakes only cells are met."""
    rng = np.random.default_rng(3)
    spots = [(f"s{i % 90}" if i % 40 else None, "red pass" if i % 3 else "blue pass", float(rng.integers(0, 40)) / 4, float(rng.integers(-40, 0)) / 4) for i in range(120)]
    spots += [("n", "red pass", float("nan"), -1.0), ("m", "red pass", None, -1.0)]
    south, west, *over = (rng.integers(*ends, 150) / 4 for ends in ((-2, 42), (-42, 2), (-1, 14), (-1, 14)))
    asked = [("red pass" if i % 2 else "blue pass", *map(float, (south[i], west[i], south[i] + over[0][i], west[i] + over[1][i]))) for i in range(150)]
    asked += [("red pass", 0.0, None, 9.0, 0.0), ("grey pass", -90.0, -180.0, 90.0, 180.0), ("red pass", -90.0, -180.0, 90.0, 180.0)]
    expected = {}
    for name, s, w, n, e in set(asked):
        met = [k for k, a, lat, lon in spots if a == name and lat is not None and w is not None and s <= lat <= n and w <= lon <= e]
        if met:
            held = sorted(k for k in met if k)
            expected[name, s, w, n, e] = held[0] if len(set(held)) == 1 else len(held) > 1
    known = spark.createDataFrame(spots, "slug string, alias string, lat double, lon double")
    bounds = F.struct("south", "west", "north", "east").alias("bounds")
    rows = gazetteer._in_bounds(spark.createDataFrame(asked, "alias string, south double, west double, north double, east double").select("alias", bounds).distinct(), known).collect()
    assert {(r["alias"], *r["bounds"]): r["least"] if r["least"] and r["least"] == r["greatest"] else r["least"] is not None for r in rows} == expected and len(rows) == len(expected)
    assert {True, "s0"} & set(expected.values()) and any(isinstance(v, str) for v in expected.values())


def test_trips_meet_only_the_first_passes_of_a_name(spark, monkeypatch):
    """Of a name that many passes bear a trip is given as many as it may have, the same ones as if it met all."""
    names = ["cold water pass", "dark wood gap", "old iron peak"]
    rows = [(f"p{i}", names[i % 3], "featured" if i % 4 == 0 else "osm", ["the pass after big blue lakes"] if i % 8 == 0 else None, 40 + i % 7 / 10, -120 + i % 5 / 10, i) for i in range(240)]
    passes = spark.createDataFrame(rows, "slug string, name string, tier string, aliases array<string>, lat double, lon double, ord long")
    texts = ["from cold water pass to drk wood gap", "to drk wood gap", "after big blue lakes to old iron peak", "cold water pass and dark wood gap"]
    asked = spark.createDataFrame([(i, texts[i % 4], *((40.1 + i / 10, -120.2) if i % 3 else (None, None))) for i in range(12)], "trip long, text string, lat double, lon double")
    routes = spark.createDataFrame([], "route string, aliases array<string>, passes array<string>")
    places = spark.createDataFrame([], "place string, kind string, passes array<struct<slug:string,distance_mi:double>>")
    most, plain = [], trips._owned

    def owned(asked, owners, table, known, limit, away):
        found = plain(asked, owners, table, known, limit, away)
        most.append(found.groupBy("trip", "key", "at").count().agg(F.max("count")).first()[0] or 0)
        return found

    monkeypatch.setattr(trips, "_owned", owned)
    got = trips.candidates(asked, passes, routes, places, limit=9).collect()
    assert max(most) == 9
    monkeypatch.setattr(trips, "_owned", lambda asked, owners, *more: asked.join(owners.select("key", "slug").distinct(), "key").select(*asked.columns, "slug"))
    whole = trips.candidates(asked, passes, routes, places, limit=9).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, whole)) and {r["kind"] for r in got} >= {"name", "fuzzy"}


def test_documents_are_written_by_many_tasks(spark, tmp_path):
    rows = [(k, f"name {k}") for k in range(64)]
    feeds.write_documents(spark.createDataFrame(rows, "slug long, name string").coalesce(1), "slug", str(tmp_path / "out"))
    files = list((tmp_path / "out").glob("slug=*/part-*"))
    assert len(files) == 64 and (spark.sparkContext.defaultParallelism == 1 or len({f.name.split("-")[1] for f in files}) > 1)
