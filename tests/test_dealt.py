"""Work on rows of small files is dealt over tasks, and what one task holds does not grow with the tables."""

import datetime as dt

import pandas as pd
from cairn.functions import rows, rules, text
from cairn.operators import links, names, trip_summary, watches
from cairn.sources import html, official
from cairn.streaming import watch
from pyspark.sql import Row
from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().toString()


def test_pages_are_read_by_many_tasks_and_nothing_is_joined(spark, monkeypatch):
    monkeypatch.setattr(official, "TASK_PAGES", 4)
    body = "<h3>A</h3><table><tr><th>n<tr><td>x <a>map</a><br><a>map</a></table><p>last updated 1/2/2024"
    items = official.stream(spark.createDataFrame([(k, body) for k in range(70)], "key long, html string").coalesce(1))
    assert items.rdd.getNumPartitions() >= 18
    found = official.table_rows(items)
    assert "Join" not in plan(found) and plan(found).count("REPARTITION_BY_NUM") == 2
    # What follows keeps to these tasks: no exchange but the two by number.
    assert "ENSURE_REQUIREMENTS" not in plan(found)
    got = {(r["row"], r["heading"], str(r["cells"]), str(r["header"]), tuple(r["linked"]), r["page_day"]) for r in found.collect()}
    assert got == {(0, "A", "[['n']]", "[['n']]", ("map",), dt.date(2024, 1, 2)), (1, "A", "[['x map', 'map']]", "[['n']]", ("map",), dt.date(2024, 1, 2))} and found.count() == 140


def test_rows_are_dealt_by_their_number(spark):
    assert rows.dealt(spark.range(100).coalesce(1), "id", most=5).rdd.getNumPartitions() >= 21


def test_a_text_is_cut_into_sentences_once(spark):
    cut = spark.createDataFrame([("Mt. A is. B! c",), ("No end " * 3,), (None,), ("",), ("A. B. C. D. E.",)], "t string").select(rules.excerpt(F.col("t"), 9).alias("x"))
    assert cut._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") == 1
    assert [r["x"] for r in cut.collect()] == ["Mt. A is.", "No end No end No end", None, "", "A. B. C."]


def test_zones_are_searched_once_a_position(spark):
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]
    zone = spark.createDataFrame([(1, [dict(lon=x, lat=y) for x, y in ring], 0.0, 0.0, 1.0, 1.0)], "zone int, ring array<struct<lon:double,lat:double>>, west double, south double, east double, north double")
    points = spark.createDataFrame([(k, *((0.5, 0.5) if k % 2 else (0.5, 1.2)), ) for k in range(40)] + [(99, None, 0.5), (98, 30.0, 30.0)], "key long, lat double, lon double")
    found = links.nearest_ring(points.coalesce(1), zone, 50)
    got = {r["key"]: r["km"] for r in found.collect()}
    assert set(got) == set(range(40)) and len(set(got.values())) == 2 and all((got[k] == 0) == (k % 2 == 1) for k in got)
    assert "Aggregate [lat" in found._jdf.queryExecution().optimizedPlan().toString() and "REPARTITION_BY_NUM" in plan(found)


def test_items_are_given_on_a_few_at_a_time(monkeypatch):
    monkeypatch.setattr(html, "BATCH_ROWS", 10)

    class Pages:
        def mapInPandas(self, read, schema):
            return read

    pages = pd.DataFrame({"key": range(30), "html": ["<p>a<p>b<p>c"] * 29 + [None]})
    parts = list(html.items(Pages())([pages]))
    assert max(map(len, parts)) <= 12 and sum(map(len, parts)) == 87 and list(pd.concat(parts)["ord"]) == [0, 1, 2] * 29


def test_exports_are_dealt_by_place_before_they_are_grouped(spark):
    exports = spark.createDataFrame([(k, "n", dt.date(2024, 1, d), "open", "Open", None, None) for k in range(5) for d in (1, 2)], watches.EXPORT)
    found = watches.paired(exports.coalesce(1))
    assert found.count() == 5 and "REPARTITION_BY_NUM" in plan(found) and "ENSURE_REQUIREMENTS" not in plan(found)


def test_states_take_rows_as_they_come():
    class State:
        held, calls = None, 0

        def get(self):
            self.calls += 1
            return self.held

        def update(self, value):
            self.calls, self.held = self.calls + 1, value

    pairs, day = watch._Pairs(), dt.date(2024, 1, 2)
    pairs.last = State()
    later = day + dt.timedelta(days=1)
    told = list(pairs.handleInputRows((7,), iter([Row(slug=7, date=later, body="b"), Row(slug=7, date=day, body="a")]), None))
    assert told == [Row(slug=7, now="b", was="a")] and pairs.last.held == (later, "b") and pairs.last.calls == 2
    assert list(pairs.handleInputRows((7,), iter([Row(slug=7, date=day, body="late")]), None)) == [] and pairs.last.held == (later, "b")


def test_a_stop_carries_only_the_worst_days_of_its_place(spark):
    days = spark.createDataFrame([("a", dt.date(2024, 1, d), d % 3 * 10, 0) for d in range(1, 9)] + [("b", dt.date(2024, 1, 2), 20, None), ("b", dt.date(2024, 1, 5), 5, None)], "slug string, day date, precip_chance int, thunder_chance int")
    stops = [(t, p, s, f"{s}{p}", 100 + p, "Open", "high", dt.date(2024, 1, 1)) for t, p, s in ((1, 1, "a"), (1, 2, "b"), (1, 3, "a"), (2, 1, "b"), (3, 1, "none"))]
    stops = spark.createDataFrame(stops, "trip long, pos int, slug string, name string, elevation_ft long, label string, confidence string, as_of date")
    found = trip_summary.summaries(stops, days, "2024-01-01")
    # Stops are joined to places, places to their own maxima, and nothing else; then they are grouped by trip.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2
    got = {r["trip"]: (r["precipitation"], r["thunder"]) for r in found.collect()}
    assert got[1][0].endswith("20% on Tue, Jan 2 at a1, b2 and a3.") and got[1][1].startswith("The forecast") and got[2][0].endswith("20% on Tue, Jan 2 at b1.") and got[2][1] is None and got[3] == (None, None)


def test_runs_of_words_are_columns(spark, monkeypatch):
    said = "Red pass,  by the OLD  red mill - pass"
    found = names.mentions(spark.createDataFrame([(1, said), (2, "old"), (3, ""), (4, None)], "key long, text string"), spark.createDataFrame([("red mill pass",), ("the old",), ("old",)], "name string"))
    assert {(r["key"], r["name"]) for r in found.collect()} == {(1, "red mill pass"), (2, "old")}
    monkeypatch.setattr(names, "BROADCAST_NAMES", 0)
    many = names.mentions(spark.createDataFrame([(1, said), (2, "old"), (3, ""), (4, None)], "key long, text string"), spark.createDataFrame([("red mill pass",), ("the old",), ("old",)], "name string"))
    assert sorted(many.collect()) == sorted(found.collect())
    starts = names._starts(spark.createDataFrame([(1, "a, b c")], "key long, text string"), 2)
    assert {tuple(r) for r in starts.collect()} == {(1, "a", "b"), (1, "b", "c"), (1, "c", None)} and "lambda" not in plan(found)
    assert spark.createDataFrame([(" A--b  c,D ",), ("",), (None,)], "t string").select(text.normal(F.col("t")).alias("n")).collect() == [Row(n="a b c d"), Row(n=""), Row(n=None)]
