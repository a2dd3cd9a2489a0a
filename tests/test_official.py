"""Agency pages: literal pages of each family."""

import datetime as dt

import pytest
from cairn.sources import official, roads
from pyspark.sql import functions as F

D = dt.date


@pytest.fixture
def read(spark):
    return lambda html: official.stream(spark.createDataFrame([(1, html)], "key long, html string"))


def reports(found, fetched="2026-09-30 12:00:00"):
    dated = found.withColumn("fetched_at", F.lit(fetched).cast("timestamp"))
    rows = roads.official_reports(dated).orderBy("ord").collect()
    return [(r["section"], r["place"], r["text"], r["day"]) for r in rows]


def test_tables_left_open_close_themselves(read):
    got = read("<h2>A</h2><table><tr><td>a<p>b<td>c<tr><td><table><tr><td>in</table>after<td></table>tail<nav>no</nav>").collect()
    said = [(r["kind"], r["text"], r["tbl"], r["row"], r["cell"]) for r in got if r["kind"] in ("heading", "line")]
    assert said == [("heading", "A", None, None, None), ("line", "a", 0, 0, 0), ("line", "b", 0, 0, 0), ("line", "c", 0, 0, 1), ("line", "in", 1, 0, 0), ("line", "after", 0, 1, 0), ("line", "tail", None, None, None)]
    assert [(r["tbl"], r["row"], r["cell"]) for r in got if r["kind"] == "cell"] == [(0, 0, 0), (0, 0, 1), (0, 1, 0), (1, 0, 0), (0, 1, 1)]


@pytest.mark.parametrize(
    ("text", "day", "rest"),
    [("9/21/2026 - Creek runs", D(2026, 9, 21), "Creek runs"), ("9/29-Open", D(2026, 9, 29), "Open"), ("10/2: Snow", D(2025, 10, 2), "Snow"), ("7/24/25: old", D(2025, 7, 24), "old"), ("9/31/2026 no", None, None), ("9/21/2026", None, None), ("9/29 Open", None, None), ("words", None, None), ("2/29-leap", None, None)],
)
def test_dates_that_lead_a_line(spark, text, day, rest):
    a, b = official.leading(F.col("t"), F.lit(D(2026, 9, 30)))
    row = spark.createDataFrame([(text,)], "t string").select(a.alias("a"), b.alias("b")).first()
    assert (row["a"], row["b"]) == (day, rest)


@pytest.mark.parametrize(("text", "whole", "inside"), [("Sept. 3rd, 2026", D(2026, 9, 3), D(2026, 9, 3)), ("2026-09-03T10:00:00", D(2026, 9, 3), D(2026, 9, 3)), ("on 9/3/26.", None, D(2026, 9, 3)), ("9/3/2026 10:00", None, D(2026, 9, 3)), ("19/3/2026", None, None), ("a9/3/2026", None, None), ("1/2/3/2026", None, None)])
def test_dates(spark, text, whole, inside):
    row = spark.createDataFrame([(text,)], "t string").select(official.whole_date(F.col("t")).alias("a"), official.first_date(F.col("t")).alias("b")).first()
    assert (row["a"], row["b"]) == (whole, inside)


def test_headed_lines(read):
    html = """<button class="accordion x">North</button><h4>Copper Creek</h4><p>09/21/2026 - Still running.</p><p>9/20/2026: Log down</p><p>Some prose ends the tie.</p><p>9/19/2026 lost</p>
    <b>Bold Lake</b><br>9/18/2026 ice<br>10/5/2026 is of tomorrow<h3>No place</h3><p>9/1/2026 lost too</p>"""
    assert reports(official.headed(read(html))) == [
        ("North", "Copper Creek", "Still running.", D(2026, 9, 21)), ("North", "Copper Creek", "Log down", D(2026, 9, 20)), ("North", "Bold Lake", "ice", D(2026, 9, 18)),
    ]


def test_lines_in_cells(read):
    html = """<p>September 30, 2026</p><h3>Trails</h3><table><tr><th>Trail <b>Name</b></th><th>Reported Conditions</th></tr><tr><td>Cascade<br>Pass</td><td>9/29-Clear<br><a href=x>9/28-map</a><br>no date<br>7/24/25: logs</td></tr><tr><td>Short</td></tr></table>
    <table><tr><th>Other</th><th>Reported Conditions</th></tr><tr><td>a</td><td>9/29-no</td></tr></table>"""
    rows = official.table_rows(read(html))
    assert reports(official.table_lines(rows)) == [("Trails", "Cascade Pass", "Clear", D(2026, 9, 29)), ("Trails", "Cascade Pass", "logs", D(2025, 7, 24))]
    assert reports(official.table_lines(official.table_rows(read(html.replace("<p>September 30, 2026</p>", ""))))) == []


def test_tables_with_a_column_of_dates(read):
    html = """<h2>East</h2><table><tr><th>Trail Name</th><th>Snow Cover</th><th>Trail Conditions</th><th>Last Update</th></tr>
    <tr><td>Summary</td><td></td><td>Dry.<br><a>Map</a></td><td>9/12/2026</td></tr><tr><td>Rim</td><td>Patchy</td><td>Wet<p>Muddy</td><td>Sept 1, 2026</td></tr>
    <tr><td>Old</td><td>x</td><td>No recent reports.</td><td>9/1/2026</td></tr><tr><td>Undated</td><td>x</td><td>Fine</td><td>soon</td></tr></table>"""
    got = reports(official.dated_rows(official.table_rows(read(html)), extras=("snow cover",)))
    assert got == [("East", "East", "Dry.", D(2026, 9, 12)), ("East", "Rim", "Snow Cover: Patchy\nWet\nMuddy", D(2026, 9, 1))]


def test_bulletin(read):
    html = """<h2>Intro</h2><p>x</p><h2>General Conditions</h2><p>September 25, 2026</p><h3>Valley</h3><p>Open.</p><h4>Detail</h4><p>lost</p><h3>Current Closures</h3><p>none</p><h3>High</h3><p>Snow.</p><p>Ice.</p><h2>End</h2><h3>Valley</h3><p>after</p>"""
    standing = ("Current Closures",)
    assert [r[1:] for r in reports(official.bulletin(read(html), standing=standing))] == [("Valley", "Open.", D(2026, 9, 25)), ("High", "Snow.", D(2026, 9, 25)), ("High", "Ice.", D(2026, 9, 25))]
    assert reports(official.bulletin(read(html.replace("<p>September 25, 2026</p>", "<h3>September 25, 2026</h3>")))) == []


def test_road_tables(read):
    html = """<h2>Updated 9/20/2026</h2><h3>road status</h3><table><tr><th>Road</th><th>Status</th></tr><tr><td>Tioga<br>to the gate<br><a>map</a></td><td>Open<br>Watch for ice</td></tr><tr><td>Glacier Point</td><td>winter</td><td>Closed</td></tr><tr><td>Empty</td><td></td></tr></table><h3>Else</h3><table><tr><td>a</td><td>b</td></tr></table>"""
    assert reports(official.road_tables(official.table_rows(read(html)))) == [("road status", "Tioga", "Open\nto the gate\nWatch for ice", D(2026, 9, 20)), ("road status", "Glacier Point", "Closed\nwinter", D(2026, 9, 20))]


def test_highways(read):
    html = """<p>Latest reported as of Tuesday, 9/29/2026 at 5 am</p><h3>SR 120</h3><p>[IN THE SIERRA NEVADA]</p><p>Is closed from the gate.</p><p>No traffic restrictions are reported for this area.</p><h3>US-395</h3><p>Wind.</p><h3>Other</h3><p>[X]</p><p>lost</p><h3>I 80</h3><p>Chains.</p>"""
    assert reports(official.highway_lines(read(html))) == [("IN THE SIERRA NEVADA", "SR 120", "Is closed from the gate.", D(2026, 9, 29)), ("", "US-395", "Wind.", D(2026, 9, 29)), ("", "I 80", "Chains.", D(2026, 9, 29))]
