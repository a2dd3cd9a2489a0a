"""Division by zero, means and rounding as SQL has them; positions that repeat."""

import datetime
import itertools
import math
import operator
from functools import reduce

from cairn.functions.numbers import mean, quotient, rounded
from cairn.operators import asof, conditions, links
from cairn.plans import registry
from cairn.plans.inputs import Tables
from cairn.sources import roads
from pyspark.sql import functions as F

_DAY = datetime.date(2024, 1, 6)


def _events(spark, folder, rows):
    """A folder whose events are (user, type, value) at the 6th and an hour each."""
    at = lambda i: datetime.datetime(2024, 1, 6, i % 24)
    table = spark.createDataFrame([(i, at(i), u, k, v, "") for i, (u, k, v) in enumerate(rows)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    table.write.mode("overwrite").parquet(f"{folder}/events.parquet")
    return str(folder)


def test_days_of_zeros_melt(spark, tmp_path):
    import duckdb

    folder = _events(spark, tmp_path, [(1, "click", 0.0), (2, "click", 3.0), (2, "click", 5.0), (3, "click", 0.0), (3, "click", 0.0)])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    for name in ("melt_activity", "diurnal_swing"):
        got = {tuple(map(str, r)) for r in registry.queries()[name](spark, folder).collect()}
        assert got == {tuple(map(str, r)) for r in con.execute(registry.oracle_sql()[name]).fetchall()}
        assert len(got) >= 2


def test_flow_from_nothing_rises(spark):
    rows = [(s, _DAY - datetime.timedelta(days=5 - i), v, i) for s, values in ((1, [0.0, 1.0, 2.0, 3.0]), (2, [0.0, 1.0, 2.0, 0.0]), (3, [2.0, 1.0, 1.0, 0.0]), (4, [2.0, 2.0, 2.0, 2.0])) for i, v in enumerate(values)]
    got = asof.flow(spark.createDataFrame(rows, "station long, day date, value double, ord long"), ["2024-01-08"])
    assert {r["station"]: r["trend"] for r in got.collect()} == {1: "rising", 2: "rising", 3: "dropping", 4: "steady"}


def test_quotients(spark):
    row = spark.createDataFrame([(0.0,)], "z double").select(quotient(F.lit(1.0), F.col("z")).alias("a"), quotient(F.lit(-1.0), F.col("z")).alias("b"), quotient(F.col("z"), F.col("z")).alias("c"), quotient(F.lit(6.0), F.lit(4.0)).alias("d")).first()
    assert (row["a"], row["b"], row["d"]) == (math.inf, -math.inf, 1.5) and math.isnan(row["c"])


def test_swings_round_the_scaled_double(spark):
    gauges = spark.createDataFrame([(1, _DAY, "diurnal_swing_pct", 3.4499999999999997, 1)], "slug long, day date, metric string, value double, ord long")
    assert conditions.creeks(gauges, ["2024-01-08"]).first()["swing"] == 3.5
    assert spark.range(1).select(rounded(F.lit(3.4499999999999997), 1)).first()[0] == 3.5


def test_means_do_not_hang_on_order(spark):
    values = [35.26, 33.82, 40.68, 0.1, 1e-3]
    means = set()
    for order in itertools.permutations(values):
        means.add(reduce(operator.add, order) / len(order))
    assert len(means) > 1
    rows = [(i, v) for i, order in enumerate(itertools.permutations(values)) for v in order]
    got = spark.createDataFrame(rows, "k long, v double").groupBy("k").agg(mean(F.col("v")).alias("m"))
    assert got.select("m").distinct().count() == 1
    assert spark.createDataFrame([(1, None)], "k long, v double").groupBy("k").agg(mean(F.col("v")).alias("m")).first()["m"] is None


def test_swing_of_a_day_rounds_the_scaled_double(spark):
    days = spark.createDataFrame([(1, _DAY, v) for v in (142.31, 49.03, 19.94, 32.15, 56.57)] + [(2, _DAY, v) for v in (3.0, 100.0, 97.0345)], "site long, day date, value double")
    for r in roads.daily_swings(days, 3).collect():
        values = sorted(x["value"] for x in days.filter(F.col("site") == r["site"]).collect())
        assert r["swing"] == math.floor((values[-1] - values[0]) / (reduce(operator.add, values) / len(values)) * 100 * 10 + 0.5) / 10


def test_swings_add_readings_in_their_order(spark, tmp_path):
    """Days that repeat their readings, whose swing lies on an edge of rounding."""
    import duckdb

    days = [[12.09, 7.75] * 6, [23.52, 0.9, 13.02] * 60, [1.48, 6.66, 31.86] * 60, [30.09, 24.31] * 60]
    folder = _events(spark, tmp_path, [(u, "view", v) for u, values in enumerate(days) for v in values])
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE TABLE events AS FROM '{folder}/events.parquet/*.parquet' ORDER BY event_id")
    want = {tuple(map(str, r)) for r in con.execute(registry.oracle_sql()["quarter_hour_swings"]).fetchall()}
    assert {tuple(map(str, r)) for r in registry.queries()["quarter_hour_swings"](spark, folder).collect()} == want and len(want) == len(days)


def test_corners_as_written(spark):
    body = "<Placemark><description>Density: Heavy</description><coordinates>-120.00999999999999,1,0 2,1,0 2,3,0 -120.00999999999999,3,0</coordinates></Placemark>"
    kml = spark.createDataFrame([(1, body)], "id long, body string")
    assert roads.plumes(kml, None).first()["ring"][0]["lon"] == -120.00999999999999
    assert roads.plumes(kml).first()["ring"][0]["lon"] == -120.01


def test_smoke_on_an_edge(spark, sf, duck):
    """Places on the edges of plumes lie in or out as SQL has it, by the last digit."""
    customers = spark.range(1, 17001).select(F.col("id").alias("c_custkey"), F.lit("x").alias("c_name"))

    class Edges(Tables):
        def __getattr__(self, name):
            return customers if name == "customer" else super().__getattr__(name)

    duck.execute("CREATE OR REPLACE TEMP VIEW wide AS SELECT range AS c_custkey, 'x' AS c_name FROM range(1, 17001)")
    want = duck.execute(registry.oracle_sql()["smoke_over_places"].replace("FROM customer", "FROM wide")).fetchall()
    run = registry.QUERIES["smoke_over_places"].__closure__[0].cell_contents
    assert {tuple(r) for r in run(Edges(spark, sf)).select("key", "density").collect()} == set(want)


def test_nearest_of_repeated_positions(spark):
    left = [(k, 40.0 + k % 3 / 100, -120.0 - k % 2 / 100) for k in range(40)] + [(99, None, -120.0)]
    right = [(k, 40.0 + k % 5 / 50, -120.0 + k % 4 / 50) for k in range(200)]
    made = lambda rows: spark.createDataFrame(rows, "key long, lat double, lon double")
    pairs = links.within(made(left), made(right), 9).collect()
    want = set()
    for key, _, _ in left:
        own = sorted((p["km"], p["rkey"]) for p in pairs if p["lkey"] == key)
        want |= {(key, r, km, i + 1) for i, (km, r) in enumerate(own[:3])}
    got = links.nearest_k(made(left), made(right), 9, 3)
    assert {tuple(r) for r in got.collect()} == want and len(want) == 120
    # What is met grows with the positions, not with the rows.
    assert links.met(made(left), made(right), 3)[0].count() == 6
    assert links.met(made(left), made(right), 3)[1].count() <= 60
