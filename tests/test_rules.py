"""Rules at their edges, on small tables."""

import datetime as dt

import numpy as np
import pytest
from cairn.functions import geo, rules, text
from cairn.operators import asof, backtest, conditions, fusion, islands, ledger, links, rollup, screen, season, shapes
from cairn.sources import feeds, html
from pyspark.sql import functions as F

D = dt.date


def series(spark, values, start=D(2024, 3, 1), gap=1):
    rows = [(1, start + dt.timedelta(days=i * gap), float(v)) for i, v in enumerate(values) if v is not None]
    return spark.createDataFrame(rows, "station long, day date, value double")


@pytest.mark.parametrize(("age", "kept"), [(0, 1), (10, 1), (11, 0), (-1, 0)])
def test_window_edge(spark, age, kept):
    day = D(2024, 1, 15) - dt.timedelta(days=age)
    readings = spark.createDataFrame([(1, day, 2.0, 1)], "station long, day date, value double, ord long")
    assert asof.newest(readings, ["2024-01-15"], 10).count() == kept


def test_equal_days_take_the_first(spark):
    readings = spark.createDataFrame([(1, D(2024, 1, 15), 2.0, 9), (1, D(2024, 1, 15), 5.0, 3)], "station long, day date, value double, ord long")
    assert asof.newest(readings, ["2024-01-15"], 10).first()["value"] == 5.0


@pytest.mark.parametrize(("days", "since"), [(6, None), (7, D(2024, 3, 1))])
def test_bare_run_needs_a_week(spark, days, since):
    got = islands.melted_out(series(spark, [0.0] * days)).collect()
    assert [r["since"] for r in got] == ([since] if since else [])


@pytest.mark.parametrize(("gap", "since"), [(20, D(2024, 3, 21)), (21, None)])
def test_bare_run_stops_at_a_gap(spark, gap, since):
    rows = [(1, D(2024, 3, 1), 9.0), (1, D(2024, 3, 1) + dt.timedelta(days=gap), 0.0)]
    got = islands.melted_out(spark.createDataFrame(rows, "station long, day date, value double")).collect()
    assert [(r["since"], r["observed"]) for r in got] == ([(since, True)] if since else [])


def test_half_an_inch_is_not_bare(spark):
    assert islands.melted_out(series(spark, [0.5] * 9)).count() == 0


@pytest.mark.parametrize(("start", "n", "kept"), [(D(2024, 6, 1), 6, 7), (D(2024, 6, 1), 7, 1), (D(2024, 5, 28), 10, 11), (D(2024, 5, 28), 11, 1)])
def test_flat_run_counts_summer_days(spark, start, n, kept):
    daily = series(spark, [9.0, *[4.0] * n], start - dt.timedelta(days=1))
    assert screen.believed(daily).filter("believed").count() == kept


@pytest.mark.parametrize(("value", "ok"), [(200.0, True), (200.1, False)])
def test_ceiling(spark, value, ok):
    assert screen.believed(series(spark, [3.0, value])).filter("believed").count() == 1 + ok


def test_stray_goes_and_step_stays(spark):
    assert [r["value"] for r in islands.without_strays(series(spark, [1, 2, 99, 3, 4])).orderBy("day").collect()] == [1, 2, 3, 4]
    assert islands.without_strays(series(spark, [1, 2, 99, 98, 97])).count() == 5


def test_change_needs_the_very_day(spark):
    assert islands.change(series(spark, [5, 6, 7, 9]), 3).first()["delta"] == 4.0
    assert islands.change(series(spark, [5, 6, 7, 1]), 3).first()["delta"] == 0.0
    assert islands.change(series(spark, [None, 6, 7, 9]), 3).first()["delta"] is None


def test_median_with_open_ends(spark):
    df = spark.range(1).select(*(season.middle(F.array(*map(F.lit, v))).alias(n) for n, v in {"a": [1.0, 2.0, float("inf")], "b": [1.0, float("inf")], "c": [float("-inf"), 4.0, 5.0, float("inf")]}.items()))
    assert tuple(df.first()) == (2.0, None, 4.5)


def test_statuses_and_conflicts(spark):
    rows = [(1, D(2024, 1, 1), "a", 0.0, 1.0, 1), (1, D(2024, 1, 1), "b", 1.0, 1.0, 1), (2, D(2024, 1, 1), "a", 0.0, 1.0, 9), (2, D(2024, 1, 1), "b", 3.0, 1.0, 9)]
    got = {r["slug"]: r for r in fusion.fuse(spark.createDataFrame(rows, "slug long, eval_date date, kind string, severity double, weight double, age int")).collect()}
    assert (got[1]["status"], got[1]["conflicts"], got[1]["score"]) == ("snow_caution", "", 4)
    assert (got[2]["status"], got[2]["conflicts"], got[2]["confidence"]) == ("traction_advised", "a~b", "low")


def test_hold_out_drops_self_and_same_author_that_day(spark):
    rows = [(1, "p", "x", D(2024, 1, 1)), (2, "p", "x", D(2024, 1, 1)), (3, "p", "x", D(2024, 1, 2)), (4, "p", "y", D(2024, 1, 1)), (5, "q", "y", D(2024, 1, 1))]
    reports = spark.createDataFrame(rows, "id long, place string, author string, day date")
    assert {r["target"]: r["n"] for r in backtest.held_out(reports, reports).collect()} == {1: 2, 2: 2, 3: 3, 4: 3, 5: 0}


def test_thin_cells_have_no_interval(spark):
    rows = spark.createDataFrame([(0, 0, "a")] * 9 + [(1, 0, "b")] * 10, "engine int, observed int, k string")
    got = {r["cell"]: r for r in backtest.outcome_sets(rows, ["k"]).collect()}
    assert got["a"]["low"] is None and got["b"]["low"] == 0.0 and got[None]["n"] == 19


def test_reconcile_cases(spark):
    side = lambda d: spark.createDataFrame(list(d.items()) or [("x", 0)], "key string, value int").filter("value > 0")
    base = {"same": 1, "mine": 1, "theirs": 1, "gone_here": 1, "gone_there": 1, "both": 1}
    local = {"same": 1, "mine": 2, "theirs": 1, "gone_there": 1, "both": 2, "new": 1}
    server = {"same": 1, "mine": 1, "theirs": 2, "gone_here": 1, "both": 3}
    got = {r["key"]: r["action"] for r in ledger.reconcile(side(local), side(base), side(server)).collect()}
    assert got == {"same": "keep", "mine": "push", "theirs": "pull", "gone_here": "delete_remote", "gone_there": "delete_local", "both": "conflict", "new": "push"}


def test_distance_zero_and_radius(spark):
    a = spark.createDataFrame([(1, 40.0, -120.0)], "key long, lat double, lon double")
    b = spark.createDataFrame([(1, 40.0, -120.0), (2, 40.44, -120.0), (3, 41.0, -120.0)], "key long, lat double, lon double")
    assert [(r["rkey"], r["km"]) for r in links.nearest_k(a, b, 50, 3).orderBy("rank").collect()] == [(1, 0.0), (2, 48.9)]


def test_ring_edge_and_compass(spark):
    ring = F.array(*(F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]))
    inside = [geo.in_ring(F.lit(x), F.lit(y), ring) for x, y in [(1.0, 1.0), (0.0, 0.0), (2.0, 1.0), (1.0, 2.0)]]
    assert list(spark.range(1).select(*inside).first()) == [True, True, False, False]
    words = [geo.compass(F.lit(float(b))) for b in (0, 22.5, 67.5, 359, -90)]
    assert list(spark.range(1).select(*words).first()) == ["north", "north", "east", "north", "west"]
    km = spark.range(1).select(geo.ring_km(F.lit(3.0), F.lit(1.0), ring)).first()[0]
    assert abs(km - 111.32 * 0.99985) < 0.05


def test_interval_over_midnight(spark):
    t = lambda d, h: dt.datetime(2024, 1, d, h)
    rows = [("a", t(1, 18), t(2, 0), 1.0), ("a", t(1, 12), t(3, 12), 4.8), ("a", t(5, 1), t(5, 1), 9.0)]
    df = spark.createDataFrame(rows, "slug string, start timestamp_ntz, end timestamp_ntz, value double")
    assert [(r["day"].day, r["hundredths"], r["highest"]) for r in rollup.by_day(df).orderBy("day").collect()] == [(1, 220, 4.8), (2, 240, 4.8), (3, 120, 4.8)]


def test_text_functions(spark):
    df = spark.createDataFrame([("seen 2024-02-30 or 2/3/24", "http://u@Pass.Example:80/x", "  Big\n Pass")], "t string, u string, n string")
    got = df.select(text.found_date(F.col("t")), text.host(F.col("u")), text.reserved(F.col("u")), text.normal(F.col("n")), text.slug(F.lit("Mt. X's Pass"))).first()
    assert list(got) == [D(2024, 2, 3), "pass.example", True, "big pass", "mt-x-s-pass"]


def test_html_null_and_unclosed(spark):
    pages = spark.createDataFrame([(1, None), (2, "<h2>A <b>b</b></h2><p>one<p>two<script>x<y</script><table><tr><td>c<td>d")], "key long, html string")
    assert [(r["kind"], r["level"], r["text"]) for r in html.items(pages).orderBy("ord").collect()] == [("heading", 2, "A b"), ("line", 0, "one"), ("line", 0, "two"), ("cell", 0, "c"), ("cell", 0, "d")]


def test_feeds(spark, tmp_path):
    body = '[{"station":"s1","data":[{"element":"W","values":[{"date":"2024-01-01","value":1.5},{"date":"2024-01-02","value":null},{"date":"x","value":1}]}]}]'
    one = spark.createDataFrame([(body,)], "body string")
    assert [tuple(r) for r in feeds.station_values(one).collect()] == [("s1", "W", D(2024, 1, 1), 1.5)]
    rows = '[{"station":"A","sensor":"3","date":"2024-1-5 0:00","value":2},{"station":"A","sensor":"3","date":"2024-1-5 1:00","value":3},{"station":"A","sensor":"3","date":"2024-1-6 0:00","value":-9999},{"station":"A","sensor":"7","date":"2024-1-5 0:00","value":1}]'
    assert [tuple(r) for r in feeds.sensor_rows(spark.createDataFrame([(rows,)], "body string"), {"3": "swe_in"}).collect()] == [("A", "swe_in", D(2024, 1, 5), 3.0)]
    (tmp_path / "s.rdb").write_text("# c\nagency_cd\tsite_no\tstation_nm\n5s\t15s\t50s\nUSGS\t1\tBIG CREEK\nUSGS\t2\tMILL DITCH\n")
    assert [r["site_no"] for r in feeds.tab_sites(spark, str(tmp_path / "s.rdb"), "USGS", "DITCH|CANAL").collect()] == ["1"]
    (tmp_path / "k.kml").write_text("<kml><Placemark><description>Density: Heavy</description><styleUrl>#Light</styleUrl><Polygon><outerBoundaryIs><LinearRing><coordinates>0,0 1,0 1,1</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark></kml>")
    got = feeds.placemarks(spark, str(tmp_path / "k.kml")).first()
    assert got["density"] == "heavy" and len(got["ring"]) == 4
    fires = '{"features":[{"properties":{"name":"A","gis_acres":5,"category":null},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]],[[0,0],[1,0],[0,0]]]}},{"properties":{"name":"D","acres":1},"geometry":{"type":"Polygon","coordinates":[[[0,0]]]}},{"properties":{"name":"B","category":"RX"},"geometry":{"type":"Polygon","coordinates":[]}},{"properties":{"name":"C","category":"WF","out":"2024"},"geometry":{"type":"Polygon","coordinates":[]}}]}'
    got = feeds.perimeters(spark.createDataFrame([(fires,)], "body string")).collect()
    assert [(r["name"], r["acres"], r["updated"], [len(x) for x in r["rings"]]) for r in got] == [("A Fire", 5, None, [4])]
    assert feeds.directory(spark.range(9), spark.range(10), age_days=3).count() == 10
    with pytest.raises(ValueError):
        feeds.directory(spark.range(0), spark.range(0))
    assert feeds.directory(spark.range(8), spark.range(10)).count() == 10 and feeds.directory(spark.range(9), spark.range(10)).count() == 9
    feeds.write_documents(spark.createDataFrame([("a", 1), ("b", 2)], "slug string, n int"), "slug", str(tmp_path / "out"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()) == ['{"slug":"a","n":1}', '{"slug":"b","n":2}']
    feeds.append_raw(spark.createDataFrame([("s", "u", "x")], "source string, url string, body string"), str(tmp_path / "raw"))
    assert spark.read.parquet(str(tmp_path / "raw")).first()["sha256"].startswith("2d711642")


def test_thinned_ring_against_the_recursion():
    rng = np.random.default_rng(2)
    x, y = np.arange(80) * 1.0, rng.standard_normal(80).cumsum()

    def keep(a, b):
        if b - a < 2:
            return set()
        away = []
        for i in range(a + 1, b):
            dx, dy = x[b] - x[a], y[b] - y[a]
            t = min(1, max(0, ((x[i] - x[a]) * dx + (y[i] - y[a]) * dy) / (dx * dx + dy * dy)))
            away.append(np.hypot(x[i] - x[a] - t * dx, y[i] - y[a] - t * dy))
        far = a + 1 + int(np.argmax(away))
        return {far} | keep(a, far) | keep(far, b) if max(away) > 1.5 else set()

    assert shapes.kept_points(x, y, 1.5, [0, 79]).tolist() == sorted({0, 79} | keep(0, 79))


def evidence(spark, **kinds):
    """fused() of one place with literal components: severity, weight, age and the like."""
    day = D(2024, 6, 1)
    place = spark.createDataFrame([(1,)], "key long")

    def rows(schema, given):
        frame = spark.createDataFrame([(1, *given)] if given else [], "slug long, " + schema)
        return frame.withColumn("eval_date", F.lit(day))

    return conditions.fused(
        place, ["2024-06-01"], rows("severity double, weight double, age int", kinds.get("sensor")), rows("severity double, weight double", kinds.get("line")),
        rows("severity double, weight double, age int, modeled boolean", kinds.get("scene")), rows("severity double, weight double, age int, n_reports long", kinds.get("reports")),
        rows("worst string", kinds.get("worst")), rows("flow double", kinds.get("flow")),
    ).first()


def test_no_evidence_is_unknown(spark):
    got = evidence(spark, flow=(120.0,))
    assert (got["status"], got["severity"], got["score"], got["confidence"]) == ("unknown", None, 0.0, "low")


def test_weighted_mean_conflict_and_grade(spark):
    got = evidence(spark, sensor=(2.4, 0.9, 1), scene=(0.6, 0.65, 4, False), reports=(2.0, 0.75, 2, 2), flow=(10.0,))
    want = (2.4 * 0.9 + 0.6 * 0.65 + 2.0 * 0.75) / (0.9 + 0.65 + 0.75)
    assert got["severity"] == round(want, 2) and got["status"] == "traction_advised"
    assert got["conflicts"] == "Sensors suggest more snow than satellite do (severity 2.4 vs 0.6).".replace("satellite do", "satellite does") + " Parties on the ground suggest more snow than satellite does (severity 2.0 vs 0.6)."
    assert got["score"] == 2.0 + 1.5 + 2.0 + 1.0 - 2.0 and got["confidence"] == "moderate"


def test_a_sensor_silences_the_line_and_fords_overlay(spark):
    got = evidence(spark, sensor=(0.2, 0.9, 0), line=(2.0, 0.405), worst=("thigh_high",))
    assert (got["severity"], got["status"], got["score"]) == (0.2, "snow_caution", 2.0)
    assert evidence(spark, sensor=(0.2, 0.9, 0), worst=("dangerous",))["status"] == "not_recommended"
    assert evidence(spark, line=(2.0, 0.405))["score"] == 0.5


@pytest.mark.parametrize(("comfort", "register", "said"), [("relaxed", "thru_hiker", 0.0), ("sketchy", "first_timer", 1.25), ("terrifying", "thru_hiker", 3.0), ("cautious", None, 1.0), ("cautious", "experienced", 1.25), (None, "unknown", None)])
def test_comfort_by_experience(spark, comfort, register, said):
    row = spark.createDataFrame([(comfort, register)], "c string, r string").select(conditions.calibrated(F.col("c"), F.col("r")).alias("s")).first()
    assert row["s"] == said


def test_reports_average_what_they_say(spark):
    told = spark.createDataFrame([(1, D(2024, 6, 1), "deep", "crampons", None, None), (1, D(2024, 5, 27), "none", None, None, None), (1, D(2024, 5, 1), "deep", None, None, None), (1, D(2024, 6, 1), None, None, None, None)], "slug long, day date, snow string, traction string, comfort string, register string")
    got = conditions.reports(told, ["2024-06-01"]).first()
    assert got["n_reports"] == 2 and got["age"] == 0 and got["severity"] == round((2.625 * 1 + 0.0 * 0.5) / 1.5, 2) and abs(got["weight"] - 0.75) < 1e-12


def test_trend_is_of_the_weighted_mean(spark):
    linked = spark.createDataFrame(
        [(1, 10, D(2024, 6, 1), D(2024, 6, 1), 4.0, 0, D(2024, 5, 27), 6.0, 0.0, 0.0), (1, 11, D(2024, 6, 1), D(2024, 5, 31), 8.0, 1, D(2024, 5, 29), 9.0, 10.0, 0.0), (1, 12, D(2024, 6, 1), D(2024, 6, 1), 0.4, 0, D(2024, 6, 1), 0.4, 1.0, 301.0)],
        "slug long, station long, eval_date date, day date, value double, age int, first_day date, first_value double, km double, gap_ft double",
    )
    got = conditions.sensors(linked).first()
    swe = (4.0 / 3 + 8.0 * 0.5) / (1 / 3 + 0.5)  # no distance at all counts as 20 km
    assert got["swe"] == round(swe, 1) and got["trend"] == round((swe - 7.5) / 5, 2) and got["stations"] == [10, 11]


def test_line_from_quiet_and_blind_stations(spark):
    days = [(1, D(2024, 5, 1), 3.0)] + [(1, D(2024, 5, 2) + dt.timedelta(days=i), 0.0) for i in range(3)] + [(2, D(2024, 5, 20) + dt.timedelta(days=i), 0.0) for i in range(13)]
    daily = spark.createDataFrame(days, "station long, day date, value double")
    linked = spark.createDataFrame([(7, 1, 1000.0, 6000.0), (7, 2, 2000.0, 5000.0)], "slug long, station long, gap_ft double, station_ft double")
    got = conditions.snow_lines(linked, daily, ["2024-06-01"]).first()
    assert (got["station"], got["since"], got["observed"], got["hundreds"]) == (1, D(2024, 5, 2), True, 72) and got["severity"] == 0.5
    assert conditions.snow_lines(linked.filter("station = 2"), daily, ["2024-06-01"]).first()["hundreds"] == 55


def test_excerpt_ends_with_a_sentence(spark):
    text = "Mt. Hood Rd. closed. " + "Snow at 5 mi. from the gate and on. " * 3 + "Next sentence that runs on and on and on."
    row = spark.createDataFrame([(text, "short", "x" * 500)], "a string, b string, c string").select(rules.excerpt(F.col("a"), 60).alias("a"), rules.excerpt(F.col("b"), 60).alias("b"), rules.excerpt(F.col("c"), 60).alias("c")).first()
    assert row["a"] == "Mt. Hood Rd. closed. Snow at 5 mi. from the gate and on." and row["b"] == "short" and row["c"] == "x" * 500


def test_a_stuck_station_falls_silent_and_its_scenes_go(spark):
    day = D(2024, 7, 20)
    rows = [(1, D(2024, 7, 1) + dt.timedelta(days=i), 14.5, i) for i in range(20)] + [(2, D(2024, 7, 19), 3.0, 1), (2, D(2024, 7, 20), 2.0, 2), (2, D(2024, 7, 20), 9.0, 3), (3, D(2024, 7, 20), 260.0, 1), (3, D(2024, 7, 18), 1.5, 1)]
    judged = screen.judged_as_of(spark.createDataFrame(rows, "station long, day date, value double, ord long"), [str(day)])
    got = {r["station"]: r for r in conditions.newest(judged).collect()}
    assert set(got) == {2} and (got[2]["value"], got[2]["first_value"], got[2]["age"]) == (2.0, 3.0, 0)
    broken = {r["station"]: (r["reason"], r["since"], r["value"]) for r in conditions.faulty(judged).collect()}
    assert broken == {1: ("stuck", D(2024, 7, 1), 14.5), 3: ("ceiling", day, 260.0)}
    states = {(r["station"], r["day"].day): r["state"] for r in judged.collect()}
    assert states[1, 1] == "rejected" and states[3, 18] == "silent"
    scene = spark.createDataFrame([(7, D(2024, 7, 19), 0.9, True, 1), (7, D(2024, 7, 15), 0.4, False, None), (8, D(2024, 7, 18), 0.7, True, 3)], "slug long, day date, cover double, modeled boolean, from_station long")
    seen = {r["slug"]: r["cover"] for r in conditions.scenes(scene, [str(day)], judged.filter("state = 'rejected'").select("station", "eval_date", "day")).collect()}
    assert seen == {7: 0.4, 8: 0.7}


def test_silent_station_still_dates_its_melt_out(spark):
    rows = [(1, D(2024, 5, 1), 3.0, 1), (1, D(2024, 5, 2), 0.0, 1), (1, D(2024, 5, 3), 0.0, 1), (1, D(2024, 5, 20), 300.0, 1)]
    judged = screen.judged_as_of(spark.createDataFrame(rows, "station long, day date, value double, ord long"), ["2024-05-21"])
    linked = spark.createDataFrame([(7, 1, 1000.0, 6000.0)], "slug long, station long, gap_ft double, station_ft double")
    got = conditions.believed_lines(linked, judged).first()
    assert (got["since"], got["quiet_since"], got["observed"], got["hundreds"]) == (D(2024, 5, 2), D(2024, 5, 3), True, 68)


def facts_of(spark, **kinds):
    day = D(2024, 7, 20)

    def rows(kind, schema):
        given = kinds.get(kind)
        frame = spark.createDataFrame([(1, *r) for r in given] if given else [], "slug long, " + schema)
        return frame.withColumn("eval_date", F.lit(day))

    got = conditions.facts(
        spark.createDataFrame([(1,)], "key long"), [str(day)], rows("sensor", "swe double, trend double, age int"),
        rows("line", "station long, station_ft double, hundreds long, since date, observed boolean, quiet_since date, severity double"),
        rows("scene", "cover double, modeled boolean, age int"), rows("reports", "n_reports long, severity double"), rows("worst", "worst string"),
        rows("creek", "flow double, flow_trend string, active_melt boolean"), rows("blind", "blind int, min_gap_ft long, named string"),
        rows("faulty", "station long, station_ft double, value double, reason string, since date"),
    ).first()["facts"]
    return [(f["stream"], f["text"]) for f in got]


def test_facts_of_a_place_in_order(spark):
    got = facts_of(
        spark, sensor=[(4.0, -0.2, 1)], line=[(5, 6000.0, 70, D(2024, 6, 1), True, None, 0.5)], scene=[(0.345, True, 3)], reports=[(1, 1.3)], worst=[("knee_high",)], creek=[(120.5, "rising", True)],
        blind=[(1, 1200, "9 (6,000 ft)")], faulty=[(3, None, 260.04, "ceiling", D(2024, 7, 20)), (2, 7100.0, 14.5, "stuck", D(2024, 7, 1))],
    )
    assert [s for s, _ in got] == ["sensor", "satellite", "report", "report", "gauge", "sensor", "sensor", "sensor"]
    text = [t for _, t in got]
    assert text[0] == "Nearby snow sensors read 4.0 in of water in the snowpack, melting fast (1d old)."
    assert text[1].startswith("Modeled snow cover is 34% in the pass bowl") and "1 party reported" in text[2] and "continuous snow" in text[2] and text[3].endswith("knee high.")
    assert text[4] == "The nearest creek gauge reads 120 cfs and rising. Strong afternoon melt pulse: flow rises through the day."
    assert "sits at least 1,200 ft" in text[5] and text[6].startswith("2 (7,100 ft) has read 14.5 in since 2024-07-01") and text[7].startswith("3 reports 260.0 in")


def test_facts_without_snow_evidence(spark):
    assert facts_of(spark) == [("none", "No recent evidence for this pass in any stream.")]
    got = facts_of(spark, creek=[(80.0, None, False)])
    assert got == [("none", "No recent snow evidence for this pass."), ("gauge", "The nearest creek gauge reads 80 cfs.")]
    got = facts_of(spark, creek=[(80.0, None, False)], blind=[(2, 800, "a, b")])
    assert got[0][1].startswith("Snow sensors nearby have melted out, but a, b sit at least 800 ft") and got[1][0] == "gauge"
    got = facts_of(spark, line=[(5, 9000.0, 145, D(2024, 6, 1), False, D(2024, 5, 30), 0.0)], blind=[(2, 800, "a, b")])
    assert len(got) == 1 and "melted out by 2024-06-01 and stopped reporting" in got[0][1] and got[0][1].endswith("above the highest terrain: likely melted out, though no sensor sees it directly.")


def test_a_report_is_judged_without_its_party(spark):
    day = D(2024, 6, 10)
    rows = [
        (1, 5, day, "Ann", 3.0, "dangerous", 3), (2, 5, day, " ann ", 0.75, "thigh_high", 1), (3, 5, day, "Bob", 1.0, "low", 1), (4, 5, day, None, 2.0, None, 2), (5, 5, day, "", None, "knee_high", None),
        (6, 5, D(2024, 6, 5), "ann", 0.0, "dry", 0), (7, 5, D(2024, 5, 20), "Cy", 3.0, "dangerous", 3), (8, 6, day, "Ann", 1.0, None, 1), (9, 5, None, "Ann", 3.0, "dangerous", 3),
    ]
    posts = spark.createDataFrame(rows, "id long, slug long, day date, author string, said double, crossing string, observed int")
    got = {r["id"]: r for r in backtest.left_out(posts).collect()}
    assert set(got) == {1, 2, 3, 4, 6, 7, 8}
    assert (got[1]["n_reports"], got[1]["worst"], got[1]["reports_age"]) == (3, "knee_high", 0) and got[1]["reports_severity"] == round((1.0 + 2.0 + 0.0 * 0.5) / 2.5, 2)
    assert got[2]["reports_severity"] == got[1]["reports_severity"]  # one party
    assert (got[3]["n_reports"], got[3]["worst"]) == (4, "dangerous") and got[3]["reports_severity"] == round((3.0 + 0.75 + 2.0) / 3.5, 2)
    assert got[4]["n_reports"] == 4 and got[6]["n_reports"] is None and got[6]["worst"] is None and got[8]["n_reports"] is None and got[7]["n_reports"] is None
    empty = [got[8]["reports_severity"], got[8]["reports_weight"], got[8]["reports_age"]]
    assert empty == [None, None, None]
