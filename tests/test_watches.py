"""Watches: literal exports."""

import datetime as dt

import pytest
from cairn.operators import watches
from cairn.streaming import watch

D = dt.date
ONE, TWO = D(2026, 1, 4), D(2026, 1, 5)


def export(day, status="open", label="Open", fire=None, winter=None, slug=1):
    return (slug, "Muir Pass", day, status, label, fire, winter)


def blaze(day, miles, inside=False, name="Elk Fire", acres=1200, contained=10, direction="east"):
    return (day, name, acres, contained, miles, direction, inside)


def road(location, active, text, miles=1.0, named=False, code=None, name="SR 120"):
    return ("Caltrans", name, location, active, [(None, None, "first"), ("North", code, text)], miles, named)


@pytest.fixture
def told(spark):
    def run(*exports):
        frame = spark.createDataFrame(list(exports), watches.EXPORT)
        return {r["kind"]: r["reason"] for r in watches.fired(watches.paired(frame)).collect()}

    return run


def test_a_verdict_that_turns(told):
    got = told(export(ONE, "snow_caution", "Snow caution"), export(TWO))
    assert got == {k: "Muir Pass reads Open as of Jan 5; on Jan 4 it read Snow caution." for k in ("any_change", "snow_free")}
    assert told(export(ONE), export(TWO)) == {} and told(export(ONE), export(ONE, "x", "y")) == {}
    assert set(told(export(ONE), export(TWO, "snow_caution", "Snow caution"))) == {"any_change"}


def test_fires(told):
    fire = lambda a, b: told(export(ONE, fire=a), export(TWO, fire=b)).get("fire_nearby")
    assert fire(None, blaze(TWO, 12.4)) == "The Elk Fire, 1,200 acres, 10% contained, is 12 mi to the east of Muir Pass as mapped on Jan 5."
    assert fire(blaze(ONE, 9.5), blaze(TWO, 6.5)).endswith("is 6.5 mi to the east of Muir Pass as mapped on Jan 5; on Jan 4 its edge was 9.5 mi away.")
    assert fire(blaze(ONE, 9.4), blaze(TWO, 6.5)) is None and fire(blaze(ONE, 1.0), None) is None
    assert fire(blaze(ONE, 1.0), blaze(TWO, 0.0, True, acres=1, contained=None)) == "Muir Pass is inside the mapped perimeter of the Elk Fire, 1 acre, containment not reported, as mapped on Jan 5."
    assert fire(blaze(ONE, 0.0, True), blaze(TWO, 0.0, True)) is None
    assert "The Oak Fire" in fire(blaze(ONE, 3.0), blaze(TWO, 0.05, name="Oak Fire")) and "less than 0.1 mi" in fire(blaze(ONE, 3.0), blaze(TWO, 0.05, name="Oak Fire"))


def test_new_snow(told):
    stations = [("Low", None, 2.0, TWO, 0.5, None), ("High", 9000, 3.0, TWO, None, 4.0), ("Near", 8000, 1.0, TWO, 0.25, 4.0), ("None", 7000, 0.5, TWO, 0.0, 0.0)]
    got = told(export(ONE, winter=(ONE, ONE, stations, [])), export(TWO, winter=(TWO, TWO, stations, [])))
    assert got["new_snow"] == "Near (8,000 ft, 1 mi away) gained 0.25 in of snow water and 4 in of snow depth in the 24 hours to Jan 5."
    assert "new_snow" not in told(export(ONE, winter=(ONE, TWO, [], [])), export(TWO, winter=(TWO, TWO, stations, [])))
    assert "new_snow" in told(export(ONE), export(TWO, winter=(TWO, TWO, stations[:1], [])))


def test_roads(told):
    def roads(before, now):
        return told(export(ONE, winter=(ONE, None, [], before) if before is not None else None), export(TWO, winter=(TWO, None, [], now))).get("road_restriction")

    a, b = road("the gate", True, "Chains required.", code="R-1"), road("Town", True, "Ice.", miles=0.2)
    assert roads([], [b, road("the gate", True, "Chains required.", 5.0, True, "R-1")]) == 'Caltrans reports on SR 120 at the gate as of Jan 5: "R-1: Chains required."'
    assert roads([a], [a]) is None and roads(None, [a]).startswith("Caltrans reports on")
    assert roads([a], [road("THE GATE", True, "Chains off.", code="R-1")]) == 'Caltrans changed its report for SR 120 at THE GATE as of Jan 5: "R-1: Chains off."'
    assert roads([a, b], [b, road("the gate", False, "Open.")]) == "Caltrans no longer reports a restriction on SR 120 at the gate as of Jan 5."
    assert roads([], [road("x", False, "Open.")]) is None
    long = roads([], [road("x", True, "word " * 60, code="R-2", name=None)])
    assert long.startswith('Caltrans reports on x as of Jan 5: "R-2: word') and long.endswith('word..."') and len(long) < 210


def test_a_stream_told_twice_fires_once(spark):
    days = [D(2026, 1, 1) + dt.timedelta(days=i) for i in range(6)]
    rows = [export(d, "open" if i % 2 else "closed", "Open" if i % 2 else "Closed", slug=s) for s in (1, 2) for i, d in enumerate(days)]
    frame = spark.createDataFrame(rows + rows[:3], watches.EXPORT)
    want = sorted(map(tuple, watches.fired(watches.paired(frame)).collect()))
    assert sorted(map(tuple, watch.watched(frame, ["2026-01-02", "2026-01-03", "2026-01-06"]).collect())) == want and len(want) == 2 * 5 + 2 * 3
