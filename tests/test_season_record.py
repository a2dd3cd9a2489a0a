"""Literal cases of the season record: what each season comes to, and the sentences of a place."""

from datetime import date, timedelta

import pytest
from cairn.operators import season_record as R

LATE = {2023: "07-10", 2024: "06-01", 2025: "06-05", 2026: "06-24"}
SOON = {2023: "07-01", 2024: "05-20", 2025: "05-28", 2026: "06-09"}
THREE = "the three earlier seasons on file (2023 to 2025)"
LINKED = "slug string, station string, name string, network string, lat double, lon double, elevation_ft double, distance_km double, place_ft double"


def melting(year, melt, peak=30.0, until="08-31", start="04-01"):
    """Daily readings that fall evenly to nothing on the day ``melt``; "bare" lies at nothing throughout, None never falls."""
    first = date.fromisoformat(f"{year}-{start}")
    stop = (date.fromisoformat(f"{year}-{until}") - first).days
    gone = 0 if melt == "bare" else None if melt is None else (date.fromisoformat(f"{year}-{melt}") - first).days
    for i in range(stop + 1):
        value = peak if gone is None else 0.0 if i >= gone else max(0.6, peak * (gone - i) / gone)
        yield first + timedelta(days=i), round(value, 2)


class Places:
    """Places, their stations and all readings, as the operator takes them."""

    def __init__(self):
        self.links, self.rows = [], []

    def add(self, slug, name, feet, melts, km=5.0, peaks=None, ends=None, network="a", at=None, place=9000.0, change=None):
        station = f"{slug}/{name}"
        lat, lon = at or (37.0 + km / 10, -119.0 - (feet or 0) / 1e4)
        self.links.append((slug, station, name, network, lat, lon, None if feet is None else float(feet), km, place))
        for year, melt in melts.items():
            until = (ends or {}).get(year, "09-28" if year == 2026 else "08-31")
            series = melting(year, melt, (peaks or {}).get(year, 30.0), until)
            self.rows += [(station, day, change(day, value) if change else value) for day, value in series]
        return self

    def frames(self, spark):
        return spark.createDataFrame(self.links, LINKED), spark.createDataFrame(self.rows, "station string, day date, value double")

    def told(self, spark, today, **more):
        return {r["slug"]: r for r in R.records(*self.frames(spark), today, **more).collect()}


def text(row, kind):
    return next((f["text"] for f in row["facts"] if f["kind"] == kind), None)


@pytest.fixture(scope="module")
def autumn(spark):
    p = Places()
    p.add("one", "Alder Flat", 8600, LATE)
    p.add("two", "Alder Flat", 8600, LATE).add("two", "Birch Camp", 8100, SOON, km=9.0)
    p.add("three", "Alder Flat", 8600, LATE).add("three", "Birch Camp", 8100, SOON, km=9.0).add("three", "Cedar Bench", 7900, SOON, km=14.0)
    p.add("apart", "Alder Flat", 8600, LATE).add("apart", "Birch Camp", 8100, {**SOON, 2026: "05-18"}, km=9.0)
    p.add("edge", "Alder Flat", 8600, LATE).add("edge", "Birch Camp", 8100, {**SOON, 2026: "05-26"}, km=9.0)
    p.add("few", "Alder Flat", 8600, {2025: "06-05", 2026: "06-24"})
    p.add("midpoint", "Alder Flat", 8600, {y: LATE[y] for y in (2024, 2025, 2026)})
    p.add("cut", "Alder Flat", 8600, LATE, ends={2023: "06-01"})
    p.add("open", "Alder Flat", 8600, {2023: "06-01", 2024: "bare", 2025: "05-10", 2026: "05-20"})
    p.add("outside", "Alder Flat", 8600, {2023: "06-01", 2024: "bare", 2025: "bare", 2026: "05-20"})
    p.add("bound", "Alder Flat", 6500, {2023: "05-20", 2024: "05-06", 2025: "04-28", 2026: "bare"})
    p.add("lowest", "Alder Flat", 8600, {**LATE, 2026: "04-25"}, peaks={2023: 77.5, 2024: 40.3, 2025: 33.9, 2026: 4.0})
    a, b = {2023: 70.0, 2024: 40.0, 2025: 30.0}, {2023: 60.0, 2024: 20.0, 2025: 35.0}
    p.add("ranks", "Alder Flat", 8600, LATE, peaks={**a, 2026: 50.0}).add("ranks", "Birch Camp", 8100, SOON, km=9.0, peaks={**b, 2026: 25.0})
    p.add("equal", "Alder Flat", 8600, LATE, peaks={**a, 2026: 80.0}).add("equal", "Birch Camp", 8100, SOON, km=9.0, peaks={**b, 2026: 65.0})
    p.add("above", "Alder Flat", 10000, LATE)
    p.add("far", "Alder Flat", 6400, LATE)
    p.add("autumn", "Alder Flat", 6600, {2023: "08-20", 2024: "07-20", 2025: "07-25", 2026: "08-10"})
    p.add("clash", "Alder Flat", 8800, LATE).add("clash", "Birch Camp", 8900, {2023: "06-01", 2024: "05-01", 2025: "05-05", 2026: "04-20"}, km=9.0)
    p.add("site", "Css Lab", 6890, LATE, km=4.1, at=(39.3257, -120.3679))
    p.add("site", "Snow Lab", 6900, LATE, km=4.0, at=(39.3250, -120.3680), ends={2023: "05-01", 2025: "05-01"}, network="b")
    p.add("kin", "Alpha", 7600, LATE, km=6.0, at=(38.8, -120.2)).add("kin", "Ridge", 7600, SOON, km=6.0, at=(38.8, -120.2))
    p.add("middle", "Alder Flat", 8600, {**LATE, 2026: "06-05"})
    p.add("upto", "Alder Flat", 8600, {**LATE, 2026: "06-05"}).add("upto", "Birch Camp", 8100, SOON, km=9.0)
    p.add("stuck", "Alder Flat", 8600, LATE, change=lambda d, v: 1.6 if date(2024, 6, 1) <= d <= date(2024, 8, 19) else v)
    p.add("wild", "Alder Flat", 8600, LATE, change=lambda d, v: (67.55 if d < date(2023, 7, 10) else 0.0) if d.year == 2023 else v)
    p.add("never", "Alder Flat", 2930, {2023: "05-06", 2024: "bare", 2025: "bare", 2026: "04-20"})
    p.add("agency", "Horse Meadow (Nrcs)", 8557, LATE)
    p.add("nofeet", "Alder Flat", None, LATE)
    return p.told(spark, "2026-09-29")


MELTS = {
    "one": f"Snow left Alder Flat (8,600 ft) 19 days later this year than the median of {THREE}.",
    "two": f"Snow left Alder Flat (8,600 ft) and Birch Camp (8,100 ft) 12 to 19 days later this year than the median of {THREE}.",
    "three": f"Snow left 3 nearby stations 12 to 19 days later this year than the median of {THREE}.",
    "apart": f"The nearby stations disagree about this year: snow left Alder Flat (8,600 ft) 19 days later and Birch Camp (8,100 ft) 10 days earlier than the median of {THREE}.",
    "edge": f"Snow left Alder Flat (8,600 ft) and Birch Camp (8,100 ft) between 2 days earlier and 19 days later this year than the median of {THREE}.",
    "midpoint": "Snow left Alder Flat (8,600 ft) 21 days later this year than the midpoint of the two earlier seasons on file (2024 and 2025).",
    "cut": "Snow left Alder Flat (8,600 ft) 21 days later this year than the midpoint of two of the three earlier seasons on file (2024 and 2025).",
    "bound": f"Snow had already left Alder Flat (6,500 ft) when this year's record begins on April 1, at least 36 days earlier than the median of {THREE}.",
    "middle": f"Snow left Alder Flat (8,600 ft) this year on the same day as the median of {THREE}.",
    "upto": f"Snow left Alder Flat (8,600 ft) and Birch Camp (8,100 ft) up to 12 days later this year than the median of {THREE}.",
    "agency": f"Snow left Horse Meadow (8,557 ft) 19 days later this year than the median of {THREE}.",
    "nofeet": f"Snow left Alder Flat 19 days later this year than the median of {THREE}.",
    "outside": None,
}
HIGHEST = "highest snow water on or after April 1"
FOUR = "the four seasons on file (2023 to 2026)"
PEAKS = {
    "lowest": f"At Alder Flat (8,600 ft), this year's {HIGHEST} was 4.0 in, the lowest of {FOUR}.",
    "ranks": f"This year's {HIGHEST} was the second highest of {FOUR} at Alder Flat (8,600 ft) and the third highest at Birch Camp (8,100 ft).",
    "equal": f"This year's {HIGHEST} was the highest of {FOUR} at Alder Flat (8,600 ft) and Birch Camp (8,100 ft).",
    "stuck": f"At Alder Flat (8,600 ft), this year's {HIGHEST} was 30.0 in, the highest of three of {FOUR.replace('2023 to 2026', '2023, 2025 and 2026')}.",
}
WINDOWS = {
    "one": ("melted", "2026-06-07", "2026-07-25"),
    "above": ("melted", "2026-05-09", "2026-07-05"),
    "two": ("melted", "2026-06-02", "2026-07-24"),
    "far": None,
    "autumn": None,
    "clash": None,
    "nofeet": None,
}


@pytest.mark.parametrize("slug", MELTS)
def test_when_snow_left(autumn, slug):
    assert (text(autumn[slug], "melt_out") if slug in autumn else None) == MELTS[slug]


@pytest.mark.parametrize("slug", PEAKS)
def test_how_peaks_rank(autumn, slug):
    assert text(autumn[slug], "peak") == PEAKS[slug]


@pytest.mark.parametrize("slug", WINDOWS)
def test_windows_of_the_place(autumn, slug):
    w = autumn[slug]["pass_window"]
    assert (w and (w["state"], str(w["from"]), str(w["through"]))) == WINDOWS[slug]


def test_places_without_facts_have_no_row(autumn):
    assert not {"few", "never"} & set(autumn)


def test_summaries_and_evidence(autumn):
    one, apart, opened = autumn["one"], autumn["apart"], autumn["open"]
    fact = one["facts"][0]
    assert (fact["kind"], fact["estimate"], fact["disagree"]) == ("melt_out", False, False)
    assert fact["evidence"][0]["detail"] == "left June 24; earlier seasons: July 10 (2023), June 1 (2024), June 5 (2025)"
    assert (one["stations"][0]["days"], one["stations"][0]["median_day"], one["year"]) == (19, 65, 2026)
    assert (apart["melt_out"]["agree"], apart["melt_out"]["spread_days"], apart["facts"][0]["disagree"]) == (False, 29, True)
    assert autumn["edge"]["melt_out"]["agree"]
    assert (opened["stations"][0]["median_day"], opened["stations"][0]["days"]) == (39, 10)
    assert "2023: stopped reporting before melt-out" in autumn["cut"]["facts"][0]["evidence"][0]["detail"]
    assert [e["name"] for e in autumn["three"]["facts"][0]["evidence"]] == ["Alder Flat", "Birch Camp", "Cedar Bench"]
    assert text(one, "pass_window") == "An estimate: snow left the pass itself between June 7 and July 25, carried from the melt-out date at Alder Flat (8,600 ft) to the pass elevation."
    assert "400 ft below the pass" in one["facts"][-1]["evidence"][0]["detail"] and one["facts"][-1]["estimate"]
    assert "1,000 ft above the pass" in autumn["above"]["facts"][-1]["evidence"][0]["detail"]
    assert text(autumn["clash"], "pass_window").startswith("The nearby stations disagree about when snow left the pass itself, so no window is given: Alder Flat (8,800 ft) points to ")
    assert text(autumn["far"], "pass_window") is None


def test_sites_and_charts(autumn):
    assert [s["name"] for s in autumn["site"]["stations"]] == ["Css Lab"]
    assert len(autumn["kin"]["stations"]) == 2
    assert [y["year"] for y in autumn["wild"]["chart"]["seasons"]] == [2024, 2025, 2026]
    chart = autumn["open"]["chart"]
    assert [(y["year"], y["note"]) for y in chart["seasons"]] == [(2023, "Jun 1"), (2024, "before Apr 1"), (2025, "May 10"), (2026, "May 20")]
    assert (chart["name"], chart["most"], chart["seasons"][0]["peak"]) == ("Alder Flat", 150.0, 30.0)


def test_seasons_under_way(spark):
    def at(today, *stations):
        p = Places()
        for s in stations:
            p.add("x", *s[:3], **(s[3] if len(s) > 3 else {}))
        return p.told(spark, today)["x"]

    held = ("Alder Flat", 8600, {**LATE, 2026: None})
    june = at("2026-06-15", held)
    assert text(june, "still_snow") == f"Snow was still on the ground at Alder Flat (8,600 ft) on June 15, 10 days past the median melt-out date of {THREE}."
    assert "30.0 in of snow water on June 15" in june["facts"][0]["evidence"][0]["detail"]
    assert june["pass_window"] is None and june["melt_out"] is None
    may = at("2026-05-20", held)
    assert text(may, "still_snow") == f"Snow was still on the ground at Alder Flat (8,600 ft) on May 20. The median melt-out date of {THREE} there is June 5."
    july = at("2026-07-01", ("Alder Flat", 8600, LATE))
    assert text(july, "pass_window").startswith("An estimate: snow leaves the pass itself between June 7 and July 25") and text(july, "pass_window").endswith(" Today falls inside that window.")
    low = {2023: "06-10", 2024: "05-20", 2025: "05-22", 2026: "05-10"}
    both = at("2026-06-20", ("Alder Flat", 7600, low), ("Birch Camp", 8800, {**LATE, 2026: None}, {"km": 9.0}))
    w = both["pass_window"]
    assert (w["state"], str(w["from"]), str(w["through"])) == ("underway", "2026-06-20", "2026-07-05")
    winter = at("2027-01-14", ("Alder Flat", 8600, LATE))
    assert text(winter, "melt_out") == f"Snow left Alder Flat (8,600 ft) 19 days later in 2026 than the median of {THREE}."
    assert text(winter, "peak").startswith(f"At Alder Flat (8,600 ft), the {HIGHEST} in 2026 was 30.0 in")
    assert "this year" not in str(winter["facts"]) and "in 2026" in text(winter, "pass_window")


def test_what_a_season_comes_to(spark):
    cases = {
        "even": (list(melting(2024, "06-10")), ("melted", None, "2024-06-10")),
        "blip": ([(d, 1.2 if d == date(2024, 6, 25) else v) for d, v in melting(2024, "06-10")], ("melted", None, "2024-06-10")),
        "back": ([(d, 1.2 if d == date(2024, 6, 13) else v) for d, v in melting(2024, "06-10")], ("melted", None, "2024-06-14")),
        "bare": (list(melting(2024, "bare")), ("bare_at_start", None, None)),
        "quiet": (list(melting(2024, "06-10", until="06-01")), ("unusable", "quiet", None)),
        "silent": (list(melting(2024, "06-10", until="06-12")), ("melted", None, "2024-06-10")),
        "hole": ([(d, v) for d, v in melting(2024, "06-10") if not date(2024, 5, 1) <= d <= date(2024, 6, 20)], ("unusable", "gap", None)),
        "offset": ([(d, max(v, 1.4)) for d, v in melting(2024, "06-10")], ("unusable", "residual", None)),
        "jump": ([(d, v + 60 if d > date(2024, 5, 1) else v) for d, v in melting(2024, "06-10")], ("unusable", "erratic", None)),
        "stray": ([(d, 90.0 if d == date(2024, 5, 3) else v) for d, v in melting(2024, "06-10")], ("melted", None, "2024-06-10")),
        "held": (list(melting(2024, None)), ("unusable", "stuck", None)),
        "drift": ([(d, v if v >= 3 else 0.3 + 0.4 * (d.day % 2)) for d, v in melting(2024, "06-10")], ("unusable", "wandering", None)),
        "sentinel": ([(d, 32767.0 if d.day == 3 else v) for d, v in melting(2024, "06-10")], ("melted", None, "2024-06-10")),
    }
    daily = spark.createDataFrame([(k, d, v) for k, (rows, _) in cases.items() for d, v in rows], "station string, day date, value double")
    got = {r["station"]: (r["status"], r["reason"], r["melt_out"] and str(r["melt_out"])) for r in R.station_seasons(daily, "2026-09-29").collect()}
    assert got == {k: want for k, (_, want) in cases.items()}
    fresh = spark.createDataFrame([("x", d, v) for d, v in melting(2026, "06-10", until="06-13")], "station string, day date, value double")
    assert R.station_seasons(fresh, "2026-06-13").first()["reason"] == "unconfirmed"


def test_no_rows(spark):
    linked, daily = Places().add("x", "Alder Flat", 8600, LATE).frames(spark)
    assert R.records(linked, daily.limit(0), "2026-09-29").count() == 0
    assert R.records(linked.limit(0), daily, "2026-09-29").count() == 0


def test_records_of_whole_tables(spark, sf):
    """Which places have a record, and what it compares, from the seasons of their stations."""
    from cairn.plans import registry

    queries, folder = registry.queries(), sf.replace("sf0.001", "sf0.01")
    seasons = {}
    for r in queries["station_seasons"](spark, folder).collect():
        seasons.setdefault(r["station"], {})[r["year"]] = r
    stations = {}
    for r in queries["links_nearest_k"](spark, folder).collect():
        stations.setdefault(r["lkey"], []).append((r["km"], r["rkey"]))
    want = {}
    for slug, near in stations.items():
        exact, other, ranked = {}, 0, 0
        for km, station in sorted(near):
            own = seasons.get(station, {})
            now, usable = own.get(1998), {y: s for y, s in own.items() if y < 1998 and s["status"] != "unusable"}
            ends = {"snow": float("inf"), "bare_at_start": float("-inf")}
            days = sorted(ends.get(s["status"]) or (s["melt_out"] - date(y, 4, 1)).days for y, s in usable.items())
            ranked += now is not None and now["peak"] is not None and sum(s["peak"] is not None for s in own.values()) > 2
            if now is None or now["status"] == "unusable" or len(days) < 2:
                continue
            low, high = days[(len(days) - 1) // 2], days[len(days) // 2]
            if abs(low) == float("inf") or abs(high) == float("inf"):
                continue
            if now["status"] == "melted":
                off = (now["melt_out"] - date(1998, 4, 1)).days - (low + high) / 2
                exact.setdefault(tuple(sorted(usable)), []).append((km, int(abs(off) + 0.5) * (1 if off >= 0 else -1)))
            else:
                other += 1
        if exact:
            best = max(exact, key=lambda k: (len(k), len(exact[k]), -exact[k][0][0]))
            shifts = [d for _, d in exact[best]]
            want[slug] = (min(shifts), max(shifts))
        elif other or ranked:
            want[slug] = None
    got = {r["slug"]: (r["min_days"], r["max_days"]) if r["kind"] == "exact" else None for r in queries["season_records"](spark, folder).collect()}
    assert got == want and any(got.values()) and not all(got.values())
