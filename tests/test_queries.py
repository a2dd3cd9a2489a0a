"""Every query of the conditions engine against its SQL; those without SQL against a plain computation."""

import difflib
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pytest
from cairn.operators import names, screen
from cairn.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf, same_as_sql, name):
    same_as_sql(QUERIES[name](spark, sf), ORACLES[name])


def test_only_these_have_no_sql():
    assert set(QUERIES) - set(ORACLES) == {"screened_series", "screened_as_of", "alias_fuzzy", "html_items", "resolved_names", "thinned_rings", "trip_candidates", "season_records"}


def test_fuzzy_names(spark, sf):
    part = pd.read_parquet(f"{sf}/part.parquet")
    known = sorted(set(part["p_name"]))
    want = {}
    for key, name in zip(part["p_partkey"], part["p_name"]):
        typed = name[:4] + name[5:]
        best = difflib.get_close_matches(typed, known, 1, 0.78)
        if best:
            want[key] = best[0]
    assert {r["key"]: r["name"] for r in QUERIES["alias_fuzzy"](spark, sf).collect()} == want


def test_html_items_hold_all_visible_words(spark, sf):
    class Words(HTMLParser):
        def __init__(self):
            super().__init__()
            self.skip, self.seen = 0, []

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style")

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style")

        def handle_data(self, data):
            self.seen += [] if self.skip else data.split()

    pages = pd.read_parquet(f"{sf}/pages.parquet")
    got = QUERIES["html_items"](spark, sf).toPandas().sort_values(["key", "ord"])
    for key, html in zip(pages["page_id"], pages["html"]):
        reader = Words()
        reader.feed(html)
        assert " ".join(got[got["key"] == key]["text"]).split() == reader.seen
    assert {"heading", "line"} <= set(got["kind"])


def _fault(days, values, i):
    """By the definition: of all stretches that end at i the longest flat one, and what makes it a fault."""
    if values[i] > screen.CEILING:
        return i
    flat = [s for s in range(i + 1) if all(screen.FLAT_LEAST <= v <= screen.CEILING for v in values[s : i + 1]) and max(values[s : i + 1]) - min(values[s : i + 1]) <= screen.FLAT]
    return min(flat) if flat and sum("06-01" <= str(d)[5:10] <= "09-30" for d in days[min(flat) : i + 1]) >= screen.RUN else None


def _believed(days, values):
    """Places believed as of the newest: a set that holds i if no fault that counts covers it."""
    gone = set()
    for i in reversed(range(len(values))):
        if i not in gone and (start := _fault(days, values, i)) is not None:
            gone |= set(range(start, i + 1))
    return [i not in gone for i in range(len(values))]


def test_screen_of_whole_table(spark, sf):
    got = QUERIES["screened_series"](spark, sf).toPandas().sort_values(["station", "day"])
    for _, rows in got.groupby("station"):
        assert _believed(rows["day"].tolist(), rows["value"].tolist()) == rows["believed"].tolist()


def test_screen_of_flat_runs(spark):
    rng = np.random.default_rng(4)
    rows = []
    for station in range(30):
        value, day = 5.0, pd.Timestamp("2024-05-01")
        for _ in range(90):
            value = rng.choice([value, value, value, value + 0.1, value - 0.1, value - 0.4, 250.0 if station % 5 == 0 else value, 0.5]) if value < 201 else 5.0
            day += pd.Timedelta(days=int(rng.integers(1, 3)))
            rows.append((station, day.date(), float(value)))
    daily = spark.createDataFrame(rows, "station long, day date, value double")
    table = pd.DataFrame(rows, columns=["station", "day", "value"])
    got = screen.believed(daily).toPandas().sort_values(["station", "day"])
    assert not got["believed"].all()
    dates = ["2024-06-20", "2024-07-10", "2024-08-20"]
    seen = screen.believed_as_of(daily, dates).toPandas()
    for station, own in table.groupby("station"):
        days, values = own["day"].tolist(), own["value"].tolist()
        assert _believed(days, values) == got[got["station"] == station]["believed"].tolist()
        for when in map(lambda d: pd.Timestamp(d).date(), dates):
            upto = [d for d in days if d <= when]
            ok = _believed(upto, values[: len(upto)])
            mine = seen[(seen["station"] == station) & (seen["eval_date"] == when)]
            near = [d for d, o in zip(upto, ok) if o and (when - d).days <= 10] if ok[-1] else []
            assert sorted(mine["day"].dropna()) == near
            assert mine["faulty_since"].notna().sum() == (not ok[-1] and (when - upto[-1]).days <= 10)


def test_names_resolved_in_three_stages(spark):
    known = spark.createDataFrame([("a", "Elk Pass", 1), ("b", "Elk", 2), ("c", "Muir Pass", 3), ("d", "elk pass", 4)], "slug string, name string, ord int")
    asked = spark.createDataFrame([(1, "ELK pass!"), (2, "over Muir Pass by noon, then elk"), (3, "Muir Pas"), (4, "nothing"), (5, None), (6, "elk")], "key long, text string")
    assert {r["key"]: r["slug"] for r in names.resolve(asked, known).collect()} == {1: "a", 2: "c", 3: "c", 6: "b"}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["slug", "eval_date", "severity", "status", "conflicts", "score", "confidence"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
