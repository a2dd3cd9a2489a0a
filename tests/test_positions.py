"""Searches by position meet positions, not rows, and find what comparing all pairs finds."""

import pytest
from cairn.operators import gazetteer, links
from cairn.plans import registry
from pyspark.sql import functions as F

COPIES = 40


@pytest.fixture
def met(monkeypatch):
    """Rows that were handed to ``links.within``, a pair of counts for each call."""
    seen, plain = [], links.within

    def within(left, right, *more):
        seen.append((left.count(), right.count()))
        return plain(left, right, *more)

    monkeypatch.setattr(links, "within", within)
    return seen


def _rows(spark, spots, n, *more):
    """``n`` rows dealt over so many positions a hundredth of a degree apart; each of ``more`` is (name, column)."""
    return spark.range(n).select(F.col("id").alias("key"), (40 + F.col("id") % spots / 100.0).alias("lat"), F.lit(-120.0).alias("lon"), *(c.alias(name) for name, c in more))


def test_starts_of_one_position(spark, met):
    starts = _rows(spark, 3, 30 * COPIES, ("name", F.lit("a")))
    places = _rows(spark, 5, 50 * COPIES, ("featured", F.col("id") % 7 == 0))
    got = gazetteer.inverted(starts, places, 3, 6).collect()
    assert met == [(3, got_right := met[0][1])] and got_right <= 5 * 10
    pairs = links.within(starts.filter("key < 3"), places, 3).collect()
    for key in range(3):
        order = sorted((p["km"], p["rkey"], p["featured"]) for p in pairs if p["lkey"] == key)
        kept = sorted(set(order[:6]) | set([p for p in order if p[2]][:4]))
        want = [(p[1], i + 1) for i, p in enumerate(kept)]
        for same in range(key, 30 * COPIES, 3 * COPIES):
            assert sorted(((r["place"], r["rank"]) for r in got if r["start"] == same), key=lambda r: r[1]) == want


def test_nodes_of_one_position(spark, met):
    name = F.concat(F.lit("N"), (F.col("id") % 2).cast("string"))
    featured = _rows(spark, 5, 10 * COPIES, ("name", name)).filter("key % 10 < 5").withColumn("lat", F.col("lat") + 0.05)
    nodes = _rows(spark, 7, 14 * COPIES, ("name", F.lower(name)), ("elevation_ft", F.lit(1))).withColumn("key", F.col("key") + 1000)
    nearest = {r["key"]: (r["node"], r["km"]) for r in gazetteer.namesakes(featured, nodes, 4).collect()}
    assert met[0][1] == 14
    left = {r["key"] for r in gazetteer.merged(featured, nodes, 1.5, 4).collect()}
    assert all(max(m) <= 400 for m in met) and met[1] == (7, 5) and met[2] == (14, 5)
    ours, theirs = featured.collect(), nodes.collect()
    km = {(p["lkey"], p["rkey"]): p["km"] for p in links.within(featured, nodes, 4).collect()}
    for f in ours:
        own = [(km[f["key"], n["key"]], n["key"]) for n in theirs if (f["key"], n["key"]) in km and n["name"] == f["name"].lower()]
        assert nearest[f["key"]] == ((min(own)[1], min(own)[0]) if own else (None, None))
    gone = {n["key"] for n in theirs for f in ours if (d := km.get((f["key"], n["key"]))) is not None and (d < 1.5 or d < 4 and n["name"] == f["name"].lower())}
    assert left == {n["key"] for n in theirs} - gone and gone and left


def test_roads_of_one_position(spark, met):
    places = _rows(spark, 3, 30 * COPIES, ("name", F.concat(F.lit("Elk Pass "), (F.col("id") % 200).cast("string"))))
    roads = _rows(spark, 20, 20 * COPIES, ("active", F.col("id") % 3 > 0), ("location", F.concat(F.lit("near elk  pass elk pass "), (F.col("id") % 100).cast("string"), F.lit(" grade"))))
    got = links.road_links(places, roads, 2, 15)
    assert met[0] == (3, 80)
    pairs = links.within(places, roads, 15).collect()
    names = {r["key"]: r["name"].lower() for r in places.collect()}
    said = {r["key"]: r["location"] for r in roads.collect()}
    want, by = set(), {}
    for p in pairs:
        named = f" {names[p['lkey']]} " in f" {said[p['rkey']]} "
        if named or p["km"] <= 2:
            by.setdefault(p["lkey"], []).append((not p["active"], not named, p["km"], p["rkey"]))
    for key, rows in by.items():
        want |= {(key, r, km, not unnamed, not idle, i + 1) for i, (idle, unnamed, km, r) in enumerate(sorted(rows)[:4])}
    assert {tuple(r) for r in got.collect()} == want


def test_five_nearest_of_stations_at_one_position(spark, met, tmp_path):
    spark.range(1, 401).select((F.col("id") * 17000 + F.col("id") % 4 * 3).alias("s_suppkey"), F.lit("x").alias("s_name")).write.parquet(f"{tmp_path}/supplier.parquet")
    got = registry.queries()["nearest_five"](spark, str(tmp_path)).collect()
    assert met and max(met[0]) <= 4 * 6 and len(got) == 2000
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    assert {tuple(r) for r in got} == set(con.execute(f"SELECT key, other, rank FROM ({registry.oracle_sql()['nearest_five']}) x").fetchall())


def test_backtest_screens_stations_of_asked_places(spark, sf, monkeypatch):
    from cairn.operators import screen
    from cairn.plans import verdicts
    from cairn.plans.inputs import Tables

    class Few(Tables):
        def __getattr__(self, name):
            table = super().__getattr__(name)
            return table.filter("slug < 4") if name == "posts" else table

    seen, plain = [], screen.judged_as_of
    monkeypatch.setattr(verdicts.screen, "judged_as_of", lambda daily, *more: seen.append(daily.select("station").distinct().count()) or plain(daily, *more))
    few = {tuple(r) for r in verdicts._without(Few(spark, sf)).collect()}
    assert few and few == {tuple(r) for r in verdicts._without(Tables(spark, sf)).filter("slug < 4").collect()}
    assert seen[0] < seen[1] <= Tables(spark, sf).snowpack.select("station").distinct().count()
