"""Trip candidates against a plain search of one text at a time."""

import difflib
import math
import re

import pytest
from cairn.functions.rules import GENERIC, SUFFIXES
from cairn.operators import trips
from cairn.plans.gazetteer import _trip_inputs
from cairn.plans.inputs import Tables

RANK = {k: i for i, k in enumerate(trips.KINDS)}


def norm(text):
    return re.sub(" +", " ", re.sub("[^a-z0-9 ]", " ", text.lower())).strip()


def bare(text):
    return norm(re.sub("['’]", "", text))


def spans_of(text, key):
    found, at = [], f" {text} ".find(f" {key} ")
    while at != -1:
        found.append((at, at + len(key)))
        at = f" {text} ".find(f" {key} ", at + 1)
    return found


def within(a, b):
    return a[0] >= b[0] and a[1] <= b[1] and a[1] - a[0] < b[1] - b[0]


def place_key(name):
    key = bare(name)
    for suffix in SUFFIXES:
        if key.endswith(f" {suffix}"):
            key = key[: -len(suffix) - 1]
            break
    words = key.split()
    if not [w for w in words if w not in GENERIC] or (len(words) == 1 and len(words[0]) < 7):
        return None
    return key


def miles(a, p):
    dlat, dlon = math.radians(p.lat - a[0]), math.radians(p.lon - a[1])
    h = math.sin(dlat / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(p.lat)) * math.sin(dlon / 2) ** 2
    return 2 * 3958.8 * math.asin(math.sqrt(h))


def plain(text, here, passes, routes, places, limit=40):
    """(slug, kind, matched, at, miles) of one text, by going through everything."""
    q, found = norm(text or ""), []
    if not q:
        return []

    def keys(p, free):
        own = [norm(p.name), bare(p.name)]
        return own if free and p.tier == "osm" else [*own, norm(p.slug), *(k for a in p.aliases or [] for k in (norm(a), bare(a)))]

    index = {}
    for p in passes:
        for k in dict.fromkeys(keys(p, True)):
            if k:
                index.setdefault(k, []).append(p)
    whole = [p for p in passes if q in keys(p, False)]
    found += [(p, "name", q, 0) for p in whole]
    hits = [(k, s) for k in index for s in spans_of(q, k)]
    hits = [(k, s) for k, s in hits if not any(within(s, o) for _, o in hits)]
    found += [(p, "name", k, s[0]) for k, s in hits for p in index[k]]
    words, fuzzy = [m.span() for m in re.finditer("[a-z0-9]+", q)], []
    for i in range(len(words)):
        for n in range(1, min(4, len(words) - i) + 1):
            a, b = words[i][0], words[i + n - 1][1]
            window = q[a:b]
            if any(s[0] < b and a < s[1] for _, s in hits) or len(window) < 5 or all(w in GENERIC or w.isdigit() for w in window.split()):
                continue
            scores = [(difflib.SequenceMatcher(None, k, window).ratio(), k) for k in index if k[0] == window[0]]
            top = max((s for s, _ in scores), default=0)
            if top < 0.78:
                continue
            key = next(k for s, k in scores if s == top)
            if window.split()[-1] in GENERIC and window.split()[-1] != key.split()[-1]:
                continue
            fuzzy.append((key, (a, b), top))
    for key, (a, b), score in fuzzy:
        if not any(s[0] < b and a < s[1] and x > score for _, s, x in fuzzy):
            found += [(p, "fuzzy", q[a:b], a) for p in index[key]]
    for p in passes:
        for alias in (p.aliases or []) if p.tier == "featured" else []:
            every = norm(alias).split(" ")
            kept = [w for w in every if w not in ("the", "pass", "after", "on", "gap")]
            m = " ".join(kept)
            if len(every) >= 3 and 2 <= len(kept) < len(every) and f" {m} " in f" {norm(alias)} " and f" {m} " in f" {q} ":
                found.append((p, "mention", m, f" {q} ".index(f" {m} ")))
    by_slug = {p.slug: p for p in passes}
    for r in routes:
        at = [f" {q} ".find(f" {n} ") for n in map(norm, [r.route, *(r.aliases or [])]) if len(n) >= 3]
        at = min((x for x in at if x != -1), default=None)
        if at is not None:
            found += [(by_slug[s], "route", r.route, at + i / 1000) for i, s in enumerate(s for s in r.passes if s in by_slug)]
    away = (lambda p: miles(here, p)) if here[0] is not None else (lambda p: 0)
    pq, told = bare(text), [*([q] if whole else []), *(k for k, _ in hits)]
    met = []
    for pl in places:
        key = place_key(pl.place)
        if key and not any(f" {key} " in f" {n} " for n in told) and f" {key} " in f" {pq} ":
            met.append((pl, key, f" {pq} ".index(f" {key} ")))
    best = {}
    for pl, key, at in met:
        if any(within((at, at + len(key)), (x, x + len(k))) for _, k, x in met):
            continue
        near = [(by_slug[n.slug], n.distance_mi) for n in pl.passes if n.slug in by_slug]
        near.sort(key=lambda x: (x[0].tier != "featured", x[1], x[0].ord))
        for p, mi in near[: 3 if sum(k == key for _, k, _ in met) > 2 else 5]:
            one = (pl.kind != "trailhead", mi, at, pl.place, key)
            best[p.slug] = min(best.get(p.slug, one), one)
    ranked = sorted(best.items(), key=lambda x: (x[1][2], away(by_slug[x[0]]), by_slug[x[0]].tier != "featured", x[1][1], by_slug[x[0]].ord))
    found += [(by_slug[s], "place", b[4], i) for i, (s, b) in enumerate(ranked)]
    first = {}
    for p, kind, matched, at in found:
        one = (RANK[kind], at, matched)
        first[p.slug] = min(first.get(p.slug, one), one)
    order = sorted(first, key=lambda s: (*first[s][:2], away(by_slug[s]), by_slug[s].tier != "featured", by_slug[s].ord))[:limit]
    return [(s, trips.KINDS[first[s][0]], first[s][2], round(first[s][1], 6), math.floor(away(by_slug[s]) / 10 + 0.5) * 10 if here[0] is not None else None) for s in order]


def same(frames, limit=40):
    asked, passes, routes, places = ([*f.collect()] for f in frames)
    passes.sort(key=lambda p: p.ord)
    got = {}
    for r in sorted(trips.candidates(*frames, limit=limit).collect(), key=lambda r: (r["trip"], r["rank"])):
        got.setdefault(r["trip"], []).append((r["slug"], r["kind"], r["matched"], round(r["at"], 6), r["from_you_mi"]))
    want = {t.trip: plain(t.text, (t.lat, t.lon), passes, routes, places, limit) for t in asked}
    assert got == {k: v for k, v in want.items() if v}
    return want


def test_literal_trips(spark):
    passes = spark.createDataFrame(
        [
            ("muir-pass", "Muir Pass", "featured", ["Muir Hut", "the pass after evolution lake"], 37.1, -118.6, 1), ("army", "Army Pass", "osm", None, 36.5, -118.2, 2), ("new-army", "New Army Pass", "featured", [], 36.4, -118.2, 3),
            ("devils", "Devil's Gate Pass", "osm", None, 38.3, -119.3, 4), ("glacier", "Glacier Pass", "featured", ["glacier"], 36.4, -118.5, 5), ("white1", "White Pass", "osm", None, 46.6, -121.4, 6), ("white2", "White Pass", "osm", None, 36.5, -118.5, 7),
        ],
        "slug string, name string, tier string, aliases array<string>, lat double, lon double, ord long",
    )
    asked = spark.createDataFrame(
        [
            (1, "Over New Army pass, then muir pas", None, None), (2, "muir", None, None), (3, "devils gate pass or Devil's Gate", 38.0, -119.0), (4, "camp past Evolution Lake", None, None), (5, "glacier peak", None, None), (6, "white pass", 36.0, -118.0),
            (7, "the Rae Loop by army pass", None, None), (8, "Snow Lake and Upper Snow Lake, White Pass Camp", 46.0, -121.0), (9, " !! ", None, None), (10, None, None, None), (11, "new-army", None, None), (12, "stuart lake to snow lake", None, None),
        ],
        "trip long, text string, lat double, lon double",
    )
    routes = spark.createDataFrame([("Rae Loop", ["rl", "rae"], ["army", "gone", "muir-pass"])], "route string, aliases array<string>, passes array<string>")
    near = [("army", 2.0), ("muir-pass", 3.0), ("white1", 1.0), ("white2", 9.0), ("glacier", 2.5), ("new-army", 8.0), ("devils", 0.1)]
    places = spark.createDataFrame(
        [("Snow Lake Trailhead", "trailhead", near), ("Snow Lake Campground", "campground", near[:2]), ("Upper Snow Lake", "campground", near[2:]), ("White Pass Camp", "campground", near), ("Stuart Lake Trailhead", "trailhead", near[3:]), ("Lake", "campground", near), ("Snow Lake Horse Camp", "campground", near)],
        "place string, kind string, passes array<struct<slug:string,distance_mi:double>>",
    )
    want = same((asked, passes, routes, places))
    assert want[1][0][:2] == ("new-army", "name") and ("muir-pass", "fuzzy", "muir pas") == want[1][1][:3] and "army" not in {c[0] for c in want[1]}
    assert want[4][0][1] == "mention" and {c[0]: c[1] for c in want[7]} == {"army": "name", "muir-pass": "route"} and [c[0] for c in want[6]] == ["white2", "white1"]
    assert "glacier" in {c[0] for c in want[5]} and {c[1] for c in want[12]} == {"place"} and want[11] == [("new-army", "name", "new army", 0, None)]
    assert same((asked, passes, routes, places), limit=2)[8]


@pytest.mark.parametrize("free", [True])
def test_trips_of_the_tables(spark, sf, free):
    want = same(_trip_inputs(Tables(spark, sf)))
    assert {k for rows in want.values() for _, k, *_ in rows} == set(trips.KINDS) - {"mention"} and max(map(len, want.values())) > 6


def test_drafts(spark):
    allowed = spark.createDataFrame([(1, f"p{i}") for i in range(30)] + [(2, "a")], "trip long, slug string")
    many = "[" + ",".join(f'"p{i}"' for i in range(25)) + "]"
    rows = [
        (1, "Via Rae lakes", f'{{"passes":{many},"start_date":"2024-03-05","end_date":"2024-03-01","party_size":99,"activity":"hiking","unplaced":["rae lakes"," rae   lakes ","lakes via"]}}'),
        (2, None, '{"passes":["a","a",null,{"x":1},"b"],"start_date":"2024-02-30","end_date":"2024-03-09","party_size":0,"unplaced":"rae"}'), (3, "x", "no json"), (4, "x", '{"passes":{"a":1},"party_size":true,"start_date":"2021-01-01"}'), (5, "x", None),
    ]
    got = {r["trip"]: r for r in trips.understood(spark.createDataFrame(rows, "trip long, text string, body string"), allowed, "2024-02-01").collect()}
    assert got[1]["passes"] == [f"p{i}" for i in range(20)] and (str(got[1]["start"]), str(got[1]["end"])) == ("2024-03-01", "2024-03-05")
    assert (got[1]["party_size"], got[1]["activity"], got[1]["unplaced"]) == (99, "hiking", ["rae lakes"])
    assert got[2]["passes"] == ["a"] and got[2]["rejected"] == ["b"] and str(got[2]["start"]) == str(got[2]["end"]) == "2024-03-09" and got[2]["party_size"] is None and got[2]["unplaced"] == []
    for k in (3, 4, 5):
        assert got[k]["passes"] == [] and got[k]["start"] is None and got[k]["party_size"] is None and got[k]["activity"] is None
