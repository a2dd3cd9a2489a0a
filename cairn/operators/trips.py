"""Passes that a typed trip may mean: five streams of matches for many trips at once, the best per pass, the first forty per trip.

Trips are (trip, text, lat, lon), the position null if unknown; passes (slug, name, tier, aliases, lat, lon, ord); routes
(route, aliases, passes); places (place, kind, passes), where passes is an array of (slug, distance_mi).
A match is (trip, slug, kind, matched, at): ``at`` is where in the text it stands.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.rules import GENERIC
from ..functions.text import normal
from . import names

#: Kinds in order of trust, candidates of a trip, passes that a place speaks for, fewer if several share its name.
KINDS = ("name", "fuzzy", "mention", "route", "place")
LIMIT, PER_PLACE, PER_SHARED = 40, 5, 3
#: Words that an alias mentions nothing by; words of a window that is compared, and its least length.
DROPPED = ("the", "pass", "after", "on", "gap")
WINDOW_WORDS, WINDOW_LEAST = 4, 5


def _spelled(name: Column) -> Column:
    return F.array(normal(name), normal(F.regexp_replace(name, "['’]", "")))


def keys(passes: DataFrame, free: bool) -> DataFrame:
    """key, slug, ord, kord: what a pass is called; in free text one of the map (tier ``osm``) only by its name. ``kord`` orders keys."""
    own = _spelled(F.col("name"))
    more = F.flatten(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), _spelled))
    every = F.concat(own, F.array(normal(F.col("slug"))), more)
    told = F.when(F.lit(free) & (F.col("tier") == "osm"), own).otherwise(every)
    rows = passes.select("slug", "ord", F.posexplode(told).alias("pos", "key")).filter("key <> ''")
    return rows.groupBy("key", "slug", "ord").agg(F.min("pos").alias("pos")).withColumn("kord", F.struct("ord", "pos"))


def windows(texts: DataFrame, most: int) -> DataFrame:
    """trip, gram, at, to: all runs of up to ``most`` words of a normal text ``q``, and the characters from ``at`` to before ``to``."""
    words = texts.select("trip", F.split("q", " ").alias("w")).filter("w[0] <> ''")
    words = words.select("trip", "w", F.posexplode("w").alias("i", "one"))
    runs = F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.size("w") - F.col("i"))), lambda n: F.array_join(F.slice("w", F.col("i") + 1, n), " "))
    before = F.aggregate(F.slice("w", 1, F.col("i")), F.lit(0), lambda s, x: s + F.length(x) + 1)
    grams = words.select("trip", before.alias("at"), F.explode(runs).alias("gram"))
    return grams.withColumn("to", F.col("at") + F.length("gram"))


def _outer(hits: DataFrame) -> DataFrame:
    """Hits (trip, at, to, ...) that lie in no longer hit of their trip."""
    spans = hits.groupBy("trip").agg(F.collect_set(F.struct("at", "to")).alias("spans"))
    within = F.exists("spans", lambda s: (s["at"] <= F.col("at")) & (s["to"] >= F.col("to")) & (s["to"] - s["at"] > F.col("to") - F.col("at")))
    return hits.join(spans, "trip").filter(~within).drop("spans")


def _longest(rows: DataFrame, key: str) -> int:
    """Most words of a key: a number, at least one."""
    return rows.agg(F.max(F.size(F.split(key, " ")))).first()[0] or 1


def mention(alias: Column) -> Column:
    """What an alias mentions once words like pass are gone, if that is one run of it of two words or more; else null."""
    whole = normal(alias)
    words = F.split(whole, " ")
    kept = F.filter(words, lambda w: ~w.isin(*DROPPED))
    joined = F.array_join(kept, " ")
    run = F.contains(F.concat(F.lit(" "), whole, F.lit(" ")), F.concat(F.lit(" "), joined, F.lit(" ")))
    return F.when((F.size(words) >= 3) & (F.size(kept) >= 2) & (F.size(kept) < F.size(words)) & run, joined)


def _owned(asked: DataFrame, owners: DataFrame, trips: DataFrame, passes: DataFrame, limit: int, away: Column) -> DataFrame:
    """``asked`` (trip, key, ...) with the slugs (key, slug) of each key.

    Of one key and one position of typers only the first ``limit`` passes in the order of candidates: all of a key
    found at one place of a text share what orders them before, so no others can be among a trip's first ``limit``.
    """
    here = F.struct(F.col("lat").alias("here_lat"), F.col("lon").alias("here_lon")).alias("here")
    placed = asked.join(trips.select("trip", here), "trip")
    met = placed.select("key", "here").distinct().join(owners.select("key", "slug").distinct(), "key")
    met = met.join(passes.select("slug", (F.col("tier") != "featured").alias("far"), "ord", "lat", "lon"), "slug").select("*", "here.*").withColumn("away", away)
    rank = F.row_number().over(Window.partitionBy("key", "here").orderBy("away", "far", "ord"))
    first = met.withColumn("rank", rank).filter(F.col("rank") <= limit).groupBy("key", "here").agg(F.collect_set("slug").alias("slugs"))
    return placed.join(first, ["key", "here"]).select(*asked.columns, F.explode("slugs").alias("slug"))


def _fuzzy(grams: DataFrame, named: DataFrame, free: DataFrame, cutoff: float, owned: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Windows that no name covers, much like a key that begins with the same letter; of overlapping ones the most alike stay."""
    spans = named.groupBy("trip").agg(F.collect_set(F.struct("at", "to")).alias("spans"))
    touched = F.exists(F.coalesce("spans", F.array().cast("array<struct<at:int,to:int>>")), lambda s: (s["at"] < F.col("to")) & (F.col("at") < s["to"]))
    telling = F.exists(F.split("gram", " "), lambda w: ~w.isin(*GENERIC) & ~w.rlike("^[0-9]+$"))
    asked = grams.join(spans, "trip", "left").filter(~touched & (F.length("gram") >= WINDOW_LEAST) & telling).select("trip", "at", "to", "gram")
    order = free.groupBy("key").agg(F.min("kord").alias("kord"))
    pairs = names.alike(asked.select(F.col("gram").alias("text")).distinct(), order.select(F.col("key").alias("name")), cutoff)
    pairs = pairs.filter(F.left("text", F.lit(1)) == F.left("name", F.lit(1))).join(order, F.col("name") == F.col("key"))
    best = pairs.groupBy("text").agg(F.max_by(F.struct("key", "ratio"), F.struct("ratio", (-F.col("kord.ord")).alias("o"), (-F.col("kord.pos")).alias("p"))).alias("b"))
    hits = asked.join(best, asked["gram"] == best["text"]).select("trip", "at", "to", "gram", "b.key", "b.ratio")
    last = lambda c: F.element_at(F.split(c, " "), -1)
    hits = hits.filter(~(last("gram").isin(*GENERIC) & (last("gram") != last("key"))))
    rivals = hits.groupBy("trip").agg(F.collect_list(F.struct("at", "to", "ratio")).alias("all"))
    beaten = F.exists("all", lambda o: (o["at"] < F.col("to")) & (F.col("at") < o["to"]) & (o["ratio"] > F.col("ratio")))
    return owned(hits.join(rivals, "trip").filter(~beaten).select("trip", "key", "gram", "at"), free).select("trip", "slug", F.lit("fuzzy").alias("kind"), F.col("gram").alias("matched"), F.col("at").cast("double").alias("at"))


def _places(trips: DataFrame, passes: DataFrame, places: DataFrame, told: DataFrame, away: Column) -> DataFrame:
    """Passes near places that a trip names; ``told``: (trip, key) of names found before, whose parts name no place."""
    bare = trips.select("trip", normal(F.regexp_replace("text", "['’]", "")).alias("q"))
    keyed = places.select("place", "kind", "passes", rules.place_key(F.col("place")).alias("pkey")).filter("pkey is not null")
    grams = windows(bare, _longest(keyed, "pkey"))
    met = grams.join(keyed, grams["gram"] == keyed["pkey"]).groupBy("trip", "place", "kind", "pkey", "passes").agg(F.min("at").alias("at"))
    names_of = told.groupBy("trip").agg(F.collect_set("key").alias("names"))
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    named = F.exists(F.coalesce("names", F.array().cast("array<string>")), lambda n: F.contains(pad(n), pad(F.col("pkey"))))
    met = met.join(names_of, "trip", "left").filter(~named).drop("names").withColumn("to", F.col("at") + F.length("pkey"))
    shared = met.groupBy("trip", "pkey").agg(F.count("*").alias("shared"))
    met = _outer(met).join(shared, ["trip", "pkey"])
    near = met.select("*", F.explode("passes").alias("n")).select("trip", "place", "kind", "pkey", "at", "shared", F.col("n.slug").alias("slug"), F.col("n.distance_mi").alias("mi"))
    near = near.join(passes.select("slug", (F.col("tier") != "featured").alias("far"), "ord", "lat", "lon"), "slug")
    rank = F.row_number().over(Window.partitionBy("trip", "place", "kind").orderBy("far", "mi", "ord"))
    near = near.withColumn("r", rank).filter(F.col("r") <= F.when(F.col("shared") > 2, PER_SHARED).otherwise(PER_PLACE))
    # Of one pass's places a trailhead speaks before a campground, then the nearer one.
    first = F.struct((F.col("kind") != "trailhead").alias("camp"), "mi", "at", "place", "pkey")
    best = near.groupBy("trip", "slug", "far", "ord", "lat", "lon").agg(F.min(first).alias("b")).select("trip", "slug", "far", "ord", "lat", "lon", "b.*")
    placed = best.join(trips.select("trip", F.col("lat").alias("here_lat"), F.col("lon").alias("here_lon")), "trip").withColumn("away", away)
    order = Window.partitionBy("trip").orderBy("at", "away", "far", "mi", "ord")
    return placed.select("trip", "slug", F.lit("place").alias("kind"), F.col("pkey").alias("matched"), (F.row_number().over(order) - 1).cast("double").alias("at"))


def candidates(trips: DataFrame, passes: DataFrame, routes: DataFrame, places: DataFrame, limit: int = LIMIT, cutoff: float = 0.78) -> DataFrame:
    """Trip, rank, slug, kind, matched, at, from_you_mi: what each trip's text may mean, best first, each pass once.

    Order: kind, place in the text, distance from the typer, featured passes, the passes' own order. A text without letters
    or digits has none. Trips and texts are never paired with names but by equal runs of words, or pairs of characters.
    """
    texts = trips.select("trip", normal(F.col("text")).alias("q")).filter("q <> ''")
    free, every = keys(passes, True), keys(passes, False)
    away = F.when(F.col("here_lat").isNotNull() & F.col("here_lon").isNotNull(), rules.miles(F.col("here_lat"), F.col("here_lon"), F.col("lat"), F.col("lon"))).otherwise(0.0)
    owned = lambda asked, owners: _owned(asked, owners, trips, passes, limit, away)
    whole = texts.join(every.select("key").distinct(), texts["q"] == F.col("key")).select("trip", "key", F.lit(0).alias("at"))
    grams = windows(texts, max(WINDOW_WORDS, _longest(free, "key")))
    hits = _outer(grams.join(free.select("key").distinct(), grams["gram"] == F.col("key")).select("trip", "key", "at", "to"))
    named = owned(hits.select("trip", "key", "at"), free).unionByName(owned(whole, every))
    found = [named.select("trip", "slug", F.lit("name").alias("kind"), F.col("key").alias("matched"), F.col("at").cast("double").alias("at"))]
    short = grams.filter(F.size(F.split("gram", " ")) <= WINDOW_WORDS)
    found.append(_fuzzy(short, hits, free, cutoff, owned))
    said = passes.filter("tier = 'featured'").select("slug", F.explode("aliases").alias("alias")).select("slug", mention(F.col("alias")).alias("m")).filter("m is not null").distinct()
    longer = windows(texts, _longest(said, "m"))
    met = longer.join(said.select("m").distinct(), longer["gram"] == F.col("m")).groupBy("trip", F.col("m").alias("key")).agg(F.min("at").alias("at"))
    met = owned(met, said.withColumnRenamed("m", "key"))
    found.append(met.select("trip", "slug", F.lit("mention").alias("kind"), F.col("key").alias("matched"), F.col("at").cast("double").alias("at")))
    called = routes.select("route", "passes", F.explode(F.array_distinct(F.concat(F.array("route"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("n"))
    called = called.select("route", "passes", normal(F.col("n")).alias("n")).filter(F.length("n") >= 3)
    runs = windows(texts, _longest(called, "n"))
    on = runs.join(called, runs["gram"] == called["n"]).groupBy("trip", "route", "passes").agg(F.min("at").alias("at"))
    known = F.broadcast(passes.select("slug").distinct()) if passes.count() <= names.BROADCAST_NAMES else passes.select("slug").distinct()
    legs = on.select("trip", "route", "at", F.posexplode("passes").alias("i", "slug")).join(known, "slug")
    # A route's passes keep its order, counted over those that are known.
    step = F.row_number().over(Window.partitionBy("trip", "route").orderBy("i")) - 1
    found.append(legs.select("trip", "slug", F.lit("route").alias("kind"), F.col("route").alias("matched"), (F.col("at") + step / 1000).alias("at")))
    found.append(_places(trips, passes, places, hits.select("trip", "key").unionByName(whole.select("trip", "key")), away))
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    kind = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("k")
    best = rows.groupBy("trip", "slug").agg(F.min(F.struct(kind, "at", "matched", "kind")).alias("b")).select("trip", "slug", "b.*")
    best = best.join(passes.select("slug", (F.col("tier") != "featured").alias("far"), "ord", "lat", "lon"), "slug")
    best = best.join(trips.select("trip", F.col("lat").alias("here_lat"), F.col("lon").alias("here_lon")), "trip").withColumn("away", away)
    # Row numbers up to a limit are cut in each task before the shuffle.
    rank = F.row_number().over(Window.partitionBy("trip").orderBy("k", "at", "away", "far", "ord"))
    here = F.when(F.col("here_lat").isNotNull() & F.col("here_lon").isNotNull(), (F.floor(F.col("away") / 10 + 0.5) * 10).cast("long"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= limit).select("trip", "rank", "slug", "kind", "matched", "at", here.alias("from_you_mi"))


#: Activities, days that a trip may lie away, passes of a trip, phrases told back and their longest, of a rejected slug.
ACTIVITIES = ("hiking", "backpacking", "trail running", "climbing", "skiing", "snowshoeing", "cycling", "driving", "other")
DAYS_AWAY, PASSES, PHRASES, PHRASE_MOST, SLUG_MOST = 732, 20, 8, 80, 80


def understood(drafts: DataFrame, allowed: DataFrame, today: str) -> DataFrame:
    """Trip, passes, start, end, activity, party_size, unplaced, rejected of drafts (trip, text, body) that a model wrote as JSON.

    Whatever has the wrong type counts as not there, and so does a body that is no JSON. ``allowed`` (trip, slug): candidates of each
    trip. Passes: distinct, in order, candidates only, twenty at most; others are rejected. Dates far from today go; one stands for
    the other, and they are swapped if need be. Phrases told back as unplaced must stand in the typed text, so that no
    sentence of the model's own is shown.
    """
    sets = allowed.groupBy("trip").agg(F.collect_set("slug").alias("allowed"))
    read = drafts.select("trip", "text", F.try_parse_json("body").alias("v")).join(sets, "trip", "left")
    none = F.array().cast("array<string>")

    def of(path: str, kind: str) -> Column:
        return F.try_variant_get("v", path, kind)

    def word(path: str) -> Column:
        return F.when(F.schema_of_variant(of(path, "variant")) == "STRING", of(path, "string"))

    def words(path: str) -> Column:
        own = F.transform(of(path, "array<variant>"), lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")))
        return F.coalesce(F.array_compact(own), none)

    slugs = F.array_distinct(words("$.passes"))
    known = lambda s: F.array_contains(F.coalesce("allowed", none), s)
    when = {}
    for name in ("start", "end"):
        raw = word(f"$.{name}_date")
        day = F.try_to_date(F.when(raw.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), raw), "yyyy-MM-dd")
        when[name] = F.when(F.abs(F.datediff(day, F.lit(today).cast("date"))) <= DAYS_AWAY, day)
    start, end = F.coalesce(when["start"], when["end"]), F.coalesce(when["end"], when["start"])
    size = F.when(F.schema_of_variant(of("$.party_size", "variant")).rlike("^(BIGINT|DOUBLE|DECIMAL)"), of("$.party_size", "double"))
    typed = F.concat(F.lit(" "), normal(F.coalesce("text", F.lit(""))), F.lit(" "))
    phrases = F.transform(words("$.unplaced"), lambda p: F.trim(F.regexp_replace(F.trim(p), r"\s+", " ")))
    told = F.transform(phrases, lambda p: F.struct(p.alias("phrase"), normal(p).alias("key")))
    told = F.filter(told, lambda p: (p["key"] != "") & (F.length(p["phrase"]) <= PHRASE_MOST) & F.contains(typed, F.concat(F.lit(" "), p["key"], F.lit(" "))))
    read = read.withColumn("told", told)
    once = F.filter("told", lambda p, i: F.size(F.filter(F.slice("told", 1, i), lambda o: o["key"] == p["key"])) == 0)["phrase"]
    return read.select(
        "trip", F.slice(F.filter(slugs, known), 1, PASSES).alias("passes"), F.least(start, end).alias("start"), F.greatest(start, end).alias("end"),
        F.when(word("$.activity").isin(*ACTIVITIES), word("$.activity")).alias("activity"), F.when((size == F.floor(size)) & size.between(1, 99), size.cast("int")).alias("party_size"),
        F.slice(once, 1, PHRASES).alias("unplaced"), F.transform(F.filter(slugs, lambda s: ~known(s)), lambda s: F.left(s, F.lit(SLUG_MOST))).alias("rejected"),
    )
