"""Places brought together: same sites, namesakes, duplicates, places to start from, reports that name a place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import slug, words_key
from . import links

#: Last words of names that may be looked for, and words that make a name that of something else.
ENDINGS = ("pass", "gap", "col", "saddle", "summit", "notch", "divide", "crest")
OTHERS = ("junction", "jct", "camp", "camps", "campground", "creek", "lake", "lakes", "trailhead", "ski", "resort", "lodge", "sno")


def one_per_site(ordered: Column, km: float = 1.5, feet: float = 500) -> Column:
    """Of an array of stations (network, lat, lon, elevation_ft) those that are at no earlier kept one's site in another network.

    Which one goes depends on which ones stay, so the array is folded in order. A station without a position is a site of its own.
    """

    def apart(a, b):
        half = F.pow(F.sin(F.radians(b["lat"] - a["lat"]) / 2), 2) + F.cos(F.radians(a["lat"])) * F.cos(F.radians(b["lat"])) * F.pow(F.sin(F.radians(b["lon"] - a["lon"]) / 2), 2)
        far = F.coalesce(2 * 6371 * F.asin(F.sqrt(half)) > km, F.lit(True))
        return F.coalesce(a["network"] == b["network"], F.lit(False)) | far | F.coalesce(F.abs(a["elevation_ft"] - b["elevation_ft"]) > feet, F.lit(False))

    none = F.filter(ordered, lambda x: F.lit(False))
    return F.aggregate(ordered, none, lambda acc, x: F.when(F.forall(acc, lambda k: apart(k, x)), F.concat(acc, F.array(x))).otherwise(acc))


def same_sites(stations: DataFrame, km: float = 1.5, feet: float = 500) -> DataFrame:
    """Slug, station of the stations of a place with each site once, the one of most usable seasons, then the nearest.

    ``stations``: slug, station, network, lat, lon, elevation_ft, usable, distance_km. Which one goes depends on
    which ones stay, so a place's handful of stations is folded in order; the pairs are one fold over an array.
    """
    row = F.struct((-F.col("usable")).alias("u"), "distance_km", "station", "network", "lat", "lon", "elevation_ft")
    lists = stations.groupBy("slug").agg(F.array_sort(F.collect_list(row)).alias("all"))

    kept = one_per_site(F.col("all"), km, feet)
    return lists.select("slug", F.explode(kept).alias("k")).select("slug", "k.station")


def namesakes(entries: DataFrame, nodes: DataFrame, km: float = 15) -> DataFrame:
    """Key, node, km of the nearest node of the same name within reach; entries without one have nulls."""
    named = lambda df: df.select("key", "lat", "lon", F.lower("name").alias("name"))
    first = named(nodes).groupBy("name", "lat", "lon").agg(F.min("key").alias("key"))  # of one position the least key counts
    best = links.within(named(entries), first, km, ("name",)).groupBy("lkey").agg(F.min(F.struct("km", "rkey")).alias("m")).select(F.col("lkey").alias("key"), F.col("m.rkey").alias("node"), F.col("m.km").alias("km"))
    return entries.select("key").join(best, "key", "left")


def merged(featured: DataFrame, nodes: DataFrame, near_km: float = 0.3, same_km: float = 5) -> DataFrame:
    """Key, slug of the nodes that are no featured place under another name, nor the same name mapped twice.

    A slug that is taken, by a featured place or an earlier node, gets the node's key behind it.
    """
    known = nodes.filter("elevation_ft is not null")
    # Whether a node goes hangs on its position and name alone, so each is asked once: those near any, then those near a namesake.
    spot = ["lat", "lon"]
    spots = lambda df, *also: df.select(*spot, *also).distinct().withColumn("key", F.struct(*spot, *also))
    lower = [df.withColumn("name", F.lower("name")) for df in (known, featured)]
    near = links.within(spots(known), spots(featured), near_km).filter(F.col("km") < near_km).select("lkey.*").distinct()
    same = links.within(spots(lower[0], "name"), spots(lower[1], "name"), same_km, ("name",)).filter(F.col("km") < same_km).select("lkey.*").distinct()
    left = known.join(near, spot, "left_anti").withColumn("low", F.lower("name")).join(same.withColumnRenamed("name", "low"), [*spot, "low"], "left_anti").select("key", slug(F.col("name")).alias("slug"))
    taken = featured.select(slug(F.col("name")).alias("slug"), F.lit(True).alias("taken")).distinct()
    first = F.row_number().over(Window.partitionBy("slug").orderBy("key")) == 1
    told = left.join(taken, "slug", "left").withColumn("own", first & F.col("taken").isNull())
    return told.select("key", F.when(F.col("own"), F.col("slug")).otherwise(F.concat("slug", F.lit("-"), F.col("key").cast("string"))).alias("slug"))


def inverted(starts: DataFrame, places: DataFrame, km: float, nearest: int, featured: int = 4) -> DataFrame:
    """Start, place, rank: the nearest places of each start, and the nearest featured ones, each once, nearest first."""
    # Starts of one position reach the same places, and of one position only the least keys can be among the nearest.
    starts, spot = starts.filter("trim(name) <> ''"), ["lat", "lon"]
    spots = starts.select(*spot).filter("lat is not null and lon is not null").distinct().withColumn("key", F.struct(*spot))
    own = lambda *also: F.row_number().over(Window.partitionBy(*spot, *also).orderBy("key"))
    least = places.select("key", *spot, "featured").withColumn("n", own()).withColumn("m", own("featured")).filter((F.col("n") <= nearest) | (F.col("featured") & (F.col("m") <= featured))).drop("n", "m")
    near = links.within(spots, least, km)
    by = Window.partitionBy("lkey").orderBy("km", "rkey")
    ranked = near.withColumn("r", F.row_number().over(by)).withColumn("f", F.sum(F.col("featured").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    kept = ranked.filter((F.col("r") <= nearest) | (F.col("featured") & (F.col("f") <= featured)))
    found = kept.select("lkey", F.struct(F.col("rkey").alias("place"), F.row_number().over(by).alias("rank")).alias("f")).groupBy("lkey").agg(F.collect_list("f").alias("found"))
    rows = starts.select(F.col("key").alias("start"), *spot).join(found.select("lkey.*", "found"), spot)
    return rows.select("start", F.explode("found").alias("f")).select("start", "f.*")


def _in_bounds(asked: DataFrame, known: DataFrame) -> DataFrame:
    """alias, bounds, least, greatest: where any place bears a name within bounds, its slug twice if it is the only one, else two of them.

    ``asked``: distinct (alias, bounds). Namesakes are counted by cells of a degree first. Only where the cells that lie wholly
    within do not show two owners are the places of the other cells met, so bounds are never paired with all namesakes.
    """
    b, ends = F.col("bounds"), (F.min("least").alias("least"), F.max("greatest").alias("greatest"))
    spots = known.filter(~F.isnan("lat") & ~F.isnan("lon")).groupBy("alias", "lat", "lon").agg(F.min("slug").alias("least"), F.max("slug").alias("greatest"))
    spots = spots.withColumn("row", F.floor("lat")).withColumn("col", F.floor("lon"))
    cells = spots.groupBy("alias", "row", "col").agg(*ends)
    inside = (F.col("row") >= b["south"]) & (F.col("row") + 1 <= b["north"]) & (F.col("col") >= b["west"]) & (F.col("col") + 1 <= b["east"])
    rows = F.when((b["south"] <= b["north"]) & (b["west"] <= b["east"]), F.sequence(F.floor(b["south"]), F.floor(b["north"])))
    opened = asked.select("alias", "bounds", F.explode(rows).alias("row"))
    sure = opened.join(cells, ["alias", "row"]).filter(inside).groupBy("alias", "bounds").agg(*ends)
    shared = sure.filter("least < greatest").select("alias", "bounds")
    edge = opened.join(shared, ["alias", "bounds"], "left_anti").join(spots, ["alias", "row"])
    edge = edge.filter(~inside & F.col("lat").between(b["south"], b["north"]) & F.col("lon").between(b["west"], b["east"]))
    return sure.unionByName(edge.select("alias", "bounds", "least", "greatest")).groupBy("alias", "bounds").agg(*ends)


def _hits(reports: DataFrame, field: str, places: DataFrame) -> DataFrame:
    """id, slug of the places that ``field`` names, as ``naming`` says."""
    known = places.select("slug", "lat", "lon", words_key(F.col("name")).alias("alias")).withColumn("n", F.size(F.split("alias", " ")))
    known = known.filter((F.col("n") >= 2) & ~F.startswith("alias", F.lit("the ")) & F.element_at(F.split("alias", " "), -1).isin(*ENDINGS))
    lengths = [r["n"] for r in known.select("n").distinct().collect()]  # a row per length of a name
    words, gaps = F.regexp_extract_all(field, F.lit("([A-Za-z0-9]+)"), F.lit(1)), F.split(field, "[A-Za-z0-9]+", -1)
    split = reports.select("id", "bounds", words.alias("w"), gaps.alias("g"))

    def runs(i):
        each = []
        for n in lengths:
            first, last = F.get("w", i), F.get("w", i + n - 1)
            after = F.when(F.get("g", i + n).rlike("^[ \\t]+$"), F.regexp_extract(F.get("w", i + n), "^[A-Za-z]+", 0))
            named = first.rlike("^[A-Z0-9]") & last.rlike("^[A-Z0-9]") & ~F.coalesce(F.lower(after).isin(*OTHERS), F.lit(False))
            each.append(F.when((i + n <= F.size("w")) & named, F.struct(F.lower(F.array_join(F.slice("w", i + 1, F.lit(n)), " ")).alias("alias"), i.alias("at"), F.lit(n).alias("n"))))
        return F.array_compact(F.array(*each))

    cut = split.select("id", "bounds", F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0))), runs))).alias("h")).select("id", "bounds", "h.*") if lengths else None
    if cut is None:
        return reports.select("id", F.lit(None).cast("string").alias("slug")).limit(0)
    met = cut.join(_in_bounds(cut.select("alias", "bounds").distinct(), known), ["alias", "bounds"])
    # A name inside a longer one that also matched is not meant; one with two owners names neither.
    spans = met.groupBy("id").agg(F.collect_set(F.struct("at", "n")).alias("spans"))
    alone = met.join(spans, "id").filter(~F.exists("spans", lambda s: (s["at"] <= F.col("at")) & (s["at"] + s["n"] >= F.col("at") + F.col("n")) & (s["n"] > F.col("n"))))
    owners = alone.groupBy("id", "alias").agg(F.min("least").alias("slug"), F.max("greatest").alias("greatest")).filter("slug = greatest")
    return owners.select("id", "slug").distinct()


def naming(reports: DataFrame, places: DataFrame, cap: int = 4) -> DataFrame:
    """Slug, id, named_in, rank of the reports that name a place within their bounds, where the place is given or in their words.

    ``reports``: id, place, text, unit, day, bounds (struct south, west, north, east); ``places``: slug, name, lat, lon.
    Names count as whole words that open with capitals, unless the next word makes them another's. What prints the same counts once.
    """
    where = _hits(reports, "place", places).withColumn("o", F.lit(0))
    text = _hits(reports, "text", places).join(where.select("id", "slug"), ["id", "slug"], "left_anti").withColumn("o", F.lit(1))
    found = where.unionByName(text).join(reports.select("id", "place", "text", "unit", "day"), "id")
    once = found.groupBy("slug", "unit", "place", "day", "text").agg(F.min(F.struct("id", "o")).alias("m")).select("slug", "day", "m.*")
    rank = F.row_number().over(Window.partitionBy("slug").orderBy("o", F.desc("day"), "id"))
    named = F.when(F.col("o") == 0, "place").otherwise("text")
    return once.withColumn("rank", rank).filter(F.col("rank") <= cap).select("slug", "id", named.alias("named_in"), "rank")
