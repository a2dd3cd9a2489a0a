"""Records whose shape is not to be trusted: what can be read is read, what cannot is kept beside it with the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Access that is closed, what yes and no are written as, feet in a metre.
CLOSED = ("private", "no")
YES_NO = {"yes": True, "no": False}
FEET = 3.28084
ELEMENT = "id bigint, lat double, lon double, center struct<lat:double,lon:double>, tags map<string,string>, broken string"


def _whole(text: Column) -> Column:
    """A number's whole part; null if the text is none."""
    return F.nullif(text, F.lit("")).try_cast("double").cast("int")


def _flag(text: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in YES_NO.items() for x in pair)), text)


def elements(lines: DataFrame) -> DataFrame:
    """Records of map elements (body: JSON; kind: trailhead, campground or parking), good and bad ones alike.

    ``problem`` is null for a good one, else ``unreadable``, ``closed``, ``nowhere`` or ``nameless`` (a campground), with the body
    as it came. Tags are a map, so what else they hold is no error; a value that is no number is null, not a problem.
    """
    read = lines.select("kind", "body", F.from_json("body", ELEMENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}).alias("e")).select("kind", "body", "e.*")
    tag = lambda name: F.nullif(F.try_element_at("tags", F.lit(name)), F.lit(""))
    own = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    lat, lon = F.when(own, F.col("lat")).otherwise(F.col("center.lat")), F.when(own, F.col("lon")).otherwise(F.col("center.lon"))
    problem = (
        F.when(F.col("broken").isNotNull() | F.col("id").isNull(), "unreadable").when(tag("access").isin(*CLOSED), "closed")
        .when(lat.isNull() | lon.isNull(), "nowhere").when((F.col("kind") == "campground") & tag("name").isNull(), "nameless")
    )
    camp, parking, good = F.col("kind") == "campground", F.col("kind") == "parking", problem.isNull()
    fields = {
        "name": F.when(F.col("kind") == "trailhead", F.coalesce(tag("name"), F.lit("Trailhead"))).otherwise(tag("name")), "lat": lat, "lon": lon,
        "elevation_ft": F.bround(tag("ele").try_cast("double") * FEET, 0).cast("int"), "fee": _flag(tag("fee")), "website": tag("website"), "operator": tag("operator"),
        "reservation": F.when(camp, tag("reservation")), "sites": F.when(camp, _whole(tag("capacity"))), "tents": F.when(camp, _flag(tag("tents"))),
        "backcountry": F.when(camp & (tag("backcountry") == "yes"), True), "spaces": F.when(parking, _whole(tag("capacity"))), "surface": F.when(parking, tag("surface")),
    }
    told = (F.when(good, value).alias(name) for name, value in fields.items())
    return read.select("kind", F.when(good, F.col("id")).alias("osm_id"), *told, problem.alias("problem"), F.when(~good, F.col("body")).alias("quarantined"))


def _text(value: Column) -> Column:
    """A JSON string; null for any other kind of value."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _texts(value: Column) -> Column:
    """The strings of a JSON array, others left out; null if it is no array."""
    return F.array_compact(F.transform(F.try_variant_get(value, "$", "array<variant>"), _text))


def routes(documents: DataFrame) -> DataFrame:
    """Route, aliases, passes of JSON documents (body); entries without a name, or a list of passes that holds one, are skipped."""
    listed = F.try_variant_get(F.try_parse_json("body"), "$.routes", "array<variant>")
    entries = documents.select(F.explode(listed).alias("r"))
    at = lambda name, kind="variant": F.try_variant_get("r", f"$.{name}", kind)
    read = entries.select(_text(at("name")).alias("route"), _texts(at("aliases")).alias("aliases"), _texts(at("passes")).alias("passes"))
    return read.filter("route is not null and size(passes) > 0")


def places(documents: DataFrame) -> DataFrame:
    """Place, kind, passes (slug, distance_mi) of JSON documents (body); entries without a name, of other kinds or without a pass are skipped.

    A pass is a pair of a string and a number; pairs of another shape are left out.
    """
    listed = F.try_variant_get(F.try_parse_json("body"), "$.places", "array<variant>")
    entries = documents.select(F.explode(listed).alias("p"))
    at = lambda name, kind="variant": F.try_variant_get("p", f"$.{name}", kind)
    far = lambda x: F.when(F.schema_of_variant(x).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), F.try_variant_get(x, "$", "double"))
    pair = lambda x: F.struct(_text(F.try_variant_get(x, "$[0]", "variant")).alias("slug"), far(F.try_variant_get(x, "$[1]", "variant")).alias("distance_mi"))
    pairs = F.filter(F.transform(at("passes", "array<variant>"), pair), lambda q: q["slug"].isNotNull() & q["distance_mi"].isNotNull())
    read = entries.select(_text(at("name")).alias("place"), _text(at("kind")).alias("kind"), pairs.alias("passes"))
    return read.filter("place is not null and kind in ('trailhead', 'campground') and size(passes) > 0")
