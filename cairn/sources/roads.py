"""Road, station and alert feeds of agencies, landed as text, read into rows. Expressions and joins only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import mean, rounded
from ..functions.rules import ZONE, position

#: Texts that restrict nothing, and the code of no controls.
NOTHING = ("", "none", "no restrictions", "no restriction", "not reported", "no current information available", "no current information")
NO_CONTROLS = "R-0"
CONTROLS = "array<struct<cc:struct<inService:string,location:struct<locationName:string,route:string,direction:string,latitude:string,longitude:string>,statusData:struct<status:string,statusDescription:string,statusTimestamp:struct<statusDate:string,statusTime:string>>>>>"
PASSES = "array<struct<MountainPassName:string,Latitude:double,Longitude:double,RoadCondition:string,WeatherCondition:string,DateUpdated:string,RestrictionOne:struct<TravelDirection:string,RestrictionText:string>,RestrictionTwo:struct<TravelDirection:string,RestrictionText:string>>>"
REPORTS = "array<struct<name:string,route:string,lat:string,lon:string,road:string,weather:string,limit:string,comments:string,snow_cm:double>>"


def _text(c: str | Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _line(label: Column, code: Column, text: Column) -> Column:
    return F.struct(label.cast("string").alias("label"), code.cast("string").alias("code"), text.alias("text"))


def controls(payloads: DataFrame) -> DataFrame:
    """Road, location, lat, lon, active, updated, lines of chain-control points (body); the directions at one place are one row.

    ``payloads`` have an ``ord``; of a place the position of the first row counts.
    """
    r = payloads.select("ord", F.posexplode(F.from_json("body", CONTROLS)).alias("i", "r")).select("ord", "i", "r.cc.*")
    at, st = F.col("location"), F.col("statusData")
    stamp = F.concat(_text(st["statusTimestamp"]["statusDate"]), F.lit("T"), _text(st["statusTimestamp"]["statusTime"]))
    rows = r.filter(F.col("inService") == "true").select(
        "ord", "i", _text(at["route"]).alias("road"), _text(at["locationName"]).alias("location"), position(at["latitude"], at["longitude"]).alias("p"),
        _text(st["status"]).alias("code"), _text(st["statusDescription"]).alias("text"), F.when(at["direction"] != "*", _text(at["direction"])).alias("label"), stamp.alias("updated"),
    )
    rows = rows.filter("road is not null and location is not null and p is not null and text is not null").filter(F.col("code").rlike(r"^[A-Z]{1,3}-?\d?$"))
    lines = F.array_sort(F.collect_set(_line(F.col("label"), F.col("code"), F.col("text"))))
    out = rows.groupBy("road", "location").agg(F.min_by("p", F.struct("ord", "i")).alias("p"), F.max(F.col("code") != NO_CONTROLS).alias("active"), F.max("updated").alias("updated"), lines.alias("lines"))
    return out.select("road", "location", "p.lat", "p.lon", "active", "updated", "lines")


def pass_reports(payloads: DataFrame) -> DataFrame:
    """Location, road, lat, lon, active, updated, lines of mountain pass reports; a restriction counts unless it restricts nothing."""
    r = payloads.select(F.inline(F.from_json("body", PASSES)))
    where = position(F.col("Latitude").cast("string"), F.col("Longitude").cast("string"))

    def limit(c: str) -> Column:
        return _text(F.col(c)["RestrictionText"])

    bites = [F.coalesce(~F.regexp_replace(F.lower(limit(c)), r"\.+$", "").isin(*NOTHING), F.lit(False)) for c in ("RestrictionOne", "RestrictionTwo")]
    said = [(F.lit("Road"), _text("RoadCondition")), (F.lit("Weather"), _text("WeatherCondition"))] + [(_text(F.col(c)["TravelDirection"]), limit(c)) for c in ("RestrictionOne", "RestrictionTwo")]
    lines = F.array_compact(F.array(*(F.when(text.isNotNull(), _line(label, F.lit(None), text)) for label, text in said)))
    ms, zone = F.regexp_extract("DateUpdated", r"^/Date\((-?\d+)([+-]\d{4})?\)/$", 1), F.regexp_extract("DateUpdated", r"^/Date\((-?\d+)([+-]\d{4})?\)/$", 2)
    offset = F.when(zone == "", "+00:00").otherwise(F.concat(F.left(zone, F.lit(3)), F.lit(":"), F.right(zone, F.lit(2))))
    updated = F.when(ms != "", F.concat(F.date_format(F.from_utc_timestamp(F.timestamp_millis(F.nullif(ms, F.lit("")).cast("long")), offset), "yyyy-MM-dd'T'HH:mm:ss"), offset))
    road = F.nullif(F.regexp_extract("MountainPassName", r"\b(I-\d+|US \d+|SR \d+)\b", 1), F.lit(""))
    kept = r.select(_text("MountainPassName").alias("location"), road.alias("road"), where.alias("p"), (bites[0] | bites[1]).alias("active"), updated.alias("updated"), lines.alias("lines"))
    return kept.filter(F.col("location").isNotNull() & F.col("p").isNotNull() & (F.size("lines") > 0)).select("location", "road", "p.lat", "p.lon", "active", "updated", "lines")


def id_reports(payloads: DataFrame, words: DataFrame) -> DataFrame:
    """Road and weather reports whose ids are explained by the agency's own table (kind, id, words); ids without words are left out.

    The table of words is a small dimension; ids come as 7 in one place and 7.0 in the other.
    """
    plain = lambda c: F.regexp_replace(F.trim(c), r"\.0$", "")
    r = payloads.select(F.inline(F.from_json("body", REPORTS))).withColumn("p", position(F.col("lat"), F.col("lon"))).filter("p is not null and trim(name) <> ''")
    for kind in ("road", "weather", "limit"):
        own = words.filter(F.col("kind") == kind).select(plain("id").alias(f"{kind}_id"), F.trim("words").alias(f"{kind}_words")).filter(f"{kind}_words <> ''")
        r = r.join(own, plain(kind) == F.col(f"{kind}_id"), "left")
    lines = [(F.lit("Road"), F.lit(None), F.col("road_words")), (F.lit("Weather"), F.lit(None), F.col("weather_words")), (F.lit("Restriction"), F.col("limit_id"), F.col("limit_words")), (F.lit("Crew comment"), F.lit(None), _text("comments"))]
    said = F.array_compact(F.array(*(F.when(text.isNotNull(), _line(label, code, text)) for label, code, text in lines)))
    active = F.coalesce(~F.regexp_replace(F.lower("limit_words"), r"\.+$", "").isin(*NOTHING), F.lit(False))
    inches = F.when(F.col("snow_cm") > 0, F.round(F.col("snow_cm") / 2.54, 1))
    kept = r.select(F.trim("name").alias("location"), _text("route").alias("road"), "p.lat", "p.lon", active.alias("active"), said.alias("lines"), inches.alias("new_snow_in"))
    return kept.filter(F.size("lines") > 0)


def search_page(pages: DataFrame) -> DataFrame:
    """station_id, name, lon, lat, elevation_ft of the rows of a station search page (body); rows that are no stations go."""
    rows = pages.select(F.explode(F.regexp_extract_all("body", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("row"))
    cells = F.transform(F.regexp_extract_all("row", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]+>", ""), r"&nbsp;|\s+", " ")))
    c = rows.select(cells.alias("c")).filter((F.size("c") >= 7) & F.col("c")[0].rlike("^[A-Z0-9]{3}$"))
    feet = F.regexp_replace(F.get("c", F.lit(6)), ",", "")
    out = c.select(F.get("c", F.lit(0)).alias("station_id"), F.initcap(F.get("c", F.lit(1))).alias("name"), F.get("c", F.lit(4)).try_cast("double").alias("lon"), F.get("c", F.lit(5)).try_cast("double").alias("lat"), feet.alias("feet"), feet.try_cast("int").alias("elevation_ft"))
    return out.filter("lon is not null and lat is not null and (feet = '' or elevation_ft is not null)").drop("feet")


def directories(payloads: DataFrame) -> DataFrame:
    """The stations of several JSON arrays, one per state, each station once."""
    schema = "array<struct<stationTriplet:string,name:string,latitude:double,longitude:double,elevation:double>>"
    return payloads.select(F.inline(F.from_json("body", schema))).dropDuplicates(["stationTriplet"])


def alerts(payloads: DataFrame, parks: DataFrame, host: str) -> DataFrame:
    """Unit, title, text, day, url of official alerts; codes that no park has go, links to other hosts are dropped."""
    schema = "struct<data:array<struct<id:string,url:string,title:string,parkCode:string,description:string,lastIndexedDate:string>>>"
    rows = payloads.select(F.inline(F.from_json("body", schema)["data"]))
    day = F.try_to_date(F.left("lastIndexedDate", F.lit(10)), "yyyy-MM-dd")
    site = F.try_parse_url("url", F.lit("HOST"))
    own = F.when((site == host) | F.endswith(site, F.lit(f".{host}")), F.col("url"))
    kept = rows.join(F.broadcast(parks), F.lower("parkCode") == F.lower("code"))  # a list of parks, a few hundred at most
    return kept.select("id", "unit", "title", F.col("description").alias("text"), day.alias("day"), own.alias("url")).filter("day is not null")


def official_reports(found: DataFrame) -> DataFrame:
    """Reports of found page items (place, lines, day, fetched_at); one without place, text or day, or of a day after it was fetched (Pacific), goes."""
    text = F.trim(F.array_join(F.filter("lines", lambda x: F.trim(x) != ""), "\n"))
    fetched = F.to_date(F.from_utc_timestamp("fetched_at", ZONE))
    return found.withColumn("text", text).filter((F.trim("place") != "") & (F.col("text") != "") & F.col("day").isNotNull() & (F.col("day") <= fetched)).drop("lines")


def daily_swings(values: DataFrame, least: int = 24, order: str | None = None) -> DataFrame:
    """Site, day, swing in percent of quarter-hour flows; a day needs ``least`` readings and a mean above nothing.

    Readings are added up in the order of the column ``order``, if one is named, as the reference adds them.
    """
    days = values.groupBy("site", "day").agg(F.count("value").alias("n"), F.max("value").alias("hi"), F.min("value").alias("lo"), mean(F.col("value"), F.col(order) if order else None).alias("mean")).filter((F.col("n") >= least) & (F.col("mean") > 0))
    return days.select("site", "day", rounded((F.col("hi") - F.col("lo")) / F.col("mean") * 100, 1).alias("swing"))


def cell_order(points: DataFrame) -> DataFrame:
    """Grid cells by the best of their places: featured first, then the highest."""
    best = points.groupBy("office", "x", "y").agg(F.max(F.struct("featured", "elevation_ft")).alias("b"))
    return best.select("office", "x", "y", "b.featured", "b.elevation_ft").orderBy(F.desc("featured"), F.desc("elevation_ft"), "office", "x", "y")


def fresh_layer(rows: DataFrame, today: str, days: int = 1) -> DataFrame:
    """The rows of a layer issued today or yesterday; an older layer is empty."""
    return rows.filter(F.datediff(F.lit(today).cast("date"), "issued_for") <= days)


def plumes(kml: DataFrame, digits: int | None = 3) -> DataFrame:
    """Density, start, end, ring of smoke placemarks (body: one placemark); documents that declare a DOCTYPE or ENTITY are not read.

    Corners are rounded to ``digits``, or taken as written with None.
    """
    degree = lambda text: text.cast("double") if digits is None else F.round(text.cast("double"), digits)
    safe = kml.filter(~F.contains("body", F.lit("<!DOCTYPE")) & ~F.contains("body", F.lit("<!ENTITY")))
    tag = lambda n: F.regexp_extract("body", rf"(?s)<{n}>(.*?)</{n}>", 1)
    told = F.nullif(F.regexp_extract(tag("description"), r"(?i)density:\s*(\w+)", 1), F.lit(""))
    density = F.lower(F.coalesce(told, F.regexp_extract(tag("styleUrl"), r"(?i)smoke_(\w+)", 1)))

    def at(which: str) -> Column:
        pattern = rf"(?i){which} time:\s*(\d{{4}})(\d{{3}}) (\d{{2}})(\d{{2}}) UTC"
        year, doy, hour, minute = (F.nullif(F.regexp_extract(tag("description"), pattern, i), F.lit("")).cast("int") for i in (1, 2, 3, 4))
        day = F.date_add(F.make_date(year, F.lit(1), F.lit(1)), doy - 1)
        return F.when(year.isNotNull(), F.format_string("%sT%02d:%02dZ", day.cast("string"), hour, minute))

    pairs = F.filter(F.split(F.trim(tag("coordinates")), r"\s+"), lambda p: p != "")
    ring = F.transform(pairs, lambda p: F.struct(degree(F.split(p, ",")[0]).alias("lon"), degree(F.split(p, ",")[1]).alias("lat")))
    closed = F.when(F.get(ring, F.lit(0)) == F.get(ring, F.size(ring) - 1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))
    rows = safe.select("id", density.alias("density"), at("start").alias("start"), at("end").alias("end"), closed.alias("ring"))
    return rows.filter(F.col("density").isin("light", "medium", "heavy") & (F.size("ring") >= 4))
