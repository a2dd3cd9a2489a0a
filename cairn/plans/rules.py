"""Queries of one-row rules: buckets, positions, filed reports, ratings, names, keys, intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from .inputs import Tables
from .registry import query


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN month(d) BETWEEN 4 AND 6 THEN 'early' WHEN month(d) IN (7, 8) THEN 'midsummer' WHEN month(d) IN (9, 10) THEN 'fall' ELSE 'winter' END AS bucket,
  strftime(d, '%m-%d') >= '06-01' AND strftime(d, '%m-%d') <= '09-30' AS melting,
  CASE WHEN s IS NULL THEN 'undated' WHEN d < DATE '1998-06-01' THEN 'past' WHEN s > DATE '1998-06-10' THEN 'beyond' WHEN d > DATE '1998-06-10' THEN 'partly' ELSE 'within' END AS horizon
FROM (SELECT *, CAST(l_shipdate AS DATE) AS d, CASE WHEN l_linenumber < 7 THEN CAST(l_shipdate AS DATE) - l_linenumber END AS s FROM lineitem) x"""
)
def date_buckets(t: Tables) -> DataFrame:
    """F28, P05, F31."""
    day = F.col("l_shipdate").cast("date")
    start = F.when(F.col("l_linenumber") < 7, F.date_sub(day, F.col("l_linenumber")))
    on = lambda d: F.lit(d).cast("date")
    return t.lineitem.select("l_orderkey", "l_linenumber", R.season_bucket(day).alias("bucket"), R.melt_season(day).alias("melting"), R.horizon(start, day, on("1998-06-01"), on("1998-06-10")).alias("horizon"))


@query(
    """SELECT id, CASE WHEN step IS NULL THEN NULL WHEN f IS NULL THEN step ELSE greatest(step, least(f, step + 1)) END AS step FROM (SELECT id, CASE snow WHEN 'none' THEN 0 WHEN 'patchy' THEN 1 WHEN 'continuous' THEN 2 WHEN 'deep' THEN 3 END AS step,
  CASE traction WHEN 'none' THEN 0 WHEN 'microspikes' THEN 2 WHEN 'crampons' THEN 3 WHEN 'ice_axe' THEN 3 WHEN 'spikes_and_axe' THEN 3 END AS f FROM $told t) x"""
)
def observed_steps(t: Tables) -> DataFrame:
    """F27."""
    return t.told.select("id", R.observed_step(F.col("snow"), F.col("traction")).alias("step"))


_RAW = "(SELECT key, CASE key % 9 WHEN 0 THEN 'Not Reported' WHEN 1 THEN '0' WHEN 2 THEN NULL ELSE CAST(lat AS VARCHAR) END AS la, CASE key % 11 WHEN 0 THEN '' ELSE CAST(lon AS VARCHAR) END AS lo, CASE WHEN key % 3 = 0 THEN 'CA' WHEN key % 3 = 1 THEN 'OR' END AS state, lat, lon FROM $places p)"


@query(
    f"""SELECT key, round(la, 5) AS lat, round(lo, 5) AS lon, coalesce(slat BETWEEN 30 AND 52 AND slon BETWEEN -130 AND -110, false) AS shared, CASE WHEN state = 'CA' AND slat BETWEEN 35.3 AND 40.3 AND slon BETWEEN -121.6 AND -117.6 THEN 'Sierra Nevada' ELSE 'Elsewhere' END AS region
FROM (SELECT key, state, lat AS slat, lon AS slon, CASE WHEN ok THEN try_cast(la AS DOUBLE) END AS la, CASE WHEN ok THEN try_cast(lo AS DOUBLE) END AS lo FROM (SELECT *, coalesce(try_cast(la AS DOUBLE) BETWEEN 30 AND 50 AND try_cast(lo AS DOUBLE) BETWEEN -126 AND -113, false) AS ok FROM {_RAW} r) a) b"""
)
def coordinate_sanity(t: Tables) -> DataFrame:
    """P10, P11, F29."""
    text = lambda c: F.col(c).cast("string")
    la = F.when(F.col("key") % 9 == 0, "Not Reported").when(F.col("key") % 9 == 1, "0").when(F.col("key") % 9 != 2, text("lat"))
    lo = F.when(F.col("key") % 11 == 0, "").otherwise(text("lon"))
    state = F.when(F.col("key") % 3 == 0, "CA").when(F.col("key") % 3 == 1, "OR")
    kept = t.places.select("key", R.position(la, lo).alias("p"), R.shared_position(F.col("lat"), F.col("lon")).alias("shared"), R.region(state, F.col("lat"), F.col("lon")).alias("region"))
    return kept.select("key", "p.lat", "p.lon", "shared", "region")


#: Filed reports made of documents, some of them wrong in one way or another.
_FILED = """(SELECT doc_id AS id, CASE WHEN doc_id % 23 = 0 THEN 'Bad Slug' WHEN doc_id % 29 = 0 THEN NULL ELSE concat('pass-', doc_id % 150) END AS slug,
  CASE WHEN doc_id % 31 = 0 THEN '2024-02-30' WHEN doc_id % 37 = 0 THEN '01/02/2024' WHEN doc_id % 19 = 0 THEN '2024-03-09' WHEN doc_id % 17 = 0 THEN '2023-12-01' ELSE concat('2024-02-', substr(concat('0', 1 + doc_id % 28), -2)) END AS day,
  CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 5 = 1 THEN text ELSE substr(text, 1, 200) END AS text, CASE n_chars % 6 WHEN 0 THEN 'none' WHEN 1 THEN 'patchy' WHEN 2 THEN '' WHEN 3 THEN 'slush' END AS snow,
  CASE doc_id % 4 WHEN 0 THEN 'flowing' WHEN 1 THEN 'dry' END AS water, CASE doc_id % 6 WHEN 0 THEN 'creek  at the bend' WHEN 1 THEN substr(text, 1, 90) END AS source,
  CASE doc_id % 13 WHEN 0 THEN 'u1/0123abcd-0000-1111-2222-0123456789ab.jpg' WHEN 1 THEN 'u2/0123abcd-0000-1111-2222-0123456789ab.jpg' WHEN 2 THEN 'u1/x.jpg' END AS photo FROM {0})"""


@query(
    f"""SELECT id, CASE WHEN slug IS NULL OR NOT regexp_matches(slug, '^[a-z0-9-]{{{{1,80}}}}$') THEN 'bad_slug' WHEN NOT regexp_matches(day, '^\\d{{{{4}}}}-\\d{{{{2}}}}-\\d{{{{2}}}}$') OR d IS NULL THEN 'bad_date' WHEN d > DATE '2024-03-01' THEN 'date_in_future'
  WHEN DATE '2024-03-01' - d > 30 THEN 'date_too_old' WHEN length(body) > 1000 THEN 'text_too_long' WHEN snow = 'slush' THEN 'bad_tap' WHEN length(src) > 60 THEN 'water_source_too_long' WHEN src <> '' AND water IS NULL THEN 'water_needs_status'
  WHEN photo IS NOT NULL AND photo <> 'u1/0123abcd-0000-1111-2222-0123456789ab.jpg' THEN 'bad_photo' WHEN body = '' AND coalesce(nullif(snow, ''), water, nullif(src, '')) IS NULL THEN 'empty' ELSE 'ok' END AS code
FROM (SELECT *, try_cast(day AS DATE) AS d, trim(regexp_replace(coalesce(text, ''), '[\\x00-\\x08\\x0b-\\x1f\\x7f]', '', 'g'), ' ') AS body, trim(regexp_replace(coalesce(source, ''), '\\s+', ' ', 'g'), ' ') AS src FROM {_FILED.format('documents')} f) x""".replace("{{", "{").replace("}}", "}")
)
def filing_check(t: Tables) -> DataFrame:
    """The first reason to refuse each filed report."""
    filed = t.spark.sql("SELECT * FROM " + _FILED.format("{documents}"), documents=t.documents)
    code = R.filing_code(F.col("slug"), F.col("day"), F.col("text"), {"snow": F.col("snow"), "water": F.col("water")}, F.col("source"), F.col("photo"), F.lit("u1"), F.lit("2024-03-01").cast("date"))
    return filed.select("id", code.alias("code"))


@query(
    """SELECT id, array_to_string(list_filter([CASE WHEN snow NOT IN ('none', 'patchy', 'continuous', 'deep') THEN 'snow: ' || snow || ' not allowed' END, CASE WHEN traction NOT IN ('none', 'microspikes', 'crampons', 'ice_axe', 'spikes_and_axe') THEN 'traction: ' || traction || ' not allowed' END,
  CASE WHEN id % 7 = 0 THEN 'day: ' || CAST(id AS VARCHAR) || ' is not a date' END], lambda x: x IS NOT NULL), '; ') AS problems FROM $told t"""
)
def record_problems(t: Tables) -> DataFrame:
    """What is wrong with each extracted record."""
    day = F.when(F.col("id") % 7 == 0, F.col("id").cast("string")).otherwise(F.col("day").cast("string"))
    return t.told.select("id", F.array_join(R.problems({"snow": F.col("snow"), "traction": F.col("traction")}, day), "; ").alias("problems"))


@query(
    """SELECT doc_id AS id, CASE doc_id % 5 WHEN 0 THEN 'unreadable' WHEN 1 THEN 'spam' END AS flag, CASE WHEN doc_id % 5 < 2 THEN 'hidden' ELSE 'visible' END AS status,
  CASE WHEN doc_id % 3 = 0 THEN 'deep' WHEN doc_id % 5 < 2 OR doc_id % 5 = 2 THEN NULL ELSE 'patchy' END AS snow,
  CASE WHEN doc_id % 4 = 0 THEN 'flowing' WHEN doc_id % 5 > 2 AND src IS NOT NULL THEN 'dry' END AS water, CASE WHEN doc_id % 4 = 0 THEN CASE WHEN doc_id % 8 = 0 THEN 'spring' END WHEN doc_id % 5 > 2 THEN src END AS source
FROM (SELECT doc_id, CASE WHEN clean <> '' AND length(clean) <= 60 AND contains(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ')), lower(clean)) THEN clean END AS src
  FROM (SELECT doc_id, text, trim(regexp_replace(CASE WHEN doc_id % 2 = 0 THEN substr(text, 5, 30) ELSE 'no such words' END, '\\s+', ' ', 'g'), ' ') AS clean FROM documents) a) b"""
)
def merged_reports(t: Tables) -> DataFrame:
    """What a visitor set by hand over what was read from the words; water only with a source in the visitor's own words."""
    of = F.col("doc_id") % 5
    flag = F.when(of == 0, "unreadable").when(of == 1, "spam")
    read = of > 2
    source = R.verbatim(F.when(F.col("doc_id") % 2 == 0, F.substring("text", 5, 30)).otherwise("no such words"), F.col("text"), R.SOURCE_MOST)
    tap_snow, tap_water, tap_source = F.when(F.col("doc_id") % 3 == 0, "deep"), F.when(F.col("doc_id") % 4 == 0, "flowing"), F.when(F.col("doc_id") % 8 == 0, "spring")
    return t.documents.select(
        F.col("doc_id").alias("id"), flag.alias("flag"), F.when(flag.isNull(), "visible").otherwise("hidden").alias("status"),
        F.coalesce(tap_snow, F.when(read, "patchy")).alias("snow"), F.coalesce(tap_water, F.when(read & source.isNotNull(), "dry")).alias("water"),
        F.when(tap_water.isNotNull(), tap_source).when(read, source).alias("source"),
    )


@query(
    """SELECT n_nationkey AS zone, CASE WHEN n_nationkey % 7 BETWEEN 1 AND 5 AND (n_nationkey % 4 = 0 OR n_nationkey % 4 = 1 AND n_nationkey % 7 = 3) THEN CAST(n_nationkey % 7 AS BIGINT) END AS level,
  CASE WHEN n_nationkey % 6 > 0 THEN strftime(timezone('UTC', timezone('America/Los_Angeles', TIMESTAMP '2024-01-01 17:00:00' + INTERVAL 1 DAY * (n_nationkey * 20))), '%Y-%m-%dT%H:%M:%S+00:00') END AS until_utc, n_nationkey % 2 = 0 AS off_season FROM nation"""
)
def avalanche_ratings(t: Tables) -> DataFrame:
    """Zones out of a GeoJSON document, one feature per line; ratings whose word disagrees are dropped."""
    key = F.col("n_nationkey")
    local = F.expr("timestamp_ntz'2024-01-01 17:00:00' + make_dt_interval(cast(n_nationkey * 20 as int))")
    props = F.struct(
        key.alias("id"), F.col("n_name").alias("name"), (key % 7).alias("danger_level"), F.when(key % 4 == 0, "").when(key % 4 == 1, " considerable").otherwise("none of these").alias("danger"),
        F.when(key % 6 > 0, F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss")).otherwise("soon").alias("end_date"), F.lit("America/Los_Angeles").alias("timezone"), (key % 2 == 0).alias("off_season"),
    )
    landed = t.nation.select(F.to_json(F.struct(props.alias("properties"))).alias("feature"))
    schema = "properties struct<id:long,name:string,danger_level:long,danger:string,end_date:string,timezone:string,off_season:boolean>"
    p = landed.select(F.from_json("feature", schema).alias("f")).select("f.properties.*")
    return p.select(F.col("id").cast("int").alias("zone"), R.danger_level(F.col("danger_level"), F.col("danger")).alias("level"), R.to_utc(F.col("end_date"), F.col("timezone")).alias("until_utc"), F.coalesce("off_season", F.lit(False)).alias("off_season"))


@query(
    """SELECT event_id, CAST(timezone('America/Los_Angeles', timezone('UTC', ts)) AS DATE) AS local_day, sha256(concat('v2:', event_type, chr(0), props)) AS key, sha256(concat(event_type, chr(0), CAST(user_id AS VARCHAR))) AS answer,
  regexp_replace(regexp_replace(lower(concat(event_type, ' / ', props)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, CAST(CASE WHEN value - 200 < 0 THEN -floor(abs(value - 200) + 0.5) ELSE floor(abs(value - 200) + 0.5) END AS BIGINT) AS whole FROM events"""
)
def keys_and_days(t: Tables) -> DataFrame:
    """F20, F23 to F25, F09."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return t.events.select(
        "event_id", R.local_date(ms).alias("local_day"), R.hash_key(F.col("event_type"), F.col("props"), salt="v2:").alias("key"), R.hash_key(F.col("event_type"), F.col("user_id").cast("string")).alias("answer"),
        R.slug(F.concat("event_type", F.lit(" / "), "props")).alias("slug"), R.half_away(F.col("value") - 200).alias("whole"),
    )


@query(
    """SELECT p_partkey AS key, CASE WHEN lower(fire) LIKE '% complex' THEN fire ELSE fire || ' Fire' END AS fire, regexp_replace(regexp_replace(station, '\\s*\\([^)]*\\)\\s*$', ''), '(?i)\\s+snotel$', '') AS station,
  CASE WHEN p_partkey % 4 = 0 THEN CASE WHEN length(w2) >= 7 THEN w2 END WHEN p_partkey % 4 = 1 THEN w1 || ' ' || w2 WHEN p_partkey % 4 = 2 AND w1 NOT IN ('new', 'old', 'big', 'little', 'upper', 'lower') THEN w1 || ' lake' END AS place
FROM (SELECT *, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2,
  CASE p_partkey % 3 WHEN 0 THEN upper(substr(p_name, 1, 1)) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) || ' MP18'
    WHEN 1 THEN upper(substr(p_name, 1, 1)) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) ELSE split_part(p_name, ' ', 1) || 'X ' || 'Complex' END AS fire,
  CASE p_partkey % 2 WHEN 0 THEN p_name || ' (Nrcs)' ELSE p_name || ' SNOTEL' END AS station FROM part) x"""
)
def names_told(t: Tables) -> DataFrame:
    """names of fires, stations and places as they are told."""
    w1, w2 = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    key = F.col("p_partkey")
    fire = F.when(key % 3 == 0, F.concat(F.upper("p_name"), F.lit("  MP18"))).when(key % 3 == 1, F.concat(F.lower(w1), F.lit(" "), F.upper(w2))).otherwise(F.concat(w1, F.lit("X COMPLEX")))
    station = F.when(key % 2 == 0, F.concat("p_name", F.lit(" (Nrcs)"))).otherwise(F.concat("p_name", F.lit(" SNOTEL")))
    place = F.when(key % 4 == 0, F.concat(w2, F.lit(" Trailhead"))).when(key % 4 == 1, F.concat("p_name", F.lit(" family campground"))).when(key % 4 == 2, F.concat(w1, F.lit(" Lake"))).otherwise(F.lit("Upper Meadow Camp"))
    return t.part.select(key.alias("key"), R.fire_name(fire).alias("fire"), R.plain_station(station).alias("station"), R.place_key(place).alias("place"))


@query(
    """WITH c AS (SELECT c_custkey AS key, c_acctbal > 0 AS visible, c_nationkey AS owner, CASE WHEN c_custkey % 3 > 0 THEN DATE '2024-01-01' + CAST(c_custkey % 40 AS INTEGER) END AS until FROM customer)
SELECT key, owner = 7 AS mine, until IS NULL OR until >= DATE '2024-01-20' AS in_force, CASE WHEN owner = 7 THEN 'words ' || CAST(key AS VARCHAR) END AS words, coalesce(DATE '2024-01-25' - until BETWEEN 0 AND 21, false) AS current FROM c WHERE visible OR owner = 7"""
)
def visible_or_mine(t: Tables) -> DataFrame:
    """What a viewer may see, watches in force, reports still current."""
    viewer, day = 7, lambda d: F.lit(d).cast("date")
    key = F.col("c_custkey")
    rows = t.customer.select(key.alias("key"), (F.col("c_acctbal") > 0).alias("visible"), (F.col("c_nationkey") == viewer).alias("mine"), F.when(key % 3 > 0, F.date_add(day("2024-01-01"), (key % 40).cast("int"))).alias("until"))
    words = F.when(F.col("mine"), F.concat(F.lit("words "), F.col("key").cast("string")))
    return rows.filter("visible or mine").select("key", "mine", R.in_force(F.col("until"), day("2024-01-20")).alias("in_force"), words.alias("words"), R.current(F.col("until"), day("2024-01-25")).alias("current"))


_RULES = [("/", True), ("/private", False), ("/private/open*", True), ("*.pdf$", False), ("/reports/*/draft", False), ("/reports/a", True)]


@query(
    """WITH u AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN '/private/x' WHEN 1 THEN '/private/openly/a.pdf' WHEN 2 THEN '/files/a.pdf' WHEN 3 THEN '/reports/abc/draft' WHEN 4 THEN '/reports/z/final' ELSE '/file.pdf?x' END AS path FROM pages),
r(pattern, allow, n) AS (VALUES ('^/', true, 1), ('^/private', false, 8), ('^/private/open.*', true, 14), ('^.*\\.pdf$', false, 6), ('^/reports/.*/draft', false, 16), ('^/reports/a', true, 10))
SELECT page_id, path, coalesce(arg_max(allow, n * 2 + CASE WHEN allow THEN 1 ELSE 0 END), true) AS allowed FROM u LEFT JOIN r ON regexp_matches(path, pattern) GROUP BY page_id, path"""
)
def robots_rules(t: Tables) -> DataFrame:
    """The longest rule that matches a path decides; of equal ones the one that allows. Rules are a small fixed list, so each row looks at all."""
    key = F.col("page_id") % 6
    path = F.when(key == 0, "/private/x").when(key == 1, "/private/openly/a.pdf").when(key == 2, "/files/a.pdf").when(key == 3, "/reports/abc/draft").when(key == 4, "/reports/z/final").otherwise("/file.pdf?x")
    rows = t.pages.select("page_id", path.alias("path"))
    hits = []
    for pattern, allow in _RULES:
        body = F.lit(pattern.removesuffix("$").replace(".", r"\.").replace("*", ".*"))
        match = F.regexp_like("path", F.concat(F.lit("^"), body, F.lit("$" if pattern.endswith("$") else "")))
        hits.append(F.when(match, F.struct(F.lit(len(pattern)).alias("n"), F.lit(allow).alias("allow"))))
    return rows.select("page_id", "path", F.coalesce(F.array_max(F.array_compact(F.array(*hits)))["allow"], F.lit(True)).alias("allowed"))
