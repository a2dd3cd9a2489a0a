"""Rules over one row: names, keys, buckets, checks of filed reports and ratings. All Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The choices that a filed report may make, field by field.
CHOICES = {
    "snow": ("none", "patchy", "continuous", "deep"),
    "traction": ("none", "microspikes", "crampons", "ice_axe", "spikes_and_axe"),
    "crossing": ("dry", "low", "knee_high", "thigh_high", "dangerous"),
    "comfort": ("relaxed", "cautious", "sketchy", "terrifying"),
    "register": ("thru_hiker", "experienced", "first_timer", "unknown"),
    "water": ("flowing", "trickling", "dry"),
}
#: Days that reports are taken for, characters of a text, a water source and a quote.
REPORT_DAYS, TEXT_MOST, SOURCE_MOST, QUOTE_MOST = 30, 1000, 60, 200
#: The steps of snow words, the least step of each traction, how far traction may raise.
SNOW_STEP = {"none": 0, "patchy": 1, "continuous": 2, "deep": 3}
TRACTION_FLOOR = {"none": 0, "microspikes": 2, "crampons": 3, "ice_axe": 3, "spikes_and_axe": 3}
#: Danger ratings by level.
DANGER = ("Low", "Moderate", "Considerable", "High", "Extreme")
#: Words that are no name by themselves, and endings of places.
GENERIC = (
    "the", "a", "an", "and", "of", "to", "from", "on", "in", "at", "via", "over", "after", "then", "with", "pass", "gap", "saddle", "summit", "col", "divide", "notch",
    "lake", "lakes", "creek", "river", "fork", "peak", "mountain", "mount", "mt", "trail", "trailhead", "loop", "camp", "campground", "camping", "area", "backcountry",
    "meadow", "meadows", "valley", "north", "south", "east", "west", "upper", "lower", "big", "little", "old", "new",
)
SUFFIXES = ("backcountry camping", "camping area", "family campground", "group campground", "horse campground", "horse camp", "campground", "trailhead", "camp")
ZONE = "America/Los_Angeles"


def season_bucket(day: Column) -> Column:
    """early (April to June), midsummer, fall (September, October) or winter."""
    month = F.month(day)
    return F.when(month.between(4, 6), "early").when(month.between(7, 8), "midsummer").when(month.between(9, 10), "fall").otherwise("winter")


def melt_season(day: Column) -> Column:
    """From 1 June to 30 September."""
    return F.date_format(day, "MM-dd").between("06-01", "09-30")


def horizon(start: Column, end: Column, today: Column, through: Column) -> Column:
    """where a trip lies against the forecast that reaches ``through``."""
    return (
        F.when(start.isNull() | end.isNull(), "undated").when(end < today, "past").when(through.isNull() | (start > through), "beyond")
        .when(end > through, "partly").otherwise("within")
    )


def observed_step(snow: Column, traction: Column) -> Column:
    """the step of the snow word, raised at most one by what was worn; null without a snow word."""

    def of(table: dict, value: Column) -> Column:
        return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), value)

    step, floor = of(SNOW_STEP, snow), of(TRACTION_FLOOR, traction)
    return F.when(floor.isNull(), step).otherwise(F.when(step.isNotNull(), F.greatest(step, F.least(floor, step + 1))))


def position(lat: Column, lon: Column) -> Column:
    """P10: struct(lat, lon) rounded to five digits; null unless both are numbers on the coast."""
    la, lo = lat.try_cast("double"), lon.try_cast("double")
    inside = la.between(30, 50) & lo.between(-126, -113)
    return F.when(inside, F.struct(F.round(la, 5).alias("lat"), F.round(lo, 5).alias("lon")))


def shared_position(lat: Column, lon: Column) -> Column:
    """Whether a shared position is finite and within the wider box."""
    return F.coalesce(lat.between(30, 52) & lon.between(-130, -110) & ~F.isnan(lat) & ~F.isnan(lon), F.lit(False))


def region(state: Column, lat: Column, lon: Column) -> Column:
    """F29."""
    sierra = (state == "CA") & lat.between(35.3, 40.3) & lon.between(-121.6, -117.6)
    return F.when(F.coalesce(sierra, F.lit(False)), "Sierra Nevada").otherwise("Elsewhere")


def boxes_overlap(a: str, b: str) -> Column:
    """Boxes in columns west, south, east, north of two aliases touch or overlap."""
    c = lambda t, n: F.col(f"{t}.{n}")
    return (c(a, "west") <= c(b, "east")) & (c(b, "west") <= c(a, "east")) & (c(a, "south") <= c(b, "north")) & (c(b, "south") <= c(a, "north"))


def current(day: Column, today: Column, days: int = 21) -> Column:
    """0 to ``days`` old; an unknown day is not current."""
    return F.coalesce(F.datediff(today, day).between(0, days), F.lit(False))


def in_force(until: Column, today: Column) -> Column:
    """A watch without an end, or not yet past it."""
    return until.isNull() | (until >= today)


def problems(fields: dict[str, Column], day: Column) -> Column:
    """What is wrong with an extracted record, field by field; empty if nothing."""
    named = [F.when(value.isNotNull() & ~value.isin(*CHOICES[name]), F.concat(F.lit(f"{name}: "), value, F.lit(" not allowed"))) for name, value in fields.items()]
    dated = F.when(day.isNotNull() & ~day.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(F.lit("day: "), day, F.lit(" is not a date")))
    return F.array_compact(F.array(*named, dated))


def filing_code(slug: Column, day: Column, text: Column, taps: dict[str, Column], source: Column, photo: Column, user: Column, today: Column) -> Column:
    """The first reason to refuse a filed report, or ok."""
    when = F.try_to_date(day)
    clean = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x08\x0b-\x1f\x7f]", ""))
    bad_tap = F.lit(False)
    for name, value in taps.items():
        bad_tap = bad_tap | F.coalesce((value != "") & ~value.isin(*CHOICES[name]), F.lit(False))
    squeezed = F.trim(F.regexp_replace(F.coalesce(source, F.lit("")), r"\s+", " "))
    made = F.coalesce(*(F.nullif(v, F.lit("")) for v in taps.values()), F.nullif(squeezed, F.lit(""))).isNotNull()
    name = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\.jpg$"
    parts = F.split(photo, "/", -1)
    bad_photo = photo.isNotNull() & ~((F.size(parts) == 2) & (F.get(parts, F.lit(0)) == user) & F.coalesce(F.get(parts, F.lit(1)).rlike(name), F.lit(False)))
    return (
        F.when(slug.isNull() | ~slug.rlike("^[a-z0-9-]{1,80}$"), "bad_slug").when(day.isNull() | ~day.rlike(r"^\d{4}-\d{2}-\d{2}$") | when.isNull(), "bad_date")
        .when(when > today, "date_in_future").when(F.datediff(today, when) > REPORT_DAYS, "date_too_old").when(F.length(clean) > TEXT_MOST, "text_too_long").when(bad_tap, "bad_tap")
        .when(F.length(squeezed) > SOURCE_MOST, "water_source_too_long").when((squeezed != "") & F.coalesce(taps["water"] == "", F.lit(True)), "water_needs_status")
        .when(bad_photo, "bad_photo").when((clean == "") & ~made, "empty").otherwise("ok")
    )


def verbatim(span: Column, text: Column, most: int) -> Column:
    """The span with blanks squeezed if the text holds it so, whatever the case; else null."""
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    clean = squeeze(span)
    held = (clean != "") & (F.length(clean) <= most) & F.contains(F.lower(squeeze(text)), F.lower(clean))
    return F.when(held, clean)


def danger_level(level: Column, word: Column) -> Column:
    """The level, 1 to 5, unless the word beside it says another."""
    own = F.element_at(F.array(*map(F.lit, DANGER)), F.when(level.between(1, 5), level).cast("int"))
    said = F.nullif(F.trim(word), F.lit(""))
    return F.when(level.between(1, 5) & (said.isNull() | (F.lower(said) == F.lower(own))), level)


def to_utc(local: Column, zone: Column) -> Column:
    """a local time with a named zone as UTC, in ISO form; null if it is no time."""
    at = F.to_utc_timestamp(F.try_to_timestamp(local), zone)
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def local_date(epoch_ms: Column, zone: str = ZONE) -> Column:
    """the local day of a time in milliseconds."""
    return F.to_date(F.from_utc_timestamp(F.timestamp_millis(epoch_ms), zone))


def interval(valid: Column) -> tuple[Column, Column]:
    """start and end of ``start/PnDTnHnM``."""
    start = F.to_timestamp(F.split_part(valid, F.lit("/"), F.lit(1)))
    part = F.split_part(valid, F.lit("/"), F.lit(2))

    def of(letter: str) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(part, rf"(\d+){letter}", 1), F.lit("")).cast("int"), F.lit(0))

    return start, start + F.make_dt_interval(of("D"), of("H"), of("M"))


def words_key(text: Column) -> Column:
    """anything but ASCII letters and digits becomes one blank."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def place_key(name: Column) -> Column:
    """the telling words of a place, without an ending like campground; null if none tells, or a lone one is short."""
    key = words_key(F.regexp_replace(name, "['’]", ""))
    cut = F.regexp_replace(key, f"^(.+?) ({'|'.join(SUFFIXES)})$", "$1")
    words = F.split(cut, " ")
    telling = F.filter(words, lambda w: ~w.isin(*GENERIC) & (w != ""))
    lone = (F.size(words) == 1) & (F.length(F.get(words, F.lit(0))) < 7)
    return F.when((F.size(telling) > 0) & ~lone, cut)


def fire_name(raw: Column) -> Column:
    """words all in one case get a capital; Fire is added unless the name ends so, or in Complex."""
    words = F.filter(F.split(raw, r"\s+"), lambda w: w != "")
    told = F.transform(words, lambda w: F.when(w.rlike("^([A-Z]+|[a-z]+)$"), F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2))))).otherwise(w))
    name = F.array_join(told, " ")
    return F.when(name.rlike(r"(?i)\b(fire|complex)$"), name).otherwise(F.concat(name, F.lit(" Fire")))


def plain_station(name: Column) -> Column:
    """without a bracket at the end, and without the network's name."""
    return F.regexp_replace(F.regexp_replace(name, r"\s*\([^)]*\)\s*$", ""), r"(?i)\s+snotel$", "")


def hash_key(*parts: Column, salt: str = "") -> Column:
    """SHA-256 of the salt and of the parts joined by a zero character."""
    return F.sha2(F.concat(F.lit(salt), F.concat_ws("\0", *parts)).cast("binary"), 256)


def slug(text: Column, mark: str = "-") -> Column:
    """lower case, anything but letters and digits one mark."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", mark), f"^{mark}+|{mark}+$", "")


def miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """great circle with a radius of 3958.8 miles."""
    half = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 3958.8 * F.asin(F.sqrt(half))


def half_away(x: Column) -> Column:
    """to the nearest whole number, halves away from zero."""
    return (F.signum(x) * F.floor(F.abs(x) + 0.5)).cast("long")


def excerpt(text: Column, most: int = 400) -> Column:
    """The text up to the last sentence that ends within ``most`` characters, or its first sentence whole.

    A sentence ends at a line feed, or at . ! ? before a blank or the end; not at a dot after one
    of the short forms below, or before a small letter.
    """
    clean = F.trim(text)
    # Each match runs from the start of a sentence to its end.
    parts = F.regexp_extract_all(clean, F.lit(f"(?s)(?:.+?(?:\\n|[!?](?=\\s|$)|(?<!(?i:\\b(?:{'|'.join(SHORT)})))\\.(?=\\s*$|\\s+[^\\sa-z])))|.+$"), F.lit(0))
    # The parts are gone through once: a lambda that named them would look for them again for each.
    nothing = F.struct(F.lit(0).alias("end"), F.lit(None).cast("int").alias("fit"), F.lit(None).cast("int").alias("first"))

    def longer(told: Column, part: Column) -> Column:
        end = told["end"] + F.length(part)
        return F.struct(end.alias("end"), F.when(end <= most, end).otherwise(told["fit"]).alias("fit"), F.coalesce(told["first"], end).alias("first"))

    cut = F.aggregate(parts, nothing, longer, lambda told: F.coalesce(told["fit"], told["first"]))
    return F.when(F.length(clean) <= most, clean).otherwise(F.trim(F.left(clean, cut)))


#: Short forms after which a dot ends no sentence.
SHORT = (
    "mt", "st", "dept", "rd", "hwy", "jct", "co", "approx", "mi", "ft", "hrs", "hr", "pt", "no", "vs", "etc", "sr", "us", "fs", "fr", "ave", "blvd", "lk", "cr", "ck", "mtn", "mts",
    "jr", "dr", "e", "w", "n", "s", "a", "p", "m", "g", "i",
)
