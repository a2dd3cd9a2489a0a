"""What is known of each place at each date: sensors, snow line, scenes, reports and fords, fused into one verdict.

Every component is a DataFrame of rows (slug, eval_date, ...); a place without evidence of a
kind has no row there. ``fused`` lays them over places and dates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import mean, rounded
from . import asof, screen

#: Weight of each kind of evidence, half-lives and windows in days.
PRIOR = {"sensor": 0.9, "satellite": 0.65, "report": 0.75}
HALF_LIFE = {"sensor": 4.0, "satellite": 3.0, "report": 5.0}
WINDOW = {"sensor": 10, "satellite": 12, "report": 14}
#: Water at full severity (in), bare (in), blind below a place (ft), rise of the snow line (ft a day),
#: its margin (ft), ceiling (ft) and weight, days of a gap between seasons, of a bare run, last day for quiet stations.
FULL, BARE, BLIND = 15.0, 0.5, 300.0
RISE, MARGIN, CEILING, INFERRED = 40.0, 500.0, 14_500.0, 0.45
SEASON_GAP, BARE_RUN, QUIET_UNTIL = 20, 7, "10-15"
#: Severities that reports state, and what the writer's experience adds to them.
SNOW = {"none": 0.0, "patchy": 1.0, "continuous": 2.0, "deep": 3.0}
TRACTION = {"none": 0.0, "microspikes": 1.5, "crampons": 2.25, "ice_axe": 2.5, "spikes_and_axe": 2.75}
COMFORT = {"relaxed": 0.0, "cautious": 1.0, "sketchy": 2.0, "terrifying": 3.0}
REGISTER = {"first_timer": -0.75, "thru_hiker": 0.5, "experienced": 0.25, "unknown": 0.0}
#: Fords from easy to dangerous, statuses from clear to closed with the severities between them.
CROSSINGS = ("dry", "low", "knee_high", "thigh_high", "dangerous")
STATUSES = ("open", "snow_caution", "traction_advised", "not_recommended")
CUTS = (0.5, 1.25, 2.1)


def looked_up(value: Column, table: dict) -> Column:
    """The value's entry in a small fixed table; null if it has none."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), value)


def is_blind(value: Column, gap_ft: Column) -> Column:
    """Bare, and too far below the place to say anything of it; an unknown gap is not blind."""
    return F.coalesce((gap_ft > BLIND) & (value < BARE), F.lit(False))


def newest(judged: DataFrame) -> DataFrame:
    """Station, eval_date, newest (day, value) and first (day, value) believed reading in the sensors' window.

    ``judged`` as ``screen.judged_as_of`` gives it. Of one day the least ``ord`` counts, at either end.
    """
    age = F.datediff("eval_date", "day")
    seen = judged.filter((F.col("state") == "believed") & age.between(0, WINDOW["sensor"]))
    last = F.max_by(F.struct("day", "value"), F.struct("day", -F.col("ord"))).alias("l")
    first = F.min_by(F.struct("day", "value"), F.struct("day", "ord")).alias("f")
    ends = seen.groupBy("station", "eval_date").agg(last, first)
    named = (F.col("f.day").alias("first_day"), F.col("f.value").alias("first_value"))
    return ends.select("station", "eval_date", "l.*", F.datediff("eval_date", "l.day").alias("age"), *named)


def faulty(judged: DataFrame) -> DataFrame:
    """Station, eval_date, value, reason, since of stations whose newest reading is rejected and in the sensors' window."""
    told = judged.filter("newest and state = 'rejected'").filter(F.datediff("eval_date", "day") <= WINDOW["sensor"])
    return told.select("station", "eval_date", "value", "reason", "since")


def sensors(linked: DataFrame) -> DataFrame:
    """Severity, swe, trend, age, weight, stations. ``linked``: newest readings of linked stations, with km, gap_ft.

    Blind stations are left out; see ``asof.station_weight``. The trend is the weighted newest value against the plain mean
    of the first ones, a day of the whole span.
    """
    w = asof.station_weight(F.col("km"), F.col("gap_ft"))
    seen = linked.filter(~is_blind(F.col("value"), F.col("gap_ft"))).groupBy("slug", "eval_date").agg(
        (F.sum(w * F.col("value")) / F.sum(w)).alias("swe"),
        F.avg("first_value").alias("first"),
        F.greatest(F.datediff(F.max("day"), F.min("first_day")), F.lit(1)).alias("span"),
        F.min("age").alias("age"),
        F.array_sort(F.collect_set("station")).alias("stations"),
    )
    return seen.select(
        "slug", "eval_date", F.round(F.least(F.lit(3.0), F.col("swe") / FULL * 3), 2).alias("severity"), F.round("swe", 1).alias("swe"),
        F.round((F.col("swe") - F.col("first")) / F.col("span"), 2).alias("trend"), "age", (PRIOR["sensor"] * asof.decay(F.col("age"), HALF_LIFE["sensor"])).alias("weight"), "stations",
    )


def blind(linked: DataFrame) -> DataFrame:
    """The blind stations of a place, highest first, the highest three by name, and the least gap."""
    seen = linked.filter(is_blind(F.col("value"), F.col("gap_ft")))
    order = F.array_sort(F.collect_list(F.struct((-F.col("station_ft")).alias("down"), "station")))
    out = seen.groupBy("slug", "eval_date").agg(order.alias("all"), F.round(F.min("gap_ft")).cast("long").alias("min_gap_ft"))
    named = F.array_join(F.transform(F.slice("all", 1, 3), lambda s: F.concat(s["station"].cast("string"), F.lit(" ("), F.format_number(-s["down"], 0), F.lit(" ft)"))), ", ")
    return out.select("slug", "eval_date", F.size("all").alias("blind"), "min_gap_ft", named.alias("named"))


def melt_outs(daily: DataFrame, keys: tuple[str, ...] = ("station",)) -> DataFrame:
    """W01 at every reading of a series (``keys``): since when the bare run that it ends has lasted, whether its start was seen, and whether it counts.

    A run breaks at snow, at a gap of more than SEASON_GAP days and at the turn of a year; one
    whose start was not seen counts once it is BARE_RUN days old. Depends on the past alone, so
    one pass over the series serves every date.
    """
    by_day = Window.partitionBy(*keys).orderBy("day")
    last, before = F.lag("day").over(by_day), F.lag("value").over(by_day)
    joined = F.coalesce((F.datediff("day", last) <= SEASON_GAP) & (F.year("day") == F.year(last)), F.lit(False))
    bare = F.col("value") < BARE
    run = daily.select(*keys, "day", "value", bare.alias("bare"), (joined & (before >= BARE)).alias("seen"), (~(joined & bare & (before < BARE))).cast("int").alias("opens"))
    run = run.withColumn("run", F.sum("opens").over(by_day.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy(*keys, "run").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    run = run.withColumn("since", F.first("day").over(whole)).withColumn("observed", F.first("seen").over(whole))
    counts = F.col("bare") & (F.col("observed") | (F.datediff("day", "since") >= BARE_RUN))
    return run.select(*keys, "day", "value", F.when(counts, F.col("since")).alias("since"), F.when(counts, F.col("observed")).alias("observed"))


def first_melt_outs(daily: DataFrame) -> DataFrame:
    """Of each station and year the first reading at which a bare run has lasted BARE_RUN days: since, observed."""
    runs = melt_outs(daily).filter((F.col("value") < BARE) & (F.datediff("day", "since") >= BARE_RUN))
    first = runs.groupBy("station", F.year("day").alias("year")).agg(F.min(F.struct("day", "since", "observed")).alias("m"))
    return first.select("station", "year", "m.since", "m.observed")


def believed_lines(linked: DataFrame, judged: DataFrame) -> DataFrame:
    """The highest snow line that bare stations of a place imply, risen since they melted out.

    ``linked``: slug, station, gap_ft, station_ft; ``judged``: see ``screen.judged_as_of``, of which believed readings of
    the date's year count. Stations count that report and are blind, or that are quiet, were bare when last heard of,
    and the year is not past QUIET_UNTIL.
    """
    keys = ("station", "eval_date")
    told = judged.filter((F.col("state") == "believed") & (F.year("day") == F.year("eval_date")))
    last = F.max_by(F.struct("day", "value", "since", "observed"), "day").alias("l")
    opened = melt_outs(told, keys).groupBy(*keys).agg(last).select(*keys, "l.*").join(linked, "station")
    quiet = F.datediff("eval_date", "day") > WINDOW["sensor"]
    counts = F.when(quiet, (F.col("value") < BARE) & (F.date_format("eval_date", "MM-dd") <= QUIET_UNTIL)).otherwise(is_blind(F.col("value"), F.col("gap_ft")))
    kept = opened.filter(counts & F.col("since").isNotNull() & F.col("station_ft").isNotNull() & F.col("gap_ft").isNotNull())
    kept = kept.withColumn("quiet_since", F.when(quiet, F.col("day")))
    days = F.datediff("eval_date", "since")
    best = F.struct((F.col("station_ft") + RISE * days).alias("line"), (-F.col("station")).alias("down"), "since", "observed", "quiet_since", "station_ft", (F.col("station_ft") + F.col("gap_ft")).alias("place_ft"))
    out = kept.groupBy("slug", "eval_date").agg(F.max(best).alias("b")).select("slug", "eval_date", "b.*")
    gap = F.col("place_ft") - F.col("line")
    severity = F.when(gap <= -MARGIN, 0.0).when(gap <= 0, 0.5).otherwise(F.least(F.lit(2.0), 0.5 + gap / 1000))
    return out.select(
        "slug", "eval_date", F.round(F.least("line", F.lit(CEILING)) / 100).cast("long").alias("hundreds"), (-F.col("down")).alias("station"),
        "since", "observed", "quiet_since", "station_ft", F.round(severity.cast("decimal(12,6)"), 2).cast("double").alias("severity"), F.lit(PRIOR["sensor"] * INFERRED).alias("weight"),
    )


def snow_lines(linked: DataFrame, daily: DataFrame, dates: list[str]) -> DataFrame:
    """``believed_lines`` of readings (station, day, value, one a day), which are screened as of each date first."""
    return believed_lines(linked, screen.judged_as_of(daily.withColumn("ord", F.lit(0)), dates))


def scenes(seen: DataFrame, dates: list[str], rejected: DataFrame) -> DataFrame:
    """The newest scene of a place, modelled ones on readings rejected at the date (station, eval_date, day) left out."""
    thrown = rejected.select(F.col("station").alias("from_station"), "eval_date", "day").distinct()
    opened = asof.dates(seen, dates, WINDOW["satellite"]).join(thrown, ["from_station", "eval_date", "day"], "left_anti")
    best = opened.groupBy("slug", "eval_date").agg(F.max_by(F.struct("cover", "age", "modeled"), F.struct("day", "cover")).alias("b")).select("slug", "eval_date", "b.*")
    weight = PRIOR["satellite"] * asof.decay(F.col("age"), HALF_LIFE["satellite"])
    return best.select("slug", "eval_date", F.round(F.col("cover") * 3, 2).alias("severity"), "cover", "age", F.coalesce(F.col("modeled"), F.lit(False)).alias("modeled"), weight.alias("weight"))


def calibrated(comfort: Column, register: Column) -> Column:
    """Severity of a word of comfort, moved by the writer's experience; what is relaxed stays so."""
    base = looked_up(comfort, COMFORT)
    moved = base + F.coalesce(looked_up(F.coalesce(register, F.lit("unknown")), REGISTER), F.lit(0.0))
    return F.when(base == 0, 0.0).when(base > 0, F.greatest(F.lit(0.0), F.least(F.lit(3.0), moved)))


def report_severity(snow: Column, traction: Column, comfort: Column, register: Column) -> Column:
    """Mean of what a report says of snow, traction and comfort; null if it says nothing."""
    said = F.array_compact(F.array(looked_up(snow, SNOW), looked_up(traction, TRACTION), calibrated(comfort, register)))
    return F.when(F.size(said) > 0, F.aggregate(said, F.lit(0.0), lambda s, v: s + v) / F.size(said))


def reports(told: DataFrame, dates: list[str]) -> DataFrame:
    """Reports of a place, the fresher weighing more. ``told``: slug, day, snow, traction, comfort, register, crossing."""
    scored = told.withColumn("said", report_severity(F.col("snow"), F.col("traction"), F.col("comfort"), F.col("register"))).filter("said is not null")
    opened = asof.dates(scored, dates, WINDOW["report"]).withColumn("w", asof.decay(F.col("age"), HALF_LIFE["report"]))
    out = opened.groupBy("slug", "eval_date").agg((F.sum(F.col("said") * F.col("w")) / F.sum("w")).alias("s"), F.count("*").alias("n_reports"), F.min("age").alias("age"))
    weight = PRIOR["report"] * asof.decay(F.col("age"), HALF_LIFE["report"]) * F.least(F.lit(1.0), F.col("n_reports") / 2.0)
    return out.select("slug", "eval_date", F.round("s", 2).alias("severity"), "n_reports", "age", weight.alias("weight"))


def worst_crossings(told: DataFrame, dates: list[str]) -> DataFrame:
    """The worst ford that reports of the window name."""
    step = F.array_position(F.array(*map(F.lit, CROSSINGS)), F.col("crossing"))
    named = told.withColumn("step", step).filter("step > 0")
    worst = asof.dates(named, dates, WINDOW["report"]).groupBy("slug", "eval_date").agg(F.max("step").cast("int").alias("step"))
    return worst.select("slug", "eval_date", F.element_at(F.array(*map(F.lit, CROSSINGS)), F.col("step")).alias("worst"))


def creeks(gauges: DataFrame, dates: list[str]) -> DataFrame:
    """Flow of the newest row in ten days with its trend, and whether the mean swing of a week tells of active melt."""
    opened = asof.dates(gauges, dates, 10)
    flow, order = F.when(F.col("metric") == "discharge_cfs", F.col("value")), F.struct("day", "ord")
    out = opened.groupBy("slug", "eval_date").agg(
        F.max_by("value", F.when(flow.isNotNull(), order)).alias("flow"), F.min_by("value", F.when(flow.isNotNull(), order)).alias("first"), F.count(flow).alias("rows"),
        mean(F.when((F.col("metric") == "diurnal_swing_pct") & (F.col("age") <= 7), F.col("value"))).alias("swing"),
    )
    trend = F.when(F.col("rows") < 4, None).when(F.col("flow") < F.col("first") * 0.92, "dropping").when(F.col("flow") > F.col("first") * 1.08, "rising").when(F.col("flow").isNotNull(), "steady")
    return out.select("slug", "eval_date", "flow", trend.alias("flow_trend"), rounded(F.col("swing"), 1).alias("swing"), F.coalesce(F.col("swing") >= 35, F.lit(False)).alias("active_melt"))


def status_of(severity: Column) -> Column:
    word = F.when(severity.isNull(), "unknown")
    for cut, name in zip(CUTS, STATUSES, strict=False):
        word = word.when(severity < cut, name)
    return word.otherwise(STATUSES[3])


def fused(places: DataFrame, dates: list[str], sensor: DataFrame, snow_line: DataFrame, satellite: DataFrame, human: DataFrame, worst: DataFrame, creek: DataFrame) -> DataFrame:
    """Severity, status with the overlay of fords, conflicts as sentences, score and confidence; places without evidence are unknown.

    The snow line counts only where no sensor does. All kinds are one long table, grouped once.
    """
    nothing = F.lit(None)

    def part(df: DataFrame, kind: str, **also: Column) -> DataFrame:
        columns = {"severity": nothing.cast("double"), "weight": nothing.cast("double"), "age": nothing.cast("int"), "n": nothing.cast("long"), "modeled": nothing.cast("boolean"), "word": nothing.cast("string"), "flow": nothing.cast("double")}
        return df.select("slug", "eval_date", F.lit(kind).alias("kind"), *((also[c] if c in also else columns[c]).alias(c) for c in columns))

    same = {c: F.col(c) for c in ("severity", "weight", "age")}
    parts = part(sensor, "sensor", **same)
    parts = parts.unionByName(part(snow_line, "snow_line", severity=F.col("severity"), weight=F.col("weight")))
    parts = parts.unionByName(part(satellite, "satellite", **same, modeled=F.col("modeled")))
    parts = parts.unionByName(part(human, "reports", **same, n=F.col("n_reports")))
    parts = parts.unionByName(part(worst, "worst", word=F.col("worst"))).unionByName(part(creek, "creek", flow=F.col("flow")))
    every = places.select(F.col("key").alias("slug"), F.explode(F.array(*(F.lit(d).cast("date") for d in dates))).alias("eval_date"))
    parts = parts.unionByName(part(every, "place"))

    def of(kind: str, c: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col(c)))

    wide = parts.groupBy("slug", "eval_date").agg(
        *(of(k, c).alias(f"{k}_{c}") for k in KINDS for c in ("severity", "weight", "age")),
        of("satellite", "modeled").alias("modeled"), of("reports", "n").alias("n_reports"), of("worst", "word").alias("worst"), of("creek", "flow").alias("flow"), of("place", "kind").alias("known"),
    ).filter("known is not null")
    return verdict(wide, "slug", "eval_date")


KINDS = ("sensor", "snow_line", "satellite", "reports")


def verdict(wide: DataFrame, *keys: str) -> DataFrame:
    """A05 to A08 of rows with ``keys`` and, for each of KINDS, severity, weight and age, null without evidence; modeled, n_reports, worst, flow."""
    kinds = KINDS
    for c in ("severity", "weight"):
        wide = wide.withColumn(f"snow_line_{c}", F.when(F.col("sensor_severity").isNull(), F.col(f"snow_line_{c}")))
    s = {k: F.col(f"{k}_severity") for k in kinds}
    total = sum((F.coalesce(F.col(f"{k}_weight"), F.lit(0.0)) for k in kinds), F.lit(0.0))
    severity = sum((F.coalesce(s[k] * F.col(f"{k}_weight"), F.lit(0.0)) for k in kinds), F.lit(0.0)) / F.nullif(total, F.lit(0.0))
    wide = wide.withColumn("severity", severity)
    status = F.when(F.col("severity").isNull(), "unknown").when(F.col("worst") == "dangerous", STATUSES[3])
    status = status.when((F.col("worst") == "thigh_high") & (F.col("severity") < CUTS[0]), STATUSES[1]).otherwise(status_of(F.col("severity")))
    scene = F.when(F.col("modeled"), "Modeled snow cover").otherwise("Satellite")
    names = {"sensor": (F.lit("Sensors"), "suggest", "do"), "snow_line": (F.lit("The snow line estimate"), "suggests", "does"), "satellite": (scene, "suggests", "does"), "reports": (F.lit("Parties on the ground"), "suggest", "do")}

    def sentence(hi: str, lo: str) -> Column:
        return F.concat(
            names[hi][0], F.lit(f" {names[hi][1]} more snow than "), F.lower(names[lo][0]), F.lit(f" {names[lo][2]} (severity "),
            F.format_string("%.1f", F.bround(s[hi], 1)), F.lit(" vs "), F.format_string("%.1f", F.bround(s[lo], 1)), F.lit(")."),
        )

    pairs = [(a, b) for i, a in enumerate(kinds) for b in kinds[i + 1 :]]
    conflicts = F.array_compact(F.array(*(F.when(F.abs(s[a] - s[b]) > 1.0, F.when(s[a] < s[b], sentence(b, a)).otherwise(sentence(a, b))) for a, b in pairs)))
    differ = F.coalesce(F.greatest(*(F.abs(s[a] - s[b]) for a, b in pairs)), F.lit(0.0))
    score = (
        F.when(s["sensor"].isNull(), 0.0).when(F.col("sensor_age") <= 2, 2.0).when(F.col("sensor_age") <= 7, 1.0).otherwise(0.5)
        + F.when(s["snow_line"].isNull(), 0.0).otherwise(0.5)
        + F.when(s["satellite"].isNull(), 0.0).when(F.col("satellite_age") <= 4, 1.5).otherwise(0.75)
        + F.when(F.col("n_reports").isNull(), 0.0).otherwise(F.least(F.lit(3.0), F.col("n_reports").cast("double")))
        + F.when(F.col("flow").isNull(), 0.0).otherwise(1.0)
        - F.when(differ > 1.5, 2.0).when(differ > 0.8, 1.0).otherwise(0.0)
    )
    score = F.when(F.col("severity").isNull(), 0.0).otherwise(score)
    grade = F.when(score >= 5, "high").when(score >= 2.5, "moderate").otherwise("low")
    return wide.select(*keys, F.round("severity", 2).alias("severity"), status.alias("status"), F.array_join(conflicts, " ").alias("conflicts"), F.round(score, 1).alias("score"), grade.alias("confidence"), "worst")


def severity_word(severity: Column) -> Column:
    """A severity in words."""
    words = ("little or no snow", "patchy snow", "continuous snow", "deep snow or serious hazards")
    out = F.when(severity < CUTS[0], words[0])
    for cut, word in zip(CUTS[1:], words[1:3], strict=True):
        out = out.when(severity < cut, word)
    return out.otherwise(words[3])


def facts(places: DataFrame, dates: list[str], sensor: DataFrame, snow_line: DataFrame, satellite: DataFrame, human: DataFrame, worst: DataFrame, creek: DataFrame, blind_ones: DataFrame, faults: DataFrame) -> DataFrame:
    """slug, eval_date, facts: what a verdict rests on, a sentence for each kind, as an array of (stream, text) in order.

    The snow line is told only where no sensor counts, blind stations only where no snow line is told. A
    place without snow evidence says so, and still tells of its creek and of faulty sensors. ``faults``: rows of
    ``faulty`` with the slug and ``station_ft``. All kinds are one long table, grouped once.
    """

    def whole(n: Column) -> Column:
        return F.format_number(F.bround(n.cast("double"), 0), 0)

    def part(df: DataFrame, kind: str, ord: int, stream: str, text: Column) -> DataFrame:
        return df.select("slug", "eval_date", F.lit(kind).alias("kind"), F.lit(ord).alias("ord"), F.lit(stream).alias("stream"), text.alias("text"))

    age = F.concat(F.col("age").cast("string"), F.lit("d"))
    melting = F.when(F.col("trend") < -0.15, ", melting fast").when(F.col("trend") < -0.02, ", melting steadily").otherwise("")
    read = F.concat(F.lit("Nearby snow sensors read "), F.col("swe").cast("string"), F.lit(" in of water in the snowpack"), melting, F.lit(" ("), age, F.lit(" old)."))
    percent = F.concat(F.bround(F.col("cover") * 100, 0).cast("long").cast("string"), F.lit("%"))
    shown = F.when(
        F.col("modeled"),
        F.concat(F.lit("Modeled snow cover is "), percent, F.lit(" in the pass bowl, worked out from a snow sensor reading "), age, F.lit(" ago; no satellite saw the pass.")),
    ).otherwise(F.concat(F.lit("Satellite shows "), percent, F.lit(" snow cover in the pass bowl, last clear look "), age, F.lit(" ago.")))
    parties = F.when(F.col("n_reports") == 1, " party").otherwise(" parties")
    said = F.concat(F.col("n_reports").cast("string"), parties, F.lit(" reported from this pass recently; calibrated read: "), severity_word(F.col("severity")), F.lit("."))
    ford = F.concat(F.lit("Worst reported crossing nearby: "), F.translate("worst", "_", " "), F.lit("."))
    pulse = F.when(F.col("active_melt"), " Strong afternoon melt pulse: flow rises through the day.").otherwise("")
    trend = F.coalesce(F.concat(F.lit(" and "), F.col("flow_trend")), F.lit(""))
    flow = F.concat(F.lit("The nearest creek gauge reads "), F.bround("flow", 0).cast("long").cast("string"), F.lit(" cfs"), trend, F.lit("."), pulse)
    quiet = (
        F.when(F.col("quiet_since").isNull(), "")
        .when(F.col("quiet_since") <= F.col("since"), " and stopped reporting")
        .otherwise(F.concat(F.lit(" and has been quiet since "), F.col("quiet_since").cast("string")))
    )
    top = F.col("hundreds") * 100 >= CEILING
    level = F.when(top, "above the highest terrain").otherwise(F.concat(F.lit("near "), whole(F.col("hundreds") * 100), F.lit(" ft")))
    tail = (
        F.when(F.col("severity") == 0, F.concat(F.when(top, "").otherwise(", above the pass"), F.lit(": likely melted out, though no sensor sees it directly.")))
        .when(F.col("severity") <= 0.5, ", close to the pass: expect lingering patches.")
        .otherwise(", still below the pass: expect snow up high.")
    )
    when = F.when(F.col("observed"), "on").otherwise("by")
    line = F.concat(
        F.col("station").cast("string"), F.lit(" ("), whole(F.col("station_ft")), F.lit(" ft) melted out "), when, F.lit(" "), F.col("since").cast("string"), quiet,
        F.lit(f"; at a typical {RISE:.0f} ft a day that puts the snowline estimate "), level, tail,
    )
    one = F.col("blind") == 1
    unseen = F.concat(
        F.when(one, "The nearest snow sensor has").otherwise("Snow sensors nearby have"), F.lit(" melted out, but "), F.col("named"), F.when(one, " sits").otherwise(" sit"), F.lit(" at least "),
        whole(F.col("min_gap_ft")), F.lit(" ft below the pass: "), F.when(one, "it cannot").otherwise("they cannot"), F.lit(" tell whether the pass still holds snow."),
    )
    where = F.concat(F.col("station").cast("string"), F.coalesce(F.concat(F.lit(" ("), whole(F.col("station_ft")), F.lit(" ft)")), F.lit("")))
    value = F.bround("value", 1).cast("string")
    broken = F.when(
        F.col("reason") == "ceiling",
        F.concat(where, F.lit(" reports "), value, F.lit(" in of water, more than any snowpack holds. It is left out as a sensor fault.")),
    ).otherwise(F.concat(where, F.lit(" has read "), value, F.lit(" in since "), F.col("since").cast("string"), F.lit(" without moving. A snowpack in melt season changes every day, so it is left out as a stuck sensor.")))
    every = places.select(F.col("key").alias("slug"), F.explode(F.array(*(F.lit(d).cast("date") for d in dates))).alias("eval_date"))
    parts = part(every, "place", 0, "none", F.lit(""))
    for more in (
        part(sensor, "sensor", 1, "sensor", read), part(satellite, "satellite", 2, "satellite", shown), part(human, "reports", 3, "report", said),
        part(worst, "worst", 4, "report", ford), part(creek.filter("flow is not null"), "creek", 5, "gauge", flow), part(snow_line, "snow_line", 6, "sensor", line),
        part(blind_ones, "blind", 7, "sensor", unseen), part(faults, "fault", 8, "sensor", broken),
    ):
        parts = parts.unionByName(more)
    told = parts.groupBy("slug", "eval_date").agg(F.array_sort(F.collect_list(F.struct("ord", "text", "stream", "kind"))).alias("all"))
    kinds = F.transform("all", lambda f: f["kind"])
    has = {k: F.array_contains(kinds, k) for k in ("place", "sensor", "satellite", "reports", "snow_line", "worst", "creek", "blind")}
    told = told.filter(has["place"])
    snow = has["snow_line"] & ~has["sensor"]
    present = has["sensor"] | has["satellite"] | has["reports"] | snow
    nothing = F.when(has["worst"] | has["creek"], "No recent snow evidence for this pass.").otherwise("No recent evidence for this pass in any stream.")
    kept = F.filter(
        "all",
        lambda f: F.when(f["kind"] == "place", ~present & ~has["blind"]).when(f["kind"] == "snow_line", snow).when(f["kind"] == "blind", ~snow).otherwise(F.lit(True)),
    )
    # Without snow evidence blind stations come first.
    moved = F.transform(kept, lambda f: F.struct(F.when(~present & (f["kind"] == "blind"), 0).otherwise(f["ord"]).alias("ord"), f["stream"].alias("stream"), F.when(f["kind"] == "place", nothing).otherwise(f["text"]).alias("text")))
    return told.select("slug", "eval_date", F.transform(F.array_sort(moved), lambda f: F.struct(f["stream"].alias("stream"), f["text"].alias("text"))).alias("facts"))
