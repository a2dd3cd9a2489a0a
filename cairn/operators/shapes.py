"""Polygons of fires thinned, samples inside polygons counted, cover modelled from a station."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .conditions import BARE, is_blind
from .links import zones_of

#: Metres a degree of latitude; index of snow and most cloud of a scene; days between scenes, inches of
#: water a thousand feet, inches of full cover.
METRES, SNOWY, CLOUDY = 111_320.0, 0.4, 0.4
REVISIT, LAPSE, FULL = 3, 4.0, 20.0


def kept_points(x: np.ndarray, y: np.ndarray, tolerance: float, fixed: list[int]) -> np.ndarray:
    """Places of the points of a line that simplification keeps (Douglas and Peucker), given some that stay.

    All open stretches are looked at together: each point's distance to its stretch's chord,
    the farthest of each stretch, and those beyond the tolerance split it. Rounds go on until none does.
    """
    kept = np.array(sorted(set(fixed)))
    while True:
        of = np.clip(np.searchsorted(kept, np.arange(len(x)), "right") - 1, 0, len(kept) - 2)
        a, b = kept[of], kept[of + 1]
        dx, dy = x[b] - x[a], y[b] - y[a]
        square = dx * dx + dy * dy
        along = np.where(square > 0, ((x - x[a]) * dx + (y - y[a]) * dy) / np.where(square > 0, square, 1), 0)
        along = np.clip(along, 0, 1)
        away = (x - x[a] - along * dx) ** 2 + (y - y[a] - along * dy) ** 2
        away[kept] = -1
        order = np.lexsort((np.arange(len(x)), -away, of))
        first = order[np.append(True, of[order][1:] != of[order][:-1])]
        far = first[away[first] > tolerance * tolerance]
        if not len(far):
            return kept
        kept = np.sort(np.concatenate((kept, far)))


def thinned(rings: DataFrame, tolerance_m: float = 60, decimals: int = 4) -> DataFrame:
    """rings (array of lon, lat), closed and thinned to a tolerance in metres; null if nothing is left to enclose.

    A closed ring has no chord, so its first point and the one farthest from it stay. One ring is a row's
    own array; rows are dealt out as they lie.
    """

    @F.pandas_udf("array<struct<lon:double,lat:double>>")
    def thin(column: pd.Series) -> pd.Series:
        return column.map(lambda ring: None if ring is None else _thin(ring, tolerance_m, decimals))

    return rings.withColumn("ring", thin("ring"))


def _thin(ring: list, tolerance_m: float, decimals: int) -> list[dict] | None:
    lon, lat = (np.array([p[c] for p in ring], float) for c in ("lon", "lat"))
    if len(lon) >= 2 and (lon[0], lat[0]) != (lon[-1], lat[-1]):
        lon, lat = np.append(lon, lon[0]), np.append(lat, lat[0])
    if len(lon) < 4:
        return None
    squash = np.cos(np.radians(lat.mean()))
    x = lon * squash
    far = int(np.argmax((x - x[0]) ** 2 + (lat - lat[0]) ** 2))
    if far == 0:
        return None
    at = kept_points(x, lat, tolerance_m / METRES, [0, far, len(x) - 1])
    points = [(round(float(a), decimals), round(float(b), decimals)) for a, b in zip(lon[at], lat[at], strict=True)]
    points = [p for i, p in enumerate(points) if i == 0 or p != points[i - 1]]
    flat = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:], strict=False))
    if len(points) < 4 or points[0] != points[-1] or flat == 0:
        return None
    return [{"lon": a, "lat": b} for a, b in points]


def sampled_cover(samples: DataFrame, zones: DataFrame) -> DataFrame:
    """Zone, cover, cloud, n of samples (key, lat, lon, index, cloudy) inside zones; scenes too cloudy have no row."""
    held = zones_of(samples, zones).select("key", "zone").join(samples.select("key", "index", "cloudy"), "key")
    clear = F.count_if(~F.col("cloudy"))
    out = held.groupBy("zone").agg(F.count("*").alias("n"), (F.count_if("cloudy") / F.count("*")).alias("cloud"), (F.count_if(~F.col("cloudy") & (F.col("index") >= SNOWY)) / F.nullif(clear, F.lit(0))).alias("cover"))
    return out.filter(F.col("cloud") <= CLOUDY).select("zone", F.round("cover", 3).alias("cover"), F.round("cloud", 3).alias("cloud"), "n")


def cover_of(value: Column, gap_ft: Column) -> Column:
    """Share of a place under snow by a station's water, with more of it the higher the place lies above."""
    bonus = F.greatest(gap_ft / 1000, F.lit(0.0)) * LAPSE
    more = F.when(value > BARE, bonus).when(value > 0, bonus * value / BARE).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value + more) / FULL)), 3)


def modelled_scenes(daily: DataFrame, linked: DataFrame, faulty: DataFrame) -> DataFrame:
    """Slug, day, cover, station of every third reading of the nearest station of a place that has readings.

    ``linked``: slug, station, km, gap_ft; ``faulty``: station, day. Faulty days, blind readings and days under
    cloud (three of ten, by a digest of place and day) give no scene and do not shift the cycle.
    """
    has = linked.join(daily.select("station").distinct(), "station", "left_semi")
    nearest = has.groupBy("slug").agg(F.min_by(F.struct("station", "gap_ft"), F.struct("km", "station")).alias("n")).select("slug", "n.*")
    turn = F.row_number().over(Window.partitionBy("station").orderBy("day"))
    series = daily.withColumn("turn", turn).filter((F.col("turn") - 1) % REVISIT == 0).join(faulty.select("station", "day").distinct(), ["station", "day"], "left_anti")
    met = series.join(nearest, "station").filter(~is_blind(F.col("value"), F.col("gap_ft")))
    digest = F.sha2(F.concat(F.col("slug").cast("string"), F.lit(":"), F.col("day").cast("string")).cast("binary"), 256)
    cloudy = F.conv(F.left(digest, F.lit(2)), 16, 10).cast("int") % 10 < 3
    return met.filter(~cloudy).select("slug", "day", cover_of(F.col("value"), F.coalesce("gap_ft", F.lit(0.0))).alias("cover"), "station")
