"""Positions: great-circle distance, rings, compass."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
KM_PER_DEGREE = 110.0
COMPASS = ("north", "northeast", "east", "southeast", "south", "southwest", "west", "northwest")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    """Great-circle distance."""
    half = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(half))


def in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Ray cast: an edge counts if exactly one end is above the point. ``ring``: array<struct<lon,lat>>, closed."""
    edges = F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def crossed(odd: Column, e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (a["lat"] > lat) != (b["lat"] > lat)
        at = a["lon"] + (lat - a["lat"]) * (b["lon"] - a["lon"]) / F.when(spans, b["lat"] - a["lat"])
        return F.when(spans & (lon < at), ~odd).otherwise(odd)

    return F.aggregate(edges, F.lit(False), crossed)


def ring_km(lon: Column, lat: Column, ring: Column) -> Column:
    """Distance to the nearest edge of a closed ring, on the plane at the point's latitude."""
    x = lambda p: (p["lon"] - lon) * 111.320 * F.cos(F.radians(lat))
    y = lambda p: (p["lat"] - lat) * 110.574
    n = F.size(ring) - 1

    def away(a: Column, b: Column) -> Column:
        dx, dy = x(b) - x(a), y(b) - y(a)
        length = dx * dx + dy * dy
        along = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(x(a) * dx + y(a) * dy) / length))).otherwise(0.0)
        return F.hypot(x(a) + along * dx, y(a) + along * dy)

    return F.array_min(F.zip_with(F.slice(ring, F.lit(1), n), F.slice(ring, F.lit(2), n), away))


def octagon(lat: Column, lon: Column, radius_m: float) -> Column:
    """Closed ring of eight points round a position."""
    per_degree = 111_320.0
    point = lambda i: F.struct(
        (lon + radius_m * F.cos(i % 8 * (math.pi / 4)) / (per_degree * F.cos(F.radians(lat)))).alias("lon"),
        (lat + radius_m * F.sin(i % 8 * (math.pi / 4)) / per_degree).alias("lat"),
    )
    return F.transform(F.sequence(F.lit(0), F.lit(8)), point)


def ring_area_km2(ring: Column) -> Column:
    """Shoelace on the plane at the ring's first latitude."""
    x = lambda p: p["lon"] * 111.320 * F.cos(F.radians(ring[0]["lat"]))
    y = lambda p: p["lat"] * 110.574
    n = F.size(ring) - 1
    cross = F.zip_with(F.slice(ring, F.lit(1), n), F.slice(ring, F.lit(2), n), lambda a, b: x(a) * y(b) - x(b) * y(a))
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2


def ring_bounds(ring: Column) -> Column:
    """west, south, east, north of a ring; null of one without points."""
    of = lambda f, field: f(F.transform(ring, lambda p: p[field]))
    return F.when(
        F.size(ring) > 0,
        F.struct(of(F.array_min, "lon").alias("west"), of(F.array_min, "lat").alias("south"), of(F.array_max, "lon").alias("east"), of(F.array_max, "lat").alias("north")),
    )


def compass(bearing: Column) -> Column:
    """One of eight directions."""
    sector = F.pmod(F.bround(F.pmod(bearing, F.lit(360)) / 45), F.lit(8)).cast("int")
    return F.element_at(F.array(*map(F.lit, COMPASS)), sector + 1)
