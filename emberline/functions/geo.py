"""Geometry as native column expressions: points are lat and lon doubles, rings are arrays of struct<x, y>."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
_A, _E2 = 6_378_137.0, 0.0066943799901413165
_E = _E2**0.5
#: Scale of the equal-area cylinder at 30 degrees.
_K0 = 0.8667510025721987
METRES_PER_DEGREE = 111_320.0


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    a, b, c, d = (F.radians(_c(v)) for v in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((c - a) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def equal_area_xy(lat, lon) -> tuple[Column, Column]:
    """Metres on the global equal-area cylinder with standard parallels at 30 degrees."""
    s = F.sin(F.radians(_c(lat)))
    q = (1 - _E2) * (s / (1 - _E2 * s * s) - F.log((1 - _E * s) / (1 + _E * s)) / (2 * _E))
    return _A * _K0 * F.radians(_c(lon)), _A * q / (2 * _K0)


def cell_key(lat, lon, size_m: float = 1000.0) -> Column:
    x, y = equal_area_xy(lat, lon)
    return F.concat_ws("_", F.floor(x / size_m).cast("string"), F.floor(y / size_m).cast("string"))


def mercator_distance_m(lat1, lon1, lat2, lon2) -> Column:
    """Straight distance on web Mercator, which stretches with 1 / cos(lat)."""

    def y(lat: Column) -> Column:
        return _A * F.log(F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2))

    return F.hypot(_A * (F.radians(_c(lon2)) - F.radians(_c(lon1))), y(_c(lat2)) - y(_c(lat1)))


def planar_m(lat1, lon1, lat2, lon2, per_lat: float = METRES_PER_DEGREE) -> Column:
    """Equirectangular metres about the first point."""
    dy = (_c(lat2) - _c(lat1)) * per_lat
    dx = (_c(lon2) - _c(lon1)) * METRES_PER_DEGREE * F.cos(F.radians(_c(lat1)))
    return F.hypot(dx, dy)


def extent_m(lat: str, lon: str, per_lat: float = METRES_PER_DEGREE) -> Column:
    """Aggregate: diagonal of the box around a group's points. per_lat differs between the two users of it."""
    dy = (F.max(lat) - F.min(lat)) * per_lat
    dx = (F.max(lon) - F.min(lon)) * METRES_PER_DEGREE * F.cos(F.radians(F.avg(lat)))
    return F.hypot(dx, dy)


def _edges(ring: Column) -> Column:
    return F.zip_with(ring, F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)), lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def ring_area(ring: Column) -> Column:
    """Signed shoelace area in square units of the coordinates."""
    return F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + (e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"])) / 2


def ring_area_m2(ring: Column) -> Column:
    """Area of a lon/lat ring on a local equirectangular plane."""
    middle = F.aggregate(ring, F.lit(0.0), lambda s, p: s + p["y"]) / F.size(ring)
    return F.abs(ring_area(ring)) * METRES_PER_DEGREE * METRES_PER_DEGREE * F.cos(F.radians(middle))


def ring_centroid(ring: Column) -> Column:
    def total(axis: str) -> Column:
        return F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + (e["p"][axis] + e["q"][axis]) * (e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"]))

    a = 6 * ring_area(ring)
    return F.struct((total("x") / a).alias("x"), (total("y") / a).alias("y"))


def ring_bounds(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def ring_valid(ring: Column) -> Column:
    """Closed, four points or more, an area, and inside the globe."""
    b = ring_bounds(ring)
    closed = (F.element_at(ring, 1)["x"] == F.element_at(ring, -1)["x"]) & (F.element_at(ring, 1)["y"] == F.element_at(ring, -1)["y"])
    return F.when(F.size(ring) < 4, False).otherwise(closed & (ring_area(ring) != 0) & (b["xmin"] >= -180) & (b["xmax"] <= 180) & (b["ymin"] >= -90) & (b["ymax"] <= 90))


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Ray casting by even crossings."""

    def crossing(e: Column) -> Column:
        p, q = e["p"], e["q"]
        at = p["x"] + (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)) * (q["x"] - p["x"])
        return ((p["y"] > y) != (q["y"] > y)) & (x < at)

    return F.aggregate(_edges(ring), F.lit(False), lambda s, e: s != F.coalesce(crossing(e), F.lit(False)))


def in_polygon(x: Column, y: Column, rings: Column) -> Column:
    """rings: outer ring and holes, in any order; inside an odd number of them."""
    return F.aggregate(rings, F.lit(False), lambda s, r: s != in_ring(x, y, r))


def equivalent_radius_m(ring: Column) -> Column:
    return F.sqrt(ring_area_m2(ring) / 3.141592653589793)


def in_box(lat, lon, south: float, west: float, north: float, east: float) -> Column:
    return _c(lat).between(south, north) & _c(lon).between(west, east)


def geohash(lat: Column, lon: Column, precision: int = 4) -> Column:
    """Base-32 geohash from the interleaved bits of the two halvings."""
    bits = 5 * precision
    nlon, nlat = (bits + 1) // 2, bits // 2
    x = F.least(F.floor((lon + 180) / 360 * (1 << nlon)), F.lit((1 << nlon) - 1)).cast("long")
    y = F.least(F.floor((lat + 90) / 180 * (1 << nlat)), F.lit((1 << nlat) - 1)).cast("long")
    letters = F.lit("0123456789bcdefghjkmnpqrstuvwxyz")
    out = []
    for k in range(precision):
        value = F.lit(0).cast("long")
        for b in range(5 * k, 5 * k + 5):
            source, at = (x, nlon - 1 - b // 2) if b % 2 == 0 else (y, nlat - 1 - b // 2)
            value = value * 2 + F.shiftright(source, at).bitwiseAND(F.lit(1).cast("long"))
        out.append(F.substring(letters, (value + 1).cast("int"), F.lit(1)))
    return F.concat(*out)


def _turn(p: Column, q: Column, r: Column) -> Column:
    return (q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"])


def self_crossing(ring: Column) -> Column:
    """Whether two sides cross inside both."""
    sides = _edges(ring)

    def crossing(e: Column, f: Column) -> Column:
        return (_turn(e["p"], e["q"], f["p"]) * _turn(e["p"], e["q"], f["q"]) < 0) & (_turn(f["p"], f["q"], e["p"]) * _turn(f["p"], f["q"], e["q"]) < 0)

    return F.exists(sides, lambda e: F.exists(sides, lambda f: crossing(e, f)))


def repaired_ring(ring: Column) -> Column:
    """The ring without missing and repeated points, closed; null where that gives no valid ring or its sides cross."""
    there = F.filter(ring, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    apart = F.filter(there, lambda p, i: (i == 0) | (p != F.get(there, i - 1)))
    closed = F.when(F.get(apart, F.lit(0)) == F.element_at(apart, -1), apart).otherwise(F.concat(apart, F.slice(apart, 1, 1)))
    return F.when(F.size(apart) >= 3, F.when(ring_valid(closed) & ~self_crossing(closed), closed))


def _simplified(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points of a line stay: ends, and of each stretch the farthest one from its chord, where over the tolerance."""
    keep = np.zeros(len(x), bool)
    keep[[0, -1]] = True
    todo = [(0, len(x) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        dx, dy = x[b] - x[a], y[b] - y[a]
        px, py = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a]
        length = math.hypot(dx, dy)
        away = np.abs(dx * py - dy * px) / length if length else np.hypot(px, py)
        k = int(away.argmax())
        if away[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return keep


def simplified(points: Column, tolerance: float) -> Column:
    """A line or ring with fewer points, none of those left out farther than the tolerance from the new line."""

    def run(values: pd.Series) -> pd.Series:
        def one(v):
            if v is None or len(v) < 3:
                return v
            keep = _simplified(np.array([p["x"] for p in v]), np.array([p["y"] for p in v]), tolerance)
            return [p for p, k in zip(v, keep, strict=True) if k]

        return values.map(one)

    return F.pandas_udf(run, "array<struct<x:double,y:double>>")(points)


_UTM_K, _E4, _E6 = 0.9996, _E2 * _E2, _E2**3
_EP2 = _E2 / (1 - _E2)


def utm_zone(lon) -> Column:
    return (F.floor((_c(lon) + 180) / 6) + 1).cast("int")


def utm_xy(lat, lon, zone: Column) -> tuple[Column, Column]:
    """Easting and northing, by the usual series of the transverse Mercator projection; northern hemisphere."""
    phi, lam = F.radians(_c(lat)), F.radians(_c(lon) - (zone * 6 - 183))
    s, c, t = F.sin(phi), F.cos(phi), F.pow(F.tan(phi), 2)
    n, cc, a = _A / F.sqrt(1 - _E2 * s * s), _EP2 * c * c, lam * c
    m = _A * ((1 - _E2 / 4 - 3 * _E4 / 64 - 5 * _E6 / 256) * phi - (3 * _E2 / 8 + 3 * _E4 / 32 + 45 * _E6 / 1024) * F.sin(2 * phi) + (15 * _E4 / 256 + 45 * _E6 / 1024) * F.sin(4 * phi) - 35 * _E6 / 3072 * F.sin(6 * phi))
    east = _UTM_K * n * (a + (1 - t + cc) * F.pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * cc - 58 * _EP2) * F.pow(a, 5) / 120) + 500_000
    north = _UTM_K * (m + n * F.tan(phi) * (a * a / 2 + (5 - t + 9 * cc + 4 * cc * cc) * F.pow(a, 4) / 24 + (61 - 58 * t + t * t + 600 * cc - 330 * _EP2) * F.pow(a, 6) / 720))
    return east, north


def utm_inverse(east, north, zone: Column) -> tuple[Column, Column]:
    """Latitude and longitude of easting and northing; northern hemisphere."""
    e1 = (1 - math.sqrt(1 - _E2)) / (1 + math.sqrt(1 - _E2))
    mu = _c(north) / _UTM_K / (_A * (1 - _E2 / 4 - 3 * _E4 / 64 - 5 * _E6 / 256))
    phi = mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + 151 * e1**3 / 96 * F.sin(6 * mu) + 1097 * e1**4 / 512 * F.sin(8 * mu)
    s, c, t = F.sin(phi), F.cos(phi), F.pow(F.tan(phi), 2)
    w = 1 - _E2 * s * s
    n, r, cc = _A / F.sqrt(w), _A * (1 - _E2) / F.pow(w, 1.5), _EP2 * c * c
    d = (_c(east) - 500_000) / (n * _UTM_K)
    lat = phi - n * F.tan(phi) / r * (d * d / 2 - (5 + 3 * t + 10 * cc - 4 * cc * cc - 9 * _EP2) * F.pow(d, 4) / 24 + (61 + 90 * t + 298 * cc + 45 * t * t - 252 * _EP2 - 3 * cc * cc) * F.pow(d, 6) / 720)
    lon = (d - (1 + 2 * t + cc) * F.pow(d, 3) / 6 + (5 - 2 * cc + 28 * t - 3 * cc * cc + 8 * _EP2 + 24 * t * t) * F.pow(d, 5) / 120) / c
    return F.degrees(lat), F.degrees(lon) + (zone * 6 - 183)
