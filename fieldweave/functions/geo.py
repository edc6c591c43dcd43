"""Earth geometry as column expressions (WGS84); rings are arrays of structs."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .keys import _c
from .series import bind

# Fixed values of the WGS84 ellipsoid and of UTM.
A = 6_378_137.0
FLAT = 1 / 298.257223563
E2 = FLAT * (2 - FLAT)
K0 = 0.9996
FALSE_EAST = 500_000.0
FALSE_NORTH = 10_000_000.0
AREA_ZONE = 35

_N = FLAT / (2 - FLAT)
_RECT = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_FWD = [
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
]
_INV = [
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
]
_LAT = [
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
]
_ECC = 2 * math.sqrt(_N) / (1 + _N)


def utm_zone(lon) -> Column:
    return (F.floor((_c(lon) + 180.0) / 6.0) + 1).cast("int")


def utm_epsg(lon, lat) -> Column:
    return F.when(_c(lat) >= 0, 32600).otherwise(32700) + utm_zone(lon)


def _total(terms) -> Column:
    out = None
    for t in terms:
        out = t if out is None else out + t
    return out


def _conformal(lon: Column, lat: Column, z: Column) -> tuple[Column, Column]:
    """(tangent of the conformal latitude, longitude from the middle of the zone)."""
    sp = F.sin(F.radians(lat))
    return F.sinh(F.atanh(sp) - F.lit(_ECC) * F.atanh(F.lit(_ECC) * sp)), F.radians(lon - (z * 6.0 - 183.0))


def _sphere(t: Column, dl: Column) -> tuple[Column, Column]:
    """(xi, eta)"""
    return F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1.0 + t * t))


def _series_xy(xi: Column, eta: Column, s: Column) -> tuple[Column, Column]:
    """(easting, northing)"""
    x = eta + _total(a * F.cos(2.0 * j * xi) * F.sinh(2.0 * j * eta) for j, a in enumerate(_FWD, 1))
    y = xi + _total(a * F.sin(2.0 * j * xi) * F.cosh(2.0 * j * eta) for j, a in enumerate(_FWD, 1))
    return F.lit(K0 * _RECT) * x + FALSE_EAST, F.lit(K0 * _RECT) * y + F.when(s, FALSE_NORTH).otherwise(0.0)


def to_utm(lon, lat, zone: Column | int, south: Column | bool = True) -> tuple[Column, Column]:
    """(easting, northing) in metres, transverse Mercator by the Krueger series to fourth order."""
    z = F.lit(zone) if isinstance(zone, int) else zone
    s = F.lit(south) if isinstance(south, bool) else south
    return _series_xy(*_sphere(*_conformal(_c(lon), _c(lat), z)), s)


def from_utm(x, y, zone: Column | int, south: Column | bool = True) -> tuple[Column, Column]:
    """(lon, lat) in degrees."""
    z = F.lit(zone) if isinstance(zone, int) else zone
    s = F.lit(south) if isinstance(south, bool) else south
    eta = (_c(x) - FALSE_EAST) / (K0 * _RECT)
    xi = (_c(y) - F.when(s, FALSE_NORTH).otherwise(0.0)) / (K0 * _RECT)
    xi2 = xi - _total(b * F.sin(2.0 * j * xi) * F.cosh(2.0 * j * eta) for j, b in enumerate(_INV, 1))
    eta2 = eta - _total(b * F.cos(2.0 * j * xi) * F.sinh(2.0 * j * eta) for j, b in enumerate(_INV, 1))
    chi = F.asin(F.sin(xi2) / F.cosh(eta2))
    phi = chi + _total(d * F.sin(2.0 * j * chi) for j, d in enumerate(_LAT, 1))
    return F.degrees(F.atan2(F.sinh(eta2), F.cos(xi2))) + (z * 6.0 - 183.0), F.degrees(phi)


def geodesic_box(lat, lon, half_side_km: float = 0.5) -> Column:
    """Struct(south, west, north, east) half a side away along the ellipsoid.

    North and south follow the meridian to second order, east and west the prime
    vertical; at half a kilometre what is left out is below a millimetre.
    """
    phi = F.radians(_c(lat))
    d = half_side_km * 1000.0
    sp, cp = F.sin(phi), F.cos(phi)
    w = 1.0 - E2 * sp * sp
    u = d * w * F.sqrt(w) / (A * (1 - E2))
    bend = u * u * (1.5 * E2) * sp * cp / w
    v = d * F.sqrt(w) / A
    tp = sp / cp
    east = v / cp * (1.0 - v * v * tp * tp / 3.0)
    return F.struct(
        F.degrees(phi - u - bend).alias("south"), (_c(lon) - F.degrees(east)).alias("west"),
        F.degrees(phi + u - bend).alias("north"), (_c(lon) + F.degrees(east)).alias("east"))


def point(lon: Column, lat: Column) -> Column:
    return F.struct(lon.cast("double").alias("lon"), lat.cast("double").alias("lat"))


def box_ring(box) -> Column:
    """SW, SE, NE, NW, SW."""
    b = _c(box)
    return F.array(point(b["west"], b["south"]), point(b["east"], b["south"]), point(b["east"], b["north"]),
                   point(b["west"], b["north"]), point(b["west"], b["south"]))


def ring_geojson(ring) -> Column:
    coords = F.array(F.transform(_c(ring), lambda p: F.array(p["lon"], p["lat"])))
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), coords.alias("coordinates")))


def metric_box(lon, lat, size_m: float = 1000.0) -> Column:
    """Struct(minx, miny, maxx, maxy) in degrees of a square in UTM metres around the point."""
    zone, south = utm_zone(lon), _c(lat) < 0
    x, y = to_utm(lon, lat, zone, south)
    h = size_m / 2

    def corners(p):
        a, b = from_utm(p["x"] - h, p["y"] - h, p["z"], p["s"]), from_utm(p["x"] + h, p["y"] + h, p["z"], p["s"])
        return F.struct(a[0].alias("minx"), a[1].alias("miny"), b[0].alias("maxx"), b[1].alias("maxy"))

    return bind(F.struct(x.alias("x"), y.alias("y"), zone.alias("z"), south.alias("s")), corners)


def centred_grid(lon, lat, cells: int = 334, cell_m: float = 3.0) -> Column:
    """Struct(x0, y0, cell, height, width): top left corner of a grid centred on the point."""
    zone, south = utm_zone(lon), _c(lat) < 0
    x, y = to_utm(lon, lat, zone, south)
    half = cells * cell_m / 2.0
    return F.struct((x - half).alias("x0"), (y + half).alias("y0"), F.lit(float(cell_m)).alias("cell"), F.lit(cells).alias("height"), F.lit(cells).alias("width"))


def ring_to_utm(ring, zone: int = AREA_ZONE) -> Column:
    """Ring of (lon, lat) to a ring of (x, y) metres; always one zone, as areas are compared.

    One transform a step of ``to_utm``: within one lambda, what a step uses several times would be computed anew each time.
    """
    pair = lambda values, *names: F.struct(*(v.alias(n) for v, n in zip(values, names, strict=True)))
    a = F.transform(_c(ring), lambda p: pair(_conformal(p["lon"], p["lat"], F.lit(zone)), "t", "dl"))
    b = F.transform(a, lambda p: pair(_sphere(p["t"], p["dl"]), "xi", "eta"))
    return F.transform(b, lambda p: pair(_series_xy(p["xi"], p["eta"], F.lit(True)), "x", "y"))


def ring_xy(ring) -> Column:
    """The same ring with x, y field names, still in degrees."""
    return F.transform(_c(ring), lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))


def shoelace(xy) -> Column:
    """Area of a ring of (x, y), whatever its direction, closed or not."""
    def area(r):
        nxt = F.concat(F.slice(r, 2, F.size(r)), F.slice(r, 1, 1))
        twice = F.aggregate(
            F.zip_with(r, nxt, lambda a, b: (a["x"] - r[0]["x"]) * (b["y"] - r[0]["y"]) - (b["x"] - r[0]["x"]) * (a["y"] - r[0]["y"])),
            F.lit(0.0), lambda acc, v: acc + v)
        return F.abs(twice) / 2.0

    return bind(_c(xy), area)


def clipped(xy, axis: str, limit, keep_above: bool) -> Column:
    """The part of a ring on one side of a line ``axis`` = ``limit``: each edge gives its crossing with the line and its end, where they are on that side.

    One step a vertex. The part of a ring with a dent may run back along the line, which changes no area.
    """
    at = _c(limit)
    inside = (lambda p: p[axis] >= at) if keep_above else (lambda p: p[axis] <= at)

    def corners(a, b):
        t = F.try_divide(at - a[axis], b[axis] - a[axis])
        crossing = F.struct(*[(at if c == axis else a[c] + (b[c] - a[c]) * t).cast("double").alias(c) for c in ("x", "y")])
        end = F.struct(b["x"].cast("double").alias("x"), b["y"].cast("double").alias("y"))
        return F.filter(F.array(F.when(inside(a) != inside(b), crossing), F.when(inside(b), end)), lambda p: p.isNotNull())

    return bind(_c(xy), lambda r: F.flatten(F.zip_with(r, F.concat(F.slice(r, 2, F.size(r)), F.slice(r, 1, 1)), corners)))


def clipped_to_box(xy, west, south, east, north) -> Column:
    """The part of a ring inside a box; empty if there is none."""
    part = clipped(xy, "x", west, True)
    for axis, limit, above in (("x", east, False), ("y", south, True), ("y", north, False)):
        part = clipped(part, axis, limit, above)
    return part


def _edges(r: Column) -> Column:
    """Array of (x1, y1, x2, y2), the last edge closing the ring."""
    nxt = F.concat(F.slice(r, 2, F.size(r)), F.slice(r, 1, 1))
    return F.zip_with(r, nxt, lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))


def crossings(xy, y) -> Column:
    """Sorted x where the ring crosses the horizontal line; even count, so they pair into spans."""
    line = _c(y)
    hit = F.filter(_edges(_c(xy)), lambda e: (e["y1"] <= line) != (e["y2"] <= line))
    return F.array_sort(F.transform(hit, lambda e: e["x1"] + (line - e["y1"]) * (e["x2"] - e["x1"]) / (e["y2"] - e["y1"])))


def contains(xy, x, y) -> Column:
    """Even-odd test of a point."""
    right = F.size(F.filter(crossings(xy, y), lambda c: c > _c(x)))
    return right % 2 == 1


def overlaps_box(xy, west, south, east, north) -> Column:
    """True when the ring and the box share any point: an edge enters the box, or the box lies inside the ring."""
    w, s, e, n = (_c(v) for v in (west, south, east, north))

    def enters(g):
        dx, dy = g["x2"] - g["x1"], g["y2"] - g["y1"]

        def near_far(d, a, lo, hi):
            t1, t2 = F.try_divide(lo - a, d), F.try_divide(hi - a, d)
            flat_ok = (a >= lo) & (a <= hi)
            return (F.when(d != 0, F.least(t1, t2)).otherwise(F.when(flat_ok, 0.0).otherwise(2.0)),
                    F.when(d != 0, F.greatest(t1, t2)).otherwise(F.when(flat_ok, 1.0).otherwise(-1.0)))

        ax, bx = near_far(dx, g["x1"], w, e)
        ay, by = near_far(dy, g["y1"], s, n)
        return F.greatest(ax, ay, F.lit(0.0)) <= F.least(bx, by, F.lit(1.0))

    return F.exists(_edges(_c(xy)), enters) | contains(xy, (w + e) / 2.0, (s + n) / 2.0)
