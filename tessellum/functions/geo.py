"""Coordinates as column expressions: projection, distances, codes and bearings."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
# The ellipsoid GRS80.
A, INVERSE_FLATTENING = 6378137.0, 298.257222101


def haversine(lon0: Column, lat0: Column, lon1: Column, lat1: Column, radius: float = EARTH_KM) -> Column:
    p0, p1 = F.radians(lat0), F.radians(lat1)
    h = F.pow(F.sin((p1 - p0) / 2), 2) + F.cos(p0) * F.cos(p1) * F.pow(F.sin(F.radians(lon1 - lon0) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(h))


def transverse_mercator(lon: Column, lat: Column, *, lon0: float, lat0: float, scale: float = 0.9999) -> tuple[Column, Column]:
    """(easting, northing) by the series in the third flattening to its fourth order."""
    n = 1 / (2 * INVERSE_FLATTENING - 1)
    alpha = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    ]
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64) * scale
    e = 2 * math.sqrt(n) / (1 + n)

    def conformal(phi: float) -> float:
        return math.sinh(math.atanh(math.sin(phi)) - e * math.atanh(e * math.sin(phi)))

    xi0 = math.atan(conformal(math.radians(lat0)))
    meridian = radius * (xi0 + sum(a * math.sin(2 * (j + 1) * xi0) for j, a in enumerate(alpha)))
    s, d = F.sin(F.radians(lat)), F.radians(lon - lon0)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(alpha):
        k = 2 * (j + 1)
        x = x + a * F.cos(k * xi) * F.sinh(k * eta)
        y = y + a * F.sin(k * xi) * F.cosh(k * eta)
    return radius * x, radius * y - meridian


def tile_xy(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    n = float(1 << zoom)
    phi = F.radians(lat)
    y = (1 - F.ln(F.tan(phi) + 1 / F.cos(phi)) / math.pi) / 2
    return F.floor((lon + 180) / 360 * n), F.floor(y * n)


def mesh_code(lon: Column, lat: Column) -> Column:
    """The 250 m mesh code of ten digits: 40' x 1 degree, eighths, tenths, halves and halves again."""
    a, b = lat * 1.5, lon - 100
    p, u = F.floor(a), F.floor(b)
    a, b = (a - p) * 8, (b - u) * 8
    q, v = F.floor(a), F.floor(b)
    a, b = (a - q) * 10, (b - v) * 10
    r, w = F.floor(a), F.floor(b)
    a, b = (a - r) * 2, (b - w) * 2
    m = F.floor(a) * 2 + F.floor(b) + 1
    a, b = (a - F.floor(a)) * 2, (b - F.floor(b)) * 2
    h = F.floor(a) * 2 + F.floor(b) + 1
    return F.concat(*[F.lpad(x.cast("string"), k, "0") for x, k in ((p, 2), (u, 2), (q, 1), (v, 1), (r, 1), (w, 1), (m, 1), (h, 1))])


def bearing(dx: Column, dy: Column) -> Column:
    """Degrees clockwise from north, 0 to 360."""
    return F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0))


def axial_difference(a: Column, b: Column, period: float = 180.0) -> Column:
    d = F.pmod(a - b, F.lit(period))
    return F.least(d, period - d)


def segment_distance(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    dx, dy = x1 - x0, y1 - y0
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - x0) * dx + (py - y0) * dy) / size))).otherwise(0.0)
    return F.hypot(px - (x0 + t * dx), py - (y0 + t * dy))
