"""Closed-form coordinate reference systems, and distances.

Supported without a projection library: longitude/latitude (EPSG:4326 and any "+proj=longlat" string)
and Web Mercator (EPSG:3857, "+proj=merc" with a=b), with vertical units of metres, feet or kilometres.
Others raise ``UnsupportedCRS``.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT = "+proj=longlat +datum=WGS84 +no_defs +vunits=m"
RADIUS, FLATTENING = 6378137.0, 1 / 298.257223563
MEAN_RADIUS = 6371008.8
#: Metres in a unit.
METRES = {"m": 1.0, "metre": 1.0, "meter": 1.0, "km": 1000.0, "kilometer": 1000.0, "ft": 0.3048, "foot": 0.3048, "us-ft": 1200 / 3937, "cm": 0.01, "mm": 0.001, "mile": 1609.344, "nmile": 1852.0}


class UnsupportedCRS(ValueError):
    pass


def kind(crs: str) -> str:
    text = crs.lower().replace(" ", "")
    if text in ("epsg:4326", "wgs84", "ogc:crs84", "crs84") or "+proj=longlat" in text or "+proj=latlong" in text:
        return "longlat"
    if text in ("epsg:3857", "epsg:900913", "epsg:3785") or "+proj=merc" in text or "+proj=webmerc" in text:
        return "mercator"
    raise UnsupportedCRS(f"no closed form for CRS {crs!r}; supported are longitude/latitude and Web Mercator")


def vertical_unit(crs: str) -> str | None:
    m = re.search(r"\+vunits=([\w-]+)", crs)
    return m[1] if m else None


def same(a: str, b: str) -> bool:
    return kind(a) == kind(b) and (vertical_unit(a) or "m") == (vertical_unit(b) or "m")


def transform(lat: Column, lon: Column, source: str, target: str) -> tuple[Column, Column]:
    """(lat, lon) columns in ``target``: northing and easting in metres for Web Mercator."""
    a, b = kind(source), kind(target)
    if a == b:
        return lat, lon
    if b == "mercator":
        y = RADIUS * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))
        return y, RADIUS * F.radians(lon)
    return F.degrees(2 * F.atan(F.exp(lat / RADIUS)) - math.pi / 2), F.degrees(lon / RADIUS)


def transform_value(lat: float, lon: float, source: str, target: str) -> tuple[float, float]:
    a, b = kind(source), kind(target)
    if a == b:
        return lat, lon
    if b == "mercator":
        return RADIUS * math.log(math.tan(math.pi / 4 + math.radians(lat) / 2)), RADIUS * math.radians(lon)
    return math.degrees(2 * math.atan(math.exp(lat / RADIUS)) - math.pi / 2), math.degrees(lon / RADIUS)


def vertical_factor(source: str, target: str) -> float:
    return METRES[vertical_unit(source) or "m"] / METRES[vertical_unit(target) or "m"]


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres on the mean sphere."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * MEAN_RADIUS * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def geodesic(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    """Distance in metres on the WGS84 ellipsoid (Vincenty's inverse; the sphere's near antipodes)."""
    if (lat1, lon1) == (lat2, lon2):
        return 0.0
    f, a = FLATTENING, RADIUS
    b = a * (1 - f)
    u1, u2 = (math.atan((1 - f) * math.tan(math.radians(x))) for x in (lat1, lat2))
    length = lam = math.radians(lon2 - lon1)
    for _ in range(200):
        s = math.hypot(math.cos(u2) * math.sin(lam), math.cos(u1) * math.sin(u2) - math.sin(u1) * math.cos(u2) * math.cos(lam))
        if s == 0:
            return 0.0
        c = math.sin(u1) * math.sin(u2) + math.cos(u1) * math.cos(u2) * math.cos(lam)
        sigma = math.atan2(s, c)
        sin_alpha = math.cos(u1) * math.cos(u2) * math.sin(lam) / s
        cos2 = 1 - sin_alpha**2
        mid = c - 2 * math.sin(u1) * math.sin(u2) / cos2 if cos2 else 0.0
        k = f / 16 * cos2 * (4 + f * (4 - 3 * cos2))
        before, lam = lam, length + (1 - k) * f * sin_alpha * (sigma + k * s * (mid + k * c * (2 * mid**2 - 1)))
        if abs(lam - before) < 1e-12:
            u = cos2 * (a**2 - b**2) / b**2
            big_a = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
            big_b = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
            d = big_b * s * (mid + big_b / 4 * (c * (2 * mid**2 - 1) - big_b / 6 * mid * (4 * s**2 - 3) * (4 * mid**2 - 3)))
            return b * big_a * (sigma - d)
    p = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * MEAN_RADIUS * math.asin(min(1.0, math.sqrt(p)))


def distance(p: tuple[float, float], q: tuple[float, float], crs: str = DEFAULT, units: str = "m") -> float:
    """Between (lat, lon) points: geodesic for longitude/latitude, the plane's norm otherwise."""
    metres = geodesic(*p, *q) if kind(crs) == "longlat" else math.dist(p, q)
    return metres / METRES[units]
