"""Geodesy as Column arithmetic: UTM by Krueger's series, distances, local frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 and UTM
_A, _F, _K0, _E0 = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0
_N = _F / (2 - _F)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
# Krueger's series to the fourth order
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45, 56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630)
_ECC = 2 * _N**0.5 / (1 + _N)


def utm_zone(lon: Column) -> Column:
    return F.floor((lon + 180) / 6) + 1


def utm_epsg(zone: Column, south: Column) -> Column:
    return F.when(south, 32700).otherwise(32600) + zone


def to_utm(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """(easting, northing) in metres; degrees in."""
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - _ECC * F.atanh(_ECC * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return _E0 + _K0 * _RADIUS * x, F.when(lat < 0, 10_000_000.0).otherwise(0.0) + _K0 * _RADIUS * y


def from_utm(easting: Column, northing: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """(lon, lat) in degrees."""
    xi, eta = (northing - F.when(south, 10_000_000.0).otherwise(0.0)) / (_K0 * _RADIUS), (easting - _E0) / (_K0 * _RADIUS)
    a, b = xi, eta
    for j, k in enumerate(_BETA, 1):
        a = a - k * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        b = b - k * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(a) / F.cosh(b))
    lat = chi
    for j, d in enumerate(_DELTA, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return zone * 6 - 183 + F.degrees(F.atan2(F.sinh(b), F.cos(a))), F.degrees(lat)


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371 * F.asin(F.sqrt(h))


def local_to_degrees(lon0: float, lat0: float, metres: float = 111320.0) -> tuple[Callable, Callable]:
    """Functions from metres east and north of a point to degrees, on a plane."""
    return lambda x: lon0 + x / (metres * F.cos(F.radians(F.lit(lat0)))), lambda z: lat0 + z / metres
