"""Coordinate systems as closed-form SQL expressions (published formulas)."""
from __future__ import annotations

import math

from quartier.functions.geometry import box, let, map_vertices, point

# Spherical Mercator radius, WGS84 ellipsoid, UTM scale and false easting.
RADIUS = 6378137.0
FLATTENING = 1 / 298.257223563
UTM_SCALE = 0.9996
UTM_EASTING = 500000.0


def mercator_x(lon: str) -> str:
    return f"{RADIUS}D * radians({lon})"


def mercator_y(lat: str) -> str:
    return f"{RADIUS}D * ln(tan(pi() / 4 + radians({lat}) / 2))"


def mercator_lon(x: str) -> str:
    return f"degrees(({x}) / {RADIUS}D)"


def mercator_lat(y: str) -> str:
    return f"degrees(2 * atan(exp(({y}) / {RADIUS}D)) - pi() / 2)"


def to_mercator(geom: str) -> str:
    """EPSG:4326 -> EPSG:3857."""
    return map_vertices(geom, lambda v: point(mercator_x(f"{v}.x"), mercator_y(f"{v}.y")))


def to_lonlat(geom: str) -> str:
    """EPSG:3857 -> EPSG:4326."""
    return map_vertices(geom, lambda v: point(mercator_lon(f"{v}.x"), mercator_lat(f"{v}.y")))


def square_around(lon: str, lat: str, size: str | float) -> str:
    """Longitude/latitude box of a square of ``size`` map metres centred on a point."""
    return let(
        point(mercator_x(lon), mercator_y(lat)),
        lambda c: box(
            mercator_lon(f"{c}.x - {size} / 2"), mercator_lat(f"{c}.y - {size} / 2"),
            mercator_lon(f"{c}.x + {size} / 2"), mercator_lat(f"{c}.y + {size} / 2"),
        ),
    )


def _krueger() -> tuple[float, tuple, tuple, tuple]:
    """Rectifying radius and third-order Krueger coefficients (forward, inverse, latitude)."""
    n = FLATTENING / (2 - FLATTENING)
    a = RADIUS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    return a, alpha, beta, delta


def utm(lon: str, lat: str, zone: int = 16) -> str:
    """UTM position (x easting, y northing) on the northern hemisphere, EPSG:326zz."""
    a, alpha, _, _ = _krueger()
    n = FLATTENING / (2 - FLATTENING)
    ecc = 2 * math.sqrt(n) / (1 + n)
    lam = f"radians({lon} - {6.0 * zone - 183.0}D)"
    t = f"sinh(atanh(sin(radians({lat}))) - {ecc!r}D * atanh({ecc!r}D * sin(radians({lat}))))"

    def series(p: str) -> str:
        east = "".join(f" + {c!r}D * cos({2 * j} * {p}.x) * sinh({2 * j} * {p}.y)" for j, c in enumerate(alpha, 1))
        north = "".join(f" + {c!r}D * sin({2 * j} * {p}.x) * cosh({2 * j} * {p}.y)" for j, c in enumerate(alpha, 1))
        scale = f"{UTM_SCALE * a!r}D"
        return point(f"{UTM_EASTING}D + {scale} * ({p}.y{east})", f"{scale} * ({p}.x{north})")

    return let(
        t, lambda v: let(point(f"atan2({v}, cos({lam}))", f"atanh(sin({lam}) / sqrt(1 + {v} * {v}))"), series)
    )


def utm_inverse(east: str, north: str, zone: int = 16) -> str:
    """Longitude and latitude (x, y) of a UTM position."""
    a, _, beta, delta = _krueger()
    scale = f"{UTM_SCALE * a!r}D"
    start = point(f"({north}) / {scale}", f"(({east}) - {UTM_EASTING}D) / {scale}")

    def corrected(p: str) -> str:
        xi = "".join(f" - {c!r}D * sin({2 * j} * {p}.x) * cosh({2 * j} * {p}.y)" for j, c in enumerate(beta, 1))
        eta = "".join(f" - {c!r}D * cos({2 * j} * {p}.x) * sinh({2 * j} * {p}.y)" for j, c in enumerate(beta, 1))
        return point(f"{p}.x{xi}", f"{p}.y{eta}")

    def position(q: str) -> str:
        lon = f"{6.0 * zone - 183.0}D + degrees(atan2(sinh({q}.y), cos({q}.x)))"
        lat = let(
            f"asin(sin({q}.x) / cosh({q}.y))",
            lambda chi: f"degrees({chi}" + "".join(f" + {c!r}D * sin({2 * j} * {chi})" for j, c in enumerate(delta, 1)) + ")",
        )
        return point(lon, lat)

    return let(start, lambda p: let(corrected(p), position))


def to_utm(geom: str, zone: int = 16) -> str:
    return map_vertices(geom, lambda v: utm(f"{v}.x", f"{v}.y", zone))


def utm_to_lonlat(geom: str, zone: int = 16) -> str:
    return map_vertices(geom, lambda v: utm_inverse(f"{v}.x", f"{v}.y", zone))
