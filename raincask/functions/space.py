"""Coordinates, regions, distances."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

KM_PER_DEGREE = 111.0

# Named regions in order (latitude from, to, longitude from, to); the first that holds a point wins.
REGIONS = {
    "west_coast_ghats": (8.0, 21.0, 72.5, 76.0),
    "central_india": (18.0, 26.0, 76.0, 86.0),
    "northeast": (22.0, 29.5, 89.5, 97.5),
    "northwest": (23.0, 32.0, 68.0, 78.0),
    "south_peninsula": (8.0, 18.0, 76.0, 84.5),
    "himalayan_foothills": (27.0, 36.0, 74.0, 89.5),
    "east_coast_bay": (17.0, 23.0, 84.5, 89.5),
}
INDEX_BOX, SYSTEM_BOX = (18.0, 28.0, 65.0, 88.0), (15.0, 28.0, 74.0, 93.0)
# Rough outline of the land area (longitude, latitude).
OUTLINE = [
    (68.4, 23.6), (69.0, 22.4), (70.5, 20.8), (72.6, 21.2), (72.8, 19.0), (73.3, 16.5), (74.0, 14.8), (74.8, 12.8), (75.6, 11.2), (76.3, 9.5),
    (77.3, 8.1), (78.2, 8.9), (79.3, 10.3), (79.8, 11.6), (80.3, 13.3), (80.2, 15.5), (81.3, 16.4), (82.3, 17.0), (84.0, 18.5), (85.5, 19.7),
    (87.0, 21.3), (88.3, 21.6), (89.0, 21.9), (89.0, 24.0), (92.0, 24.0), (92.5, 23.0), (93.3, 23.0), (93.4, 24.1), (94.2, 25.0), (95.0, 26.8),
    (96.9, 27.6), (96.0, 28.3), (94.5, 29.2), (92.0, 27.8), (89.8, 26.8), (88.8, 27.3), (88.1, 27.9), (88.0, 26.6), (85.8, 26.8), (84.0, 27.5),
    (81.0, 28.8), (80.1, 30.0), (79.0, 31.0), (78.5, 32.5), (79.5, 34.5), (77.8, 35.5), (74.5, 34.8), (73.9, 33.5), (74.6, 32.5), (74.5, 31.0),
    (73.9, 30.0), (72.9, 29.0), (71.1, 27.9), (70.0, 27.2), (69.5, 26.5), (70.3, 25.7), (71.0, 24.4), (68.8, 24.3),
]
# Knots of the ridge line (latitude, longitude) and of the foothill line (longitude, latitude).
RIDGE = [(8, 77.2), (11, 76.6), (13, 75.2), (16, 74.0), (19, 73.7), (21.5, 73.6)]
FOOTHILL = [(72, 34.5), (74, 33.0), (77, 31.0), (80, 29.5), (84, 28.0), (88, 27.2), (92, 27.5), (97, 28.2)]


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    return lat.between(box[0], box[1]) & lon.between(box[2], box[3])


def region_of(lat: Column, lon: Column) -> Column:
    out = None
    for name, box in REGIONS.items():
        out = F.when(in_box(lat, lon, box), name) if out is None else out.when(in_box(lat, lon, box), name)
    return out.otherwise("other")


def inside_outline(lat: Column, lon: Column, outline=OUTLINE) -> Column:
    """Ray casting: the parity of the edges that a ray to the east crosses."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(outline, outline[1:] + outline[:1]):
        if y1 != y2:
            at = x1 + (lat - y1) * (x2 - x1) / (y2 - y1)
            crossings = crossings + F.when(((F.lit(y1) > lat) != (F.lit(y2) > lat)) & (lon < at), 1).otherwise(0)
    return crossings % 2 == 1


def wrap_longitude(lon: Column) -> Column:
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def flat_km(lat0: Column, lon0: Column, lat1: Column, lon1: Column) -> Column:
    """Flat-earth distance with the cosine of the mean latitude."""
    return F.hypot((lat1 - lat0) * KM_PER_DEGREE, (lon1 - lon0) * KM_PER_DEGREE * F.cos(F.radians((lat0 + lat1) / 2)))


def centre_km(lat: Column, lon: Column, clat: Column, clon: Column) -> Column:
    """Distance to a system's centre with the cosine of the centre's latitude."""
    return F.hypot((lat - clat) * KM_PER_DEGREE, (lon - clon) * KM_PER_DEGREE * F.cos(F.radians(clat)))


def piecewise(x: Column, knots: list[tuple[float, float]]) -> Column:
    """Linear interpolation over fixed knots, constant outside."""
    out = F.when(x <= knots[0][0], F.lit(float(knots[0][1])))
    for (x0, y0), (x1, y1) in zip(knots, knots[1:]):
        out = out.when(x <= x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0)))
    return out.otherwise(float(knots[-1][1]))


def terrain(lat: Column, lon: Column) -> Column:
    """A made-up terrain: a coastal ridge, a northern wall, two hill ranges (fixed heights and widths)."""
    sq = lambda c: c * c
    ridge = F.when((lat > 8) & (lat < 21.5), 1100 * F.exp(-sq((lon - piecewise(lat, RIDGE)) / 0.45))).otherwise(0.0)
    wall = 4500 / (1 + F.exp(-(lat - piecewise(lon, FOOTHILL) - 0.8) / 0.35))
    hills = 1500 * F.exp(-(sq((lat - 25.5) / 0.6) + sq((lon - 91.5) / 1.2))) + F.when((lat > 22) & (lat < 27), 1200 * F.exp(-sq((lon - 93.8) / 0.6))).otherwise(0.0)
    low = 500 * F.exp(-(sq((lat - 18.5) / 1.5) + sq((lon - 82.5) / 0.8)))
    return ridge + wall + hills + low


def axis(low: float, high: float, step: float) -> list[float]:
    """Cell centres by whole counts, so that steps don't drift."""
    n = math.floor((high - low) / step + 1e-6) + 1
    return [round(low + i * step, 4) for i in range(n)]


CANONICAL = (6.5, 38.5, 66.5, 100.0, 0.25)


def lattice_role(lat_min: float, lat_max: float, lon_min: float, lon_max: float, step: float, tolerance: float = 1e-6) -> str:
    """'canonical', 'crop' (aligned part of it) or 'foreign'."""
    same = lambda a, b: abs(a - b) < tolerance
    on = lambda x, origin: same((x - origin) / CANONICAL[4], round((x - origin) / CANONICAL[4]))
    if not same(step, CANONICAL[4]):
        return "foreign"
    if all(same(a, b) for a, b in zip((lat_min, lat_max, lon_min, lon_max), CANONICAL)):
        return "canonical"
    inside = lat_min >= CANONICAL[0] - tolerance and lat_max <= CANONICAL[1] + tolerance and lon_min >= CANONICAL[2] - tolerance and lon_max <= CANONICAL[3] + tolerance
    return "crop" if inside and on(lat_min, CANONICAL[0]) and on(lat_max, CANONICAL[0]) and on(lon_min, CANONICAL[2]) and on(lon_max, CANONICAL[2]) else "foreign"
