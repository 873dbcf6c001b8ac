"""Geographic expressions: distances, coordinate checks and cells, all JVM-side."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
METRES_PER_DEGREE = 111_000.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a)) * (2 * EARTH_RADIUS_M)


def haversine_m(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    """:func:`haversine` for two plain points."""
    p, q = math.radians(lat1), math.radians(lat2)
    a = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS_M * math.atan2(math.sqrt(a), math.sqrt(1 - a))


def valid_coordinate(lat: Column, lon: Column) -> Column:
    """Within the globe's bounds and not at null island; null and NaN are invalid."""
    near_zero = (F.abs(lat) < 0.001) & (F.abs(lon) < 0.001)
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180) & ~near_zero, F.lit(False))


def grid_cell(lat: Column, lon: Column, step_e6: int = 5000) -> Column:
    """A square cell of ``step_e6`` micro-degrees, as ``row_column``."""
    row, col = (F.floor(F.round(c * 1e6) / step_e6).cast("string") for c in (lat, lon))
    return F.concat_ws("_", row, col)


def _spread(x: Column) -> Column:
    """Sixteen bits, each followed by a zero."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def z_order(lat: Column, lon: Column) -> Column:
    """The place of a point on a Z-shaped curve through 65,536 by 65,536 tiles of the earth (long)."""
    cell = lambda v, span: F.least(F.greatest(F.floor((v + span / 2) / span * 65536), F.lit(0)), F.lit(65535)).cast("long")
    return F.shiftleft(_spread(cell(lat, 180.0)), 1).bitwiseOR(_spread(cell(lon, 360.0)))


def hex_edge_m(resolution: int) -> float:
    """Edge length of a hexagon at a resolution from 0 to 15: aperture seven from about 1,280 km."""
    if not 0 <= resolution <= 15:
        raise ValueError("resolution must be from 0 to 15")
    return 1_281_256.0 / 7 ** (resolution / 2)


def hex_cell(lat: Column, lon: Column, resolution: int = 12) -> Column:
    """A hexagonal cell on an equal-area cylinder, as ``resolution:q:r`` in axial coordinates.

    Cells have the scale of the usual hierarchical hexagons of that resolution, but they aren't the same cells.
    """
    edge = hex_edge_m(resolution)
    x, y = F.radians(lon) * EARTH_RADIUS_M, F.sin(F.radians(lat)) * EARTH_RADIUS_M
    q = (x * math.sqrt(3) / 3 - y / 3) / edge
    r = (y * 2 / 3) / edge
    s = -q - r
    rq, rr, rs = F.rint(q), F.rint(r), F.rint(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    fq = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
    fr = F.when((dq > dr) & (dq > ds), rr).when(dr > ds, -rq - rs).otherwise(rr)
    return F.concat_ws(":", F.lit(str(resolution)), fq.cast("long").cast("string"), fr.cast("long").cast("string"))


def degrees_of(metres: float) -> float:
    return metres / METRES_PER_DEGREE


def in_ring(lat: Column, lon: Column, ring: list[tuple[float, float]], buffer_m: float = 0.0) -> Column:
    """Whether a point lies in the polygon ``ring`` of (lon, lat), or within ``buffer_m`` of its border."""
    return in_rings(lat, lon, [ring], buffer_m)


def in_rings(lat: Column, lon: Column, rings: list[list[tuple[float, float]]], buffer_m: float = 0.0) -> Column:
    """Whether a point lies within an odd number of ``rings`` of (lon, lat): in a part and in none of its holes; or
    within ``buffer_m`` of a border.

    Ray casting and distances to sides, in degrees, by higher-order functions. The sides are one literal, dealt out by
    bands of latitude, so a point meets only those of its band, however long the border is.
    """
    sides = [(*a, *b) for ring in rings for a, b in zip(ring, [*ring[1:], *ring[:1]], strict=True) if a != b]
    if not sides:
        return F.lit(False)
    reach = degrees_of(max(buffer_m, 0.0))
    low, high = min(min(e[1], e[3]) for e in sides) - reach, max(max(e[1], e[3]) for e in sides) + reach
    n = max(1, math.isqrt(len(sides)))
    height = (high - low) / n or 1.0
    bands: list[list[list[float]]] = [[] for _ in range(n)]
    for e in sides:
        first, last = (int((y - low) / height) for y in (min(e[1], e[3]) - reach, max(e[1], e[3]) + reach))
        # One more on either side, for places at a band's very edge.
        for i in range(max(0, first - 1), min(n, last + 2)):
            bands[i].append([float(v) for v in e])
    literal = F.from_json(F.lit(json.dumps(bands)), "array<array<array<double>>>")
    band = F.coalesce(F.get(literal, F.floor((lat - low) / height).cast("int")), F.array().cast("array<array<double>>"))

    def crosses(e: Column) -> Column:
        x1, y1, x2, y2 = e[0], e[1], e[2], e[3]
        return ((y1 > lat) != (y2 > lat)) & (lon < (x2 - x1) * (lat - y1) / F.when(y2 != y1, y2 - y1).otherwise(1.0) + x1)

    inside = F.size(F.filter(band, crosses)) % 2 == 1
    if buffer_m <= 0:
        return inside

    def near(e: Column) -> Column:
        x1, y1, x2, y2 = e[0], e[1], e[2], e[3]
        dx, dy = x2 - x1, y2 - y1
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((lon - x1) * dx + (lat - y1) * dy) / (dx * dx + dy * dy)))
        return F.pow(lon - x1 - t * dx, 2) + F.pow(lat - y1 - t * dy, 2) <= reach * reach

    return inside | F.exists(band, near)
