"""Scalar geometry as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the coordinate system: the zoom level of the world's units, the Earth's equatorial radius in metres, and
# the box (least latitude, least longitude, greatest latitude, greatest longitude) of points that are kept.
ZOOM = 22
RADIUS = 6378137.0
BOX = (24.396308, -124.848974, 49.384358, -66.885444)

WORLD = 256.0 * 2**ZOOM


def _value(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def to_world(lat, lon) -> tuple[Column, Column]:
    """Web Mercator (x, y) of a latitude and longitude in degrees; y falls to the north."""
    lat, lon = _value(lat), _value(lon)
    x = (lon + 180.0) / 360.0 * WORLD
    y = (1.0 - F.atanh(F.sin(F.radians(lat))) / math.pi) / 2.0 * WORLD
    return x, y


def to_degrees(x, y) -> tuple[Column, Column]:
    """(latitude, longitude) of a world point: the inverse of to_world()."""
    x, y = _value(x), _value(y)
    return F.degrees(F.atan(F.sinh(math.pi * (1.0 - 2.0 * y / WORLD)))), x * 360.0 / WORLD - 180.0


def box_centre() -> tuple[float, float]:
    """The middle of BOX in world units."""
    lat, lon = (BOX[0] + BOX[2]) / 2, (BOX[1] + BOX[3]) / 2
    return (lon + 180) / 360 * WORLD, (1 - math.atanh(math.sin(math.radians(lat))) / math.pi) / 2 * WORLD


def in_box(lat: Column, lon: Column) -> Column:
    return lat.between(BOX[0], BOX[2]) & lon.between(BOX[1], BOX[3])


def to_plane(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Coordinates around the middle of BOX; null for points outside it."""
    x, y = to_world(lat, lon)
    cx, cy = box_centre()
    return F.when(in_box(lat, lon), x - cx), F.when(in_box(lat, lon), y - cy)


def from_plane(x: Column, y: Column) -> tuple[Column, Column]:
    cx, cy = box_centre()
    return to_degrees(x + cx, y + cy)


def ground_resolution(lat: float = (BOX[0] + BOX[2]) / 2) -> float:
    """Metres in one world unit at a latitude."""
    return math.cos(math.radians(lat)) * 2 * math.pi * RADIUS / WORLD


def pixel_size(epsilon_m: float, metres: float | None = None) -> float:
    """The side, in world units, of the pixel whose diagonal is epsilon_m metres."""
    return epsilon_m / math.sqrt(2) / (metres or ground_resolution())


@dataclass(frozen=True)
class Bounds:
    x0: float
    y0: float
    x1: float
    y1: float

    def holds(self, x: Column, y: Column) -> Column:
        """Half-open: the largest coordinates are outside."""
        return (x >= self.x0) & (x < self.x1) & (y >= self.y0) & (y < self.y1)


@dataclass(frozen=True)
class Grid:
    """nx by ny cells over bounds."""

    bounds: Bounds
    nx: int
    ny: int

    @property
    def dx(self) -> float:
        return (self.bounds.x1 - self.bounds.x0) / self.nx

    @property
    def dy(self) -> float:
        return (self.bounds.y1 - self.bounds.y0) / self.ny

    def cell(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Cell numbers, with floor; points outside the half-open bounds have numbers outside the grid."""
        b = self.bounds

        def number(v: Column, low: float, high: float, n: int) -> Column:
            cell = F.floor((v - low) / (high - low) * n).cast("long")
            return F.when(v < high, F.least(cell, F.lit(n - 1))).otherwise(cell)  # rounding may reach the next cell

        return number(x, b.x0, b.x1, self.nx), number(y, b.y0, b.y1, self.ny)

    def centre(self, cx: Column, cy: Column) -> tuple[Column, Column]:
        return F.lit(self.bounds.x0) + (cx + 0.5) * self.dx, F.lit(self.bounds.y0) + (cy + 0.5) * self.dy

    def corner(self, cx: Column, cy: Column) -> tuple[Column, Column]:
        return F.lit(self.bounds.x0) + cx * self.dx, F.lit(self.bounds.y0) + cy * self.dy


def canvas(bounds: Bounds, cell: float, limit: int = 8192) -> Grid:
    """The pixel grid for a pixel side: each axis is cut into tiles of at most `limit` pixels, all of one size, which rounds
    the number of pixels up to a multiple of the number of tiles."""

    def axis(extent: float) -> int:
        pixels = max(1, math.ceil(extent / cell))
        tiles = -(-pixels // limit)
        return -(-pixels // tiles) * tiles

    return Grid(bounds, axis(bounds.x1 - bounds.x0), axis(bounds.y1 - bounds.y0))


def square_grid(bounds: Bounds, limit: int) -> Grid:
    """Square cells, `limit` along the longer axis."""
    w, h = bounds.x1 - bounds.x0, bounds.y1 - bounds.y0
    side = max(w, h) / limit
    return Grid(bounds, max(1, math.ceil(w / side)), max(1, math.ceil(h / side)))


def normalised(x: Column, y: Column, bounds: Bounds) -> tuple[Column, Column]:
    """Scale and shift bounds to [-1, 1]."""
    return (
        (x - (bounds.x0 + bounds.x1) / 2) / ((bounds.x1 - bounds.x0) / 2),
        (y - (bounds.y0 + bounds.y1) / 2) / ((bounds.y1 - bounds.y0) / 2),
    )


def crosses(x, y, x1, y1, x2, y2) -> Column:
    """Whether a ray from (x, y) to the right crosses an edge: half-open in y, strictly right in x.  The division is
    reached only for edges that are not horizontal."""
    return F.when((y1 > y) != (y2 > y), x < (x2 - x1) * (y - y1) / (y2 - y1) + x1).otherwise(False)


#: crosses() in SQL, for a point (x, y) and an edge e; the order of operations is that of crosses().
CROSSES = "CASE WHEN (e.y1 > {y}) <> (e.y2 > {y}) THEN {x} < (e.x2 - e.x1) * ({y} - e.y1) / (e.y2 - e.y1) + e.x1 ELSE FALSE END"


def inside(x: str, y: str, edges: str) -> Column:
    """Even-odd test of a point against an array of edges (x1, y1, x2, y2)."""
    return F.expr(f"aggregate({edges}, false, (odd, e) -> odd <> ({CROSSES.format(x=x, y=y)}))")


def outcode(x, y, b) -> Column:
    """Which sides of a rectangle (x0, y0, x1, y1) a point lies beyond: 1 left, 2 right, 4 below, 8 above."""
    x0, y0, x1, y1 = b
    side = F.when(x < x0, 1).when(x > x1, 2).otherwise(0)
    return side + F.when(y < y0, 4).when(y > y1, 8).otherwise(0)


def clip_range(x1: str, y1: str, x2: str, y2: str, x0: str, y0: str, xe: str, ye: str) -> tuple[str, str]:
    """SQL for the part [t0, t1] of a segment inside a closed rectangle (Liang-Barsky); t0 > t1 if there is none."""
    number = lambda v: f"CAST({v} AS DOUBLE)"

    def ends(a: str, b: str, low: str, high: str) -> list[str]:
        d = f"({b} - {a})"
        out = []
        for pick, all_of_it, nothing in (("least", 0, 2), ("greatest", 1, -1)):
            along = f"{pick}(({low} - {a}) / nullif({d}, {number(0)}), ({high} - {a}) / nullif({d}, {number(0)}))"
            out.append(f"CASE WHEN {d} <> 0 THEN {along} WHEN {a} BETWEEN {low} AND {high} THEN {number(all_of_it)} ELSE {number(nothing)} END")
        return out

    (a0, a1), (b0, b1) = ends(x1, x2, x0, xe), ends(y1, y2, y0, ye)
    return f"greatest({number(0)}, {a0}, {b0})", f"least({number(1)}, {a1}, {b1})"


def smaller_side(u0: str, v0: str, u1: str, v1: str) -> str:
    """SQL for the area of the smaller part of the unit square cut by a chord from (u0, v0) to (u1, v1), u0 <= u1."""
    below = f"(({u1} - {u0}) * ({v0} + {v1}) / 2 + CASE WHEN {v0} >= 1 THEN {u0} ELSE 0 END + CASE WHEN {v1} >= 1 THEN 1 - {u1} ELSE 0 END)"
    return f"least({below}, 1 - {below})"


def point_segment_distance(px, py, x1, y1, x2, y2) -> Column:
    length = (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)
    t = F.when(length == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / F.nullif(length, F.lit(0.0)))))
    dx, dy = px - (x1 + t * (x2 - x1)), py - (y1 + t * (y2 - y1))
    return F.sqrt(dx * dx + dy * dy)


def in_ellipse(dx: Column, dy: Column, rx: float, ry: float) -> Column:
    return (dx / rx) * (dx / rx) + (dy / ry) * (dy / ry) <= 1.0


def rotated(x: Column, y: Column, degrees: float, ox: float = 0.0, oy: float = 0.0) -> tuple[Column, Column]:
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return ox + (x - ox) * c - (y - oy) * s, oy + (x - ox) * s + (y - oy) * c


def interpolated(a, b, t) -> Column:
    return a + (b - a) * t


def clamped(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))
