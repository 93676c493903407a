"""Polygon collections: text files, edge tables, bounds and measures."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polyagg.functions.geometry import BOX, Bounds, box_centre
from polyagg.sources.schemas import EDGE

Ring = list[tuple[float, float]]


def tidy(ring: Ring) -> Ring:
    """A ring without consecutive equal points, and without its first point repeated at the end."""
    out = [p for i, p in enumerate(ring) if not i or p != ring[i - 1]]
    return out[:-1] if len(out) > 1 and out[0] == out[-1] else out


@dataclass(frozen=True)
class Polygons:
    """Polygons by id, each of one or more rings; a point is inside by the even-odd rule over all rings, so holes and
    separate parts need no marks."""

    rings: dict[int, list[Ring]] = field(default_factory=dict)

    def edge_rows(self) -> list[tuple]:
        out = []
        for poly, parts in self.rings.items():
            n = 0
            for part, ring in enumerate(parts):
                for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
                    out.append((poly, part, n, float(x1), float(y1), float(x2), float(y2)))
                    n += 1
        return out

    def edges(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.edge_rows(), EDGE)

    def ids(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(p,) for p in self.rings], "poly_id int")

    def bounds(self) -> Bounds:
        """Of all points; an axis without extent, as of no polygons at all, is taken as 1 wide."""
        points = [p for parts in self.rings.values() for ring in parts for p in ring] or [(0.0, 0.0)]
        (x0, x1), (y0, y1) = ((float(min(v)), float(max(v))) for v in zip(*points, strict=True))
        return Bounds(x0, y0, x1 if x1 > x0 else x0 + 1, y1 if y1 > y0 else y0 + 1)

    def projected(self) -> Polygons:
        """Rings of (latitude, longitude) on the plane around the middle of the box.  A polygon with a point outside the box
        is left out; the others keep their ids."""
        import math

        from polyagg.functions.geometry import WORLD

        cx, cy = box_centre()

        def point(lat, lon):
            return (lon + 180) / 360 * WORLD - cx, (1 - math.atanh(math.sin(math.radians(lat))) / math.pi) / 2 * WORLD - cy

        good = {p: parts for p, parts in self.rings.items() if all(BOX[0] <= a <= BOX[2] and BOX[1] <= b <= BOX[3] for ring in parts for a, b in ring)}
        return Polygons({p: [[point(*q) for q in ring] for ring in parts] for p, parts in good.items()})


def _text(spark: SparkSession, path: str) -> str:
    """A small text file, through Spark's file systems."""
    return spark.read.text(path, wholetext=True).first()[0]


def read_polygons(spark: SparkSession, path: str) -> Polygons:
    """A polygon file: the number of polygons; for each its number of parts; for each part its number of points and the
    points (latitude, longitude)."""
    words = iter(_text(spark, path).split())
    number = lambda: int(next(words))
    rings = {}
    for poly in range(number()):
        rings[poly] = [tidy([(float(next(words)), float(next(words))) for _ in range(number())]) for _ in range(number())]
    return Polygons({p: [r for r in parts if r] for p, parts in rings.items()})


def read_collections(spark: SparkSession, path: str) -> dict[str, Polygons]:
    """A list file of lines `name,file`, files relative to it."""
    folder = path.rpartition("/")[0]
    pairs = [line.split(",", 1) for line in _text(spark, path).splitlines() if line.strip()]
    return {name.strip(): read_polygons(spark, f"{folder}/{file.strip()}") for name, file in pairs}


def poly_bounds(edges: DataFrame) -> DataFrame:
    return edges.groupBy("poly_id").agg(F.min("x1").alias("min_x"), F.min("y1").alias("min_y"), F.max("x1").alias("max_x"), F.max("y1").alias("max_y"))


def poly_area(edges: DataFrame) -> DataFrame:
    """Shoelace area; parts of opposite orientation count against each other, as holes do."""
    return edges.groupBy("poly_id").agg((F.abs(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))) / 2).alias("area"))


def poly_perimeter(edges: DataFrame) -> DataFrame:
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return edges.groupBy("poly_id").agg(F.sum(F.sqrt(dx * dx + dy * dy)).alias("perimeter"))


def simplified(edges: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Points (poly_id, part_id, edge_id, x, y) of rings without those at which the direction stays the same (cosine above
    1 - tolerance)."""
    ring = Window.partitionBy("poly_id", "part_id").orderBy("edge_id")
    last = Window.partitionBy("poly_id", "part_id").orderBy(F.desc("edge_id"))
    before = [F.coalesce(F.lag(c).over(ring), F.first(c).over(last)) for c in ("x1", "y1")]
    rows = edges.withColumns({"px": before[0], "py": before[1]})
    ax, ay, bx, by = F.col("x1") - F.col("px"), F.col("y1") - F.col("py"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    cosine = (ax * bx + ay * by) / F.nullif(F.sqrt((ax * ax + ay * ay) * (bx * bx + by * by)), F.lit(0.0))
    return rows.where(F.coalesce(cosine <= 1.0 - tolerance, F.lit(True))).select("poly_id", "part_id", "edge_id", F.col("x1").alias("x"), F.col("y1").alias("y"))
