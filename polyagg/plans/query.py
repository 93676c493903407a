"""The spatial aggregation query: points, polygons, filters, and one of several strategies."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polyagg.functions.geometry import Bounds, Grid, canvas, square_grid
from polyagg.functions.predicates import conjunction, time_range
from polyagg.operators.index import grid_index, index_join, nested_join
from polyagg.operators.raster import added, hybrid_join, pixel_join, range_join, totals
from polyagg.sources.polygons import Polygons


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("poly_id").agg(*totals())


def _index(q: SpatialAggregation, points: DataFrame, edges: DataFrame) -> DataFrame:
    return _summed(index_join(points, grid_index(edges, q.index_grid()) if q.index is None else q.index, q.index_grid()))


def _nested(q: SpatialAggregation, points: DataFrame, edges: DataFrame) -> DataFrame:
    return added(nested_join(points.groupBy("x", "y").agg(*totals()), edges))


#: Strategy by name; others can be added.
STRATEGIES: dict[str, Callable[[SpatialAggregation, DataFrame, DataFrame], DataFrame]] = {
    "index": _index,
    "nested": _nested,
    "raster": lambda q, points, edges: pixel_join(points, edges, q.canvas_grid(), q.index_grid()),
    "hybrid": lambda q, points, edges: hybrid_join(points, edges, q.canvas_grid()),
}


@dataclass(frozen=True)
class SpatialAggregation:
    """COUNT, SUM and AVG of points (x, y, attributes) in each polygon.

    value: what is added up, an integer or decimal expression, whose sums are exact; None counts only.  Floats and doubles add up
    differently in each order, so they are first rounded to `scale` decimal places, which must be given for them; NaN and infinity
    count as null.  As in SQL, a null value counts as a point but not for the average.  Results have a row for every polygon, with 0
    and an average of 0.0 where it holds no point, or no value.
    index: cells of grid_index() on index_grid(), such as load_index() gives; None builds them.
    """

    points: DataFrame
    polygons: Polygons
    value: Column | None = None
    index_cells: int = 128
    pixel: float | None = None
    canvas_pixels: tuple[int, int] | None = None
    condition: Column | None = None
    scale: int | None = None
    index: DataFrame | None = None

    def where(self, *filters: tuple[str, str, object]) -> SpatialAggregation:
        """Keep points that meet all of (column, comparison, constant)."""
        return self._and(conjunction(filters))

    def between(self, start: int, end: int, column: str = "t", coarse: bool = False) -> SpatialAggregation:
        return self._and(time_range(start, end, column, coarse))

    def _and(self, more: Column) -> SpatialAggregation:
        return replace(self, condition=more if self.condition is None else self.condition & more)

    def bounds(self) -> Bounds:
        return self.polygons.bounds()

    def index_grid(self) -> Grid:
        return square_grid(self.bounds(), self.index_cells)

    def canvas_grid(self) -> Grid:
        if self.canvas_pixels:
            return Grid(self.bounds(), *self.canvas_pixels)
        if self.pixel:
            return canvas(self.bounds(), self.pixel)
        raise ValueError("this strategy needs pixel or canvas_pixels")

    def input(self) -> DataFrame:
        """Points that can count: only the columns that are needed, filtered, in the polygons' bounds."""
        rows = self.points if self.condition is None else self.points.where(self.condition)
        b = self.bounds()
        box = F.col("x").between(b.x0, b.x1) & F.col("y").between(b.y0, b.y1)
        return rows.where(box).select("x", "y", self.exact(rows).alias("v"))

    def exact(self, rows: DataFrame) -> Column:
        """The value as a long or a decimal."""
        value = F.lit(0) if self.value is None else self.value
        kind = rows.select(value.alias("v")).schema["v"].dataType
        if isinstance(kind, T.DecimalType):
            return value
        if isinstance(kind, T.FractionalType):
            if self.scale is None:
                raise ValueError("a fractional value needs scale, the decimal places that its sums keep")
            return value.try_cast(T.DecimalType(28, self.scale))
        return value.cast("long")

    def run(self, strategy: str = "index") -> DataFrame:
        """(poly_id, cnt, sum_v, avg_v)."""
        spark = self.points.sparkSession
        found = STRATEGIES[strategy](self, self.input(), self.polygons.edges(spark))
        dense = self.polygons.ids(spark).join(found, "poly_id", "left")
        cnt, n = (F.coalesce(c, F.lit(0)).cast("long") for c in ("cnt", "n_v"))
        total = F.coalesce("sum_v", F.lit(0).cast(found.schema["sum_v"].dataType))
        average = F.when(n > 0, total.cast("double") / F.nullif(n, F.lit(0))).otherwise(0.0)
        return dense.select("poly_id", cnt.alias("cnt"), total.alias("sum_v"), average.alias("avg_v"))

    def ranges(self, per_edge: bool = False) -> DataFrame:
        """(poly_id, cnt, worst_lo, worst_hi, expected_lo, expected_hi) of the raster count."""
        edges = self.polygons.edges(self.points.sparkSession)
        return range_join(self.input(), edges, self.canvas_grid(), self.index_grid(), per_edge)
