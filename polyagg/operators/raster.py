"""Aggregation through pixels: pre-aggregation, coverage, borders and result ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyagg.functions.geometry import Grid, clip_range, inside, smaller_side
from polyagg.operators.index import checked, grid_index, index_join


def totals() -> list[Column]:
    """Of points with v: their number, the sum of v, and how many have a v."""
    return [F.count(F.lit(1)).alias("cnt"), F.sum("v").alias("sum_v"), F.count("v").alias("n_v")]


def pixels(points: DataFrame, grid: Grid) -> DataFrame:
    """(px, py, cnt, sum_v, n_v) of points (x, y, v) on the canvas: Spark adds up within each task before it shuffles, so no more
    rows move than there are occupied pixels."""
    px, py = grid.cell(F.col("x"), F.col("y"))
    on = points.where(grid.bounds.holds(F.col("x"), F.col("y")))
    return on.groupBy(px.alias("px"), py.alias("py")).agg(*totals())


def covered(occupied: DataFrame, edges: DataFrame, grid: Grid, index: Grid) -> DataFrame:
    """Pixels with poly_id of each polygon that holds their centre."""
    x, y = grid.centre(F.col("px"), F.col("py"))
    return index_join(occupied.withColumns({"x": x, "y": y}), grid_index(edges, index), index).drop("x", "y")


def added(rows: DataFrame) -> DataFrame:
    return rows.groupBy("poly_id").agg(*(F.sum(c).alias(c) for c in ("cnt", "sum_v", "n_v")))


def pixel_join(points: DataFrame, edges: DataFrame, grid: Grid, index: Grid) -> DataFrame:
    """Approximate (poly_id, cnt, sum_v): a pixel's points count for the polygons that hold its centre, so only points nearer
    to a border than a pixel's diagonal can be misplaced."""
    return added(covered(pixels(points, grid), edges, grid, index))


def hybrid_join(points: DataFrame, edges: DataFrame, grid: Grid) -> DataFrame:
    """Exact (poly_id, cnt, sum_v): pixels wholly inside a polygon count as pixels; points in pixels that a border of the
    polygon comes into are tested themselves."""
    cells = grid_index(edges, grid)
    whole = cells.where(~F.col("mixed")).select(F.col("cx").alias("px"), F.col("cy").alias("py"), "poly_id")
    inner = added(pixels(points, grid).join(checked(whole), ["px", "py"]))
    border = index_join(points.select("x", "y", "v"), cells.where("mixed"), grid)
    return added(inner.unionByName(border.groupBy("poly_id").agg(*totals())))


def border_pixels(edges: DataFrame, grid: Grid) -> DataFrame:
    """(poly_id, edge_id, x1, y1, x2, y2, px, py, t0, t1): pixels that an edge comes into, and the part of it inside.  For each
    row of pixels that an edge spans, only the columns that it spans in that row are tried."""
    b = grid.bounds
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    row = lambda y, nudge: F.floor((y - b.y0) / grid.dy + nudge).cast("long")
    rows = edges.withColumn("py", F.explode(F.sequence(F.greatest(F.lit(0), row(low, -1e-9)), F.greatest(F.lit(0), F.least(F.lit(grid.ny - 1), row(high, 1e-9))))))
    ya, yb = F.lit(b.y0) + F.col("py") * grid.dy, F.lit(b.y0) + (F.col("py") + 1) * grid.dy
    # where the edge is between the row's lower and upper side, with a little to spare
    slope = (F.col("x2") - F.col("x1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0))
    at = lambda y: F.coalesce(F.col("x1") + (F.least(F.greatest(y, low), high) - F.col("y1")) * slope, F.col("x1"))
    flat = F.col("y1") == F.col("y2")
    xa = F.when(flat, F.least("x1", "x2")).otherwise(F.least(at(ya), at(yb)))
    xb = F.when(flat, F.greatest("x1", "x2")).otherwise(F.greatest(at(ya), at(yb)))
    column = lambda x, nudge: F.floor((x - b.x0) / grid.dx + nudge).cast("long")
    cells = rows.withColumns({"_a": F.greatest(F.lit(0), column(xa, -1e-6)), "_b": F.least(F.lit(grid.nx - 1), column(xb, 1e-6))}).where("_a <= _b")
    cells = cells.withColumn("px", F.explode(F.sequence("_a", "_b"))).drop("_a", "_b")
    t0, t1 = clip_range("x1", "y1", "x2", "y2", *pixel_sides(grid))
    return cells.withColumns({"t0": F.expr(t0), "t1": F.expr(t1)}).where("t0 <= t1")


def pixel_sides(grid: Grid) -> tuple[str, str, str, str]:
    """SQL for a pixel's left, lower, right and upper side, in Spark as in other engines."""
    number = lambda v: f"CAST('{v!r}' AS DOUBLE)"
    b = grid.bounds
    return tuple(f"({number(start)} + (p{axis} + {more}) * {number(step)})" for more in (0, 1) for axis, start, step in (("x", b.x0, grid.dx), ("y", b.y0, grid.dy)))


def fraction(grid: Grid) -> str:
    """SQL for the smaller part of a pixel cut by an edge from border to border; a half if an edge ends inside."""
    left, lower, _, _ = pixel_sides(grid)
    number = lambda v: f"CAST('{v!r}' AS DOUBLE)"
    u = [f"((x1 + {t} * (x2 - x1) - {left}) / {number(grid.dx)})" for t in ("t0", "t1")]
    v = [f"((y1 + {t} * (y2 - y1) - {lower}) / {number(grid.dy)})" for t in ("t0", "t1")]
    on = lambda a, b: f"({a} <= 1e-9 OR {a} >= 1 - 1e-9 OR {b} <= 1e-9 OR {b} >= 1 - 1e-9)"
    snap = lambda a: f"CASE WHEN {a} >= 1 - 1e-9 THEN 1 WHEN {a} <= 1e-9 THEN 0 ELSE {a} END"
    u, v = [snap(a) for a in u], [snap(a) for a in v]
    forth, back = smaller_side(u[0], v[0], u[1], v[1]), smaller_side(u[1], v[1], u[0], v[0])
    cut = f"CASE WHEN {u[0]} <= {u[1]} THEN {forth} ELSE {back} END"
    return f"CASE WHEN {on(u[0], v[0])} AND {on(u[1], v[1])} THEN greatest(CAST(0 AS DOUBLE), {cut}) ELSE CAST(0.5 AS DOUBLE) END"


def range_join(points: DataFrame, edges: DataFrame, grid: Grid, index: Grid, per_edge: bool = False) -> DataFrame:
    """(poly_id, cnt, worst_lo, worst_hi, expected_lo, expected_hi) of the raster count.

    Points of a border pixel whose centre is inside may not be in the polygon, those of one whose centre is outside may be:
    all of them at worst, in expectation the smaller part of the pixel that the border cuts, rounded up.  A pixel counts once for
    a polygon (in expectation by its largest part), or with per_edge once for each edge in it, which widens the ranges.
    """
    occupied = pixels(points, grid).select("px", "py", "cnt")
    raster = covered(occupied, edges, grid, index).groupBy("poly_id").agg(F.sum("cnt").alias("cnt"))
    shapes = edges.groupBy("poly_id").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("all"))
    border = border_pixels(edges, grid).withColumn("part", F.expr(fraction(grid))).select("poly_id", "edge_id", "px", "py", "part")
    if not per_edge:
        border = border.groupBy("poly_id", "px", "py").agg(F.max("part").alias("part"))
    x, y = grid.centre(F.col("px"), F.col("py"))
    met = border.join(occupied, ["px", "py"]).join(checked(shapes), "poly_id").withColumns({"x": x, "y": y})
    met = met.withColumns({"within": inside("x", "y", "all"), "some": F.ceil(F.col("part") * F.col("cnt")).cast("long")})
    sums = {"out_all": ("NOT within", "cnt"), "in_all": ("within", "cnt"), "out_some": ("NOT within", "some"), "in_some": ("within", "some")}
    totals = met.groupBy("poly_id").agg(*(F.sum(F.when(F.expr(c), F.col(v)).otherwise(0)).alias(k) for k, (c, v) in sums.items()))
    both = edges.select("poly_id").distinct().join(raster, "poly_id", "left").join(totals, "poly_id", "left").na.fill(0)
    ends = {"worst_lo": ("cnt", "-", "in_all"), "worst_hi": ("cnt", "+", "out_all"), "expected_lo": ("cnt", "-", "in_some"), "expected_hi": ("cnt", "+", "out_some")}
    return both.select("poly_id", "cnt", *(F.expr(f"{a} {op} {b}").cast("long").alias(k) for k, (a, op, b) in ends.items()))


def relative_error(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """(poly_id, error_percent) of counts, for polygons with 100 points or more, or with fewer that are off by over 25."""
    both = exact.select("poly_id", F.col("cnt").alias("a")).join(approximate.select("poly_id", F.col("cnt").alias("e")), "poly_id")
    off = F.abs(F.col("a") - F.col("e"))
    return both.where((F.col("a") >= 100) | ((F.col("a") > 0) & (off > 25))).select("poly_id", (off * 100.0 / F.col("a")).alias("error_percent"))
