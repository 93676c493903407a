"""The grid index over polygons, and the exact join through it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from polyagg.functions.geometry import Grid, crosses, inside

#: Rows, and about how many bytes, up to which a table of cells is broadcast; larger ones are shuffled on the cell.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def checked(small: DataFrame) -> DataFrame:
    """small with a broadcast hint if it is within both limits; an edge in an array counts as 32 bytes, the rest of a row as 64."""
    edges = [F.coalesce(F.size(f.name), F.lit(0)) * 32 for f in small.schema if isinstance(f.dataType, ArrayType)]
    rows, size = small.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)), F.sum(sum(edges, F.lit(64)))).first()
    return F.broadcast(small) if rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else small


def grid_index(edges: DataFrame, grid: Grid) -> DataFrame:
    """Cells (cx, cy, poly_id, mixed, edges) that a polygon meets.

    mixed: an edge comes into the cell; then `edges` holds those that a ray to the right from a point of the cell can
    cross: what overlaps its rows and does not lie wholly to its left.  Other cells are listed if they lie inside the polygon, and
    need no test.  Polygons are spread over their own cells by explode, so building is distributed too.
    """
    b, slack_x, slack_y = grid.bounds, grid.dx * 1e-9, grid.dy * 1e-9
    shapes = edges.groupBy("poly_id").agg(
        F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("all"),
        *(f(c).alias(f"{n}_{c[0]}") for c in ("x1", "y1") for n, f in (("low", F.min), ("high", F.max))),
    )
    ranges = {}
    for axis, start, step, n in (("x", b.x0, grid.dx, grid.nx), ("y", b.y0, grid.dy, grid.ny)):
        low, high = (F.floor((F.col(f"{end}_{axis}") - start) / step + nudge).cast("long") for end, nudge in (("low", -1e-9), ("high", 1e-9)))
        ranges[f"c{axis}"] = F.sequence(F.greatest(F.lit(0), F.least(low, F.lit(n - 1))), F.least(F.greatest(high, F.lit(0)), F.lit(n - 1)))
    cells = shapes.withColumn("cx", F.explode(ranges["cx"])).withColumn("cy", F.explode(ranges["cy"]))
    for axis, start, step, slack in (("x", b.x0, grid.dx, slack_x), ("y", b.y0, grid.dy, slack_y)):
        corner = F.lit(start) + F.col(f"c{axis}") * step
        cells = cells.withColumns({f"{axis}a": corner - slack, f"{axis}b": corner + step + slack})
    cells = cells.withColumn("edges", F.expr("filter(all, e -> greatest(e.y1, e.y2) >= ya AND least(e.y1, e.y2) <= yb AND greatest(e.x1, e.x2) >= xa)"))
    # an edge keeps clear of a cell if all corners lie on one side of its line
    side = lambda x, y: f"(e.x2 - e.x1) * ({y} - e.y1) - (e.y2 - e.y1) * ({x} - e.x1)"
    sides = ", ".join(side(x, y) for x in ("xa", "xb") for y in ("ya", "yb"))
    cells = cells.withColumn("mixed", F.expr(f"exists(edges, e -> least(e.x1, e.x2) <= xb AND least({sides}) <= 0 AND greatest({sides}) >= 0)"))
    cells = cells.withColumns({"px": (F.col("xa") + F.col("xb")) / 2, "py": (F.col("ya") + F.col("yb")) / 2})
    cells = cells.withColumn("within", inside("px", "py", "edges")).where("mixed OR within")
    return cells.select("cx", "cy", "poly_id", "mixed", F.when(F.col("mixed"), F.col("edges")).alias("edges"))


def index_join(points: DataFrame, cells: DataFrame, grid: Grid) -> DataFrame:
    """Rows of points (x, y, ...) with poly_id, one for each polygon that holds them: an equi-join on the cell, then the
    even-odd test against the few edges of a mixed cell.  Points in no polygon vanish; a null or NaN place is in none."""
    cx, cy = grid.cell(F.col("x"), F.col("y"))
    placed = points.withColumns({"_cx": cx, "_cy": cy})
    met = placed.join(checked(cells), (F.col("_cx") == F.col("cx")) & (F.col("_cy") == F.col("cy")))
    return met.where(~F.col("mixed") | inside("x", "y", "edges")).drop("_cx", "_cy", "cx", "cy", "mixed", "edges")


def nested_join(points: DataFrame, edges: DataFrame) -> DataFrame:
    """The plain form of the same: each distinct place against each edge, odd numbers of crossings.  For small inputs; points must
    have no columns but x, y and weights that are equal for equal places."""
    e = checked(edges.select("poly_id", "x1", "y1", "x2", "y2"))
    hits = points.join(e, crosses(F.col("x"), F.col("y"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))
    return hits.groupBy("poly_id", *points.columns).agg(F.count(F.lit(1)).alias("_n")).where("_n % 2 = 1").drop("_n")


def distance_join(points: DataFrame, sites: DataFrame, rx: float, ry: float) -> DataFrame:
    """Rows of points with site_id of each site (site_id, sx, sy) within the ellipse of radii rx, ry around them: sites are
    spread over the nine cells around theirs, so the join is on the cell."""
    near = sites.withColumn("_cx", F.floor(F.col("sx") / rx).cast("long")).withColumn("_cy", F.floor(F.col("sy") / ry).cast("long"))
    for c in ("_cx", "_cy"):
        near = near.withColumn(c, F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)))
    placed = points.withColumns({"_cx": F.floor(F.col("x") / rx).cast("long"), "_cy": F.floor(F.col("y") / ry).cast("long")})
    u, v = (F.col("x") - F.col("sx")) / rx, (F.col("y") - F.col("sy")) / ry
    return placed.join(checked(near), ["_cx", "_cy"]).where(u * u + v * v <= 1.0).drop("_cx", "_cy", "sx", "sy")
