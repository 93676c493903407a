"""Point views of the test tables and polygon sets with integer corners, for Spark and as SQL text."""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, SparkSession

from polyagg.sources.polygons import Polygons

#: Point views as SQL that Spark and DuckDB both read; {t} is the table.  v is an integer: cents, or hundredths.
VIEWS = {
    "lineitem": "SELECT CAST(l_extendedprice AS DOUBLE) AS x, CAST(l_quantity * 2000 AS DOUBLE) AS y, CAST(floor(l_discount * 100 + 0.5) AS BIGINT) AS v, CAST(l_linenumber AS BIGINT) AS line, CAST(floor(l_quantity + 0.5) AS BIGINT) AS quantity, CAST(floor(l_tax * 100 + 0.5) AS BIGINT) AS tax, {epoch}(l_shipdate) AS t FROM {t}",
    "lineitem_grid": "SELECT CAST(l_partkey % 2000 AS DOUBLE) AS x, CAST((l_suppkey % 100) * 20 AS DOUBLE) AS y, CAST(l_linenumber AS BIGINT) AS v, {epoch}(l_shipdate) AS t FROM {t}",
    "events": "SELECT event_id, CAST(value AS DOUBLE) AS x, CAST({epoch}(ts) % 86400 AS DOUBLE) AS y, CAST(floor(value * 100 + 0.5) AS BIGINT) AS v, CAST(user_id AS BIGINT) AS user_id, {epoch}(ts) AS t FROM {t}",
    "embeddings": "SELECT CAST({first} AS DOUBLE) AS x, CAST({second} AS DOUBLE) AS y, CAST(label AS BIGINT) AS v FROM {t}",
}
TABLE = {"lineitem": "lineitem", "lineitem_grid": "lineitem", "events": "events", "embeddings": "embeddings"}


def points(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """A view over one table, as a projection of its scan, so that filters and columns reach Parquet."""
    table = spark.read.parquet(f"{sf_dir}/{TABLE[view]}.parquet")
    sql = VIEWS[view].format(t="{df}", epoch="epoch_of", first="embedding[0]", second="embedding[1]").replace("epoch_of(l_shipdate)", "unix_timestamp(CAST(l_shipdate AS TIMESTAMP))").replace("epoch_of(ts)", "unix_timestamp(ts)")
    return spark.sql(sql, df=table)


def view_sql(view: str) -> str:
    """The same view for DuckDB."""
    sql = VIEWS[view].format(t=TABLE[view], epoch="epoch_of", first="embedding[1]", second="embedding[2]")
    for c in ("l_shipdate", "ts"):
        sql = sql.replace(f"epoch_of({c})", f"CAST(floor(epoch(CAST({c} AS TIMESTAMP))) AS BIGINT)")
    return sql


def stars(n: int, low: tuple[int, int], high: tuple[int, int], seed: int = 3) -> Polygons:
    """n concave stars of 9 to 24 corners with integer coordinates, spread over a box, overlapping here and there."""
    rng = random.Random(seed)
    width, height = high[0] - low[0], high[1] - low[1]
    rings = {}
    for i in range(n):
        corners = rng.randint(9, 24)
        rx, ry = rng.uniform(0.05, 0.2) * width, rng.uniform(0.05, 0.2) * height
        cx, cy = rng.uniform(low[0] + rx, high[0] - rx), rng.uniform(low[1] + ry, high[1] - ry)
        ring = []
        for k in range(corners):
            a, r = 2 * math.pi * k / corners, rng.uniform(0.35, 1.0)
            ring.append((float(round(cx + rx * r * math.cos(a))), float(round(cy + ry * r * math.sin(a)))))
        rings[i] = [ring]
    return Polygons(rings)


def tiles(n: int, low: tuple[int, int], high: tuple[int, int]) -> Polygons:
    """n by n rectangles that share their sides and fill a box."""
    xs, ys = ([low[k] + (high[k] - low[k]) * i // n for i in range(n + 1)] for k in (0, 1))
    box = lambda i, j: [(float(xs[i]), float(ys[j])), (float(xs[i + 1]), float(ys[j])), (float(xs[i + 1]), float(ys[j + 1])), (float(xs[i]), float(ys[j + 1]))]
    return Polygons({i * n + j: [box(i, j)] for i in range(n) for j in range(n)})


def square(x0: float, y0: float, x1: float, y1: float) -> list[tuple[float, float]]:
    return [(float(x0), float(y0)), (float(x1), float(y0)), (float(x1), float(y1)), (float(x0), float(y1))]


STARS = stars(24, (1000, 2000), (105000, 100000))
MANY_STARS = stars(256, (1000, 2000), (105000, 100000), seed=4)
TILES = tiles(8, (0, 0), (110000, 110000))
EVENT_STARS = stars(12, (0, 0), (500, 86400), seed=5)
#: Shapes whose borders run through points: shared and horizontal sides, a hole, two parts, a ring that crosses itself, one inside
#: another, one thinner than a pixel, and one without points.
SHAPES = Polygons({
    0: [square(0, 0, 1000, 1000)], 1: [square(1000, 0, 2000, 1000)], 2: [square(0, 1000, 2000, 1980), square(500, 1200, 1500, 1800)],
    3: [square(100, 100, 300, 300), square(700, 700, 900, 900)], 4: [[(200.0, 200.0), (1800.0, 1600.0), (1800.0, 200.0), (200.0, 1600.0)]],
    5: [square(250, 250, 750, 750)], 6: [[(0.0, 20.0), (2000.0, 20.0), (2000.0, 21.0), (0.0, 21.0)]], 7: [square(3000, 3000, 3500, 3500)],
    8: [[(0.0, 0.0), (500.0, 500.0), (1000.0, 0.0), (1000.0, 1500.0), (500.0, 1000.0), (0.0, 1500.0)]],
})
#: Around the origin, so that cell numbers are negative.
SMALL = Polygons({0: [[(-0.3, -0.3), (0.3, -0.3), (0.0, 0.3)]], 1: [[(-0.25, 0.0), (0.0, -0.25), (0.25, 0.0), (0.0, 0.25)]], 2: [[(0.0, 0.0), (0.4, 0.0), (0.4, 0.4)]]})
TOY = Polygons({0: [square(5.1, 5.1, 5.2, 5.2)], 1: [square(4.9, 4.9, 5.1, 5.1)]})
TOY_POINTS = [(5.15, 5.15), (5.15, 5.15), (5.0, 5.0), (5.0, 5.0), (5.0, 5.0)]


def number(v: float) -> str:
    return f"CAST('{v!r}' AS DOUBLE)"


def edges_sql(polygons: Polygons) -> str:
    rows = ", ".join(f"({p}, {k}, {e}, {a!r}, {b!r}, {c!r}, {d!r})" for p, k, e, a, b, c, d in polygons.edge_rows())
    casts = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in ("x1", "y1", "x2", "y2"))
    return f"SELECT CAST(poly_id AS INTEGER) AS poly_id, part_id, edge_id, {casts} FROM (VALUES {rows}) AS r(poly_id, part_id, edge_id, x1, y1, x2, y2)"


def ids_sql(polygons: Polygons) -> str:
    return f"SELECT CAST(poly_id AS INTEGER) AS poly_id FROM (VALUES {', '.join(f'({p})' for p in polygons.rings)}) AS r(poly_id)"
