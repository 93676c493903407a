"""The spatial queries over the test tables, each with its SQL."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyagg import fixtures as X
from polyagg.functions import geometry as G
from polyagg.functions.predicates import BUCKET
from polyagg.operators.index import distance_join, grid_index
from polyagg.operators.raster import border_pixels, fraction, pixel_sides, pixels, relative_error
from polyagg.plans.query import SpatialAggregation
from polyagg.sources import polygons as P
from polyagg.sources import store
from polyagg.streaming.counts import windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

SETS = {"lineitem": X.STARS, "lineitem_grid": X.SHAPES, "events": X.EVENT_STARS, "embeddings": X.SMALL}


def build(spark: SparkSession, sf_dir: str, view: str = "lineitem", polygons=None, **more) -> SpatialAggregation:
    return SpatialAggregation(X.points(spark, sf_dir, view), polygons or SETS[view], F.col("v"), **more)


# The plain form in SQL: every distinct place against every edge, odd numbers of crossings.
CROSS = G.CROSSES.format(x="p.x", y="p.y")


def exact_sql(view: str, polygons, where: str = "TRUE", keep: str = "cnt, sum_v, avg_v") -> str:
    return f"""
    WITH pts AS (SELECT * FROM ({X.view_sql(view)}) AS q WHERE {where}),
    p AS (SELECT x, y, count(*) AS c, sum(v) AS s FROM pts GROUP BY x, y),
    e AS ({X.edges_sql(polygons)}),
    hits AS (SELECT p.x, p.y, p.c, p.s, e.poly_id FROM p JOIN e ON {CROSS} GROUP BY p.x, p.y, p.c, p.s, e.poly_id HAVING count(*) % 2 = 1),
    a AS (SELECT poly_id, sum(c) AS c, sum(s) AS s FROM hits GROUP BY poly_id),
    d AS (SELECT i.poly_id, CAST(coalesce(a.c, 0) AS BIGINT) AS cnt, CAST(coalesce(a.s, 0) AS BIGINT) AS sum_v FROM ({X.ids_sql(polygons)}) AS i LEFT JOIN a ON a.poly_id = i.poly_id),
    r AS (SELECT poly_id, cnt, sum_v, CASE WHEN cnt > 0 THEN CAST(sum_v AS DOUBLE) / cnt ELSE CAST(0 AS DOUBLE) END AS avg_v FROM d)
    SELECT poly_id, {keep} FROM r"""


def pixels_sql(view: str, grid: G.Grid, where: str = "TRUE") -> str:
    n, b = X.number, grid.bounds
    px = f"least(CAST(floor((x - {n(b.x0)}) / ({n(b.x1)} - {n(b.x0)}) * {grid.nx}) AS BIGINT), {grid.nx - 1})"
    py = f"least(CAST(floor((y - {n(b.y0)}) / ({n(b.y1)} - {n(b.y0)}) * {grid.ny}) AS BIGINT), {grid.ny - 1})"
    on = f"x >= {n(b.x0)} AND x < {n(b.x1)} AND y >= {n(b.y0)} AND y < {n(b.y1)}"
    return f"SELECT CAST({px} AS BIGINT) AS px, CAST({py} AS BIGINT) AS py, count(*) AS cnt, CAST(sum(v) AS BIGINT) AS sum_v FROM ({X.view_sql(view)}) AS q WHERE {on} AND {where} GROUP BY 1, 2"


def raster_sql(view: str, polygons, grid: G.Grid, where: str = "TRUE", keep: str = "cnt, sum_v, avg_v") -> str:
    n, b = X.number, grid.bounds
    return f"""
    WITH pix AS ({pixels_sql(view, grid, where)}),
    p AS (SELECT *, {n(b.x0)} + (px + CAST(0.5 AS DOUBLE)) * {n(grid.dx)} AS x, {n(b.y0)} + (py + CAST(0.5 AS DOUBLE)) * {n(grid.dy)} AS y FROM pix),
    e AS ({X.edges_sql(polygons)}),
    hits AS (SELECT p.px, p.py, p.cnt AS c, p.sum_v AS s, e.poly_id FROM p JOIN e ON {CROSS} GROUP BY 1, 2, 3, 4, 5 HAVING count(*) % 2 = 1),
    a AS (SELECT poly_id, sum(c) AS c, sum(s) AS s FROM hits GROUP BY poly_id),
    d AS (SELECT i.poly_id, CAST(coalesce(a.c, 0) AS BIGINT) AS cnt, CAST(coalesce(a.s, 0) AS BIGINT) AS sum_v FROM ({X.ids_sql(polygons)}) AS i LEFT JOIN a ON a.poly_id = i.poly_id),
    r AS (SELECT poly_id, cnt, sum_v, CASE WHEN cnt > 0 THEN CAST(sum_v AS DOUBLE) / cnt ELSE CAST(0 AS DOUBLE) END AS avg_v FROM d)
    SELECT poly_id, {keep} FROM r"""


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


# Exact aggregation by each strategy.
add("count_exact_nested", lambda s, d: build(s, d).run("nested").select("poly_id", "cnt"), exact_sql("lineitem", X.STARS, keep="cnt"))
for view, own in SETS.items():
    add(f"index_{view}", lambda s, d, v=view: build(s, d, v).run("index"), exact_sql(view, own))
    add(f"hybrid_{view}", lambda s, d, v=view: build(s, d, v, canvas_pixels=(96, 96)).run("hybrid"), exact_sql(view, own))
add("count_index", lambda s, d: build(s, d).run().select("poly_id", "cnt"), exact_sql("lineitem", X.STARS, keep="cnt"))
add("count_hybrid", lambda s, d: build(s, d, canvas_pixels=(128, 128)).run("hybrid").select("poly_id", "cnt"), exact_sql("lineitem", X.STARS, keep="cnt"))
add("sum_exact", lambda s, d: build(s, d).run().select("poly_id", "sum_v"), exact_sql("lineitem", X.STARS, keep="sum_v"))
add("avg_exact", lambda s, d: build(s, d).run("index").select("poly_id", "avg_v"), exact_sql("lineitem", X.STARS, keep="avg_v"))
add("avg_index", lambda s, d: build(s, d).run().select("poly_id", "avg_v"), exact_sql("lineitem", X.STARS, keep="avg_v"))
add("avg_hybrid", lambda s, d: build(s, d, canvas_pixels=(256, 256)).run("hybrid").select("poly_id", "avg_v"), exact_sql("lineitem", X.STARS, keep="avg_v"))
add("index_coarse_grid", lambda s, d: build(s, d, index_cells=8).run(), exact_sql("lineitem", X.STARS))
add("index_many_polygons", lambda s, d: build(s, d, polygons=X.MANY_STARS).run(), exact_sql("lineitem", X.MANY_STARS))
add("tiles_partition", lambda s, d: build(s, d, polygons=X.TILES).run(), exact_sql("lineitem", X.TILES))

# Fractional values: doubles of two decimal places, and decimals of three.
HUNDREDTHS = f"SELECT poly_id, cnt, CAST(sum_v AS DOUBLE) / 100 AS sum_v, CASE WHEN cnt > 0 THEN CAST(sum_v AS DOUBLE) / 100 / cnt ELSE CAST(0 AS DOUBLE) END AS avg_v FROM ({exact_sql('lineitem', X.STARS)}) AS q"
THOUSANDTHS = HUNDREDTHS.replace("/ 100", "/ 1000")


def fractional(strategy: str, decimal: bool = False) -> Query:
    value = lambda: (F.col("v") / F.lit(1000)).cast("decimal(20,3)") if decimal else F.col("v") / 100
    return lambda s, d: replace(build(s, d, canvas_pixels=(128, 128), scale=2), value=value()).run(strategy).withColumn("sum_v", F.col("sum_v").cast("double"))


for strategy in ("index", "hybrid", "nested"):
    add(f"avg_double_{strategy}", fractional(strategy), HUNDREDTHS)
    add(f"sum_decimal_{strategy}", fractional(strategy, True), THOUSANDTHS)
add("avg_double_raster", fractional("raster"), HUNDREDTHS.replace(exact_sql("lineitem", X.STARS), raster_sql("lineitem", X.STARS, G.Grid(X.STARS.bounds(), 128, 128))))

# Filters.
for name, filters in {
    "filter_eq": [("line", "=", 1)], "filter_lt": [("quantity", "<", 10)], "filter_lte": [("quantity", "<=", 10)], "filter_gt": [("tax", ">", 4)],
    "filter_gte": [("tax", ">=", 4)], "filter_conj4": [("line", "=", 1), ("quantity", ">", 10), ("tax", "<", 7), ("v", ">=", 2)],
}.items():
    where = " AND ".join(f"{c} {op} {v}" for c, op, v in filters)
    add(name, lambda s, d, f=filters: build(s, d).where(*f).run(), exact_sql("lineitem", X.STARS, where))
START, END = 852076800, 915148799  # 1997 and 1998
add("time_range_exact", lambda s, d: build(s, d).between(START, END).run(), exact_sql("lineitem", X.STARS, f"t BETWEEN {START} AND {END}"))
add("time_range_coarse", lambda s, d: build(s, d).between(START, END, coarse=True).run(), exact_sql("lineitem", X.STARS, f"floor(t / {float(BUCKET)}) BETWEEN {START // BUCKET} AND {END // BUCKET}"))

# Raster: by resolution, by error bound, averages, filters.
for n in (64, 128, 512):
    add(f"raster_count_{n}", lambda s, d, n=n: build(s, d, canvas_pixels=(n, n)).run("raster").select("poly_id", "cnt"), raster_sql("lineitem", X.STARS, G.Grid(X.STARS.bounds(), n, n), keep="cnt"))
add("raster_avg_128", lambda s, d: build(s, d, canvas_pixels=(128, 128)).run("raster"), raster_sql("lineitem", X.STARS, G.Grid(X.STARS.bounds(), 128, 128)))
add("raster_shapes", lambda s, d: build(s, d, "lineitem_grid", canvas_pixels=(50, 50)).run("raster"), raster_sql("lineitem_grid", X.SHAPES, G.Grid(X.SHAPES.bounds(), 50, 50)))
CELL = G.pixel_size(500, 1.0)
add("raster_epsilon", lambda s, d: build(s, d, pixel=CELL).run("raster"), raster_sql("lineitem", X.STARS, G.canvas(X.STARS.bounds(), CELL)))
add("raster_filtered", lambda s, d: build(s, d, canvas_pixels=(128, 128)).where(("quantity", "<", 10)).run("raster"), raster_sql("lineitem", X.STARS, G.Grid(X.STARS.bounds(), 128, 128), "quantity < 10"))
CANVAS = G.Grid(X.STARS.bounds(), 128, 128)
add("raster_pixels", lambda s, d: pixels(X.points(s, d, "lineitem"), CANVAS).drop("n_v"), pixels_sql("lineitem", CANVAS))


# The index, borders and ranges.
def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_index(X.SHAPES.edges(spark), G.Grid(X.SHAPES.bounds(), 35, 35)).select("cx", "cy", "poly_id", "mixed")


add("poly_grid_index", _cells)
BORDER = G.Grid(X.EVENT_STARS.bounds(), 48, 40)
T0, T1 = G.clip_range("x1", "y1", "x2", "y2", *pixel_sides(BORDER))
TOUCH_SQL = f"SELECT * FROM (SELECT e.*, px, py, {T0} AS t0, {T1} AS t1 FROM ({X.edges_sql(X.EVENT_STARS)}) AS e, (SELECT unnest(range({BORDER.nx})) AS px) AS a, (SELECT unnest(range({BORDER.ny})) AS py) AS b) AS c WHERE t0 <= t1"
add("border_pixels", lambda s, d: border_pixels(X.EVENT_STARS.edges(s), BORDER).select("poly_id", "px", "py").distinct(), f"SELECT DISTINCT poly_id, px, py FROM ({TOUCH_SQL}) AS t")


def ranges_sql(per_edge: bool) -> str:
    n, b = X.number, BORDER.bounds
    inner = G.CROSSES.format(x="m.x", y="m.y")
    border = f"SELECT poly_id, edge_id, px, py, {fraction(BORDER)} AS part FROM touch"
    if not per_edge:
        border = f"SELECT poly_id, px, py, max(part) AS part FROM ({border}) AS w GROUP BY 1, 2, 3"
    return f"""
    WITH touch AS ({TOUCH_SQL}), pix AS ({pixels_sql("events", BORDER)}), e AS ({X.edges_sql(X.EVENT_STARS)}),
    p AS (SELECT *, {n(b.x0)} + (px + CAST(0.5 AS DOUBLE)) * {n(BORDER.dx)} AS x, {n(b.y0)} + (py + CAST(0.5 AS DOUBLE)) * {n(BORDER.dy)} AS y FROM pix),
    hits AS (SELECT p.px, p.py, p.cnt, e.poly_id FROM p JOIN e ON {CROSS} GROUP BY 1, 2, 3, 4 HAVING count(*) % 2 = 1),
    raster AS (SELECT poly_id, sum(cnt) AS cnt FROM hits GROUP BY 1),
    border AS ({border}),
    m AS (SELECT b.*, p.cnt, p.x, p.y, row_number() OVER () AS id FROM border AS b JOIN p ON b.px = p.px AND b.py = p.py),
    odd AS (SELECT m.id FROM m JOIN e ON e.poly_id = m.poly_id AND {inner} GROUP BY m.id HAVING count(*) % 2 = 1),
    w AS (SELECT m.poly_id, m.cnt, CAST(ceil(m.part * m.cnt) AS BIGINT) AS share, odd.id IS NOT NULL AS within FROM m LEFT JOIN odd ON odd.id = m.id),
    s AS (SELECT poly_id, sum(CASE WHEN within THEN cnt ELSE 0 END) AS ia, sum(CASE WHEN within THEN 0 ELSE cnt END) AS oa, sum(CASE WHEN within THEN share ELSE 0 END) AS iq, sum(CASE WHEN within THEN 0 ELSE share END) AS oq FROM w GROUP BY 1)
    SELECT i.poly_id, CAST(coalesce(r.cnt, 0) AS BIGINT) AS cnt, CAST(coalesce(r.cnt, 0) - coalesce(ia, 0) AS BIGINT) AS worst_lo, CAST(coalesce(r.cnt, 0) + coalesce(oa, 0) AS BIGINT) AS worst_hi,
      CAST(coalesce(r.cnt, 0) - coalesce(iq, 0) AS BIGINT) AS expected_lo, CAST(coalesce(r.cnt, 0) + coalesce(oq, 0) AS BIGINT) AS expected_hi
    FROM ({X.ids_sql(X.EVENT_STARS)}) AS i LEFT JOIN raster AS r ON r.poly_id = i.poly_id LEFT JOIN s ON s.poly_id = i.poly_id"""


for per_edge in (False, True):
    suffix = "_per_edge" if per_edge else ""
    add(f"bounds{suffix}", lambda s, d, p=per_edge: build(s, d, "events", canvas_pixels=(BORDER.nx, BORDER.ny)).ranges(p), ranges_sql(per_edge))
add(
    "relative_error", lambda s, d: relative_error(build(s, d).run(), build(s, d, canvas_pixels=(128, 128)).run("raster")),
    f"""SELECT a.poly_id, abs(a.cnt - r.cnt) * CAST(100 AS DOUBLE) / a.cnt AS error_percent FROM ({exact_sql("lineitem", X.STARS)}) AS a
    JOIN ({raster_sql("lineitem", X.STARS, CANVAS)}) AS r ON r.poly_id = a.poly_id WHERE a.cnt >= 100 OR (a.cnt > 0 AND abs(a.cnt - r.cnt) > 25)""",
)

# Polygon measures.
E_SQL = X.edges_sql(X.STARS)
add("poly_bounds", lambda s, d: P.poly_bounds(X.STARS.edges(s)), f"SELECT poly_id, min(x1) AS min_x, min(y1) AS min_y, max(x1) AS max_x, max(y1) AS max_y FROM ({E_SQL}) AS e GROUP BY 1")
add("poly_area", lambda s, d: P.poly_area(X.STARS.edges(s)), f"SELECT poly_id, abs(sum(x1 * y2 - x2 * y1)) / 2 AS area FROM ({E_SQL}) AS e GROUP BY 1")
add(
    "poly_perimeter", lambda s, d: P.poly_perimeter(X.STARS.edges(s)).select("poly_id", F.floor(F.col("perimeter") * 1000 + 0.5).cast("long").alias("milli")),
    f"SELECT poly_id, CAST(floor(sum(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))) * 1000 + 0.5) AS BIGINT) AS milli FROM ({E_SQL}) AS e GROUP BY 1",
)
STRAIGHT = P.Polygons({0: [[(0.0, 0.0), (5.0, 0.0), (10.0, 0.0), (10.0, 10.0), (4.0, 10.0), (0.0, 10.0), (0.0, 3.0)]], 1: [[(0.0, 0.0), (4.0, 4.0), (8.0, 8.0), (0.0, 8.0)]]})
add("poly_simplify", lambda s, d: P.simplified(STRAIGHT.edges(s)).select("poly_id", "edge_id", "x", "y"), f"""
    WITH e AS ({X.edges_sql(STRAIGHT)}), n AS (SELECT poly_id, count(*) AS n FROM e GROUP BY 1)
    SELECT e.poly_id, e.edge_id, e.x1 AS x, e.y1 AS y FROM e JOIN n ON n.poly_id = e.poly_id JOIN e AS b ON b.poly_id = e.poly_id AND b.edge_id = (e.edge_id + n.n - 1) % n.n
    WHERE ((e.x1 - b.x1) * (e.x2 - e.x1) + (e.y1 - b.y1) * (e.y2 - e.y1)) / sqrt(((e.x1 - b.x1) ** 2 + (e.y1 - b.y1) ** 2) * ((e.x2 - e.x1) ** 2 + (e.y2 - e.y1) ** 2)) <= 1 - 1e-6""")

# Storage.
LOW, HIGH = (20000.0, 30000.0, START), (60000.0, 70000.0, END)
IN_BOX = " AND ".join(f"{c} BETWEEN {a} AND {b}" for c, a, b in zip("xyt", LOW, HIGH, strict=True))


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and Spark is one process, as in tests, a folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    return (found or f"file://{tempfile.mkdtemp(prefix='polyagg-')}").rstrip("/") + f"/points-{uuid.uuid4().hex[:12]}"


def index_scan_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    store.write_points(X.points(spark, sf_dir, "lineitem"), path, cell=5000.0, seconds=100 * BUCKET, columns=["v"])
    return store.read_box(spark, path, LOW, HIGH)


def index_scan_coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    store.write_points(X.points(spark, sf_dir, "lineitem"), path, cell=5000.0, seconds=100 * BUCKET, columns=["v"])
    return store.read_box(spark, path, LOW, HIGH, coarse=True).agg(F.count(F.lit(1)).alias("cnt"))


COARSE = " AND ".join([*(f"floor({c} / 5000.0) BETWEEN {a // 5000} AND {b // 5000}" for c, a, b in zip("xy", LOW[:2], HIGH[:2], strict=True)), f"floor(t / {100.0 * BUCKET}) BETWEEN {START // (100 * BUCKET)} AND {END // (100 * BUCKET)}"])
add("index_scan_box", index_scan_box, f"SELECT x, y, t, v FROM ({X.view_sql('lineitem')}) AS q WHERE {IN_BOX}")
add("index_scan_coarse", index_scan_coarse, f"SELECT count(*) AS cnt FROM ({X.view_sql('lineitem')}) AS q WHERE {COARSE}")
add("full_scan_box", lambda s, d: store.full_scan_box(X.points(s, d, "lineitem"), LOW, HIGH), f"SELECT count(*) AS cnt, count(*) FILTER (x = 0 AND y = 0) AS at_origin FROM ({X.view_sql('lineitem')}) AS q WHERE {IN_BOX}")
add(
    "cell_histogram", lambda s, d: store.cell_histogram(X.points(s, d, "embeddings").withColumn("t", F.col("v") * BUCKET), 0.05, 0.05),
    f"SELECT CAST(floor(x / CAST(0.05 AS DOUBLE)) AS BIGINT) AS cx, CAST(floor(y / CAST(0.05 AS DOUBLE)) AS BIGINT) AS cy, v AS ct, count(*) AS cnt FROM ({X.view_sql('embeddings')}) AS q GROUP BY 1, 2, 3",
)
add("scan_limit", lambda s, d: X.points(s, d, "lineitem").limit(100).agg(F.count(F.lit(1)).alias("cnt")), "SELECT count(*) AS cnt FROM (SELECT * FROM lineitem LIMIT 100) AS q")
add("time_extent", lambda s, d: X.points(s, d, "lineitem").agg(F.min("t").alias("t_min"), F.max("t").alias("t_max")), f"SELECT min(t) AS t_min, max(t) AS t_max FROM ({X.view_sql('lineitem')}) AS q")


# Projection: customers spread over a box of degrees that reaches beyond the kept one.
PLACES = "SELECT c_custkey, 24 + CAST(c_custkey % 260 AS DOUBLE) / 10 AS lat, -126 + CAST(c_custkey * 7 % 600 AS DOUBLE) / 10 AS lon FROM {t}"


def mercator_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(PLACES.format(t="{df}"), df=spark.read.parquet(f"{sf_dir}/customer.parquet"))
    x, y = G.to_plane(F.col("lat"), F.col("lon"))
    rows = rows.select(F.floor(x / 1e6 + 0.37).cast("long").alias("cx"), F.floor(y / 1e6 + 0.37).cast("long").alias("cy")).where("cx IS NOT NULL")
    return rows.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("cnt"))


CX, CY = G.box_centre()
add("mercator_cells", mercator_cells, f"""
    SELECT CAST(floor(((lon + 180) / 360 * {X.number(G.WORLD)} - {X.number(CX)}) / 1e6 + 0.37) AS BIGINT) AS cx,
      CAST(floor(((1 - atanh(sin(radians(lat))) / {X.number(math.pi)}) / 2 * {X.number(G.WORLD)} - {X.number(CY)}) / 1e6 + 0.37) AS BIGINT) AS cy, count(*) AS cnt
    FROM ({PLACES.format(t="customer")}) AS q WHERE lat BETWEEN {G.BOX[0]} AND {G.BOX[2]} AND lon BETWEEN {G.BOX[1]} AND {G.BOX[3]} GROUP BY 1, 2""")

# Extensions: points near sites, and counts over a stream.
SITES = [(i, float(10000 + 9000 * (i % 10)), float(6000 + 10000 * (i // 2 % 10))) for i in range(20)]
add(
    "distance_join", lambda s, d: distance_join(X.points(s, d, "lineitem").select("x", "y", "v"), s.createDataFrame(SITES, "site_id long, sx double, sy double"), 4000.0, 5000.0).groupBy("site_id").agg(F.count(F.lit(1)).alias("cnt"), F.sum("v").alias("sum_v")),
    f"""SELECT site_id, count(*) AS cnt, CAST(sum(v) AS BIGINT) AS sum_v FROM ({X.view_sql("lineitem")}) AS q, (SELECT CAST(i AS BIGINT) AS site_id, CAST(a AS DOUBLE) AS sx, CAST(b AS DOUBLE) AS sy FROM (VALUES {", ".join(map(str, SITES))}) AS r(i, a, b)) AS s
    WHERE (x - sx) / 4000.0 * ((x - sx) / 4000.0) + (y - sy) / 5000.0 * ((y - sy) / 5000.0) <= 1 GROUP BY 1""",
)


def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs the stream over what is there, then gives what it has written."""
    path = shared_folder(spark)
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(table.schema).parquet(f"{sf_dir}/events.parquet*")
    points = stream.select(F.col("value").alias("x"), (F.unix_timestamp("ts") % 86400).cast("double").alias("y"), F.col("ts").cast("timestamp").alias("time"))
    counts = windowed_counts(points, SpatialAggregation(points, X.EVENT_STARS), "time", "1 day", "40 days")
    latest: dict[tuple, int] = {}

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/counts-{number}")
        latest["path"] = f"{path}/counts-{number}"

    run = counts.writeStream.outputMode("complete").option("checkpointLocation", f"{path}/state").foreachBatch(keep).trigger(availableNow=True).start()
    run.awaitTermination()
    out = spark.read.parquet(latest["path"])
    return out.select(F.unix_timestamp("window_start").alias("day"), "poly_id", "cnt")


add("stream_counts", stream_counts, f"""
    WITH p AS (SELECT event_id, x, y, t - t % 86400 AS day FROM ({X.view_sql("events")}) AS q), e AS ({X.edges_sql(X.EVENT_STARS)}),
    hits AS (SELECT p.event_id, p.day, e.poly_id FROM p JOIN e ON {CROSS} GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1)
    SELECT CAST(day AS BIGINT) AS day, poly_id, count(*) AS cnt FROM hits GROUP BY 1, 2""")
