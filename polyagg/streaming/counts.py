"""Counts by polygon and window of time over a stream of points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyagg.operators.index import grid_index, index_join
from polyagg.plans.query import SpatialAggregation


def windowed_counts(points: DataFrame, query: SpatialAggregation, time: str, width: str, late: str) -> DataFrame:
    """(window_start, poly_id, cnt) of streamed points (x, y, time): each is joined with the index, which does not change, and
    counted in its window.  In the output modes append and update, rows later than `late` behind the latest are dropped, and so are
    the counts kept for their windows; in complete mode Spark keeps all windows, and late rows count.  Also runs on a table that is no
    stream."""
    edges = query.polygons.edges(points.sparkSession)
    if points.isStreaming:
        points = points.withWatermark(time, late)
    found = index_join(points, grid_index(edges, query.index_grid()), query.index_grid())
    counts = found.groupBy(F.window(time, width).alias("w"), "poly_id").agg(F.count(F.lit(1)).alias("cnt"))
    return counts.select(F.col("w.start").alias("window_start"), "poly_id", "cnt")
