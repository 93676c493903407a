"""Points in Parquet, laid out by cell of space and time, and result files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polyagg.functions.predicates import BUCKET


def _meta(path: str) -> str:
    return f"{path}/_layout"


def write_points(points: DataFrame, path: str, cell: float, seconds: int = BUCKET, columns: list[str] | None = None) -> None:
    """Write points (x, y, t, attributes) partitioned by bucket of time and column of cells, sorted by row of cells inside, so
    that a box reads only its partitions and, by the statistics of row groups, few pages of them.

    Rows are dealt by layout and a hash of place, so a crowded cell is written by several tasks.  Rows without a place or
    time are left out.  The layout and the range of time go into a table beside the data.
    """
    names = list(dict.fromkeys(["x", "y", "t", *(columns if columns is not None else points.columns)]))
    rows = points.select(*names).where("x IS NOT NULL AND y IS NOT NULL AND t IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    rows = rows.withColumns({"ct": F.floor(F.col("t") / seconds).cast("long"), "cx": F.floor(F.col("x") / cell).cast("long"), "cy": F.floor(F.col("y") / cell).cast("long")})
    dealt = rows.repartition("ct", "cx", F.pmod(F.xxhash64("y"), F.lit(4))).sortWithinPartitions("ct", "cx", "cy")
    dealt.write.partitionBy("ct", "cx").option("maxRecordsPerFile", 5_000_000).parquet(f"{path}/data")
    times = points.sparkSession.read.parquet(f"{path}/data").agg(F.min("t"), F.max("t")).first()
    layout = json.dumps({"cell": cell, "seconds": seconds, "columns": names, "t_min": times[0], "t_max": times[1]})
    points.sparkSession.createDataFrame([(layout,)], "layout string").coalesce(1).write.text(_meta(path))


def layout(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(_meta(path)).first()[0])


def read_box(spark: SparkSession, path: str, low: tuple[float, float, int], high: tuple[float, float, int], columns: list[str] | None = None, coarse: bool = False) -> DataFrame:
    """Points with low <= (x, y, t) <= high; coarse: all points of the cells that the box touches.  The cells are a filter on
    the partition columns, which Spark would not derive from one on x and t."""
    meta = layout(spark, path)
    cell, seconds = meta["cell"], meta["seconds"]
    rows = spark.read.parquet(f"{path}/data")
    keep: Column = F.col("ct").between(low[2] // seconds, high[2] // seconds)
    keep &= F.col("cx").between(int(low[0] // cell), int(high[0] // cell)) & F.col("cy").between(int(low[1] // cell), int(high[1] // cell))
    if not coarse:
        keep &= F.col("x").between(low[0], high[0]) & F.col("y").between(low[1], high[1]) & F.col("t").between(low[2], high[2])
    return rows.where(keep).select(*(columns or meta["columns"]))


def full_scan_box(points: DataFrame, low: tuple, high: tuple) -> DataFrame:
    """Number of points in a closed box, and of those at the origin, by reading all."""
    inside = F.col("x").between(low[0], high[0]) & F.col("y").between(low[1], high[1]) & F.col("t").between(low[2], high[2])
    return points.where(inside).agg(F.count(F.lit(1)).alias("cnt"), F.count_if((F.col("x") == 0) & (F.col("y") == 0)).alias("at_origin"))


def cell_histogram(points: DataFrame, cell_x: float, cell_y: float, seconds: int = BUCKET) -> DataFrame:
    """Points in each cell of space and time."""
    cells = [F.floor(F.col("x") / cell_x).cast("long").alias("cx"), F.floor(F.col("y") / cell_y).cast("long").alias("cy"), F.floor(F.col("t") / seconds).cast("long").alias("ct")]
    return points.groupBy(*cells).agg(F.count(F.lit(1)).alias("cnt"))


def write_result(result: DataFrame, path: str, columns: list[str]) -> None:
    """A result by polygon as tab-separated text in one file, by id; a result has one row for each polygon."""
    result.select(*columns).orderBy(columns[0]).coalesce(1).write.option("sep", "\t").csv(path)


def write_counts(result: DataFrame, path: str, average: bool = False) -> None:
    write_result(result, path, ["poly_id", "avg_v" if average else "cnt"])


def write_ranges(result: DataFrame, path: str) -> None:
    write_result(result, path, ["poly_id", "worst_lo", "worst_hi", "expected_lo", "expected_hi"])


def save_index(cells: DataFrame, path: str) -> None:
    cells.write.parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
