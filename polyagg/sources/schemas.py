"""Schemas of the point data sets, and the reader of their fixed-width binary records."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polyagg.functions.geometry import to_plane

# The fields of a record in file order, as (name, struct code, Spark type); little-endian, without padding.
TAXI = [
    ("db_idx", "Q", "bigint"), ("pickup_lon", "d", "double"), ("pickup_lat", "d", "double"), ("dropoff_lon", "d", "double"), ("dropoff_lat", "d", "double"),
    ("pickup_time", "Q", "bigint"), ("dropoff_time", "Q", "bigint"), ("vendor", "4s", "string"), ("duration", "I", "bigint"), ("miles", "f", "double"),
    ("fare", "H", "bigint"), ("surcharge", "H", "int"), ("mta_tax", "H", "int"), ("tip", "H", "int"), ("toll", "H", "int"), ("total", "H", "int"),
    ("medallion_id", "H", "int"), ("license_id", "H", "int"), ("store_and_forward", "?", "boolean"), ("payment_type", "B", "int"), ("passengers", "B", "int"), ("rate_code", "B", "int"),
]
TWEET = [("user_id", "q", "bigint"), ("time", "q", "bigint"), ("loc_x", "f", "double"), ("loc_y", "f", "double"), ("favorites", "i", "int"), ("retweets", "i", "int")]

EDGE = T.StructType([
    T.StructField("poly_id", T.IntegerType()), T.StructField("part_id", T.IntegerType()), T.StructField("edge_id", T.IntegerType()),
    *(T.StructField(c, T.DoubleType()) for c in ("x1", "y1", "x2", "y2")),
])


def schema(fields: list[tuple[str, str, str]]) -> str:
    return ", ".join(f"{name} {kind}" for name, _, kind in fields)


def read_records(spark: SparkSession, path: str, fields: list[tuple[str, str, str]]) -> DataFrame:
    """Rows of a file of fixed-width records; Spark splits it at record boundaries.  A cut last record is an error."""
    layout = "<" + "".join(code for _, code, _ in fields)
    records = spark.sparkContext.binaryRecords(path, struct.calcsize(layout)).map(lambda r: (bytes(r),)).toDF("record binary")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [struct.unpack(layout, r) for r in batch.column(0).to_pylist()]
            columns = []
            for (_, code, kind), values in zip(fields, zip(*rows, strict=True) if rows else [()] * len(fields), strict=True):
                values = [v.rstrip(b"\0").decode("latin-1") for v in values] if code.endswith("s") else list(values)
                columns.append(pa.array(values, {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[kind]))
            yield pa.RecordBatch.from_arrays(columns, names=[name for name, _, _ in fields])

    return records.mapInArrow(parse, schema(fields))


def taxi_points(trips: DataFrame) -> DataFrame:
    """Points (x, y, t, attributes) of taxi trips; pick-ups outside the box are left out."""
    x, y = to_plane(F.col("pickup_lat"), F.col("pickup_lon"))
    return trips.select(x.alias("x"), y.alias("y"), F.col("pickup_time").alias("t"), "duration", "miles", "fare", "passengers").where("x IS NOT NULL")


def tweet_points(tweets: DataFrame) -> DataFrame:
    """Points of tweets, whose location is latitude (loc_x) and longitude (loc_y)."""
    x, y = to_plane(F.col("loc_x"), F.col("loc_y"))
    return tweets.select(x.alias("x"), y.alias("y"), F.col("time").alias("t"), "favorites", "retweets").where("x IS NOT NULL")
