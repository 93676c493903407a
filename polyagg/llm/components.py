"""Connected components by alternating star contraction, for links of any number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyagg.llm.common import Workspace


def components(links: DataFrame, space: Workspace, most: int | None = None) -> DataFrame:
    """node, root: of each node of links (a, b: long), the smallest node that it is joined to; after `most` rounds, if that is
    given, some node that it is joined to, so that equal roots still mean one component.

    Each round hangs every node's larger neighbours, then its smaller ones, on the smallest node around it; neighbours are
    never gathered, only their minimum, which Spark takes before it shuffles.  The rounds, about log n of them, end when
    one changes nothing.  Every round's links are a table in the shared folder.
    """
    edges = space.stage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark, done = None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = space.stage(large.distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v")
        small = space.stage(small.distinct(), "small")
        space.drop(edges, large)
        edges, done = small, done + 1
        if done == most:
            break
        if most is None:
            now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if now == mark:
                break
            mark = now
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    tops = edges.select(F.col("v").alias("node")).distinct().join(edges.select(F.col("u").alias("node")).distinct(), "node", "left_anti")
    return roots.unionByName(tops.select("node", F.col("node").alias("root")))
