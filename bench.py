"""Times the headline queries; prints one JSON line.  BENCH_SF_DIR: the tables; BENCH_CPUS: cores."""

import json
import os
import time

from pyspark.sql import SparkSession

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "count_exact_nested", "count_index", "avg_index", "count_hybrid", "avg_hybrid", "raster_count_64", "raster_count_128", "raster_count_512", "raster_avg_128",
    "raster_epsilon", "bounds", "index_many_polygons", "tiles_partition", "filter_eq", "filter_conj4", "time_range_exact", "distance_join", "cell_histogram", "full_scan_box",
]


def main() -> None:
    from polyagg.queries import QUERIES

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        best = None
        for _ in range(2):  # the first run compiles
            start = time.time()
            QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.time() - start)
        took[name] = round(best, 3)
    spark.stop()
    print(json.dumps({"metric": "total of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
