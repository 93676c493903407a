import struct

import pytest
from polyagg import fixtures as X
from polyagg.functions import geometry as G
from polyagg.functions.predicates import conjunction, preset, time_range
from polyagg.plans.query import SpatialAggregation
from polyagg.sources import polygons as P
from polyagg.sources import schemas, store
from pyspark.sql import functions as F


def test_polygon_files(spark, tmp_path):
    (tmp_path / "two.txt").write_text("2\n1\n5\n40 -100\n40 -99\n40 -99\n41 -99\n40 -100\n2\n3\n30 -90\n31 -90\n31 -91\n3\n10 0\n11 0\n11 1\n")
    (tmp_path / "list.csv").write_text("neigh,two.txt\n\n")
    found = P.read_collections(spark, f"file://{tmp_path}/list.csv")
    two = found["neigh"]
    assert two.rings == {0: [[(40.0, -100.0), (40.0, -99.0), (41.0, -99.0)]], 1: [[(30.0, -90.0), (31.0, -90.0), (31.0, -91.0)], [(10.0, 0.0), (11.0, 0.0), (11.0, 1.0)]]}
    flat = two.projected()
    assert list(flat.rings) == [0]  # the other has a part outside the box; ids stay
    x, y = G.to_plane(F.lit(40.0), F.lit(-100.0))
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert flat.rings[0][0][0] == pytest.approx((r.x, r.y), abs=1e-3)


def test_binary_records(spark, tmp_path):
    layout = "<" + "".join(c for _, c, _ in schemas.TWEET)
    rows = [(7, 1_300_000_000 + i, 40.0 + i, -100.0, i, -i) for i in range(20)]
    (tmp_path / "tweets.bin").write_bytes(b"".join(struct.pack(layout, *r) for r in rows))
    df = schemas.read_records(spark, f"file://{tmp_path}/tweets.bin", schemas.TWEET)
    assert [tuple(r) for r in df.orderBy("time").collect()] == rows
    assert schemas.tweet_points(df).count() == 10  # latitudes up to 49
    assert struct.calcsize("<" + "".join(c for _, c, _ in schemas.TAXI)) > 0
    layout = "<" + "".join(c for _, c, _ in schemas.TAXI)
    trip = (1, -73.9, 40.7, -73.8, 40.8, 1_300_000_000, 1_300_000_600, b"CMT", 600, 1.5, 900, 0, 50, 100, 0, 1050, 3, 4, True, 1, 2, 1)
    (tmp_path / "taxi.bin").write_bytes(struct.pack(layout, *trip))
    r = schemas.taxi_points(schemas.read_records(spark, f"file://{tmp_path}/taxi.bin", schemas.TAXI)).where(conjunction([("passengers", "=", 2), ("miles", "<", 10.0)])).first()
    assert (r.t, r.duration, r.fare) == (1_300_000_000, 600, 900)


def test_store_prunes(spark, tmp_path):
    points = spark.range(5000).select((F.col("id") % 100).cast("double").alias("x"), (F.col("id") % 77).cast("double").alias("y"), (F.col("id") * 1000).alias("t"), F.col("id").alias("v"), F.lit(1).alias("w"))
    path = f"file://{tmp_path}/p"
    store.write_points(points, path, cell=10.0, columns=["v"])
    box = store.read_box(spark, path, (5.0, 3.0, 900_000), (25.0, 40.0, 3_000_000))
    want = points.where("x BETWEEN 5 AND 25 AND y BETWEEN 3 AND 40 AND t BETWEEN 900000 AND 3000000")
    assert sorted(r.v for r in box.collect()) == sorted(r.v for r in want.collect())
    plan = box._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan and "ct" in plan.split("PartitionFilters")[1][:200]
    coarse = store.read_box(spark, path, (5.0, 3.0, 900_000), (25.0, 40.0, 3_000_000), coarse=True)
    assert coarse.count() >= want.count()
    assert store.layout(spark, path)["t_max"] == 4_999_000


def test_sinks(spark, tmp_path):
    result = spark.createDataFrame([(1, 5, 2.5), (0, 3, 0.0)], "poly_id int, cnt long, avg_v double")
    store.write_counts(result, f"file://{tmp_path}/c")
    store.write_counts(result, f"file://{tmp_path}/a", average=True)
    read = lambda p: "".join(f.read_text() for f in (tmp_path / p).glob("*.csv"))
    assert read("c") == "0\t3\n1\t5\n" and read("a") == "0\t0.0\n1\t2.5\n"
    ranges = spark.createDataFrame([(0, 1, 2, 3, 4)], "poly_id int, worst_lo long, worst_hi long, expected_lo long, expected_hi long")
    store.write_ranges(ranges, f"file://{tmp_path}/r")
    assert read("r") == "0\t1\t2\t3\t4\n"


def test_mercator_inverse(spark):
    rows = spark.createDataFrame([(25.0, -120.0), (40.7, -74.0), (49.0, -67.0)], "lat double, lon double")
    lat, lon = G.from_plane(*G.to_plane(F.col("lat"), F.col("lon")))
    for r in rows.select("lat", "lon", lat.alias("a"), lon.alias("b")).collect():
        assert (r.a, r.b) == pytest.approx((r.lat, r.lon), abs=1e-9)
    assert G.ground_resolution() == pytest.approx(0.0299, abs=1e-4)
    x, y = G.to_plane(F.lit(10.0), F.lit(-100.0))
    assert spark.range(1).select(x.isNull()).first()[0]


def test_canvas():
    g = G.canvas(G.Bounds(0, 0, 20000, 100), 1.0)
    assert (g.nx, g.ny) == (20001, 100)  # three tiles of 6667
    assert G.square_grid(G.Bounds(0, 0, 100, 50), 10).ny == 5


def test_scalars(spark):
    one = spark.range(1)
    at = lambda c: one.select(c).first()[0]
    L = lambda v: F.lit(float(v))
    assert at(G.point_segment_distance(L(0), L(2), L(-1), L(0), L(1), L(0))) == 2
    assert at(G.point_segment_distance(L(4), L(4), L(1), L(0), L(1), L(0))) == 5
    assert at(G.in_ellipse(L(1), L(0), 1, 2)) and not at(G.in_ellipse(L(1), L(1), 1, 2))
    assert at(G.outcode(L(-1), L(5), (0, 0, 2, 2))) == 9
    x, y = G.rotated(L(1), L(0), 90)
    assert (at(x), at(y)) == pytest.approx((0, 1))
    assert at(G.clamped(L(9), 0, 5)) == 5 and at(G.interpolated(L(2), L(4), 0.5)) == 3
    assert at(G.normalised(L(5), L(5), G.Bounds(0, 0, 10, 5))[1]) == 1


def test_presets_and_times(spark):
    assert [len(preset(n)) for n in range(5)] == [0, 1, 2, 3, 4]
    df = spark.createDataFrame([(0,), (863_999,), (864_000,), (None,)], "t long")
    assert df.where(time_range(1, 2)).count() == 0 and df.where(time_range(1, 2, coarse=True)).count() == 2


def toy(spark, **more):
    return SpatialAggregation(spark.createDataFrame([(*p, 1) for p in X.TOY_POINTS], "x double, y double, v long"), X.TOY, F.col("v"), **more)


def test_toy_sample(spark):
    for strategy in ("index", "nested", "hybrid"):
        assert sorted(map(tuple, toy(spark, canvas_pixels=(30, 30)).run(strategy).collect())) == [(0, 2, 2, 1.0), (1, 3, 3, 1.0)]
    with pytest.raises(ValueError):
        toy(spark).run("raster")


def test_invariants(spark):
    sf = "/root/testdata/sf0.001"
    points = X.points(spark, sf, "lineitem")
    exact = {r.poly_id: r.cnt for r in SpatialAggregation(points, X.STARS).run().collect()}
    errors = []
    for n in (32, 128, 1024):
        q = SpatialAggregation(points, X.STARS, canvas_pixels=(n, n))
        errors.append(sum(abs(r.cnt - exact[r.poly_id]) for r in q.run("raster").collect()))
        for r in q.ranges().collect():
            assert r.worst_lo <= exact[r.poly_id] <= r.worst_hi
            assert r.worst_lo <= r.expected_lo <= r.cnt <= r.expected_hi <= r.worst_hi
    assert errors[0] > errors[1] > errors[2]
    tiles = SpatialAggregation(points, X.TILES).run().agg(F.sum("cnt")).first()[0]
    assert tiles == points.where("x < 110000 AND y < 110000").count()


def test_odd_points(spark):
    rows = [(None, 1.0, 1), (float("nan"), 1.0, 1), (150.0, 150.0, None), (1e300, 1e300, 1), (200.0, 200.0, 5)]
    df = spark.createDataFrame(rows, "x double, y double, v long")
    for strategy in ("index", "nested", "hybrid"):
        out = {r.poly_id: (r.cnt, r.sum_v) for r in SpatialAggregation(df, X.SHAPES, F.col("v"), canvas_pixels=(40, 40)).run(strategy).collect()}
        assert out[7] == (0, 0) and out[0] == (2, 5)
    empty = df.limit(0)
    assert SpatialAggregation(empty, X.TOY).run().collect()[0].cnt == 0


def test_fractional_values(spark):
    rows = [(5.15, 5.15, 0.9), (5.15, 5.15, 1.8), (5.12, 5.12, 0.7), (5.0, 5.0, None), (5.0, 5.0, float("nan")), (5.0, 5.0, 2.5)]
    df = spark.createDataFrame(rows, "x double, y double, miles double")
    for strategy in ("index", "nested", "hybrid", "raster"):
        q = SpatialAggregation(df, X.TOY, F.col("miles"), canvas_pixels=(30, 30), scale=1)
        out = {r.poly_id: (r.cnt, float(r.sum_v), round(r.avg_v, 9)) for r in q.run(strategy).collect()}
        assert out == {0: (3, 3.4, 1.133333333), 1: (3, 2.5, 2.5)}, strategy
    with pytest.raises(ValueError):
        SpatialAggregation(df, X.TOY, F.col("miles")).run()


def test_empty_and_flat_polygons(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1)], "x double, y double, v long")
    flat = P.Polygons({0: [[(0.0, 1.0), (5.0, 1.0), (2.0, 1.0)]], 1: [[(3.0, 1.0)]]})
    for strategy in ("index", "nested", "hybrid"):
        assert SpatialAggregation(df, P.Polygons(), F.col("v"), canvas_pixels=(4, 4)).run(strategy).collect() == []
        assert sorted((r.poly_id, r.cnt) for r in SpatialAggregation(df, flat, F.col("v"), canvas_pixels=(4, 4)).run(strategy).collect()) == [(0, 0), (1, 0)]


def test_saved_index(spark, tmp_path):
    from polyagg.operators.index import grid_index

    points = X.points(spark, "/root/testdata/sf0.001", "lineitem")
    q = SpatialAggregation(points, X.STARS, F.col("v"))
    store.save_index(grid_index(X.STARS.edges(spark), q.index_grid()), f"file://{tmp_path}/index")
    again = SpatialAggregation(points, X.STARS, F.col("v"), index=store.load_index(spark, f"file://{tmp_path}/index"))
    assert sorted(map(tuple, again.run().collect())) == sorted(map(tuple, q.run().collect()))
