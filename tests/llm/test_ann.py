import numpy as np
import pytest
from polyagg.llm.ann import layout, search
from pyspark.sql import functions as F


def brute(ids, x, qids, k=5):
    x = np.asarray(x, np.float64)
    n = np.sqrt((x * x).sum(1))
    out = {}
    for q in qids:
        s = x @ x[ids.index(q)] / (n * n[ids.index(q)])
        out[q] = [(ids[i], s[i]) for i in sorted((i for i in range(len(ids)) if ids[i] != q), key=lambda i: (-round(s[i], 12), ids[i]))[:k]]
    return out


def compare(out, want):
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    hits = sum(len({i for i, _ in v} & {i for i, _ in want[q]}) for q, v in got.items())
    return got, hits / max(1, sum(map(len, want.values())))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    ids, x = [r.vec_id for r in rows], [r.embedding for r in rows]
    assert layout(len(rows), 20_000)[0] > 10  # as the query has it: parts are learned at this size too
    out = search(df, df.where("vec_id % 50 = 0")).collect()
    got, recall = compare(out, brute(ids, x, [i for i in ids if i % 50 == 0]))
    assert recall >= 0.9 and all(len(v) == 5 for v in got.values()), recall
    norm = {i: np.asarray(v, np.float64) / np.linalg.norm(np.asarray(v, np.float64)) for i, v in zip(ids, x, strict=True)}
    assert all(abs(norm[q] @ norm[i] - s) < 1e-12 for q, v in got.items() for i, s in v)


def test_odd_rows_and_copies(spark):
    rng = np.random.default_rng(1)
    good = [(int(i), [float(a) for a in rng.normal(size=8).astype(np.float32)], 0) for i in range(200)]
    good += [(i, good[3][1], 0) for i in range(300, 340)]
    bad = [(400, None, 0), (450, [0.0] * 8, 0), (500, [1.0, None] + [1.0] * 6, 0), (550, [float("nan")] + [1.0] * 7, 0), (600, [float("inf")] * 8, 0), (650, [1.0], 0), (None, [1.0] * 8, 0)]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>, score int")
    out = search(df, df.where("vec_id % 50 = 0"), block_rows=50, probes=99, parts=5).collect()
    want = brute([r[0] for r in good], [r[1] for r in good], [r[0] for r in good if r[0] % 50 == 0])
    got, recall = compare(out, want)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert got[300][0][0] == 3


def test_parts_grow_with_the_table():
    parts = [layout(n, 20_000) for n in (10, 500, 2_000, 25_000, 1_000_000, 10**10)]
    assert [p for p, _ in parts] == [2, 12, 23, 80, 500, 500] and all(40 * p <= n <= 20_000 for p, n in parts)


def test_small_tables(spark):
    schema = "vec_id long, embedding array<float>"
    none = spark.createDataFrame([], schema)
    assert search(none, none).collect() == []
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0])], schema)
    out = search(two, two.where("vec_id = 0")).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in out][:1] == [(0, 1, 1)] and abs(out[0].score - 2**-0.5) < 1e-12
    one = two.where(F.col("vec_id") == 0)
    assert search(one, one).collect() == []
