"""Approximate nearest neighbours by learned partitions of a neighbour graph."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyagg.llm.common import Workspace


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """The k most similar other rows of each row of unit vectors, by brute force in blocks."""
    out = np.empty((len(x), k), np.int32)
    for at in range(0, len(x), 512):
        sims = x[at : at + 512] @ x.T
        sims[np.arange(len(sims)), at + np.arange(len(sims))] = -2
        out[at : at + 512] = np.argpartition(-sims, k - 1, 1)[:, :k]
    return out


def seated(score: np.ndarray, room: int) -> np.ndarray:
    """A part for each row, the best that has room; rows that lose most by another go first."""
    order = np.argsort(-score, 1)
    two = np.take_along_axis(score, order[:, :2], 1)
    left, out = np.full(score.shape[1], room), np.empty(len(score), np.int64)
    for i in np.argsort(-(two[:, 0] - two[:, -1]), kind="stable").tolist():
        for p in order[i].tolist():
            if left[p]:
                left[p] -= 1
                out[i] = p
                break
    return out


def partition_graph(x: np.ndarray, near: np.ndarray, parts: int, rounds: int = 10, slack: float = 1.1, seed: int = 5) -> np.ndarray:
    """Balanced parts of the neighbour graph that cut few edges: from balanced clusters, label propagation under a limit of slack times the mean size."""
    rng, n = np.random.default_rng(seed), len(x)
    room = math.ceil(slack * n / parts)
    centre = x[rng.choice(n, parts, replace=False)]
    for _ in range(8):
        own = seated(x @ centre.T, room)
        centre = np.stack([x[own == p].mean(0) if (own == p).any() else x[rng.integers(n)] for p in range(parts)])
    rows = np.repeat(np.arange(n), near.shape[1])
    for _ in range(rounds):
        votes = np.zeros((n, parts), np.float32)
        np.add.at(votes, (rows, own[near.ravel()]), 1)  # those a node points to, and those that point to it
        np.add.at(votes, (near.ravel(), own[rows]), 1)
        votes[np.arange(n), own] += 0.5
        own = seated(votes, room)
    return own


class Router:
    """A network of one hidden layer from a unit vector to parts, trained on where a node and its neighbours are."""

    def __init__(self, dim: int, parts: int, hidden: int = 128, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.w = {"a": rng.normal(0, 1 / math.sqrt(dim), (dim, hidden)).astype(np.float32) * 2, "ab": np.zeros(hidden, np.float32), "b": rng.normal(0, 1 / math.sqrt(hidden), (hidden, parts)).astype(np.float32), "bb": np.zeros(parts, np.float32)}

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w["a"] + self.w["ab"], 0) @ self.w["b"] + self.w["bb"]

    def fit(self, x: np.ndarray, target: np.ndarray, epochs: int = 30, size: int = 128, rate: float = 0.003, seed: int = 5) -> Router:
        rng, w = np.random.default_rng(seed), self.w
        mean, square, t = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), size):
                pick = order[at : at + size]
                h = np.maximum(x[pick] @ w["a"] + w["ab"], 0)
                z = h @ w["b"] + w["bb"]
                p = np.exp(z - z.max(1, keepdims=True))
                slope = (p / p.sum(1, keepdims=True) - target[pick]) / len(pick)
                back = (slope @ w["b"].T) * (h > 0)
                t += 1
                for k, g in {"a": x[pick].T @ back, "ab": back.sum(0), "b": h.T @ slope, "bb": slope.sum(0)}.items():
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    square[k] = 0.999 * square[k] + 0.001 * g * g
                    w[k] -= rate * (1 - epoch / epochs) * (mean[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.999**t)) + 1e-8)
        return self

    def route(self, x: np.ndarray, many: int) -> np.ndarray:
        """The `many` most probable parts of each row, most probable first."""
        z = self.scores(x)
        top = np.argpartition(-z, many - 1, 1)[:, :many] if many < z.shape[1] else np.broadcast_to(np.arange(many), z.shape)
        return np.take_along_axis(top, np.argsort(-np.take_along_axis(z, top, 1), 1, kind="stable"), 1)


def learn(sample: np.ndarray, parts: int, near: int = 10, cover: float = 0.96) -> tuple[Router, int]:
    """Router and number of parts to search: the fewest that hold `cover` of the sample's neighbours, where the router puts them."""
    x = (sample / np.linalg.norm(sample, axis=1, keepdims=True)).astype(np.float32)
    near = min(near, len(x) - 1)
    if parts <= 1 or near < 1:
        return Router(x.shape[1], 1), 1
    graph = neighbours(x, near)
    own = partition_graph(x, graph, parts)
    target = np.zeros((len(x), parts), np.float32)
    np.add.at(target, (np.repeat(np.arange(len(x)), near), own[graph.ravel()]), 0.5 / near)
    target[np.arange(len(x)), own] += 0.5
    router = Router(x.shape[1], parts).fit(x, target)
    order = router.route(x, parts)
    place = np.argsort(order, 1)
    depth = place[np.repeat(np.arange(len(x)), near), order[:, 0][graph.ravel()]]
    return router, int(np.quantile(depth, cover, method="higher")) + 1


def matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of equal length without nulls, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def nearest(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple]:
    """(query, rank, id, cosine) of the k nearest, ties to the smaller id; a query's own id takes no part."""
    norm, qnorm = np.sqrt(np.einsum("ij,ij->i", x, x)), np.sqrt(np.einsum("ij,ij->i", q, q))
    for at in range(0, len(q), 256):
        sims = (q[at : at + 256] @ x.T) / (qnorm[at : at + 256, None] * norm)
        sims[query_ids[at : at + 256, None] == ids] = -np.inf
        for r, s in enumerate(sims):
            if len(s) > k:
                pick = np.flatnonzero(s >= np.partition(s, -k)[-k] - 1e-9)
            else:
                pick = np.arange(len(s))
            pick = pick[s[pick] > -np.inf]
            exact = np.einsum("ij,j->i", x[pick], q[at + r], optimize=False) / (norm[pick] * qnorm[at + r])
            for rank, j in enumerate(np.lexsort((ids[pick], -exact))[:k].tolist(), 1):
                yield query_ids[at + r], rank, ids[pick[j]], exact[j]


def layout(rows: int, sample_rows: int) -> tuple[int, int]:
    """Parts, and vectors to learn them from: half the root of the rows, and forty a part."""
    parts = min(max(2, math.ceil(math.sqrt(rows) / 2)), max(2, sample_rows // 40))
    return parts, min(sample_rows, max(4000, 40 * parts))


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, parts: int | None = None, sample_rows: int = 20_000, block_rows: int = 20_000, probes: int | None = None) -> DataFrame:
    """Each query's k nearest rows of vectors (vec_id, embedding) by cosine: query_id, rank, vec_id, score.

    A sample of the vectors with the smallest hash of their id, sample_rows at most, is made into a neighbour graph,
    parted evenly, and a router learns the parts, whose number grows with the root of the rows up to sample_rows / 40 (see layout();
    a sample of fewer than 40 different vectors is one part).  Every vector is indexed under its most probable part; a query is
    compared, exactly and in double precision, with all vectors of its `probes` most probable parts.  Probes are by
    default the fewest parts that hold 96 % of the sample's own neighbours; with as many as parts, the search is exact.

    Rows whose id is null, whose vector is null, zero, or holds null or non-finite components, or has another length than
    most take no part.  Ties go to the smaller id; an id that occurs more than once is never its own neighbour.  Of equal
    vectors the k + 1 smallest ids are kept, as no more can be among k; Spark does that before it shuffles them, so
    copies make no part large.  Parts are cut into blocks of block_rows vectors and queries, each pair of blocks a group
    of its own, so that no group grows with the input.  The driver sees the sample and one count for each part.
    """
    whole = "vec_id IS NOT NULL AND embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(embedding, x -> x <> 0)"
    vectors, queries = (df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(whole) for df in (vectors, queries))
    schema = "query_id long, rank int, vec_id long, score double"
    found = vectors.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not found:
        return vectors.sparkSession.createDataFrame([], schema)
    dim, rows = found[0]["dim"], found[0]["count"]
    vectors, queries = (df.where(F.size("embedding") == dim) for df in (vectors, queries))
    queries = queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    few = Window.partitionBy("embedding").orderBy("vec_id")
    vectors = vectors.withColumn("_nth", F.row_number().over(few)).where(f"_nth <= {k + 1}").drop("_nth")

    vectors = Workspace(vectors.sparkSession, "vectors").stage(vectors, "vectors", large=True)
    wanted, size = layout(rows, sample_rows)
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(size).select("embedding").collect()
    unique = np.unique(np.array([r.embedding for r in sample], np.float64), axis=0)
    router, many = learn(unique, min(parts or wanted, max(1, len(unique) // 20)))
    many = min(probes or many, len(router.w["bb"]))

    def routed(df: DataFrame, count: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = matrix(batch.column("embedding"))
                    to = router.route((x / np.abs(x).max(1, keepdims=True) / np.linalg.norm(x / np.abs(x).max(1, keepdims=True), axis=1, keepdims=True)).astype(np.float32), count)
                    again = pa.array(np.repeat(np.arange(len(x)), count))
                    yield pa.RecordBatch.from_arrays([pa.array(to.ravel().astype(np.int32)), *(batch.column(c).take(again) for c in ("vec_id", "embedding"))], names=["part", "vec_id", "embedding"])

        return df.mapInArrow(run, df.schema.__class__([*df.limit(0).select(F.lit(0).cast("int").alias("part")).schema, *df.schema]))

    placed, asked = routed(vectors, 1), routed(queries, many)
    blocks = {r.part: math.ceil(r["count"] / block_rows) for r in placed.groupBy("part").count().collect()}
    asks = {r.part: math.ceil(r["count"] / block_rows) for r in asked.groupBy("part").count().collect()}
    lists = lambda d: F.array(*(F.lit(d.get(p, 1)) for p in range(len(router.w["bb"]))))
    salted = lambda df, mine, other, a, b: df.withColumn(a, F.pmod(F.xxhash64("vec_id"), lists(mine)[F.col("part")]).cast("int")).withColumn(b, F.explode(F.sequence(F.lit(0), lists(other)[F.col("part")] - 1)))
    keys = ["part", "block", "ask"]
    placed, asked = salted(placed, blocks, asks, "block", "ask"), salted(asked, asks, blocks, "ask", "block")

    def compare(data: pa.Table, query: pa.Table) -> pa.Table:
        got = []
        if data.num_rows and query.num_rows:
            (ids, x), (qids, q) = ((t.column("vec_id").to_numpy(), matrix(t.column("embedding").combine_chunks())) for t in (data, query))
            got = list(nearest(ids, x, qids, q, k))
        a, b, c, d = zip(*got, strict=True) if got else ((),) * 4
        return pa.table({"query_id": pa.array(a, pa.int64()), "rank": pa.array(b, pa.int32()), "vec_id": pa.array(c, pa.int64()), "score": pa.array(d, pa.float64())})

    partial = placed.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(compare, schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(best)).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
