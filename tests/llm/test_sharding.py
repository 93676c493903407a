import hashlib
import zlib
from collections import Counter

from polyagg.llm.sharding import jump_shard, shard_documents
from pyspark.sql import functions as F


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_matches_brute_force(spark):
    rows = [(i * 7, "é" * (i % 5) if i % 3 else None, "x") for i in range(500)] + [(7, "é", "x"), (7, "é", "x"), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, slot string")
    out = shard_documents(df, 8).collect()
    assert len(out) == len(rows)
    for r in out:
        key = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:16], 16)
        assert (r.shard, r.grown_shard) == (jump(key, 8), jump(key, 9))
        assert r.grown_shard in (r.shard, 8)
        assert r.law == "key"
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    for s, n in Counter(r.shard for r in out).items():
        assert sorted(r.slot for r in out if r.shard == s) == list(range(n))


def test_many_shards_and_empty(spark):
    df = spark.range(300).select((F.col("id") * 12345).alias("hi"), (F.col("id") * 999).alias("lo"))
    for n in (1, 2, 63, 64, 65, 1000):
        for r in df.select("hi", "lo", jump_shard("hi", "lo", n).alias("s")).collect():
            assert r.s == jump(r.hi * 2**32 + r.lo, n)
    assert shard_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
