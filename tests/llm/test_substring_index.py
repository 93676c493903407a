import sys
from collections import Counter

import pytest

sys.path.insert(0, __file__.rpartition("/")[0])
from brute import repeats, rows, sha, split
from polyagg.llm.substring_index import FingerprintIndex, dedup_substrings, keyed


@pytest.mark.parametrize("seed,batches", [(1, 1), (3, 4)])
def test_against_brute_force(spark, seed, batches):
    docs = rows(seed, 250)
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, spans string")
    out = dedup_substrings(df, batches).collect()
    want = []
    for d, ws, gone in repeats(docs, split, 50):
        kept = b" ".join(w for w, g in zip(ws, gone, strict=True) if not g)
        want.append((d, len(ws), sum(gone), sha(kept)))
    assert sum(w[2] for w in want) > 1000
    assert Counter((r.doc_id, r.n_words, r.n_removed, sha(bytes(r.kept))) for r in out) == Counter(want)


def test_old_documents_may_be_gone(spark, tmp_path):
    """Three batches, each from files that are deleted before the next; an old run is read without a shuffle."""
    docs = sorted((r for r in rows(4, 200) if r[0] is not None), key=lambda r: r[0])
    index, gone = FingerprintIndex(spark, fanout=9, buckets=3), Counter()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    cuts = [docs[70][0], docs[140][0]]
    for k, own in enumerate(([r for r in docs if r[0] < cuts[0]], [r for r in docs if cuts[0] <= r[0] < cuts[1]], [r for r in docs if r[0] >= cuts[1]])):
        spark.createDataFrame(own, "doc_id long, text string").write.parquet(f"{tmp_path}/{k}")
        batch = keyed(spark.read.parquet(f"{tmp_path}/{k}"))
        covered = {}
        for r in index.add(batch).collect():
            assert r.doc_id >= own[0][0]
            covered.setdefault((r.doc_id, r.text_key), set()).update(range(r.first, r.end))
        for r in batch.select("doc_id", "text_key").collect():
            gone[r.doc_id, len(covered.get((r.doc_id, r.text_key), ()))] += 1
        for f in (tmp_path / str(k)).iterdir():
            f.unlink()
    want = Counter((d, sum(flags)) for d, _, flags in repeats(docs, split, 50))
    assert gone == want
    plan = index.matches(index.runs[0][0], index.run(index.runs[0][2]))._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    index.close()


def test_empty(spark):
    assert dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    out = dedup_substrings(spark.createDataFrame([(None, None), (1, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in out) == [(0, 0, 0), (1, 0, 0)]
