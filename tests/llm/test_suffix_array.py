import random
import sys
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

sys.path.insert(0, __file__.rpartition("/")[0])
from brute import repeats, rows, sha
from polyagg.llm import suffix_array
from polyagg.llm.suffix_array import SuffixArray, dedup_suffixes, find_repeats, remove_bytes
from polyagg.llm.substring_index import keyed


def brute_repeats(strings, least):
    """(string, occurrences) of all maximal repeats: no character follows, and none comes before, all occurrences."""
    where = {}
    for s, x in enumerate(strings):
        for i in range(len(x)):
            for j in range(i + least, len(x) + 1):
                where.setdefault(x[i:j], []).append((s, i))
    for w, at in where.items():
        if len(at) < 2:
            continue
        after = {strings[s][i + len(w) : i + len(w) + 1] or (s,) for s, i in at}
        before = {strings[s][i - 1 : i] if i else (s,) for s, i in at}
        first = any(i == 0 for _, i in at)
        if len(after) > 1 and (len(before) > 1 or first):
            yield w, sorted(at)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=40).map(lambda b: bytes(x % 3 for x in b)), max_size=6), st.integers(1, 6))
def test_interval_tree(strings, least):
    sa = SuffixArray(strings, least)
    got = []
    for n, i, j in sa.maximal_repeats(least):
        at = sorted(zip(sa.owner[i:j].tolist(), sa.at[i:j].tolist()))
        got.append((strings[at[0][0]][at[0][1] : at[0][1] + n], at))
    want = [*brute_repeats(strings, least)]
    assert sorted(got) == sorted(want)
    order = [strings[o][a:] for o, a in zip(sa.owner, sa.at)]
    assert order == sorted(order)


def expected(docs):
    for d, xs, gone in repeats(docs, lambda t: (t or "").encode(), 50):
        spans = sum(g and not p for g, p in zip(gone, [False, *gone]))
        yield d, len(xs), sum(gone), spans, sha(bytes(x for x, g in zip(xs, gone) if not g))


@pytest.mark.parametrize("seed,hot,common", [(1, 2000, 64), (2, 2, 64), (3, 2000, 2)])
def test_against_brute_force(spark, monkeypatch, seed, hot, common):
    monkeypatch.setattr(suffix_array, "common_anchors", lambda rows, least, f=suffix_array.common_anchors: f(rows, least, 1, common))
    docs = rows(seed, 120, size=60, vocabulary=300)
    docs += [(5000 + i, "ab" * (40 + i)) for i in range(5)] + [(6000, "x" * 500), (6001, "y" + "x" * 70), (6002, "é" * 30)]
    df = keyed(spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, spans string"))
    out = remove_bytes(df, find_repeats(df, hot_group=hot, bucket_bytes=5000, chunk=3000)).collect()
    want = Counter(expected(docs))
    assert sum(w[2] for w in want) > 3000
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, sha(bytes(r.kept))) for r in out) == want


def test_empty_and_long(spark):
    assert dedup_suffixes(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rng = random.Random(9)
    long = "".join(rng.choice("abcdef ") for _ in range(2_300_000))
    out = {r.doc_id: r for r in dedup_suffixes(spark.createDataFrame([(1, long), (2, long[1000:2_200_000]), (3, None)], "doc_id long, text string")).collect()}
    assert [(out[i].n_removed, out[i].n_spans) for i in (1, 2, 3)] == [(0, 0), (2_199_000, 1), (0, 0)]
    assert np.isclose(out[1].n_bytes, 2_300_000)
