import hashlib
import random
import re
import struct

import xxhash
from polyagg.llm.syncmers import K, anchors, fingerprint_pairs
from pyspark.sql import functions as F


def edits(rows):
    """(doc_id, text) in order, with each one's edited text."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for k, (i, t) in enumerate(rows):
        m = len(t) // 2
        yield i, t, t[: len(t) - m] + rows[(k + 1) % len(rows)][1][:m], rows[(k + 1) % len(rows)][1]


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 8))) for _ in range(n))


def chained(values, kind):
    """Spark's xxhash64 of several numbers: each one's hash is the next one's seed."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(struct.pack(kind, v), h)
    return h - (1 << 64) if h >> 63 else h


def chain(text):
    """A text's links, in plain Python."""
    h = [x - (1 << 64) if (x := xxhash.xxh64_intdigest(t.encode(), 42)) >> 63 else x for t in re.findall(r"[^ \t\n\x0b\f\r]{1,8}", text)]
    mers = [(i, chained(h[i : i + K], "<q") >> 32) for i in range(len(h) - K + 1) if min(h[i], h[i + K - 1]) <= min(h[i + 1 : i + K - 1])]
    if not mers:
        return [chained(h, "<q") >> 32] if h else []
    if len(mers) == 1:
        return [mers[0][1]]
    return list(dict.fromkeys(chained((a[1], b[1], b[0] - a[0]), "<i") >> 32 for a, b in zip(mers, mers[1:])))


def alike(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_against_plain_python(spark):
    rng = random.Random(6)
    rows = [(i, words(rng, rng.choice([0, 1, 5, 6, 7, 8, 30, 200])) + rng.choice(["", "\n\t ", " 漢字かな交じりの長い文章です"])) for i in range(120)]
    out = {r.doc_id: r for r in fingerprint_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = lambda links: "".join(f"{x & 0xFFFFFFFF:08X}" for x in links)
    for i, t, e, nxt in edits(rows):
        r = out[i]
        assert (r.fingerprint, r.edited_fingerprint) == (text(chain(t)), text(chain(e)))
        assert abs(r.near_edited - alike(chain(t), chain(e))) < 1e-12 and abs(r.near_next - alike(chain(t), chain(nxt))) < 1e-12


def test_edits_and_likeness(spark):
    rng = random.Random(3)
    rows = [(i * i - 50, words(rng, rng.choice([0, 1, 4, 5, 6, 7, 30, 300, 3000]))) for i in range(300)]
    rows += [(None, "null id"), (None, None), (7777777, None), (7777778, "x" * 50_000), (7777778, "x" * 50_000), (7777778, "a b")]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, next_text string")
    out = fingerprint_pairs(df).collect()
    want = [*edits(rows)]
    assert sorted((r.doc_id or 0, r.n_chars, r.edited_sha256) for r in out) == sorted((i or 0, len(t), hashlib.sha256(e.encode()).hexdigest()) for i, t, e, _ in want)
    by = {(r.doc_id, r.n_chars): r for r in out}
    for i, t, e, nxt in want:
        r = by[i, len(t)]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if t == nxt and i != 7777778:  # that id has rows of equal length
            assert r.near_next == 1
        if len(t.split()) >= 300 and e != t:
            assert 0.2 < r.near_edited < 0.75 and r.near_next < 0.1, (r.near_edited, r.near_next)


def test_equal_texts_and_small_tables(spark):
    schema = "doc_id long, text string"
    assert fingerprint_pairs(spark.createDataFrame([], schema)).collect() == []
    (one,) = fingerprint_pairs(spark.createDataFrame([(5, "abc def")], schema)).collect()
    assert (one.near_next, one.n_chars, one.edited_sha256) == (1.0, 7, hashlib.sha256(b"abc abc").hexdigest())
    out = fingerprint_pairs(spark.createDataFrame([(i, "ab cd " * 9) for i in range(5)] + [(9, "")], schema)).collect()
    assert len({r.fingerprint for r in out if r.doc_id < 9}) == 1
    assert [r.fingerprint for r in out if r.doc_id == 9] == [""]


def test_anchors_are_context_free(spark):
    rng = random.Random(4)
    a, b, c = (words(rng, 200) for _ in range(3))
    df = spark.createDataFrame([(a, f"{b} {a} {c}")], "a string, b string")
    r = df.select(anchors("a").alias("a"), anchors("b").alias("b")).first()
    inside = {(x.at + 200, x.hash) for x in r.a}
    assert inside == {(x.at, x.hash) for x in r.b if 200 <= x.at <= 400 - K}
    assert 0.2 < len(r.a) / 200 < 0.5
    assert spark.sql("SELECT 1").select(F.size(anchors("''")).alias("n")).first().n == 0
