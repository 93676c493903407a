import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings, strategies as st
from polyagg.llm import bpe
from polyagg.llm.bpe import ByteBPE, RankQueue, decode, encode

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
OURS = ByteBPE(PATH, public_tokenizers.PATTERN, keep=50)
with open(PATH, "rb") as lines:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
THEIRS = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(text):
    return np.frombuffer(OURS.encode([text])[0], "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(), st.text("ab é'sthe\n 1\t"), st.text("aA")))
def test_like_tiktoken(text):
    assert ids(text) == THEIRS.encode_ordinary(text)
    assert OURS.decode(OURS.encode([text])[0]) == text.encode()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abé'sthe\n 1\t")))
def test_many_at_once(texts):
    fresh = ByteBPE.__new__(ByteBPE)
    fresh.__dict__.update(OURS.__dict__, known={}, together=20)
    assert [np.frombuffer(x, "<u4").tolist() for x in fresh.encode(texts)] == [THEIRS.encode_ordinary(t) for t in texts]


def test_one_rank_by_columns(monkeypatch):
    """Matches merged by whole columns, however few, get the ids of matches merged one by one."""
    monkeypatch.setattr(bpe, "WIDE", 1)
    rng = random.Random(4)
    for letters in ("ab", "aeéhnst", "thequickbrownfx", "a1 ."):
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 30))) for _ in range(400)]
        assert [np.frombuffer(x, "<u4").tolist() for x in OURS.merge([w.encode() for w in words])] == [THEIRS._encode_single_piece(w) for w in words]


def test_long_pieces():
    rng = random.Random(1)
    for text in ("a" * 20_000, " " * 5000 + "x", "".join(rng.choice("abcdeé") for _ in range(20_000)), "ab" * 9999):
        assert ids(text) == THEIRS.encode_ordinary(text)


def test_frequent_matches_are_merged_once(monkeypatch):
    """Words that every text holds stay known while rare ones come and go."""
    rng, word = random.Random(3), lambda: "".join(rng.choice("bcdfgéklmnprstvz") for _ in range(9))
    often = {" " + word() for _ in range(300)}
    fresh = ByteBPE.__new__(ByteBPE)
    fresh.__dict__.update(OURS.__dict__, known={}, held=0, keep=200_000, together=500)
    merged = []
    monkeypatch.setattr(fresh, "merge", lambda pieces: merged.extend(pieces) or OURS.merge(pieces))
    for _ in range(20):
        text = "".join([*often, *(" " + word() for _ in range(300))])
        assert np.frombuffer(fresh.encode([text])[0], "<u4").tolist() == THEIRS.encode_ordinary(text)
    assert sum(p.decode() in often for p in merged) <= 2 * len(often)
    assert len(fresh.known) < 1500


def test_queue_against_sorting():
    rng, q, held = random.Random(2), RankQueue(300_000), {}
    for _ in range(5000):
        if rng.random() < 0.6 or not held:
            r, i = rng.randrange(300_000) if rng.random() < 0.5 else rng.randrange(9), rng.randrange(1 << 40)
            held.setdefault(r, []).append(i)
            if r in q.buckets:
                q.buckets[r].append(i)
            else:
                q.fill(r, [i])
        else:
            r = min(held)
            assert (q.lowest(), q.drain(r)) == (r, sorted(held.pop(r)))
    assert (q.lowest() == -1) == (not held)


def test_table(spark):
    texts = [None, "", "Hallo  Welt!\n\n", "é" * 300, "Hallo  Welt!\n\n", "x" * 100_000]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)] + [(None, "a", None)], "doc_id long, text string, ids string")
    enc = encode(df, PATH, public_tokenizers.PATTERN)
    out = {r.doc_id: r for r in enc.join(decode(enc, PATH, public_tokenizers.PATTERN), "doc_id").collect()}
    for i, t in enumerate(texts):
        assert bytes(out[i].decoded) == (t or "").encode()
        assert np.frombuffer(bytes(out[i].ids), "<u4").tolist() == THEIRS.encode_ordinary(t or "")
    assert enc.count() == 7
    assert encode(df.limit(0), PATH, public_tokenizers.PATTERN).collect() == []
