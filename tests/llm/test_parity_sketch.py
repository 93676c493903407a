import random
import re
import sys
from collections import Counter

import numpy as np
import pytest

sys.path.insert(0, __file__.rpartition("/")[0])
from brute import rows
from polyagg.llm import parity_sketch
from polyagg.llm.components import components
from polyagg.llm.common import Workspace
from polyagg.llm.parity_sketch import BITS, bit_sketches, shingle_sets, similar_components


def shingles(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else frozenset()


def brute(docs):
    """(doc_id, n_shingles, component_id) of each row, by all pairs of distinct sets."""
    sets = {}
    for d, t in docs:
        sets.setdefault(shingles(t), []).append(d)
    keys = [k for k in sets if k]
    root = list(range(len(keys)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(keys):
        for j in range(i):
            if 4 * min(len(a), len(keys[j])) >= 3 * max(len(a), len(keys[j])) and 100 * len(a & keys[j]) >= 75 * len(a | keys[j]):
                root[find(i)] = find(j)
    least = {}
    for i, k in enumerate(keys):
        least.setdefault(find(i), []).extend(d for d in sets[k] if d is not None)
    where = {k: min(least[find(i)], default=None) for i, k in enumerate(keys)}
    return Counter((d, len(shingles(t)), where[shingles(t)] if shingles(t) else d) for d, t in docs)


def family(rng, vocab, n, size, edits):
    base = [rng.choice(vocab) for _ in range(size)]
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(size)] = rng.choice(vocab)
        yield " ".join(own)


def test_against_brute_force(spark, seed=2):
    docs = rows(seed, 250)
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(500)]
    texts = [*family(rng, vocab, 60, 150, 8), *family(rng, vocab, 25, 600, 25), *family(rng, vocab, 25, 7, 1), *family(rng, vocab, 12, 30, 2)]
    texts += ["One two", "one TWO", "a b c d e", "a b c d e f", "a b c d e f g", "a b c d e f g h", "a b c d e f g h i"]
    docs += [(10_000 + i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, node string")
    out = similar_components(df).collect()
    want = brute(docs)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in out)
    assert got == want, ((got - want).most_common(5), (want - got).most_common(5))


def across_bands(seed):
    """Families of 8 to 12 sets just under and over a power of two: chains of shingles, some with a word or more added."""
    rng = random.Random(seed)
    docs = [(0, "a b c d e f g"), *((i, f"a b c d e f g x{i}") for i in range(1, 9))]
    for k in (2, 3, 4, 5, 6, 7):
        for members in range(8, 13):
            own = [f"k{k}m{members}n{i}" for i in range(2**k + 3)]
            more = max(1, 2**k // 5)
            for i in range(members):
                tail = [f"t{rng.randrange(10**9)}" for _ in range(more)]
                docs.append((len(docs), " ".join(own if not i else own + tail)))
    return docs


def test_families_across_bands(spark):
    docs = across_bands(3)
    out = similar_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = brute(docs)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in out)
    assert got == want, ((got - want).most_common(5), (want - got).most_common(5))


def wide_families(seed, families, sizes):
    """Near copies in one band, and one larger set in the next that is similar to all of them: chains of shingles, each copy
    with a word of its own at the end, the larger set with many more."""
    rng = random.Random(seed)
    docs = []
    for f in range(families):
        shared, members = rng.choice(sizes), rng.randint(8, 14)
        base = [f"f{f}n{i}" for i in range(shared + 4)]
        docs += [(len(docs) + i, " ".join([*base, f"f{f}own{i}"])) for i in range(members)]
        longest = shared * 4 // 3  # similarity 0.75 at least with a set of `shared` shingles, and a little less beyond
        docs.append((len(docs), " ".join([*base, *(f"f{f}more{i}" for i in range(rng.randint(0, longest - shared + 1)))])))
    return docs


@pytest.mark.parametrize("blocks", [96, None])
def test_no_link_is_lost_between_bands(spark, blocks):
    docs = []
    for more in (156, 148, 138, 133):  # 14 sets of 119 shingles and one larger set
        base = [f"m{more}n{i}" for i in range(118 + 4)]
        docs += [(len(docs) + i, " ".join([*base, f"m{more}own{i}"])) for i in range(14)]
        docs.append((len(docs), " ".join([*base, *(f"m{more}more{i}" for i in range(more - 118))])))
    docs += [(d + len(docs), t) for d, t in wide_families(11, 200 if blocks else 40, [6, 11, 13, 24, 28, 48, 60, 63, 100, 119, 125, 127, 200, 250])]
    out = similar_components(spark.createDataFrame(docs, "doc_id long, text string"), blocks=blocks).collect()
    want = brute(docs)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in out)
    assert got == want, ((got - want).most_common(5), (want - got).most_common(5))
    assert Counter((r.doc_id, r.n_links) for r in out) == degrees(docs)


def test_long_texts_are_hashed_in_parts(monkeypatch):
    from polyagg.llm import rolling

    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(99)}" + rng.choice(["", "\n", " \t"]) for _ in range(rng.choice([0, 3, 400]))).encode() for _ in range(40)] + [b"x" * 500, b" " * 300]
    whole = rolling.words(texts)
    for size in (1, 7, 100):
        monkeypatch.setattr(rolling, "PART", size)
        cut = rolling.words(texts)
        assert all((getattr(cut, c) == getattr(whole, c)).all() for c in ("hash", "text", "first"))


def degrees(docs, percent=75):
    """(doc_id, n_links) of each row, by all pairs of distinct sets."""
    keys = list({shingles(t) for _, t in docs} - {frozenset()})
    count = Counter()
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if 100 * len(a & b) >= percent * len(a | b):
                count[a] += 1
                count[b] += 1
    return Counter((d, count[shingles(t)]) for d, t in docs)


def test_links_are_counted(spark, monkeypatch):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(500)]
    texts = [*family(rng, vocab, 60, 150, 8), *family(rng, vocab, 40, 600, 25), *family(rng, vocab, 25, 7, 1), *family(rng, vocab, 12, 30, 2), *family(rng, vocab, 5, 40, 1), "", "a"]
    docs = [*enumerate(texts), (900, texts[0]), *((1000 + d, t) for d, t in across_bands(4)[:30])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = degrees(docs)
    for part in (512, 7):
        monkeypatch.setattr(parity_sketch, "PART_SETS", part)
        got = Counter((r.doc_id, r.n_links) for r in similar_components(df).collect())
        assert got == want, (part, (got - want).most_common(5), (want - got).most_common(5))


def test_empty(spark):
    assert similar_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    out = similar_components(spark.createDataFrame([(1, None), (2, ""), (2, " "), (None, "a")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in out) == [(0, 1, 0), (1, 0, 1), (2, 0, 2), (2, 0, 2)]


def test_sketch_is_a_lower_bound():
    rng = random.Random(5)
    for _ in range(200):
        a = [str(rng.randrange(60)) for _ in range(rng.randint(0, 90))]
        b = a[: rng.randint(0, 90)] + [str(rng.randrange(60)) for _ in range(rng.randint(0, 30))]
        texts = [" ".join(x).encode() for x in (a, b)]
        value, first = shingle_sets(texts)
        bits = bit_sketches(value, np.repeat([0, 1], np.diff(first)), 2)
        far = int(np.unpackbits(bits[0] ^ bits[1]).sum())
        assert bits.shape == (2, BITS // 8) and far <= len(shingles(texts[0].decode()) ^ shingles(texts[1].decode()))


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    space = Workspace(spark, "test")
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), space).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    joined = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {k: v for k, v in root.items() if k in joined}
    assert components(spark.createDataFrame([], "a long, b long"), space).collect() == []


def test_crowded_blocks_do_not_bring_a_node_along_with_each(spark, monkeypatch):
    """200 near copies and 60 texts that share most of their words without being similar."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join([*base, f"own{i}"])) for i in range(200)]
    docs += [(200 + i, " ".join([*base[:250], *(f"x{i}n{rng.randrange(10**9)}" for _ in range(150))])) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    came, map_in_arrow = [], type(df).mapInArrow

    def counted(self, *args, **more):
        if "main" in self.columns:
            came.append(self.count())
        return map_in_arrow(self, *args, **more)

    monkeypatch.setattr(type(df), "mapInArrow", counted)
    out = similar_components(df).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == brute(docs)
    assert came and max(came) <= 2 * len(docs), came


def test_texts_that_sketches_take_for_similar_are_not_listed_in_pairs(spark, monkeypatch):
    """150 texts that share 70 in 100 of their shingles and most of their blocks: sketches rule out none of their pairs, sets all."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(1400)]
    docs = [(i, " ".join([*base, *(f"x{i}n{rng.randrange(10**9)}" for _ in range(600))])) for i in range(150)]
    docs += [(150 + i, " ".join([*base, *(f"y{k}" for k in range(600)), f"own{i}"])) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    listed, map_in_arrow = [], type(df).mapInArrow

    def counted(self, *args, **more):
        if "set_a" in self.columns:
            listed.append(self.count())
        return map_in_arrow(self, *args, **more)

    monkeypatch.setattr(type(df), "mapInArrow", counted)
    out = similar_components(df).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == brute(docs)
    assert listed and sum(listed) <= 3 * len(docs), listed


@pytest.mark.parametrize("slice_,elements", [(16, 10**6), (10**6, 3000), (7, 900)])
def test_crowded_blocks_dealt_to_cells(spark, monkeypatch, slice_, elements):
    monkeypatch.setattr(parity_sketch, "SLICE", slice_)
    monkeypatch.setattr(parity_sketch, "SLICE_ELEMENTS", elements)
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(500)]
    texts = [*family(rng, vocab, 60, 150, 14), *family(rng, vocab, 40, 600, 40), *family(rng, vocab, 40, 12, 2), *(t for _, t in wide_families(5, 6, [13, 63, 119, 200]))]
    docs = list(enumerate(texts))
    out = similar_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == brute(docs)
    assert Counter((r.doc_id, r.n_links) for r in out) == degrees(docs)


def test_texts_that_share_too_few_blocks_are_not_compared(spark, monkeypatch):
    """Texts of 146 shingles that share 36 of them six by six, or 60 by the hundred: as all 96 blocks are compared, similar ones would agree in more."""
    rng = random.Random(13)
    own = lambda n: [f"x{rng.randrange(10**9)}" for _ in range(n)]
    texts = [" ".join([*(f"g{g}n{i}" for i in range(40)), *own(110)]) for g in range(40) for _ in range(6)]
    texts += [" ".join([*(f"w{i}" for i in range(64)), *own(86)]) for _ in range(100)]
    for g in range(5):
        base = own(150)
        texts += [" ".join([*base[: 150 - k], *own(k)]) for k in (0, 5, 12, 20)]
    docs = list(enumerate(texts))
    pairs, looks, map_in_arrow = [], [], type(spark.range(0)).mapInArrow

    def counted(self, *args, **more):
        if "bits_a" in self.columns:
            pairs.append(self.count())
        if "sigs" in self.columns and "root" in self.columns:
            looks.append(self.selectExpr("sum(size(sigs))").first()[0] or 0)
        return map_in_arrow(self, *args, **more)

    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", counted)
    out = similar_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == brute(docs)
    assert Counter((r.doc_id, r.n_links) for r in out) == degrees(docs)
    assert pairs and sum(pairs) <= 60 and sum(looks) <= 100, (pairs, looks)


def test_pairs_of_near_copies_with_the_same_edits_are_not_listed(spark, monkeypatch):
    """Copies of one text with up to eight words changed, of 60 words: any two share rare blocks with a chance, so pairs grow as their square."""
    rng = random.Random(7)
    docs = []
    for i in range(400):
        words = [f"b{k}" for k in range(150)]
        for _ in range(rng.randint(1, 8)):
            words[rng.randrange(150)] = f"e{rng.randrange(6)}"
        docs.append((i, " ".join(words)))
    pairs, map_in_arrow = [], type(spark.range(0)).mapInArrow

    def counted(self, *args, **more):
        if "bits_a" in self.columns:
            pairs.append(self.count())
        return map_in_arrow(self, *args, **more)

    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", counted)
    out = similar_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == brute(docs)
    assert Counter((r.doc_id, r.n_links) for r in out) == degrees(docs)
    assert pairs and sum(pairs) <= len(docs) // 2, pairs
