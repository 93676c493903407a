"""Joining texts by the Jaccard similarity of their word shingles, with parity sketches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyagg.llm.common import Workspace, sliced, texts_as_bytes
from polyagg.llm.components import components
from polyagg.llm.rolling import LOWER, Runs, mix, words

BATCH = 1_000_000
SHINGLE = 5
#: Blocks of a band that are compared, the most documents whose pairs in one block are listed, and bits of a sketch.
BLOCKS, LISTED, BITS = 96, 8, 1024
#: Sets, and elements of sets, that make a part of a component when its links are counted.
PART_SETS, PART_ELEMENTS = 2048, 1_000_000
#: Nodes, and elements of their sets, of a crowded block (or of several blocks) that a task compares with as many others there.
SLICE, SLICE_ELEMENTS = 4096, 2_000_000
#: How many comparisons of two sketches cost about as much as bringing one set to a task.
ROW_COST = 400
#: How many of a large set's 96 compared blocks of one band must be common for it to be compared by sketches: a link that no
#: listed block shows agrees in common blocks of its band alone, ten or more of them (see block_sketches); of fewer blocks, as large a share.
COMMON = 10


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text's runs of 5 lower-cased words (of fewer, of all of them), sorted by text, then hash:
    the hashes, and the first of each text."""
    w = words([t.translate(LOWER) for t in texts])
    runs = Runs(w.hash)
    count = np.diff(w.first)
    size = len(w.hash) - SHINGLE + 1
    at = np.flatnonzero(w.text[:size] == w.text[SHINGLE - 1 :]) if size > 0 else np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    own = np.concatenate([w.text[at], short])
    value = np.concatenate([runs.every(SHINGLE)[at] if size > 0 else np.zeros(0, np.uint64), runs.of(w.first[short], w.first[short + 1])])
    order = np.lexsort((value, own))
    own, value = own[order], value[order]
    fresh = np.concatenate([[True], (own[1:] != own[:-1]) | (value[1:] != value[:-1])]) if len(own) else np.zeros(0, bool)
    own, value = own[fresh], value[fresh]
    return value, np.searchsorted(own, np.arange(len(texts) + 1))


def bands(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band of each set size and whether the band below also takes it.  Band b holds sizes in [2^b, 2^(b + 1)); sizes up to
    4/3 of its lower end can be similar to a set of the band below."""
    band = np.maximum(np.frexp(np.maximum(size, 1))[1] - 1, 0)
    return band, (band > 0) & (3 * size <= 4 << band)


def blocks_of(band: np.ndarray) -> np.ndarray:
    """Blocks into which the hashes are cut: three for four elements of a band's smallest set; below 64, so many that each
    element has one of its own."""
    return np.where(band < 6, 65536, np.maximum(96, 3 << np.maximum(band - 2, 0)))


def block_sketches(value: np.ndarray, own: np.ndarray, size: np.ndarray, blocks: int | None = BLOCKS) -> tuple[np.ndarray, np.ndarray]:
    """(text, signature) of the non-empty blocks that are compared: the XOR of the hashes in the block, with band and block.
    The highest bit of a signature is the lowest of its band, by which the two bands of a text are told apart.

    Sets whose symmetric difference has d elements differ in d blocks at most.  Similarity of 0.75 or more allows
    d <= (|A| + |B|) / 7 <= |A| / 3, fewer than the non-empty blocks, so at least those less |A| / 3 agree.  Of sets of 64
    elements or more the first `blocks` blocks are compared, None: all.  Of 96, hashes deal elements to blocks at random, so a block agrees and is not empty with a chance of 0.36 or more, and
    all of 96 fail with one below 1e-18; fewer than ten agree with one of 2e-9, and none of an even signature with one of 5e-9.
    """
    out_text, out_sig = [], []
    band, lower = bands(size)
    for shift in (0, 1):
        pick = np.arange(len(own)) if not shift else np.flatnonzero(lower[own])
        b = band[own[pick]] - shift
        h = mix(value[pick] ^ np.uint64(0x2545F4914F6CDD1D))
        block = ((h >> np.uint64(32)) * blocks_of(b).astype(np.uint64)) >> np.uint64(32)
        taken = np.flatnonzero((block < (blocks or 1 << 32)) | (b < 6))
        pick, block, b, h = pick[taken], block[taken], b[taken], h[taken]
        order = np.lexsort((block, own[pick]))
        pick, block, b, h = pick[order], block[order], b[order], h[order]
        if len(pick):
            fresh = np.flatnonzero(np.concatenate([[True], (own[pick][1:] != own[pick][:-1]) | (block[1:] != block[:-1])]))
            parity = np.bitwise_xor.reduceat(h, fresh)
            out_text.append(own[pick[fresh]])
            sig = mix(parity + block[fresh] * np.uint64(0x9E3779B97F4A7C15) + b[fresh].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
            out_sig.append(sig >> np.uint64(1) | b[fresh].astype(np.uint64) << np.uint64(63))
    if not out_text:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    text = np.concatenate(out_text)
    order = np.argsort(text, kind="stable")
    return text[order], np.concatenate(out_sig)[order]


def _agreeing(n: Column, is_odd: Column, filled: Column, blocks: int | None) -> tuple[Column, Column, Column, Column]:
    """Of a set of n elements in its even or odd band, where it fills so many of the compared blocks: whether all of the band below 64
    or of blocks=None are compared; in how many blocks it agrees with any similar set, by proof, and but for the chances of
    block_sketches(); in how many listed blocks a pair must agree to be looked at.  A link that agrees in fewer listed ones, a
    number for the whole band, agrees in as many common ones as the third less this and one more.

    By proof that is the filled blocks less n / 3 where all are compared: in bands 6 and 7 there are 96."""
    own = F.length(F.bin(n)) - 1
    band = own - (own + is_odd.cast("int")) % 2
    whole = F.lit(True) if blocks is None else band < 6
    proven = F.when(whole if blocks is not None and blocks < 96 else whole | (band < 8), F.greatest(F.lit(1), filled - F.floor(n / 3))).otherwise(1).cast("int")
    agree = F.when(whole, proven).otherwise(F.greatest(proven, F.lit(int(COMMON * min(blocks or BLOCKS, BLOCKS) / BLOCKS))))
    listed = F.lit(1) if blocks is not None and blocks < 96 else F.when(band < 4, 1).when(band < 8, 5).otherwise(3)
    return whole, proven, agree, F.least(listed, agree)


def bit_sketches(value: np.ndarray, own: np.ndarray, texts: int) -> np.ndarray:
    """A row of BITS parities for each text: every element flips one bit, so the Hamming distance of two rows is at
    most the symmetric difference of their sets."""
    bit = (mix(value + np.uint64(0x632BE59BD9B4E019)) & np.uint64(BITS - 1)).astype(np.int64)
    out = np.empty((texts, BITS // 8), np.uint8)
    for at in range(0, texts, 512):
        a, b = np.searchsorted(own, [at, at + 512])
        n = min(512, texts - at)
        odd = (np.bincount((own[a:b] - at) * BITS + bit[a:b], minlength=n * BITS) & 1).astype(np.uint8)
        out[at : at + n] = np.packbits(odd.reshape(n, BITS), axis=1)
    return out


def _sketched(blocks: int | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text", BATCH):
        texts = texts_as_bytes(batch.column("text"))
        value, first = shingle_sets(texts)
        size = np.diff(first)
        own = np.repeat(np.arange(len(texts)), size)
        total, other = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
        full = np.flatnonzero(size)
        if len(full):
            total[full] = np.add.reduceat(mix(value), first[full])
            other[full] = np.bitwise_xor.reduceat(mix(value * np.uint64(0xD6E8FEB86659FD93)), first[full])
        text, sig = block_sketches(value, own, size, blocks)
        cuts = np.searchsorted(text, np.arange(len(texts) + 1)).tolist()
        odd = np.bincount(text[sig >> np.uint64(63) == 1], minlength=len(texts))
        bits = bit_sketches(value, own, len(texts))
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), batch.column("text_key"), pa.array(size.astype(np.int32)), pa.array(mix(total + size.astype(np.uint64)).view(np.int64)), pa.array(other.view(np.int64)),
            pa.array([sig[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()), pa.array(odd.astype(np.int32)), pa.array([b.tobytes() for b in bits], pa.binary()),
        ], names=["doc_id", "text_key", "n", "node", "key", "sigs", "odd", "bits"])


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "sigs", 1_000_000):
        raw = texts_as_bytes(batch.column("sigs"))
        own = pa.array(np.repeat(np.arange(len(raw)), [len(x) // 8 for x in raw]))
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(raw), np.int64)), batch.column("node").take(own), batch.column("n").take(own)], names=["sig", "node", "n"])


def _alike(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can be similar at all."""
    return 4 * np.minimum(n, m).astype(np.int64) >= 3 * np.maximum(n, m).astype(np.int64)


def _collisions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sig, node, n) sorted by sig: the pairs of each block that LISTED nodes or fewer share (sig null), with how many such
    blocks of the even and of the odd band, and the rows (sig, node, n) of the others.  Blocks are told apart by whole columns; no
    more than one batch and LISTED rows are held."""
    tail, tail_hot = None, False
    none = np.zeros(0, np.int64)

    def emit(sig, node, n, hot_first):
        """Of whole groups: hot_first says that rows of the first group have gone out before."""
        fresh = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        size = np.diff(np.concatenate([fresh, [len(sig)]]))
        hot = size > LISTED
        if hot_first:
            hot[0] = True
        rows = np.flatnonzero(np.repeat(hot, size))
        a, b, cold = [], [], fresh[~hot]
        room = size[~hot]
        for step in range(1, LISTED):
            for at in range(LISTED - step):
                ok = cold[room > at + step]
                a.append(ok + at)
                b.append(ok + at + step)
        a, b = (np.concatenate(x) if x else none for x in (a, b))
        good = np.flatnonzero(_alike(n[a], n[b]) & (node[a] != node[b]))
        a, b = a[good], b[good]
        pairs, which = np.unique(np.stack([np.minimum(node[a], node[b]), np.maximum(node[a], node[b])], 1), axis=0, return_inverse=True)
        times = [np.bincount(which.ravel()[(sig[a] < 0) == odd], minlength=len(pairs) + len(rows)).astype(np.int32) for odd in (False, True)]
        return pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([np.zeros(len(pairs), np.int64), sig[rows]]), mask=np.arange(len(pairs) + len(rows)) < len(pairs)),
            pa.array(np.concatenate([pairs[:, 0], node[rows]])), pa.array(np.concatenate([pairs[:, 1], node[rows]])), *map(pa.array, times),
        ], names=["sig", "a", "b", "even", "odd"])

    for batch in batches:
        if not batch.num_rows:
            continue
        sig, node, n = (batch.column(c).to_numpy() for c in ("sig", "node", "n"))
        if tail is not None:
            sig, node, n = (np.concatenate(x) for x in zip(tail, (sig, node, n), strict=True))
        last = int(np.searchsorted(sig, sig[-1]))  # the last group may go on
        if last:
            yield emit(sig[:last], node[:last], n[:last], tail_hot)
            tail_hot = False
        tail = sig[last:], node[last:], n[last:]
        if len(tail[0]) > 4 * LISTED:
            yield emit(*tail, True)
            tail, tail_hot = tuple(x[-1:] for x in tail), True  # one row stays, as the group's name; it may go out twice
    if tail is not None:
        yield emit(*tail, tail_hot)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text", BATCH):
        value, first = shingle_sets(texts_as_bytes(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([value[a:b].tobytes() for a, b in zip(first.tolist(), first[1:].tolist(), strict=False)], pa.binary())], names=["node", "set"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches do not rule them out."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, BITS // 64) for c in ("bits_a", "bits_b"))
        n, m = (batch.column(c).to_numpy().astype(np.int64) for c in ("n_a", "n_b"))
        far = np.bitwise_count(x ^ y).sum(1)
        keep = pa.array((7 * far.astype(np.int64) <= n + m) & _alike(n, m))
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])


def _similar(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = []
        for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True):
            a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            good.append(100 * both >= percent * (len(a) + len(b) - both))
        keep = pa.array(good, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])


def _joined(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sig, at, node, root, main, home, looks, set) sorted by the first two, block (or main component, for all of its blocks)
    and cell: links that join components.  Every node that looks is compared with the nodes at home in the cell, by sketch and
    then by the sets themselves, the nearest first; pairs that links found here have joined are left out.  So there are fewer links
    than nodes, and no other two that are similar stay apart.  One cell's sets and one batch are held."""

    def group(rows) -> tuple[np.ndarray, np.ndarray]:
        node, root, home, looks, raw = (np.concatenate(x) for x in zip(*rows, strict=True))
        sets = [np.frombuffer(x, np.uint64) for x in raw]
        n = np.array([len(x) for x in sets], np.int64)
        value, own = np.concatenate(sets), np.repeat(np.arange(len(n)), n)
        bits = bit_sketches(value, own, len(n)).view(np.uint64)
        _, column, seen = np.unique(value, return_inverse=True, return_counts=True)
        shared = np.flatnonzero(seen[column] > 1)  # others meet in no two sets
        column, first = column[shared], np.searchsorted(own[shared], np.arange(len(n) + 1))
        mark = np.zeros(len(seen), bool)
        _, label = np.unique(root, return_inverse=True)
        a, b = [], []
        at_home = np.flatnonzero(home)
        looking = np.flatnonzero(looks)
        for at in range(0, len(looking), 64):
            rows = looking[at : at + 64]
            far = np.empty((len(rows), len(at_home)), np.float32)
            for k in range(0, len(at_home), 4096):
                far[:, k : k + 4096] = np.bitwise_count(bits[rows, None] ^ bits[None, at_home[k : k + 4096]]).sum(2)
            both = n[rows, None] + n[None, at_home]
            # of two that look at each other here, the first does
            seen_before = looks[None, at_home] & home[rows, None] & (rows[:, None] > at_home[None])
            may = (7 * far <= both) & _alike(n[rows, None], n[None, at_home]) & ~seen_before
            far /= both
            for i, ok, distance in zip(rows.tolist(), may, far, strict=True):
                ok = np.flatnonzero(ok & (label[at_home] != label[i]))
                left = at_home[ok[np.argsort(distance[ok], kind="stable")]]
                mine, step = column[first[i] : first[i + 1]], 4
                mark[mine] = True
                while len(left):
                    some, left = left[:step], left[step:]
                    size = first[some + 1] - first[some]
                    ends = np.cumsum(size)
                    hits = np.concatenate([[0], np.cumsum(mark[np.concatenate([column[first[j] : first[j + 1]] for j in some])])])
                    common = hits[ends] - hits[ends - size]
                    for j in some[100 * common >= percent * (n[i] + n[some] - common)].tolist():
                        if label[j] != label[i]:
                            label[label == label[j]] = label[i]
                            a.append(node[i])
                            b.append(node[j])
                    left = left[label[left] != label[i]]
                    step = min(8 * step, 256)
                mark[mine] = False
        return np.minimum(a, b), np.maximum(a, b)

    def links(rows) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in group(rows)], names=["a", "b"])

    held, name = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        sig, at = (batch.column(c).to_numpy() for c in ("sig", "at"))
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "root", "home", "looks", "set")]
        first = np.flatnonzero(np.concatenate([[True], (sig[1:] != sig[:-1]) | (at[1:] != at[:-1])])).tolist()
        for i, j in zip(first, [*first[1:], len(sig)], strict=True):
            if held and name != (sig[i], at[i]):
                yield links(held)
                held = []
            name = sig[i], at[i]
            held.append([x[i:j] for x in columns])
    if held:
        yield links(held)


def _held(part: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (root, n, sigs), how many of a batch's nodes of each component are in each block, and the elements of their sets; of
    one in `part` blocks, a power of two."""
    for batch in batches:
        sigs = batch.column("sigs")
        times = pc.list_value_length(sigs).to_numpy()
        own, n = (np.repeat(batch.column(c).to_numpy(), times) for c in ("root", "n"))
        sig = pc.list_flatten(sigs).to_numpy()
        some = np.flatnonzero((sig >> 1 & (part - 1)) == 0)
        order = some[np.lexsort((own[some], sig[some]))]
        sig, own, n = sig[order], own[order], n[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (sig[1:] != sig[:-1]) | (own[1:] != own[:-1])])) if len(sig) else order
        elements = np.add.reduceat(n, first) if len(sig) else n
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (sig[first], own[first], np.diff(np.append(first, len(sig))), elements)], names=["sig", "root", "count", "elements"])


def _dealt(space: Workspace, labelled: DataFrame, part: int) -> DataFrame:
    """sig, at, node, root, main, home, looks: which nodes meet in which cell, and which of them look at those at home there, from rows
    (node, n, root, sigs) with the crowded blocks of each node, of which one in `part` is taken.

    In a block that holds several components, nodes outside the largest, its main one, are to be compared with all others.  Near
    copies share dozens of blocks, and each would bring a node along.  So all blocks of a main component are taken together (sig
    is that component then): its nodes and those of all components that it meets come once.  Where this costs more than block by
    block, as where components have few blocks in common, each block is taken by itself.  Either way every two nodes of a block meet.
    """
    counts = "sig long, root long, count long, elements long"
    held = labelled.select("root", "n", "sigs").mapInArrow(lambda x: _held(part, x), counts).groupBy("sig", "root").agg(*(F.sum(c).alias(c) for c in ("count", "elements")))
    held = space.stage(held, "held")
    most = F.max(F.struct("count", "root", "elements")).alias("most")
    most = held.groupBy("sig").agg(most, F.sum("count").alias("rows"), F.sum("elements").alias("elements"), F.count(F.lit(1)).alias("apart")).where("apart > 1")
    several = most.selectExpr("sig", "most.root AS main", "rows", "elements", "rows - most.count AS outside", "elements - most.elements AS beyond", "rows * (rows - most.count) AS tests")
    several = space.stage(several, "several")
    owned = labelled.select("node", "n", "root").distinct()
    sizes = owned.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("width"))
    meets = space.stage(held.join(several.select("sig", "main"), "sig").select("main", "root").distinct(), "meets")  # the main one too
    of_others = lambda c: F.sum(F.when(F.col("root") != F.col("main"), F.col(c)))
    costs = meets.join(sizes, "root").groupBy("main").agg(F.sum("size").alias("nodes"), F.sum("width").alias("elements"), of_others("size").alias("outside"), of_others("width").alias("beyond"))
    costs = costs.join(several.groupBy("main").agg(F.sum("rows").alias("rows"), F.sum("tests").alias("tests")), "main")
    slices = lambda size, width, name: F.expr(f"greatest(1, ceil({size} / {SLICE}), ceil({width} / {SLICE_ELEMENTS}))").alias(name)
    grid = lambda size: (slices(size, "elements", "slices"), slices("outside", "beyond", "sides"))
    together = costs.where(F.expr(f"nodes * (outside + {ROW_COST}) <= tests + {ROW_COST} * rows")).select("main", *grid("nodes"))
    together = space.stage(together, "together")
    rows = meets.join(together, "main").join(owned, "root").select(F.col("main").alias("sig"), "node", "root", "main", "slices", "sides")
    single = space.stage(several.join(together, "main", "left_anti").select("sig", "main", *grid("rows")), "single")
    inside = labelled.join(held.join(single, "sig").select("root").distinct(), "root").select("node", "root", F.explode(F.expr(f"filter(sigs, s -> pmod(shiftright(s, 1), {part}) = 0)")).alias("sig"))
    rows = rows.unionByName(inside.join(single, "sig").select("sig", "node", "root", "main", "slices", "sides"))
    # many nodes are dealt to a grid of cells: each is at home in those of a row, and one outside the main component looks in those of a column
    rows = rows.withColumns({"row": F.expr("pmod(xxhash64(node, 41), slices)"), "side": F.expr("pmod(xxhash64(node, 43), sides)")})
    at_home, looking = "transform(sequence(0L, sides - 1), i -> row * sides + i)", "transform(sequence(0L, slices - 1), i -> i * sides + side)"
    rows = rows.withColumn("at", F.explode(F.expr(f"IF(root = main, {at_home}, array_distinct(concat({at_home}, {looking})))")))
    return rows.select("sig", "at", "node", "root", "main", F.expr("at div sides = row").alias("home"), F.expr("root <> main AND pmod(at, sides) = side").alias("looks"))


def _degrees(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (root, low, high, part, node, set) sorted by the first three: how many links each node has with nodes of the
    group's other part, or inside its only one."""

    def counted(rows, low, high) -> pa.RecordBatch:
        rows.sort(key=lambda r: r[1] != low)
        node, a = np.array([r[0] for r in rows], np.int64), sum(r[1] == low for r in rows)
        sets = [np.frombuffer(r[2], np.uint64) for r in rows]
        n = np.array([len(x) for x in sets], np.int64)
        own = np.repeat(np.arange(len(sets)), n)
        _, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = np.flatnonzero(seen[column] > 1)  # others meet in no two sets
        own, column = own[shared], column[shared]
        order = np.argsort(column, kind="stable")
        own, column = own[order], column[order]
        column = np.cumsum(np.diff(column, prepend=column[:1]) != 0)
        others = slice(a, None) if low != high else slice(None)
        both = np.zeros((a, len(sets[others])), np.float32)
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
            i, j = np.searchsorted(column, [at, at + 2048])
            has = np.zeros((len(sets), min(2048, int(column[-1]) + 1 - at)), np.float32)
            has[own[i:j], column[i:j] - at] = 1
            both += has[:a] @ has[others].T
        count = np.zeros(len(sets), np.int64)
        for at in range(0, a, 256):
            some = both[at : at + 256].astype(np.int64)
            linked = 100 * some >= percent * (n[at : at + len(some), None] + n[others][None] - some)
            if low == high:
                linked[np.arange(len(some)), at + np.arange(len(some))] = False
            else:
                count[a:] += linked.sum(0)
            count[at : at + len(some)] += linked.sum(1)
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(count)], names=["node", "n_links"])

    held, name = [], None
    for batch in batches:
        for root, low, high, *row in zip(*(batch.column(c).to_pylist() for c in ("root", "low", "high", "node", "part", "set")), strict=True):
            if (root, low, high) != name:
                if held:
                    yield counted(held, *name[1:])
                held, name = [], (root, low, high)
            held.append(row)
    if held:
        yield counted(held, *name[1:])


def _link_counts(space: Workspace, percent: int, crowd: DataFrame, nodes: DataFrame, sets: DataFrame, roots: DataFrame, links: DataFrame) -> DataFrame:
    """node, n_links: links of nodes of the crowd among each other by comparing parts of components, all others as listed."""
    dense = space.stage(crowd.select("node").distinct().join(roots, "node").join(nodes.select("node", "n"), "node"), "dense")
    many = dense.groupBy("root").agg(F.greatest(F.ceil(F.count("n") / PART_SETS), F.ceil(F.sum(F.col("n").cast("long")) / PART_ELEMENTS)).cast("int").alias("parts"))
    dealt = dense.join(many, "root").withColumn("part", F.pmod(F.xxhash64("node", F.lit(37)), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")})
    dealt = dealt.select("root", "low", "high", "part", "node").join(sets, "node")
    dealt = dealt.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high")
    inner = dealt.mapInArrow(lambda x: _degrees(percent, x), "node long, n_links long")
    # of the listed links, those of two such nodes are among the counted
    in_crowd = dense.select(F.col("node").alias("b")).withColumn("both", F.lit(1))
    listed = links.join(dense.select(F.col("node").alias("a")).withColumn("one", F.lit(1)), "a", "left").join(in_crowd, "b", "left").where("one IS NULL OR both IS NULL")
    ends = listed.select(F.explode(F.array("a", "b")).alias("node")).withColumn("n_links", F.lit(1).cast("long"))
    return ends.unionByName(inner).groupBy("node").agg(F.sum("n_links").alias("n_links"))


def similar_components(docs: DataFrame, percent: int = 75, blocks: int | None = BLOCKS, count_links: bool = True) -> DataFrame:
    """doc_id, text_key (the text's checksum), n_shingles, node, class_id, root, component_id, n_links for each row of docs.

    A text's set is its distinct shingles of 5 words (runs of bytes other than ASCII white space, A-Z lower-cased), of
    fewer words all of them as one; rows of equal sets are one node, the class.  Nodes are linked when 100 * intersection
    >= percent * union, percent 75 or more.  class_id is the smallest doc_id of the class, root the component's smallest node and
    component_id the smallest doc_id reached by links; texts without words (null, empty) have no set, no class, and are linked with
    nothing.  n_links is how many other classes the class is linked with; count_links=False leaves it and step (4) out.

    (1) Sets become block sketches and a bit sketch.  (2) Nodes that share a block of LISTED nodes or fewer are paired; bit
    sketches and then the sets themselves decide.  (3) A node could agree with another in blocks alone that more nodes share, if
    it has as many of those as block_sketches() says.  Every such node is compared with the smallest of most of its blocks; then, in blocks
    that still hold several components, with the nodes of other components, by sketch and by the sets themselves in one task, which
    lists only links that join components; first in some blocks, then in all.  So a group of any number of near copies is joined by a
    few links for each member, pairs that a sketch allows are never rows, and no link between components is lost: with blocks=None by
    proof, else but for the chances that block_sketches() names.
    (4) The links of such nodes among each other are counted, not listed: each component's are dealt to parts of bounded size,
    and every two parts are compared by the sets themselves.  All other links were listed in (2).

    Texts are whole; a long one is hashed part by part, so what a task holds beside it is about four times its size.  Rows of
    equal ids are rows of their own; a null id counts as larger than any other; an empty table gives no rows; other columns are
    left out.
    """
    if percent < 75:
        raise ValueError("blocks and sketches are laid out for a similarity of 0.75 or more")
    space = Workspace(docs.sparkSession, "parity")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    schema = "doc_id long, text_key long, n int, node long, key long, sigs binary, odd int, bits binary"
    made = space.stage(rows.mapInArrow(lambda b: _sketched(blocks, b), schema), "sketched", large=True)
    sketch = ("sigs", "odd", "bits")
    first = F.min(F.struct("doc_id", *sketch)).alias("one")
    nodes = space.stage(made.where("n > 0").groupBy("node", "key", "n").agg(first, F.min("doc_id").alias("least")).select("node", "n", "least", *(f"one.{c}" for c in sketch)), "nodes", large=True)

    shown = nodes.select("node", "n", "sigs").mapInArrow(_exploded, "sig long, node long, n int")
    met = shown.repartition("sig").sortWithinPartitions("sig").mapInArrow(_collisions, "sig long, a long, b long, even int, odd int")
    met = space.stage(met, "met", large=True)
    sketches = nodes.select("node", "n", "bits")
    of = lambda side: sketches.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}"))
    pairs = met.where("sig IS NULL").groupBy("a", "b").agg(F.sum("even").alias("even"), F.sum("odd").alias("odd"))
    # similar sets agree in as many blocks as is proven; those that are not among the listed are among either's crowded ones
    crowded = met.where("sig IS NOT NULL").groupBy(F.col("a").alias("node")).agg(*(F.sum(F.when((F.col("sig") < 0) == odd, 1).otherwise(0)).alias(c) for c, odd in (("even", False), ("odd", True))))
    filled = {"even": F.octet_length("sigs") / 8 - nodes["odd"], "odd": nodes["odd"]}
    least = []
    for c in filled:
        _, proven, _, listed = _agreeing(F.col("n"), F.lit(c == "odd"), filled[c], blocks)
        least.append(F.greatest(listed, proven - F.coalesce(crowded[c], F.lit(0))).alias(f"{c}_least"))
    least = space.stage(nodes.join(crowded, "node", "left").select("node", *least), "least")
    for side in ("a", "b"):
        pairs = pairs.join(least, (F.col(side) == least["node"]) & F.expr("even >= even_least OR odd >= odd_least"), "left_semi")
    near = pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b")
    near = space.stage(near.mapInArrow(_near, "a long, b long"), "near")

    # by band: sets near a power of two have blocks of two, and a link may agree in those of one alone
    common = met.where("sig IS NOT NULL").groupBy(F.col("a").alias("node"), (F.col("sig") < 0).alias("is_odd")).agg(F.collect_set("sig").alias("shared"))
    filled = F.when(F.col("is_odd"), F.col("odd")).otherwise(F.octet_length("sigs") / 8 - F.col("odd"))
    whole, _, agree, listed = _agreeing(F.col("n"), F.col("is_odd"), filled, blocks)
    heavy = common.join(nodes, "node").withColumns({"whole": whole, "agree": (agree - listed + 1).cast("int")}).where(F.size("shared") >= F.col("agree"))
    # of 96 blocks, the half with even signatures fails to show a pair with a chance of 5e-9 (8e-8 if four listed ones are left out).  As
    # `agree` of the shared signatures or more agree, the smallest that does is not among the last agree - 1
    chosen = F.expr("slice(array_sort(filter(shared, s -> whole OR s & 1 = 0)), 1, size(shared) - agree + 1)")
    crowd = heavy.select("node", "n", chosen.alias("sigs")).where(F.size("sigs") > 0)
    crowd = space.stage(crowd, "crowd")
    space.drop(met)

    wanted = near.select(F.explode(F.array("a", "b")).alias("node")).unionByName(crowd.select("node")).distinct()
    # one text of each class: that of its smallest doc_id
    named = F.min(F.struct("doc_id", "text_key")).alias("one")
    texts = made.where("n > 0").select("doc_id", "text_key", "node").join(wanted, "node").groupBy("node").agg(named).select("node", "one.*")
    found = rows.join(texts, rows["doc_id"].eqNullSafe(texts["doc_id"]) & (rows["text_key"] == texts["text_key"])).select("node", "text")
    sets = space.stage(found.mapInArrow(_sets, "node long, set binary").groupBy("node").agg(F.first("set").alias("set")), "sets", large=True)

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
        pairs = pairs.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
        return space.stage(pairs.select("a", "b", "set_a", "set_b").mapInArrow(lambda x: _similar(percent, x), "a long, b long"), "links")

    links = verified(near)
    groups = not crowd.isEmpty()
    if groups:
        # each node with the smallest of most of its first blocks: most of a family may be one component after that
        few = crowd.select(F.explode(F.slice(F.array_sort("sigs"), 1, 8)).alias("sig"), "node", "n")
        leader = few.groupBy("sig").agg(F.min(F.struct("node", "n")).alias("first"))
        led = few.join(leader, "sig").where("node <> first.node AND 4 * least(n, first.n) >= 3 * greatest(n, first.n)")
        led = led.groupBy("node", F.col("first.node").alias("to")).count().groupBy("node").agg(F.max(F.struct("count", "to")).alias("one"))
        led = led.select(F.least("node", "one.to").alias("a"), F.greatest("node", "one.to").alias("b")).distinct().join(near, ["a", "b"], "left_anti")
        links = links.unionByName(verified(space.stage(led, "led")))
    # a sixteenth of the blocks joins most of a group; whatever that leaves apart is compared in all
    for part in (16, 1) if groups else ():
        # before that two rounds of contraction do: labels that differ within a component only cost tests
        roots = space.stage(components(links, space, 2), "roots")
        labelled = crowd.select("node", "n", "sigs").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        some = _dealt(space, labelled, part).join(sets, "node").repartition("sig", "at").sortWithinPartitions("sig", "at")
        links = links.unionByName(space.stage(some.mapInArrow(lambda x: _joined(percent, x), "a long, b long").distinct(), "links"))
    roots = components(links, space)
    roots = space.stage(roots, "roots")
    counted = ["n_links"] if count_links else []
    degree = _link_counts(space, percent, crowd, nodes, sets, roots, links) if count_links else None
    labelled = nodes.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    labelled = labelled.join(smallest, "root").select("node", F.col("least").alias("class_id"), "root", "component_id")
    if count_links:
        labelled = labelled.join(degree, "node", "left")
    out = made.select("doc_id", "text_key", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("node")).alias("node"))
    out = out.join(labelled, "node", "left").select("doc_id", "text_key", "n_shingles", "node", "class_id", "root", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counted))
    out = Workspace(docs.sparkSession, "classes").stage(out, "classes", large=True)
    space.close()
    return out


def one_of_each(docs: DataFrame, percent: int = 75) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id (null counts as largest), of equal ids that of the
    smallest checksum.  Rows without words are linked with nothing and stay."""
    known = lambda df: df.withColumns({"_none": F.col("doc_id").isNull(), "_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0))})
    found = known(similar_components(docs, percent, count_links=False).where("n_shingles > 0"))
    first = found.groupBy("root").agg(F.min(F.struct("_none", "_id", "text_key")).alias("one")).select("one.*")
    keys = ["_none", "_id", "text_key"]
    rows = known(docs.withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit("")))))
    kept = rows.join(first, keys).dropDuplicates(keys)
    blank = rows.where(~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return kept.select(*docs.columns).unionByName(blank.select(*docs.columns))
