"""Removal of repeated byte strings: anchored candidates, an enhanced suffix array, and a scan of its interval tree."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyagg.llm.common import Workspace, sliced, texts_as_bytes
from polyagg.llm.rolling import Runs, merged, minimizer_groups, mix
from polyagg.llm.substring_index import keyed, span_arrays, with_spans

BATCH = 1_000_000
K = 16


class SuffixArray:
    """Enhanced suffix array of several short byte strings: the sorted suffixes whose first `least` bytes occur more than
    once, and the LCPs of neighbours.  A string's end sorts before any byte, and no match runs past it.

    Suffixes are compared by columns of 8 bytes, so strings should not be much longer than `least`.
    """

    def __init__(self, strings: list[bytes], least: int):
        sizes = np.array([len(s) for s in strings], np.int64)
        first = np.cumsum(sizes) - sizes
        width = -(-int(sizes.max(initial=1)) // 8) * 8
        flat = np.frombuffer(b"".join(strings) + bytes(width), np.uint8)
        owner = np.repeat(np.arange(len(strings)), sizes)
        rest = (first + sizes)[owner] - np.arange(len(owner))
        start = np.flatnonzero(rest >= least)
        head = Runs(flat.astype(np.uint64) + np.uint64(1)).of(start, start + least)
        by_head = np.argsort(head, kind="stable")
        same = head[by_head[1:]] == head[by_head[:-1]]
        again = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(start) else np.zeros(0, bool)
        start = start[by_head[again]]
        rest = rest[start]
        text = flat[start[:, None] + np.arange(width)]
        text[np.arange(width) >= rest[:, None]] = 0
        keys = text.view(">u8").astype(np.uint64)
        order = np.lexsort((rest, *keys.T[::-1]))
        text, start, rest = text[order], start[order], rest[order]
        self.owner, self.at = owner[start], start - first[owner[start]]
        self.before = np.where(self.at > 0, flat[start - 1].astype(np.int64) + 1, 0)  # what is on the left, 0 at a string's start
        differ = text[1:] != text[:-1]
        common = np.where(differ.any(1), differ.argmax(1), width) if len(start) > 1 else np.zeros(0, np.int64)
        self.lcp = np.minimum(common, np.minimum(rest[1:], rest[:-1]))

    def maximal_repeats(self, least: int) -> Iterator[tuple[int, int, int]]:
        """(length, i, j): the string of that length that begins the suffixes order[i:j], all its occurrences, for each
        repeat of `least` characters or more that can be extended neither to the right nor to the left.

        One scan of the LCPs with a stack visits the nodes of the tree of common-prefix intervals from the leaves up.  An
        interval extends to the left if the same character stands before all its suffixes; a string's start counts
        as a character of its own.
        """
        lcp, high = self.lcp, np.flatnonzero(self.lcp >= least)
        for run in np.split(high, np.flatnonzero(np.diff(high) > 1) + 1):
            if not len(run):
                continue
            low = int(run[0])
            left = self.before[low : low + len(run) + 1].tolist()
            stack: list[list[int]] = []  # length, first suffix, the one character before, or 0 if there are several
            for i, height in enumerate([*lcp[run].tolist(), 0]):
                begin, char = i, left[i]
                while stack and stack[-1][0] > height:
                    length, begin, seen = stack.pop()
                    char = seen if seen == char else 0
                    if not char:
                        yield length, low + begin, low + i + 1
                if stack and stack[-1][0] == height:
                    stack[-1][2] = char if stack[-1][2] == char else 0
                elif height:
                    stack.append([height, begin, char])


def repeated(strings: list[bytes], docs: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (string, first, end) of repeats of `least` bytes or more that also begin in a string of a smaller doc."""
    sa = SuffixArray(strings, least)
    own = docs[sa.owner]
    found = [(np.zeros(0, np.int64),) * 3]
    for length, i, j in sa.maximal_repeats(least):
        later = i + np.flatnonzero(own[i:j] > own[i:j].min())
        if len(later):
            found.append((sa.owner[later], sa.at[later], sa.at[later] + length))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def kmer_hashes(raw: bytes) -> np.ndarray:
    """Hashes of all runs of K = 16 bytes."""
    n = len(raw) - K + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    eight = np.ndarray((n + 8,), "<u8", raw, strides=(1,))
    h = eight[:n] * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h += eight[8:] * np.uint64(0xA0761D6478BD642F)
    return mix(h)


def byte_parts(texts: list[bytes], overlap: int, most: int = BATCH) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Texts in parts of most + overlap bytes, as many together as hold about `most`: each part's text, its place there, its bytes."""
    own, offset, parts, held = [], [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - overlap), most):
            part = text[at : at + most + overlap]
            if held and held + len(part) > most:
                yield np.array(own), np.array(offset), parts
                own, offset, parts, held = [], [], [], 0
            own.append(i)
            offset.append(at)
            parts.append(part)
            held += len(part)
    if parts:
        yield np.array(own), np.array(offset), parts


class Common:
    """Hashes that come last in the choice of an anchor; nearly all others are told by one look at a table of bits."""

    def __init__(self, hashes: list[int]):
        self.hashes = np.array(sorted(x & (1 << 64) - 1 for x in hashes), np.uint64)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.hashes >> np.uint64(44)] = True

    def rank(self, kmers: np.ndarray) -> np.ndarray:
        """What minimizer_groups() orders by."""
        rank = kmers >> np.uint64(25)
        if len(self.hashes):
            maybe = np.flatnonzero(self.seen[kmers >> np.uint64(44)])
            place = np.minimum(np.searchsorted(self.hashes, kmers[maybe]), len(self.hashes) - 1)
            rank[maybe[self.hashes[place] == kmers[maybe]]] |= np.uint64(1 << 39)
        return rank


def _anchored(least: int, common: Common, texts: list[bytes]) -> Iterator[tuple]:
    """Part by part: each part's text and place; each span's part, hash of its anchor, its own hash, first byte and end."""
    for own, offset, parts in byte_parts(texts, least - 1):
        sizes = np.array([len(p) for p in parts], np.int64)
        begin = np.cumsum(sizes) - sizes
        raw = b"".join(parts)
        owner = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
        kmers = kmer_hashes(raw)
        at, first, last = minimizer_groups(common.rank(kmers), owner, least, K)
        if len(at):
            row = owner[at]
            span = Runs(np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)).of(first, last + least)
            yield own, offset, row, kmers[at], span, first - begin[row], last + least - begin[row]


def _candidates(least: int, buckets: int, common: Common, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchored spans, packed by range of the anchor's hash.  Of equal spans only the smallest doc_id's are sent on: the
    others are covered, which a row of bucket -1 says."""
    for batch in sliced(batches, "text", BATCH):
        ids, sums = batch.column("doc_id").to_numpy(), batch.column("text_key").to_numpy()
        for own, offset, row, kmer, span, first, end in _anchored(least, common, texts_as_bytes(batch.column("text"))):
            docs, keys = ids[own], sums[own]
            # minimizers have small hashes: mixed again, they spread over all buckets
            anchor = mix(kmer ^ np.uint64(0x2545F4914F6CDD1D))
            order = np.lexsort((docs[row], span, anchor))
            anchor, span, row, first, end = (x[order] for x in (anchor, span, row, first, end))
            fresh = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (span[1:] != span[:-1])])
            least_doc = docs[row][np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
            late = docs[row] > least_doc
            rows = []
            if late.any():
                away = np.flatnonzero(late)
                far = 2 * BATCH + least  # so that parts' spans do not touch
                a, b = merged(first[away] + row[away] * far, end[away] + row[away] * far)
                part = a // far
                a, b = (x - part * far + offset[part] for x in (a, b))
                rows.append(_pack(-1, np.zeros(len(a), np.uint64), np.zeros(len(a), np.uint64), part, docs, keys, a, b))
            kept = np.flatnonzero(~late)
            place = ((anchor[kept] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            cuts = np.flatnonzero(np.diff(place)) + 1
            for i, pick in zip([0, *cuts.tolist()], np.split(kept, cuts), strict=True):
                if len(pick):
                    shift = offset[row[pick]]
                    rows.append(_pack(int(place[i]), anchor[pick], span[pick], row[pick], docs, keys, first[pick] + shift, end[pick] + shift))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "packed"])


def common_anchors(rows: DataFrame, least: int, one_in: int = 32, spans: int = 64, most: int = 1_000_000) -> Common:
    """Anchors with `spans` or more different spans in one of `one_in` documents (by a hash of the id), but no more than `most`
    can be: an anchor counts only with a `most`-th of the sample's spans."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = Common([])
        for batch in sliced(batches, "text", BATCH):
            for _, _, _, kmer, span, _, _ in _anchored(least, none, texts_as_bytes(batch.column("text"))):
                yield pa.RecordBatch.from_arrays([pa.array(kmer.view(np.int64)), pa.array(span.view(np.int64))], names=["anchor", "span"])

    found = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(41)), F.lit(one_in)) == 0).mapInArrow(seen, "anchor long, span long")
    counts = found.groupBy("anchor", "span").agg(F.count(F.lit(1)).alias("n")).groupBy("anchor").agg(F.count(F.lit(1)).alias("spans"), F.sum("n").alias("n"))
    some = counts.where(F.col("spans") >= spans)
    total = counts.agg(F.sum("n").alias("total"))
    return Common([r[0] for r in some.join(F.broadcast(total), F.col("spans") >= F.col("total") / most).select("anchor").collect()])


def _pack(bucket: int, anchor, span, row, docs, keys, first, end) -> tuple[int, bytes]:
    """Columns one after another, documents by place in a list of their own; small numbers take few bytes."""
    there = np.zeros(len(docs), bool)
    there[row] = True
    names, place = np.flatnonzero(there), (np.cumsum(there) - 1)[row]
    wide = "<u2" if len(names) <= 1 << 16 else "<u4"
    size = "u1" if (end - first).max(initial=0) < 256 else "<u4"
    head = np.array([len(anchor), len(names), np.dtype(wide).itemsize, np.dtype(size).itemsize], "<u4")
    return bucket, b"".join([head.tobytes(), anchor.astype("<u8").tobytes(), span.astype("<u8").tobytes(), place.astype(wide).tobytes(), first.astype("<u4").tobytes(), (end - first).astype(size).tobytes(), np.stack([docs[names], keys[names]], 1).astype("<i8").tobytes()])


def _unpack(packed: bytes) -> tuple[np.ndarray, ...]:
    n, names, wide, long = np.frombuffer(packed, "<u4", 4).tolist()
    at, out = 16, []
    for kind, count in (("<u8", n), ("<u8", n), (f"<u{wide}", n), ("<u4", n), (f"<u{long}", n), ("<i8", 2 * names)):
        out.append(np.frombuffer(packed, kind, count, at))
        at += count * np.dtype(kind).itemsize
    anchor, span, place, first, size, own = out
    own = own.reshape(-1, 2)[place]
    first = first.astype(np.int64)
    return anchor, span, own[:, 0], own[:, 1], first, first + size


RESOLVED = "doubtful boolean, anchor long, doc_id long, text_key long, first int, end int"


def _rows(doubtful, anchor, docs, keys, first, end) -> pa.Table:
    return pa.table({"doubtful": pa.array(np.broadcast_to(doubtful, len(docs))), "anchor": pa.array(anchor.view(np.int64)), "doc_id": pa.array(docs), "text_key": pa.array(keys), "first": pa.array(first.astype(np.int32)), "end": pa.array(end.astype(np.int32))})


def _resolve(table: pa.Table) -> pa.Table:
    """Of one range of anchors: spans that a smaller doc_id has whole, and the first document's spans whose anchor
    other documents have in other surroundings."""
    columns = [np.concatenate(x) for x in zip(*map(_unpack, table.column("packed").to_pylist()), strict=True)]
    order = np.lexsort((columns[2], columns[1], columns[0]))
    anchor, span, docs, keys, first, end = (x[order] for x in columns)
    group = np.concatenate([[True], anchor[1:] != anchor[:-1]])
    fresh = group | np.concatenate([[True], span[1:] != span[:-1]])
    own_least = docs[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
    late = docs > own_least
    starts = np.flatnonzero(group)
    number = np.cumsum(group) - 1
    mixed = (np.minimum.reduceat(own_least, starts) < np.maximum.reduceat(own_least, starts))[number] & ~late
    pick = np.flatnonzero(late | mixed)
    return _rows(mixed[pick], np.where(mixed, anchor, 0)[pick], docs[pick], keys[pick], first[pick], end[pick])


def _cut(least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of doubtful spans; of an anchor in many surroundings, each window by itself under its own hash."""
    for batch in sliced(batches, "text", BATCH):
        texts = texts_as_bytes(batch.column("text"))
        lists = batch.column("spans")
        flat = lists.flatten()
        owner, first, end = span_arrays(lists)
        anchor, hot = flat.field(2).to_pylist(), flat.field(3).to_pylist()
        out = []
        for o, a, b, h, many in zip(owner.tolist(), first.tolist(), end.tolist(), anchor, hot, strict=True):
            if many:
                for i in range(a, b - least + 1):
                    out.append((True, 0, o, i, texts[o][i : i + least]))
            else:
                out.append((False, h, o, a, texts[o][a:b]))
        if out:
            hot, group, row, at, own = zip(*out, strict=True)
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(hot), pa.array(group, pa.int64()), batch.column("doc_id").take(row), batch.column("text_key").take(row), pa.array(at, pa.int32()), pa.array(own, pa.binary())], names=["hot", "anchor", "doc_id", "text_key", "first", "bytes"])


def _scan(least: int, chunk: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor: whole groups of about `chunk` bytes go into a suffix array of their own."""

    def done() -> pa.RecordBatch:
        docs = np.array([h[1] for h in held], np.int64)
        string, first, end = repeated([h[4] for h in held], docs, least)
        key, at = np.array([h[2] for h in held], np.int64), np.array([h[3] for h in held], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(docs[string]), pa.array(key[string]), pa.array((at[string] + first).astype(np.int32)), pa.array((at[string] + end).astype(np.int32))], names=["doc_id", "text_key", "first", "end"])

    held, size = [], 0
    for batch in batches:
        for r in zip(*(batch.column(c).to_pylist() for c in ("anchor", "doc_id", "text_key", "first", "bytes")), strict=True):
            if size > chunk and r[0] != held[-1][0]:
                yield done()
                held, size = [], 0
            held.append(r)
            size += len(r[4])
    if held:
        yield done()


def find_repeats(rows: DataFrame, least: int = 50, bucket_bytes: int = 4_000_000, hot_group: int = 20_000, chunk: int = 400_000) -> DataFrame:
    """Spans (doc_id, text_key, first, end) of keyed() rows' bytes whose every string of `least` bytes also starts in a
    smaller doc_id; their union covers all such strings.

    Only strings that share an anchor, the 16 bytes in them of smallest hash, can be equal (16 bytes that common_anchors() finds
    in many surroundings are anchors only of strings that have no others), so suffixes are compared within the groups of one anchor: (1) each anchor's span, the union of the strings that chose it, is reduced to hashes;
    equal spans, however often they occur, collapse to the first document's, and the later ones are covered whole.
    (2) Spans whose anchor occurs in other surroundings are cut from their texts and sorted into enhanced suffix arrays,
    chunk by chunk of whole groups; the scan of the interval tree gives the maximal repeats with all occurrences.
    A group with more than hot_group different spans is not brought together: its strings of `least` bytes are dealt by
    their own bytes and counted with partial aggregation.
    """
    space = Workspace(rows.sparkSession, "suffixes")
    rows = rows.where("doc_id IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    common = common_anchors(rows, least)
    packed = rows.mapInArrow(lambda b: _candidates(least, buckets, common, b), "bucket int, packed binary")
    # covered ones (bucket -1) need no company: any bucket they are dealt to passes them on
    dealt = packed.withColumn("_deal", F.when(F.col("bucket") < 0, -1 - F.pmod(F.xxhash64("packed"), F.lit(4 * buckets)).cast("int")).otherwise(F.col("bucket")))

    def settle(key: tuple, table: pa.Table) -> pa.Table:
        if key[0].as_py() >= 0:
            return _resolve(table)
        anchor, _, docs, keys, first, end = (np.concatenate(x) for x in zip(*map(_unpack, table.column("packed").to_pylist()), strict=True))
        return _rows(False, np.zeros_like(anchor), docs, keys, first, end)

    resolved = space.stage(dealt.groupBy("_deal").applyInArrow(settle, RESOLVED), "resolved", large=True)
    covered = resolved.where("NOT doubtful").select("doc_id", "text_key", "first", "end")
    doubtful = resolved.where("doubtful").drop("doubtful")
    many = doubtful.groupBy("anchor").count().where(F.col("count") > hot_group).select("anchor", F.lit(True).alias("hot"))
    doubtful = doubtful.join(many, "anchor", "left")
    lists = doubtful.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("first", "end", "anchor", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("spans"))
    asked = rows.join(lists, ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "spans")
    cut = space.stage(asked.mapInArrow(lambda b: _cut(least, b), "hot boolean, anchor long, doc_id long, text_key long, first int, bytes binary"), "cut", large=True)
    spans = "doc_id long, text_key long, first int, end int"
    groups = cut.where("NOT hot").repartition("anchor").sortWithinPartitions("anchor")
    scanned = groups.select("anchor", "doc_id", "text_key", "first", "bytes").mapInArrow(lambda b: _scan(least, chunk, b), spans)
    single = cut.where("hot").select("doc_id", "text_key", "first", F.col("bytes").alias("window"))
    first_of = single.groupBy("window").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most")
    dealt_out = single.join(first_of, "window").where("doc_id > least").select("doc_id", "text_key", "first", (F.col("first") + least).alias("end"))
    found = space.stage(scanned.unionByName(dealt_out), "found", large=True)
    space.drop(cut)
    return covered.unionByName(found)


def remove_bytes(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, text_key, n_bytes, n_removed, n_spans, kept: rows without the bytes in spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", BATCH):
            owner, first, end = span_arrays(batch.column("spans"))
            bounds = np.searchsorted(owner, np.arange(batch.num_rows + 1)).tolist()
            sizes, gone, runs, kept = [], [], [], []
            for i, text in enumerate(texts_as_bytes(batch.column("text"))):
                sizes.append(len(text))
                if bounds[i] == bounds[i + 1]:
                    gone.append(0)
                    runs.append(0)
                    kept.append(text)
                    continue
                a, b = merged(first[bounds[i] : bounds[i + 1]], end[bounds[i] : bounds[i + 1]])
                gone.append(int((b - a).sum()))
                runs.append(len(a))
                kept.append(b"".join(text[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(text)], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), *(pa.array(x, pa.int64()) for x in (sizes, gone, runs)), pa.array(kept, pa.binary())], names=["doc_id", "text_key", "n_bytes", "n_removed", "n_spans", "kept"])

    return with_spans(rows, spans).select("doc_id", "text_key", "text", "spans").mapInArrow(run, "doc_id long, text_key long, n_bytes long, n_removed long, n_spans long, kept binary")


def dedup_suffixes(docs: DataFrame, least: int = 50) -> DataFrame:
    """Remove each byte covered by a string of `least` bytes that also starts in a document with a smaller doc_id.

    Texts are whole, as UTF-8; a null text has no bytes, and matches never cross documents.  Overlaps count; strings are
    judged on the input.  A long text is searched part by part, parts overlapping, so a task holds little beside the text.  Rows of equal doc_id do not cover each other, and rows with a null id take no part, but each row
    is returned.  An empty table gives an empty result.  Other columns are left out.
    """
    rows = keyed(docs)
    return remove_bytes(rows, find_repeats(rows, least))


def without_repeats(docs: DataFrame, least: int = 50) -> DataFrame:
    """docs with the repeats that dedup_suffixes() finds taken out of their texts, n_chars (if there is one) made to
    fit, and documents left out whose text was wholly repeated.  Texts without repeats stay as they are, null ones too; in others,
    bytes of a character that lost some of its bytes go as well."""
    columns = docs.columns
    rows = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text_key": F.xxhash64(F.coalesce("text", F.lit("")))})
    spans = find_repeats(keyed(docs), least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", BATCH):
            owner, first, end = span_arrays(batch.column("spans"))
            bounds = np.searchsorted(owner, np.arange(batch.num_rows + 1)).tolist()
            texts, keep = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                if bounds[i] < bounds[i + 1]:
                    raw = text.encode()
                    a, b = merged(first[bounds[i] : bounds[i + 1]], end[bounds[i] : bounds[i + 1]])
                    text = b"".join(raw[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(raw)], strict=True)).decode(errors="ignore")
                    keep.append(text != "")
                else:
                    keep.append(True)
                texts.append(text)
            made = {"text": pa.array(texts, pa.string())}
            out = pa.RecordBatch.from_arrays([made.get(c, batch.column(c)) for c in columns], names=columns)
            yield out.filter(pa.array(keep, pa.bool_()))

    left = with_spans(rows, spans).select(*columns, "spans").mapInArrow(run, rows.select(*columns).schema)
    return left.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in columns else left
