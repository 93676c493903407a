"""Substring dedup by words, with a log-structured index of fingerprints."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyagg.llm.common import Workspace, delete_path, release, sliced, texts_as_bytes
from polyagg.llm.rolling import Runs, merged, minimizer_groups, mix, words

BATCH = 1_000_000


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a checksum of the text, which together name a row up to exact repetition."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))


def with_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """rows of keyed() with the array `spans` of their (first, end)."""
    lists = spans.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct(F.col("first").cast("int").alias("first"), F.col("end").cast("int").alias("end"))).alias("spans"))
    return rows.join(lists, ["doc_id", "text_key"], "left")


def span_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of an array column of structs (first, end): owner row, first and end, flat."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.array([0 if x is None else x for x in lists.value_lengths().to_pylist()], np.int64)
    flat = lists.flatten()
    owner = np.repeat(np.arange(len(lists)), sizes)
    return owner, flat.field(0).to_numpy(zero_copy_only=False).astype(np.int64), flat.field(1).to_numpy(zero_copy_only=False).astype(np.int64)


def _fingerprints(window: int, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text", BATCH):
        w = words(texts_as_bytes(batch.column("text")))
        if len(w.hash) < window:
            continue
        runs = Runs(w.hash)
        kmers = runs.every(k)
        at, first, last = minimizer_groups(kmers >> np.uint64(24), w.text, window, k)
        owner = pa.array(w.text[at])
        offset = w.first[w.text[at]]
        yield pa.RecordBatch.from_arrays([
            pa.array(kmers[at].view(np.int64)), pa.array(runs.of(first, last + window).view(np.int64)),
            batch.column("doc_id").take(owner), batch.column("text_key").take(owner),
            pa.array((first - offset).astype(np.int32)), pa.array((last + window - offset).astype(np.int32)),
        ], names=["anchor", "span", "doc_id", "text_key", "first", "end"])


def _word_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text", BATCH):
        w = words(texts_as_bytes(batch.column("text")))
        hashes = pa.ListArray.from_arrays(pa.array(w.first.astype(np.int32)), pa.array(w.hash.view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), hashes], names=["doc_id", "text_key", "words"])


def _windows(window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of some spans, as two hashes of its words' hashes."""
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            lists = part.column("words")
            hashes = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            begin = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            owner, first, end = span_arrays(part.column("spans"))
            count = end - first - window + 1
            at = np.unique(np.repeat(first + begin[owner], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
            if not len(at):
                continue
            text = np.searchsorted(begin, at, "right") - 1
            rows = pa.array(text)
            yield pa.RecordBatch.from_arrays([
                pa.array(Runs(hashes).of(at, at + window).view(np.int64)), pa.array(Runs(mix(hashes ^ np.uint64(0x5851F42D4C957F2D))).of(at, at + window).view(np.int64)),
                *(part.column(c).take(rows) for c in ("mine", "doc_id", "text_key")), pa.array((at - begin[text]).astype(np.int32)),
            ], names=["a", "b", "mine", "doc_id", "text_key", "first"])


class FingerprintIndex:
    """Which windows of `window` words have been seen, and in which smallest doc_id: a log of sorted, immutable runs.

    A window's fingerprint is the hash of the k words in it with the smallest hash (its anchor); windows in a row that
    share an anchor form a span.  A run holds each distinct (anchor, span hash) with its first document, so repeated passages take
    one row however often they occur.  Runs are tables in the shared folder, dealt to `buckets` files by anchor and sorted by it, so
    that add() merge-joins a batch with them where they lie; `fanout` runs of one level are compacted into one of the next.
    Beside its run each batch leaves its words' hashes, by which windows of old documents are compared without their texts.
    """

    def __init__(self, spark: SparkSession, window: int = 50, k: int = 10, fanout: int = 2, buckets: int | None = None):
        self.space, self.window, self.k, self.fanout = Workspace(spark, "windows"), window, k, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[list[str]] = [[]]  # names of tables, by level
        self.words: list[DataFrame] = []

    def run(self, name: str) -> DataFrame:
        return self.space.spark.table(name)

    def _write(self, run: DataFrame, level: int) -> str:
        name = f"polyagg_run_{level}_{uuid.uuid4().hex}"
        dealt = run.repartition(self.buckets, "anchor")  # as the files are, so that each is written by one task
        dealt.write.bucketBy(self.buckets, "anchor").sortBy("anchor", "span").option("path", f"{self.space.root}/{name}").saveAsTable(name)
        release(self.space.spark, 3)
        return name

    def matches(self, name: str, batch: DataFrame) -> DataFrame:
        """Rows of an old run whose anchors the batch's run has: both lie sorted by anchor in as many files."""
        return self.run(name).join(batch.select("anchor").distinct(), "anchor", "left_semi")

    def add(self, rows: DataFrame) -> DataFrame:
        """Take in a batch of keyed() rows, whose ids exceed those of the batches before; spans (doc_id, text_key, first, end) of
        the batch that cover its windows that also start in a smaller doc_id, old or new.

        Spans whose anchor and hash an earlier document has are covered whole.  Where an anchor has other words around it, windows
        are compared one by one, with the first document of each such span.  Rows with a null id neither cover nor are covered.
        """
        window, k = self.window, self.k
        rows = rows.where("doc_id IS NOT NULL")
        schema = "anchor long, span long, doc_id long, text_key long, first int, end int"
        seen = self.space.stage(rows.mapInArrow(lambda b: _fingerprints(window, k, b), schema), "batch", large=True)
        hashes = self.space.stage(rows.mapInArrow(_word_hashes, "doc_id long, text_key long, words array<long>"), "words")
        own = self._write(seen.groupBy("anchor", "span").agg(F.min(F.struct("doc_id", "text_key", "first", "end")).alias("at")), 0)
        known = self.run(own)
        for name in (n for level in self.runs for n in level):
            known = known.unionByName(self.matches(name, self.run(own)))
        classes = self.space.stage(known.groupBy("anchor", "span").agg(F.min("at").alias("at")), "classes")
        covered = seen.join(classes, ["anchor", "span"]).where("doc_id > at.doc_id").select("doc_id", "text_key", "first", "end")
        mixed = classes.groupBy("anchor").agg(F.min("at.doc_id").alias("least"), F.max("at.doc_id").alias("most")).where("least < most").select("anchor")
        mixed = classes.join(mixed, "anchor", "left_semi")
        # a span's first document may hold it several times
        again = seen.join(mixed, ["anchor", "span"]).where("doc_id = at.doc_id").select("doc_id", "text_key", "first", "end")
        doubtful = mixed.select("at.*").unionByName(again).distinct()
        covered, doubtful = self.space.stage(covered, "covered"), self.space.stage(doubtful, "doubtful", large=True)
        self.space.drop(seen, classes)
        out = covered.unionByName(self._verified(hashes, doubtful))
        self.space.drop(doubtful)
        self.words.append(hashes)
        self.runs[0].append(own)
        self._compact()
        return out

    def _verified(self, batch: DataFrame, doubtful: DataFrame) -> DataFrame:
        """Windows of a batch, given by its words' hashes, that a smaller doc_id has in doubtful spans, old or new."""
        window, texts = self.window, batch.withColumn("mine", F.lit(True))
        for old in self.words:
            texts = texts.unionByName(old.withColumn("mine", F.lit(False)))
        asked = with_spans(texts, doubtful).where("spans IS NOT NULL")
        cuts = self.space.stage(asked.mapInArrow(lambda b: _windows(window, b), "a long, b long, mine boolean, doc_id long, text_key long, first int"), "windows", large=True)
        least = cuts.groupBy("a", "b").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most")
        found = cuts.where("mine").join(least, ["a", "b"]).where("doc_id > least").select("doc_id", "text_key", "first", (F.col("first") + window).alias("end"))
        out = self.space.stage(found, "verified", large=True)
        self.space.drop(cuts)
        return out

    def _compact(self) -> None:
        for level, runs in enumerate(self.runs):
            if len(runs) >= self.fanout:
                both = self.run(runs[0])
                for name in runs[1:]:
                    both = both.unionByName(self.run(name))
                whole = self._write(both.groupBy("anchor", "span").agg(F.min("at").alias("at")), level + 1)
                for name in runs:
                    self._drop(name)
                self.runs[level] = []
                if level + 1 == len(self.runs):
                    self.runs.append([])
                self.runs[level + 1].append(whole)

    def _drop(self, name: str) -> None:
        self.space.spark.sql(f"DROP TABLE {name}")
        delete_path(self.space.spark, f"{self.space.root}/{name}")

    def close(self) -> None:
        """Delete what only later batches would ask for."""
        for name in (n for level in self.runs for n in level):
            self._drop(name)
        self.space.drop(*self.words)
        self.runs, self.words = [[]], []


def remove_words(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept: rows without the words in spans; what is left is joined by single spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", BATCH):
            owner, first, end = span_arrays(batch.column("spans"))
            bounds = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            total, gone, kept = [], [], []
            for i, text in enumerate(texts_as_bytes(batch.column("text"))):
                own, at, left = text.split(), 0, []
                for a, b in zip(*(x.tolist() for x in merged(first[bounds[i] : bounds[i + 1]], end[bounds[i] : bounds[i + 1]])), strict=True):
                    left += own[at:a]
                    at = b
                left += own[at:]
                total.append(len(own))
                gone.append(len(own) - len(left))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])

    return with_spans(rows, spans).select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept binary")


def dedup_substrings(docs: DataFrame, batches: int = 3, window: int = 50) -> DataFrame:
    """Remove each word covered by a window of `window` words that also starts in a document with a smaller doc_id.

    Words are bytes other than ASCII white space, unchanged.  The documents go into a FingerprintIndex in `batches`
    ranges of doc_id, as they would arrive; windows are judged on the input.  A null text has no words; a long one is hashed part
    by part, so a task holds about ten times a text's size at most.  Rows of equal
    doc_id do not cover each other, and rows with a null id take no part, but each row is returned.  An empty table gives
    an empty result.  Other columns are left out.
    """
    spark = docs.sparkSession
    rows = keyed(docs)
    cuts = rows.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else None
    index = FingerprintIndex(spark, window)
    bounds = [None, *sorted(set(cuts or [])), None]
    spans = None
    for a, b in zip(bounds, bounds[1:], strict=False):
        own = rows if a is None else rows.where(F.col("doc_id") > a)
        found = index.add(own if b is None else own.where(F.col("doc_id") <= b))
        spans = found if spans is None else spans.unionByName(found)
    index.close()
    return remove_words(rows, spans)
