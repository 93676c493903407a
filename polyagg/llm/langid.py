"""Language identification by a convolutional network over bytes."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyagg.llm.common import sliced, texts_as_bytes

WIDTHS = (2, 3, 4)
WINDOW = 256
STRIDE = WINDOW - max(WIDTHS) + 1  # so that no run of bytes is missed between two windows
LETTER = regex.compile(r"\p{L}")


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fixed windows over whole texts, one a column, padded with zeros; each one's text and its bytes."""
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = np.maximum(1, -(-(sizes - (WINDOW - STRIDE)) // STRIDE))
    owner = np.repeat(np.arange(len(texts)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = nth * STRIDE
    flat = np.frombuffer(b"".join(texts) + bytes(WINDOW), np.uint8)
    offset = (np.cumsum(sizes) - sizes)[owner] + start
    used = np.minimum(sizes[owner] - start, WINDOW)
    x = flat[np.arange(WINDOW)[:, None] + offset]
    x[np.arange(WINDOW)[:, None] >= used] = 0
    return x, owner, used


def pieces(texts: list[bytes], most: int = 1000) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Texts in parts of `most` windows at most, as many together as hold about that many; windows are those of the whole text."""
    own, parts, held = [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - (WINDOW - STRIDE)), most * STRIDE):
            part = text[at : at + (most - 1) * STRIDE + WINDOW]
            own.append(i)
            parts.append(part)
            held += 1 + len(part) // STRIDE
            if held >= most:
                yield np.array(own), parts
                own, parts, held = [], [], 0
    if parts:
        yield np.array(own), parts


class ByteCNN:
    """One-hot bytes, `filters` filters of each width, the maximum over a window, ReLU, softmax; trained by Adam."""

    def __init__(self, langs: list[str], filters: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs, self.filters = langs, filters
        self.weights = {f"u{w}{j}": rng.normal(0, 0.3, (256, filters)).astype(np.float32) for w in WIDTHS for j in range(w)}
        self.weights |= {"out": rng.normal(0, 0.3, (len(WIDTHS) * filters, len(langs))).astype(np.float32), "bias": np.zeros(len(langs), np.float32)}

    def _pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        tops, places = [], []
        for w in WIDTHS:
            n = len(x) - w + 1
            conv = sum(self.weights[f"u{w}{j}"][x[j : j + n]] for j in range(w))
            places.append(conv.argmax(0))
            tops.append(np.take_along_axis(conv, places[-1][None], 0)[0])
        return np.concatenate(tops, 1), places

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted mean cross-entropy of some windows, one a column."""
        w8, m = self.weights, len(y)
        pooled, places = self._pooled(x)
        hidden = np.maximum(pooled, 0)
        slope = self._softmax(hidden @ w8["out"] + w8["bias"])
        slope[np.arange(m), y] -= 1
        slope *= weight[:, None] / m
        back = (slope @ w8["out"].T) * (pooled > 0)
        grads = {"out": hidden.T @ slope, "bias": slope.sum(0)}
        column = np.broadcast_to(np.arange(self.filters), (m, self.filters))
        for k, w in enumerate(WIDTHS):
            own = back[:, k * self.filters : (k + 1) * self.filters]
            for j in range(w):
                g = grads[f"u{w}{j}"] = np.zeros_like(w8[f"u{w}{j}"])
                np.add.at(g, (x[places[k] + j, np.arange(m)[:, None]], column), own)
        return grads

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, size: int = 128, rate: float = 0.01, seed: int = 7) -> ByteCNN:
        """x: windows, one a column; y: places in langs.  Languages weigh the same, however many windows each has."""
        rng, w8 = np.random.default_rng(seed), self.weights
        seen = np.bincount(y, minlength=len(self.langs))
        weight = (len(y) / np.maximum(seen, 1) / max(1, (seen > 0).sum()))[y].astype(np.float32)
        mean, square, t = {k: np.zeros_like(v) for k, v in w8.items()}, {k: np.zeros_like(v) for k, v in w8.items()}, 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(y), size):
                pick = order[at : at + size]
                grads = self.gradients(x[:, pick], y[pick], weight[pick])
                t += 1
                for k, g in grads.items():
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    square[k] = 0.999 * square[k] + 0.001 * g * g
                    w8[k] -= rate * (mean[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.999**t)) + 1e-8)
        return self

    def tables(self) -> ByteCNN:
        """For prediction: what any two neighbouring bytes add to each filter, so that a filter costs one or two lookups."""
        u = self.weights
        two = lambda a, b: (u[a][:, None] + u[b][None]).reshape(65536, -1)
        self.pairs = two("u20", "u21"), two("u30", "u31"), two("u40", "u41"), two("u42", "u43")
        return self

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of each language, for windows one a column."""
        t2, t3, t4, t4b = self.pairs
        out = []
        for at in range(0, x.shape[1], 128):  # what a step makes stays in the processor's cache
            xb = np.ascontiguousarray(x[:, at : at + 128])
            pair = xb[:-1].astype(np.int32) << 8 | xb[1:]
            three = np.take(t3, pair[:-1], 0)
            three += np.take(self.weights["u32"], xb[2:], 0)
            four = np.take(t4, pair[:-2], 0)
            four += np.take(t4b, pair[2:], 0)
            out.append(np.concatenate([np.take(t2, pair, 0).max(0), three.max(0), four.max(0)], 1))
        hidden = np.maximum(np.concatenate(out), 0)
        return self._softmax(hidden @ self.weights["out"] + self.weights["bias"])

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Place in langs and score of each text: the mean over its windows, weighed by their bytes."""
        mean = np.zeros((len(texts), len(self.langs)))
        for own, parts in pieces(texts):
            x, owner, used = windows(parts)
            np.add.at(mean, own[owner], self.probabilities(x) * np.maximum(used, 1)[:, None])
        mean /= mean.sum(1, keepdims=True)
        best = mean.argmax(1)
        return best, np.clip(mean[np.arange(len(best)), best].astype(float), 0, 1)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id's text ('' for null) leaves 1 when divided by 3."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, learn: Column, lang: str = "lang", docs_per_lang: int = 600, windows_per_doc: int = 4, most_windows: int = 400_000) -> ByteCNN | None:
    """Fit on a bounded sample of the rows where `learn` holds and lang is not null: about docs_per_lang documents of
    each language, however rare, chosen by a hash of their id, and windows_per_doc windows spread over each whole text; with so
    many languages that this exceeds most_windows, fewer documents of each.  None if there is nothing to learn from."""
    rows = docs.where(learn & F.col(lang).isNotNull() & F.col("text").isNotNull())
    counts = {r[lang]: r["count"] for r in rows.groupBy(lang).count().collect()}
    if not counts:
        return None
    langs = sorted(counts)
    docs_per_lang = max(1, min(docs_per_lang, most_windows // (2 * windows_per_doc * len(langs))))
    shares = F.from_json(F.lit(json.dumps({k: min(1.0, 1.3 * docs_per_lang / n) for k, n in counts.items()})), "map<string,double>")
    chance = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 24)) / float(1 << 24)
    picked = rows.where(chance < F.element_at(shares, F.col(lang))).select(F.col(lang).alias("lang"), "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 1_000_000):
            kept = [(a, t) for a, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True) if LETTER.search(t)]
            if not kept:
                continue
            x, owner, _ = windows([t.encode() for _, t in kept])
            count = np.bincount(owner)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            step = np.repeat(np.maximum(1, -(-count // windows_per_doc)), count)
            own = np.flatnonzero(nth % step == 0)
            yield pa.RecordBatch.from_arrays([pa.array([kept[i][0] for i in owner[own]], pa.string()), pa.array([x[:, i].tobytes() for i in own], pa.binary())], names=["lang", "window"])

    most = docs_per_lang * windows_per_doc * len(langs) * 2
    sample = picked.mapInArrow(cut, "lang string, window binary").orderBy(F.xxhash64("window"), "window", "lang").limit(most).collect()
    if not sample:
        return None
    x = np.stack([np.frombuffer(bytes(r.window), np.uint8) for r in sample], 1)
    place = {own: i for i, own in enumerate(langs)}
    return ByteCNN(langs).fit(x, np.array([place[r.lang] for r in sample]))


def identify(docs: DataFrame, model: ByteCNN | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns in keep, lang_pred and score for each row of docs.

    Every window of the whole text counts.  Texts that are null or hold no letter are `und` with score 0, as are all
    when there was nothing to learn from; equal texts get equal results; an empty table gives an empty one.
    The model is a few hundred KB whatever the input.
    """
    if model is not None:
        model.pairs = None
    names = ["doc_id", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.tables() if model is not None else None
        for batch in sliced(batches, "text", 1_000_000):
            texts = batch.column("text").to_pylist()
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            good = [i for i, t in enumerate(texts) if t and own is not None and LETTER.search(t)]
            if good:
                raw = texts_as_bytes(batch.column("text").take(pa.array(good)))
                best, sure = own.predict(raw)
                score[good] = sure
                for i, b in zip(good, best.tolist(), strict=True):
                    lang[i] = own.langs[b]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(lang, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    schema = docs.select(*names).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(run, schema)


def predict_languages(docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out, then identify all of docs (doc_id, text, lang)."""
    model = train(docs, ~held_out())
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    return identify(rows, model, ("held_out",))
