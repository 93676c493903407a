"""Vectorised hashing of words, runs of words and runs of bytes, and minimizers, over batches of whole texts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: An odd multiplier and its inverse modulo 2^64, for hashes of runs as differences of running sums.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
GAP = re.compile(rb"[ \t-\r]")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^(n - 1) modulo 2^64; kept by the worker up to 4 M of them."""
    found = _powers.get(base)
    if found is None or len(found) < n:
        size = max(n, 1 << 16) if n > 1 << 22 else 1 << max(16, n.bit_length())
        found = np.full(size, base, np.uint64)
        found[0] = 1
        np.multiply.accumulate(found, out=found)
        if size <= 1 << 22:
            _powers[base] = found
    return found[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread each bit over all 64."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


class Runs:
    """Hashes of runs a[i:j] of a sequence of numbers, in constant time each."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(BASE, n), out=self.total[1:])
        self.back = powers(INVERSE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.total[end] - self.total[start]) * self.back[start]
        return mix(h + (end - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))

    def every(self, length: int) -> np.ndarray:
        """Of all runs of a length, by start."""
        n = len(self.total) - length
        return mix((self.total[length:] - self.total[:n]) * self.back[:n] + np.uint64(length * 0xC2B2AE3D27D4EB4F % (1 << 64)))


@dataclass
class Words:
    """The words of a batch of texts: each one's hash and its text (by place)."""

    hash: np.ndarray
    text: np.ndarray
    first: np.ndarray  # each text's first word, and after the last text the number of words


#: Bytes that are hashed at a time; a text is cut between words.
PART = 1_000_000


def _word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The place and the hash of each word."""
    flat = np.frombuffer(b" " + raw + b" ", np.uint8)
    inside = ~SPACE[flat]
    start = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    end = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    return start - 1, Runs(flat.astype(np.uint64) + np.uint64(1)).of(start, end)


def parts(text: bytes) -> Iterator[bytes]:
    """A text cut before white space into parts of about PART bytes, or as long as a longer word."""
    at = 0
    while len(text) - at > PART:
        cut = GAP.search(text, at + PART)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def words(texts: list[bytes]) -> Words:
    """Words are runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return."""
    hashes, counts = [], np.zeros(len(texts), np.int64)
    held, own, size = [], [], 0

    def done():
        start, found = _word_hashes(b" ".join(held))
        bounds = np.cumsum([0, *(len(p) + 1 for p in held)])
        np.add.at(counts, own, np.diff(np.searchsorted(start, bounds)))
        hashes.append(found)

    for i, text in enumerate(texts):
        for part in parts(text):
            if held and size + len(part) > PART:
                done()
                held, own, size = [], [], 0
            held.append(part)
            own.append(i)
            size += len(part)
    if held:
        done()
    first = np.concatenate([[0], np.cumsum(counts)])
    return Words(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.repeat(np.arange(len(texts)), counts), first)


def leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For each start of `width` values below 2^40 in a row, the place of the first smallest."""
    if len(values) < 1 << 24:  # value and place fit into one number
        best, size = values << np.uint64(24) | np.arange(len(values), dtype=np.uint64), 1
        while size < width and len(best):
            step = min(size, width - size)
            best = np.minimum(best[:-step], best[step:]) if step < len(best) else best[:0]
            size += step
        return (best & np.uint64((1 << 24) - 1)).astype(np.int64)
    best, at, size = values, np.arange(len(values), dtype=np.int32 if len(values) < 1 << 31 else np.int64), 1
    while size < width:
        step = min(size, width - size)
        n = len(best) - step
        if n <= 0:
            return at[:0]
        right = best[step:] < best[:n]
        at = np.where(right, at[step:], at[:n])
        best = np.where(right, best[step:], best[:n])
        size += step
    return at


def minimizer_groups(rank: np.ndarray, owner: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of `window` items in a row, within one owner, by the k-mer in them with the smallest rank (below 2^40; the first of equals).

    Returns for each such k-mer its place, and the first and last start of the windows that chose it.  The choice depends
    on the window alone, so equal windows, wherever they are, choose the same k-mer at the same offset.
    """
    n = len(owner) - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    at = leftmost_minima(rank, window - k + 1)[:n]
    good = np.flatnonzero(owner[:n] == owner[window - 1 :])
    chosen = at[good]
    fresh = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (np.diff(good) != 1)])) if len(good) else np.zeros(0, np.int64)
    last = np.concatenate([fresh[1:], [len(good)]])[: len(fresh)] - 1
    return chosen[fresh].astype(np.int64), good[fresh], good[last]


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans [start, end) as maximal ones, in order."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    fresh = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
    return start[fresh], np.concatenate([end[fresh[1:] - 1], end[-1:]])
