"""Byte-level BPE, encoding and decoding, with a rank queue on hierarchical bitmaps."""

from __future__ import annotations

import base64
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from polyagg.llm.common import sliced


#: Positions of one rank from which on those in different matches are merged by whole columns.
WIDE = 64


class RankQueue:
    """Positions by merge rank: a bucket for each rank, and bitmaps of 64-bit words of which each level marks the words
    of the level below that are not zero, so that the lowest rank is found by one find-first-set a level."""

    def __init__(self, ranks: int):
        self.levels = [[0] * max(1, -(-ranks // 64))]
        while len(self.levels[-1]) > 1:
            self.levels.append([0] * -(-len(self.levels[-1]) // 64))
        self.buckets: dict[int, list[int] | array] = {}

    def fill(self, rank: int, positions: list[int] | array) -> None:
        """Give a rank that has no position some; to one that has, append to buckets[rank]."""
        self.buckets[rank] = positions
        for words in self.levels:
            word = words[rank >> 6]
            words[rank >> 6] = word | 1 << (rank & 63)
            if word:
                return
            rank >>= 6

    def lowest(self) -> int:
        """The lowest rank that has a position, or -1."""
        if not self.levels[-1][0]:
            return -1
        at = 0
        for words in reversed(self.levels):
            word = words[at]
            at = at << 6 | (word & -word).bit_length() - 1
        return at

    def drain(self, rank: int) -> list[int]:
        """All positions of a rank that has any, from left to right."""
        positions = self.buckets.pop(rank)
        for words in self.levels:
            words[rank >> 6] &= ~(1 << (rank & 63))
            if words[rank >> 6]:
                break
            rank >>= 6
        return sorted(positions)


class ByteBPE:
    """The merges of a rank file (base64 token, rank on each line; every single byte is a token).

    Each pattern match is encoded by itself: the pair of neighbouring tokens whose joined bytes have the lowest rank
    is merged, leftmost first, until no pair has a rank.  One queue serves many matches, side by side without pairs
    between them: the lowest rank of all is the lowest of each match that has it.  Matches are taken `together` at a time,
    in the middle of a text too; those not known go through the queue side by side.  Ids of short matches are kept while they
    take no more than `keep` bytes; then those go that were used longest ago.
    """

    def __init__(self, path: str, pattern: str, keep: int = 16_000_000, together: int = 100_000):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.letters = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.sizes = np.array([len(x) for x in self.tokens])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.scratch = np.full(len(self.tokens) + 1, -1, np.int32)
        self.columns: dict[int, tuple[np.ndarray, ...]] = {}
        # by token, the ranks of its pairs with the tokens that may follow it, and that may precede it
        self.follow: dict[int, dict[int, int]] = {}
        self.precede: dict[int, dict[int, int]] = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                if (a := self.ranks.get(token[:i])) is not None and (b := self.ranks.get(token[i:])) is not None:
                    self.follow.setdefault(a, {})[b] = rank
                    self.precede.setdefault(b, {})[a] = rank
        self.single = np.array([self.ranks[bytes([x])] for x in range(256)])
        self.double = np.array([self.ranks.get(bytes([x, y]), -1) for x in range(256) for y in range(256)])
        self.pattern = regex.compile(pattern)
        self.queue = RankQueue(len(self.tokens))
        self.keep, self.together = keep, together
        self.known: dict[str, bytes] = {}
        self.held = 0

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each of some matches that are not empty."""
        raw, queue, none = b"\0".join([*pieces, b""]), self.queue, {}  # a byte after each match parts it from the next
        n, buckets = len(raw), queue.buckets
        begin = np.concatenate([[0], np.cumsum([len(p) + 1 for p in pieces])])
        begins = begin.tolist()
        flat = np.frombuffer(raw, np.uint8).astype(np.int64)
        packed = lambda x: array("i", x.astype(np.int32).tobytes())
        listed = np.ndarray.tolist if n < 1 << 20 else packed
        after, before = packed(np.arange(1, n + 1)), packed(np.arange(-1, n - 1))  # a token ends where the next begins
        token = self.single[flat]
        token[begin[1:] - 1] = -1
        tokens = packed(token)  # -1 where none begins any more, and between matches
        rank = np.append(self.double[flat[:-1] << 8 | flat[1:]], -1)
        rank[begin[1:] - 1] = -1
        rank[begin[1:] - 2] = -1
        pair = packed(rank)  # the rank by which a token can merge with the next, as of now
        order = np.argsort((rank + 1).astype(np.min_scalar_type(len(self.tokens))), kind="stable")
        order = order[np.searchsorted(rank[order], 0) :]
        cuts = [0, *(np.flatnonzero(np.diff(rank[order])) + 1).tolist(), len(order)] if len(order) else []
        order, firsts = listed(order), rank[order[cuts[:-1]]].tolist()
        for first, a, b in zip(firsts, cuts, cuts[1:], strict=False):
            queue.fill(first, order[a:b])
        match = np.repeat(np.arange(len(pieces), dtype=np.int32), np.diff(begin))
        views = [np.frombuffer(x, np.int32) for x in (after, before, tokens, pair)]
        while (r := queue.lowest()) >= 0:
            positions = queue.drain(r)
            if len(positions) >= WIDE:
                positions = self._merge_apart(r, np.array(positions), match, *views)
            wait, later = 0, []  # a match in which a lower rank has come up waits for that
            follow, precede = self.follow.get(r, none), self.precede.get(r, none)
            for i in positions:
                if pair[i] != r:
                    continue  # stale: merged away, or its neighbour changed
                if i < wait:
                    later.append(i)
                    continue
                gone = after[i]
                after[i] = end = after[gone]
                before[end] = i
                tokens[i] = r
                tokens[gone] = pair[gone] = -1
                pair[i] = low = follow.get(tokens[end], -1)
                if low >= 0:
                    if (bucket := buckets.get(low)) is None:
                        queue.fill(low, [i])
                    else:
                        bucket.append(i)
                if (left := before[i]) >= 0:
                    new = precede.get(tokens[left], -1)
                    if pair[left] != new:
                        pair[left] = new
                        if new >= 0:
                            if (bucket := buckets.get(new)) is None:
                                queue.fill(new, [left])
                            else:
                                bucket.append(left)
                            if new < low or low < 0:
                                low = new
                if 0 <= low < r:
                    wait = begins[bisect_right(begins, i)]
            if later:
                queue.fill(r, later)
        found = views[2]
        ends = (np.concatenate([[0], np.cumsum(found >= 0)])[begin] * 4).tolist()
        ids = found[found >= 0].astype("<u4").tobytes()
        return [ids[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def _merge_apart(self, r: int, at: np.ndarray, match: np.ndarray, after: np.ndarray, before: np.ndarray, tokens: np.ndarray, pair: np.ndarray) -> list[int]:
        """Merge those of a rank's positions that are the only ones of their matches, all at once; the others, from left to right."""
        at = at[pair[at] == r]
        same = match[at[1:]] == match[at[:-1]]
        alone = ~(np.append(same, False) | np.append(False, same)) if len(at) else np.zeros(0, bool)
        rest, at = at[~alone].tolist(), at[alone]
        if r not in self.columns:
            sides = (self.follow.get(r, {}), self.precede.get(r, {}))
            self.columns[r] = tuple(np.fromiter(x, np.int32, len(d)) for d in sides for x in (d.keys(), d.values()))
        own = self.columns[r]
        gone = after[at]
        end = after[gone]
        after[at], before[end], tokens[at] = end, at, r
        tokens[gone] = pair[gone] = -1
        for side, where, other in ((0, at, end), (2, before[at], before[at])):
            self.scratch[own[side]] = own[side + 1]
            new = self.scratch[tokens[other]]
            self.scratch[own[side]] = -1
            fresh = np.flatnonzero((new >= 0) & (pair[where] != new))
            pair[where] = new
            buckets = self.queue.buckets
            for i, low in zip(where[fresh].tolist(), new[fresh].tolist(), strict=True):
                if (bucket := buckets.get(low)) is None:
                    self.queue.fill(low, [i])
                else:
                    bucket.append(i)
        return rest

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        held, size = [], 0
        for own, text in zip(out, texts, strict=True):
            for pieces in self._matches(text):
                held.append((own, pieces))
                size += len(pieces)
                if size >= self.together:
                    self._settle(held)
                    held, size = [], 0
        self._settle(held)
        return [own[0] if len(own) == 1 else b"".join(own) for own in out]

    def _matches(self, text: str) -> Iterator[list[str]]:
        """A text's matches, from left to right; those of a long text part by part."""
        if len(text) < 4 * self.together:
            yield self.pattern.findall(text)
            return
        found = self.pattern.finditer(text)
        while part := [m[0] for m in islice(found, self.together)]:
            yield part

    def _settle(self, held: list[tuple[list[bytes], list[str]]]) -> None:
        """Append the ids of each list of matches to the list beside it."""
        known, long, waits, size = self.known, [], [], 0
        used = set().union(*(pieces for _, pieces in held))
        missing = used.difference(known)
        for p in used.difference(missing):
            known[p] = known.pop(p)  # in order of last use
        for p in missing:
            raw = p.encode()
            if (whole := self.ranks.get(raw)) is not None:
                known[p] = whole.to_bytes(4, "little")
            else:
                waits.append((p, raw))
                size += len(raw)
                if size > 2 * self.together:
                    known.update(zip([w[0] for w in waits], self.merge([w[1] for w in waits]), strict=True))
                    waits, size = [], 0
            if len(p) > 64:
                long.append(p)
        if waits:
            known.update(zip([w[0] for w in waits], self.merge([w[1] for w in waits]), strict=True))
        for own, pieces in held:
            own.append(b"".join(map(known.__getitem__, pieces)))
        for p in long:
            del known[p]
        short = missing.difference(long)
        self.held += 160 * len(short) + 4 * sum(map(len, short))  # about what the entries take
        if self.held > self.keep:
            gone = []
            for p in known:
                if self.held <= self.keep * 7 // 8:
                    break
                self.held -= 160 + 4 * len(p)
                gone.append(p)
            for p in gone:
                del known[p]

    def decode(self, ids: bytes) -> bytes:
        return self.decode_all([ids])[0]

    def decode_all(self, coded: list[bytes]) -> list[bytes]:
        """The bytes that each one's ids stand for."""
        out, held, size = [], [], 0
        for ids in coded:
            held.append(ids)
            size += len(ids)
            if size > 4 * self.together:
                out += self._joined(held)
                held, size = [], 0
        return out + self._joined(held)

    def _joined(self, coded: list[bytes]) -> list[bytes]:
        first = [0, *accumulate(len(ids) // 4 for ids in coded)]
        flat = np.frombuffer(b"".join(coded), "<u4")
        out = []
        for at in range(0, max(1, len(flat)), self.together):  # a long text's part by part
            ids = flat[at : at + self.together]
            size = self.sizes[ids]
            ends = np.cumsum(size)
            out.append(self.letters[np.repeat(self.starts[ids] - ends + size, size) + np.arange(int(size.sum()))])
        raw = np.concatenate(out).tobytes()
        ends = np.concatenate([[0], np.cumsum(self.sizes[flat])])[first].tolist()
        return [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]


@lru_cache(maxsize=2)
def bpe(path: str, pattern: str) -> ByteBPE:
    """One for each Python worker: the vocabulary is read where it is used."""
    return ByteBPE(path, pattern)


def _mapped(docs: DataFrame, column: str, kind, out: tuple[str, ...], f) -> DataFrame:
    """docs with a column replaced by binary ones: f makes of a list of values a list for each."""
    keep = [c for c in docs.columns if c not in (column, *out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, column, 1_000_000):
            made = f(batch.column(column).cast(kind).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(x, pa.binary()) for x in made)], names=[*keep, *out])

    schema = docs.select(*keep).schema
    for name in out:
        schema = schema.add(name, "binary")
    return docs.select(*keep, column).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the text replaced by its ids, a binary column of little-endian unsigned 32-bit integers.

    Null and empty texts have no ids.  Rows are taken one by one, so ties, repeated rows and empty tables need no rule;
    other columns are kept, but one already named like `ids` is replaced.  Texts are encoded whole; a task holds
    about a MB of them, or one text if that is longer, with 100,000 of its matches at a time.
    """
    return _mapped(docs, text, pa.string(), (ids,), lambda xs: [bpe(path, pattern).encode([x or "" for x in xs])])


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """The inverse of encode(): ids replaced by the bytes they stand for.  Null ids give no bytes."""
    return _mapped(docs, ids, pa.binary(), (text,), lambda xs: [bpe(path, pattern).decode_all([x or b"" for x in xs])])


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """encode(), and beside the ids what they decode to, by one Python worker a task instead of two."""

    def both(texts: list[str | None]) -> list[list[bytes]]:
        own = bpe(path, pattern)
        found = own.encode([x or "" for x in texts])
        return [found, own.decode_all(found)]

    return _mapped(docs, text, pa.string(), (ids, decoded), both)
