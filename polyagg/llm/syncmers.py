"""Document fingerprints from closed syncmers: DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A token is a run without white space, of 8 characters at most, so that texts without spaces have tokens too.
TOKEN = r"\\S{1,8}"
#: Tokens in a k-mer; its inner substrings are single tokens.
K = 6


def let(name: str, value: str, body: str) -> str:
    """SQL of body with value bound to name and evaluated once, however often a lambda in body asks for it."""
    return f"transform(array({value}), {name} -> {body})[0]"


def anchors_sql(text: str) -> str:
    """SQL for the closed syncmers of a text: ARRAY<STRUCT<at INT, hash INT>>, by place.

    A k-mer is K tokens in a row; it is an anchor if the smallest hash of a token in it is that of its first or its last.
    Whether it is one depends on its own tokens only, never on what surrounds it.  A text of 1 to K - 1 tokens,
    or one without an anchor, has one anchor, all of it; a text without tokens has none.
    """
    edge = f"least(h[i], h[i + {K - 1}]) <= least({', '.join(f'h[i + {j}]' for j in range(1, K - 1))})"
    mer = f"named_struct('at', i, 'hash', CAST(shiftright(xxhash64({', '.join(f'h[i + {j}]' for j in range(K))}), 32) AS INT))"
    found = f"transform(filter(sequence(0, size(h) - {K}), i -> {edge}), i -> {mer})"
    whole = "array(named_struct('at', 0, 'hash', CAST(shiftright(xxhash64(h), 32) AS INT)))"
    some = f"IF(size(h) < {K}, {whole}, {let('f', found, f'IF(size(f) = 0, {whole}, f)')})"
    none = "CAST(array() AS ARRAY<STRUCT<at: INT, hash: INT>>)"
    hashes = f"transform(regexp_extract_all(coalesce({text}, ''), '{TOKEN}', 0), t -> xxhash64(t))"
    return let("h", hashes, f"IF(size(h) = 0, {none}, {some})")


def sketch_sql(text: str) -> str:
    """SQL for the fingerprint as ARRAY<INT>: the chain of all anchors, by place, each link a hash of two anchors in a row and
    of the tokens between their starts, each different link once.  A text of one anchor has that as its link.

    A link is found in another text only where the same two anchors follow each other at the same distance, so links
    match by position, whatever stands before them.
    """
    link = "CAST(shiftright(xxhash64(a[i - 1].hash, a[i].hash, a[i].at - a[i - 1].at), 32) AS INT)"
    links = f"array_distinct(transform(sequence(1, size(a) - 1), i -> {link}))"
    return let("a", anchors_sql(text), f"IF(size(a) < 2, transform(a, x -> x.hash), {links})")


def anchors(text: str) -> Column:
    return F.expr(anchors_sql(text))


def sketch(text: str) -> Column:
    return F.expr(sketch_sql(text))


def as_text(sketch: str) -> Column:
    return F.expr(f"array_join(transform({sketch}, x -> lpad(hex(x & 4294967295L), 8, '0')), '')")


def likeness(a: str, b: str) -> Column:
    """Of two chains, 0 to 1: the share of their links that both have; 1 for two empty ones."""
    share = f"IF(size({a}) + size({b}) = 0, 1D, n / CAST(size({a}) + size({b}) - n AS DOUBLE))"
    return F.expr(let("n", f"size(array_intersect({a}, {b}))", share))


def with_next(docs: DataFrame, order: str, text: str, carry, rows_per_range: int = 128, most_ranges: int = 65536) -> DataFrame:
    """Each row with the columns of carry(docs) and, as next_<column>, those of the row after it (after the last: the first).

    Rows go by `order` (nulls first), ties by text.  Quantiles of `order` cut the table into ranges; each range is sorted
    on its own and also gets the first row of the range after it, so that text is shuffled once and no task sees the
    whole order.  Only the ranges' bounds, most_ranges numbers at most, come to the driver; larger ranges are sorted with spilling.
    """
    n = docs.count()
    ranges = max(1, min(most_ranges, math.ceil(n / rows_per_range)))
    bounds = docs.agg(F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] if ranges > 1 else []
    bounds = sorted(set(bounds or []))
    top = 1 << max(0, len(bounds).bit_length() - 1)
    steps = [top >> i for i in range(top.bit_length())]
    numbers = f"from_json('{[int(b) for b in bounds]}', 'array<bigint>')"
    at = let("q", numbers, f"aggregate(array({', '.join(map(str, steps))}), 0, (p, s) -> IF(p + s <= {len(bounds)}, IF(q[least(p + s, {max(1, len(bounds))}) - 1] < {order}, p + s, p), p))")
    cut = docs.withColumn("_range", F.expr(f"coalesce({at}, 0)") if bounds else F.lit(0))
    firsts = {r["_range"]: r["_first"] for r in cut.groupBy("_range").agg(F.when(F.count(order) == F.count(F.lit(1)), F.min(order)).alias("_first")).collect()}
    own = sorted(firsts)
    before = {r: own[i - 1] for i, r in enumerate(own)}
    size = max(own, default=0) + 1
    first = f"from_json('{str([firsts.get(r) for r in range(size)]).replace('None', 'null')}', 'array<bigint>')[_range]"
    previous = f"from_json('{[before.get(r, 0) for r in range(size)]}', 'array<int>')[_range]"
    seats = F.expr(f"IF({order} <=> {first}, array(named_struct('r', _range, 'guest', 0), named_struct('r', {previous}, 'guest', 1)), array(named_struct('r', _range, 'guest', 0)))")
    seated = cut.withColumn("_seat", F.explode(seats)).withColumns({"_range": F.col("_seat.r"), "_guest": F.col("_seat.guest")}).drop("_seat")
    dealt = carry(seated.repartition("_range"))
    w = Window.partitionBy("_range").orderBy("_guest", F.asc_nulls_first(order), F.asc_nulls_first(text))
    mine = [c for c in dealt.columns if c not in ("_range", "_guest")]
    return dealt.select("_guest", *mine, *(F.lead(c).over(w).alias(f"next_{c}") for c in mine)).where("_guest = 0").drop("_guest")


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likeness.

    Edited: the last floor(n_chars / 2) code points give way to the first as many (or all) of the next row's text.
    Likeness is that of two chains of anchors, see sketch_sql(); fingerprints grow with their texts (a third of the tokens are
    anchors).  A null text counts as empty; empty texts have the empty fingerprint, which is wholly like itself and not at all like
    any other.  Rows with equal ids go by text, a null id first; repeated rows follow each other.  A table of one row is
    its own next.  Empty tables give no rows; other columns are left out.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = with_next(rows, "doc_id", "text", lambda df: df.withColumn("sketch", sketch("text")))
    n = F.char_length("text")
    cut = both.withColumns({
        "n_chars": n.cast("long"),
        "edited": F.expr("concat(left(text, char_length(text) - char_length(text) div 2), left(next_text, char_length(text) div 2))"),
    })
    cut = cut.withColumn("edited_sketch", sketch("edited"))
    return cut.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text("sketch").alias("fingerprint"), as_text("edited_sketch").alias("edited_fingerprint"),
        likeness("sketch", "edited_sketch").alias("near_edited"), likeness("sketch", "next_sketch").alias("near_next"),
    )
