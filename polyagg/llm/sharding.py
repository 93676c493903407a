"""Shards by jump consistent hashing: DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Steps that are folded for every row; a key that needs more takes the second fold.
SHORT = 64


def _step(n: int) -> str:
    """One step on s(b, j, hi, lo): the 64-bit generator key * 2862933555777941757 + 1 in halves of 32 bits.

    Products are taken by 16-bit pieces of the factor (its halves are 0x27BB2EE6 and 0x87B0B0FD), so that no
    BIGINT overflows, which ANSI mode would refuse.
    """
    a0, a1, b0, b1 = 0xB0FD, 0x87B0, 0x2EE6, 0x27BB
    low = f"(s.lo * {a0} + shiftleft(s.lo * {a1} & 65535, 16) + 1)"
    lo = f"({low} & 4294967295)"
    hi = (
        f"((s.hi * {a0} + shiftleft(s.hi * {a1} & 65535, 16) + s.lo * {b0} + shiftleft(s.lo * {b1} & 65535, 16)"
        f" + shiftright({low}, 32) + shiftright(s.lo * {a1}, 16)) & 4294967295)"
    )
    jump = f"CAST(floor((s.j + 1) * (2147483648D / (shiftright({hi}, 1) + 1))) AS BIGINT)"
    return f"IF(s.j >= {n}, s, named_struct('b', s.j, 'j', {jump}, 'hi', {hi}, 'lo', {lo}))"


def key_halves(key: str) -> tuple[str, str]:
    """SQL for the two 32-bit halves of a key's hash: the first 16 hex digits of the MD5 of its text ('' for null)."""
    md5 = f"md5(CAST(coalesce(CAST({key} AS STRING), '') AS BINARY))"
    return tuple(f"CAST(conv(substr({md5}, {at}, 8), 16, 10) AS BIGINT)" for at in (1, 9))


def jump_shard(hi: str, lo: str, shards: int) -> Column:
    """The shard, 0 to shards - 1, of the 64-bit key hi * 2^32 + lo.

    Each step raises j, so `shards` steps always end it; nearly all keys end after about ln(shards), so the fold over
    the steps beyond SHORT is evaluated for the others only.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    start = f"named_struct('b', -1L, 'j', 0L, 'hi', {hi}, 'lo', {lo})"
    first = f"aggregate(sequence(1, {min(SHORT, shards)}), {start}, (s, i) -> {_step(shards)})"
    if shards > SHORT:
        rest = f"aggregate(sequence({SHORT + 1}, {shards}), x, (s, i) -> {_step(shards)})"
        first = f"transform(array({first}), x -> IF(x.j >= {shards}, x, {rest}))[0]"
    return F.expr(f"CAST(({first}).b AS INT)")


def numbered(df: DataFrame, group: str, order: list[str], spread: Column, out: str, rows_per_bucket: int = 2048) -> DataFrame:
    """Number the rows of each group from 0, without gaps, by (spread, order), with no group in one task.

    spread: a hash in [0, 2^32) cuts each group into ranges; each range is numbered on its own and shifted by the
    count of the ranges before it.  Only those counts, one row a range, meet per group.
    """
    buckets = min(65536, max(1, math.ceil(df.count() / rows_per_bucket)))
    cut = df.withColumn("_spread", spread).withColumn("_bucket", F.shiftright(F.col("_spread") * F.lit(buckets), 32))
    before = (
        cut.groupBy(F.col(group).alias("_group"), F.col("_bucket").alias("_b")).agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_before", F.sum("_rows").over(Window.partitionBy("_group").orderBy("_b")) - F.col("_rows"))
    )
    place = F.row_number().over(Window.partitionBy(group, "_bucket").orderBy("_spread", *order))
    return (
        cut.withColumn("_place", place)
        .join(before, (F.col(group) == F.col("_group")) & (F.col("_bucket") == F.col("_b")))
        .withColumn(out, (F.col("_before") + F.col("_place") - 1).cast("long"))
        .drop("_group", "_b", "_rows", "_before", "_place", "_bucket", "_spread")
    )


def shard_documents(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's shard under the law `key`, its place in the shard, and its shard were there one more.

    Key and shard count alone decide the shard, so equal keys share one, and appending a shard moves about 1 in
    shards + 1 keys, all of them into the new one.  A null key counts as the text '', a null text as empty (size 1,
    checksum 0); repeated rows each get a slot of their own, and ties in slot order go by key, checksum and size, so
    only equal rows are interchangeable.  An empty table gives an empty result.  Columns other than key and text are
    not carried, whatever their names.
    """
    hi, lo = key_halves("doc_id")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
    ).withColumns({"_hi": F.expr(hi), "_lo": F.expr(lo)})
    rows = rows.withColumns({
        "law": F.lit("key"),
        "shard": jump_shard("_hi", "_lo", shards),
        "grown_shard": jump_shard("_hi", "_lo", shards + 1),
    })
    placed = numbered(rows, "shard", ["_lo", "doc_id", "text_crc32", "size"], F.col("_hi"), "slot")
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
