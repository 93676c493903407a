"""Filters on points: typed comparisons, joined by AND."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARE = {
    "=": lambda a, b: a == b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}

#: A bucket of time, in seconds, of the coarse time filter and the store's layout: ten days.
BUCKET = 864_000


def conjunction(filters: Iterable[tuple[str, str, object]]) -> Column:
    """All of (column, comparison, constant); none at all is true.  A null never matches."""
    return reduce(lambda a, b: a & b, (COMPARE[op](F.col(c), F.lit(v)) for c, op, v in filters), F.lit(True))


def preset(n: int) -> list[tuple[str, str, object]]:
    """The first n of the customary filters on taxi trips; the fourth comes only with all four."""
    fixed = [("passengers", "=", 1), ("fare", ">", 1000), ("miles", "<", 10.0), ("duration", ">", 20)]
    if not 0 <= n <= len(fixed):
        raise ValueError("0 to 4 filters")
    return fixed[:n]


def time_range(start: int, end: int, column: str = "t", coarse: bool = False) -> Column:
    """start <= t <= end; coarse: all of the buckets of ten days that these two fall into, and those between."""
    t = F.col(column)
    return F.floor(t / BUCKET).between(start // BUCKET, end // BUCKET) if coarse else t.between(start, end)
