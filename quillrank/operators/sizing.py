"""Joins whose small side is counted before it is broadcast."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a batch of queries or a rule table that are broadcast at once.
ROWS = 10_000


def bounded(small: DataFrame, rows: int | None = None) -> DataFrame:
    """A side of an equi-join: marked for a broadcast if it has at most ``rows`` rows, else left to a shuffle."""
    rows = ROWS if rows is None else rows
    return F.broadcast(small) if small.limit(rows + 1).count() <= rows else small


def meet(large: DataFrame, small: DataFrame, on: Column, rows: int | None = None) -> DataFrame:
    """Inner join on any condition: ``small`` is counted and broadcast in blocks of about ``rows`` rows.

    Each block meets ``large`` in a scan of its own, so neither side is shuffled or held whole.
    Rows are dealt to blocks by a hash of all their columns.
    """
    rows = ROWS if rows is None else rows
    n = max(1, -(-small.count() // rows))
    block = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in small.columns]), F.lit(n))
    sides = [small.where(block == i) for i in range(n)] if n > 1 else [small]
    return reduce(DataFrame.union, [large.join(F.broadcast(side), on) for side in sides])
