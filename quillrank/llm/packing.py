"""Best-fit packing of token sequences by patterns.

A text's ids, closed by one id 0, go to sequences of at most ``CAPACITY`` ids; only longer texts
are cut.  How often each piece length occurs is a histogram of at most ``CAPACITY`` numbers.
All patterns of two or three lengths that fill a sequence exactly are enumerated; their repeat
counts are fit to the histogram by non-negative least squares and rounded without using any
length more often than it occurs; what is left is packed best fit, longest first, whatever
number of pieces a sequence then takes.  All of this is arithmetic on the histogram, so its cost
and size depend on ``CAPACITY`` and not on the number of texts.

A piece finds its place by its rank among the pieces of its length: counts of each length in
each part of the table, summed over the parts before, and its own count within its part.  No
piece moves for that, and texts are never shuffled.

Defined results: a null or empty text is the one id 0; rows that repeat an id are packed each;
a null id keeps its pieces under null; an empty table gives no pieces; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import materialize, table, text_of

CAPACITY = 2048
ROUNDS = 400


def _piece_batches(batches: Iterator[pa.RecordBatch], capacity: int, paths: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    seen, part = np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
    for batch in batches:
        doc, piece, start, length, crc, rank = [], [], [], [], [], []
        for i, text in enumerate(batch.column(1)):
            ids = np.append(tokens.encode(text.as_py(), paths), np.uint32(0))
            cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                doc.append(i), piece.append(k), start.append(a), length.append(b - a)
                crc.append(zlib.crc32(ids[a:b].tobytes()))
                rank.append(int(seen[b - a]))
                seen[b - a] += 1
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc, rank)], pa.array([part] * len(doc), pa.int32())],
            ["doc_id", "piece", "start", "length", "ids_crc32", "rank", "part"],
        )


def pieces(docs: DataFrame, capacity: int = CAPACITY, paths: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every text, with their rank among those of their length in their part of the table."""
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    cut = partial(_piece_batches, capacity=capacity, paths=paths or tokens.vocabulary_paths())
    return src.mapInArrow(cut, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, rank bigint, part int")


def patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of three ascending lengths that add up to ``capacity``; 0 stands for none, for pairs."""
    have = np.zeros(capacity + 1, bool)
    have[lengths] = have[0] = True
    out = []
    for a in [0, *lengths[lengths <= capacity // 3]]:
        b = np.arange(max(a, 1), (capacity - a) // 2 + 1)
        c = capacity - a - b
        ok = have[b] & have[c]
        out.append(np.column_stack([np.full(ok.sum(), a), b[ok], c[ok]]))
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def fit(histogram: np.ndarray, rows: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Repeat counts x >= 0 that make the patterns' lengths match the histogram by least squares.

    Multiplicative steps x * (A'h) / (A'Ax) lower the squared error and keep x non-negative.
    """
    if not len(rows):
        return np.zeros(0)
    h = histogram.astype(float).copy()
    h[0] = 0.0
    filled = (rows > 0).sum(axis=1)
    x = np.full(len(rows), h.sum() / (len(rows) * filled.mean()))
    aim = h[rows].sum(axis=1)
    for _ in range(rounds):
        made = np.bincount(rows.ravel(), np.repeat(x, 3), minlength=len(h))
        made[0] = 0.0
        x *= aim / np.maximum(made[rows].sum(axis=1), 1e-12)
    return x


def best_fit(histogram: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: (lengths, repeats) that use the histogram up."""
    room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    spaces = np.zeros(capacity + 1, bool)  # which amounts of room there are

    def put(space: int, lengths: tuple[int, ...], n: int) -> None:
        room[space].append((lengths, n))
        spaces[space] = True

    for length in range(capacity, 0, -1):
        left = int(histogram[length])
        while left:
            at = int(np.argmax(spaces[length:])) + length if spaces[length:].any() else 0
            if not at:
                each = capacity // length
                if left >= each:
                    put(capacity - each * length, (length,) * each, left // each)
                if left % each:
                    put(capacity - (left % each) * length, (length,) * (left % each), 1)
                break
            lengths, n = room[at].pop()
            used = min(n, left)
            if n > used:
                room[at].append((lengths, n - used))
            spaces[at] = bool(room[at])
            put(at - length, (*lengths, length), used)
            left -= used
    return [x for group in room.values() for x in group]


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) of every kind of sequence; together they use each length exactly as often as it occurs."""
    left = histogram.astype(np.int64).copy()
    out = [((capacity,), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    rows = patterns(np.flatnonzero(left), capacity)
    # Rounding the running sum keeps the total and spreads what fractions lose.
    repeats = np.diff(np.floor(np.cumsum(fit(left, rows)) + 0.5), prepend=0.0).astype(np.int64)
    for at in np.flatnonzero(repeats):
        lengths = tuple(int(v) for v in rows[at] if v)
        n = min(int(repeats[at]), *(int(left[v]) // lengths.count(v) for v in lengths))
        if n > 0:
            for v in lengths:
                left[v] -= n
            out.append((lengths, n))
    return out + best_fit(left, capacity)


def _places(kinds: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first key, first sequence, offset) of each run of ranks that goes to one slot of a pattern.

    A key is length * 2 ** 40 + rank.
    """
    taken: dict[int, int] = defaultdict(int)
    keys, first, offsets, base = [], [], [], 0
    for lengths, n in kinds:
        at = 0
        for v in lengths:
            keys.append((v << 40) + taken[v])
            first.append(base)
            offsets.append(at)
            taken[v] += n
            at += v
        base += n
    order = np.argsort(np.array(keys, np.int64))
    return tuple(np.array(x, np.int64)[order] for x in (keys, first, offsets))


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to written ``pieces``."""
    spark = cut.sparkSession
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = materialize(counts.select("part", "length", "n", F.coalesce(before, F.lit(0)).alias("before")), "counts")
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # a row for each length
        histogram[length] = n
    # At most three slots for each pattern of two or three lengths, and the residual's few.
    places = spark.sparkContext.broadcast(_places(plan(histogram, capacity)))

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys, first, offsets = places.value
        key = (length.to_numpy(np.int64) << 40) + rank.to_numpy(np.int64)
        at = np.searchsorted(keys, key, "right") - 1
        return pd.DataFrame({"sequence_id": first[at] + key - keys[at], "offset": offsets[at]})

    ranked = cut.join(counts.drop("n"), ["part", "length"])
    placed = ranked.withColumn("place", place("length", F.col("rank") + F.col("before")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, paths: tuple[str, str] | None = None) -> DataFrame:
    """Pieces of all documents and their places."""
    return pack(materialize(pieces(docs, capacity, paths), "pieces"), capacity)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 ids."""
    return pack_documents(table(spark, sf_dir, "documents"))
