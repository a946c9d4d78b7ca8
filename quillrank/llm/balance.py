"""Packing into near-equal windows by Karmarkar-Karp multiway differencing.

Each task takes its texts in blocks of ``WINDOWS`` windows' worth of ids.  ``differencing`` deals a
block's pieces to windows: every piece starts as a partial partition of its own, and the two with
the largest imbalance are merged again and again, the fullest window of one onto the emptiest of
the other, until one partition with near-equal windows is left.  Where a window exceeds the
capacity, the window count rises: ``windows`` differences anew with more windows until all fit.

Documents may be cut, so ``level`` spares most of that rise: the ids by which a window exceeds
the capacity are cut from its largest piece and fill the windows that have room.  A block is
closed, by a cut, as soon as it holds just as many ids as its windows; these then all end full.
Only a task's last block can't fill whole windows: its window count rises by windows whose lengths
are powers of two, which need no padding either.

A block is at most ``WINDOWS`` times ``CAPACITY`` ids and what a task holds beside its Arrow batch;
texts are not shuffled, and a task that runs again packs the same rows in the same way.

Defined results: a null or empty text is the one id 1; rows that repeat an id are packed each;
a null id keeps its pieces under null; an empty table gives no pieces; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import table, text_of

CAPACITY = 2048
#: Windows that are balanced together.
WINDOWS = 64
#: The id that closes a document.
CLOSE = 1


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Positions of ``sizes`` in k groups with near-equal sums, by Karmarkar and Karp's differencing."""
    # A partial partition: its sums above 0, largest first, and for each the tree of what is in it.
    heap = [(-n, i, [n], [i]) for i, n in enumerate(sizes)] if k > 1 else [(0, 0, [sum(sizes)], [list(range(len(sizes)))])]
    heapq.heapify(heap)
    made = len(sizes)
    while len(heap) > 1:
        _, _, sums, trees = heapq.heappop(heap)
        _, _, sums_b, trees_b = heapq.heappop(heap)
        shared = len(sums) + len(sums_b) - k  # windows that both have something in
        joined = list(zip(sums, trees)) + list(zip(sums_b, trees_b))
        if shared > 0:
            own = len(sums) - shared
            # The smallest sums of the one meet the largest of the other, in opposite order.
            both = [(sums[own + i] + sums_b[len(sums_b) - 1 - i], (trees[own + i], trees_b[len(sums_b) - 1 - i])) for i in range(shared)]
            joined = list(zip(sums[:own], trees[:own])) + both + list(zip(sums_b[: len(sums_b) - shared], trees_b[: len(sums_b) - shared]))
        joined.sort(key=lambda x: -x[0])
        sums, trees = [s for s, _ in joined], [t for _, t in joined]
        heapq.heappush(heap, (-(sums[0] - (sums[-1] if len(sums) == k else 0)), made, sums, trees))
        made += 1
    groups = [_leaves(t) for t in heap[0][3]] if heap else []
    return groups + [[] for _ in range(k - len(groups))]


def _leaves(tree) -> list[int]:
    out, todo = [], [tree]
    while todo:
        node = todo.pop()
        if isinstance(node, int):
            out.append(node)
        else:
            todo += node
    return sorted(out)


def windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Whole pieces of at most ``capacity`` in near-equal windows; the window count rises until none exceeds the capacity."""
    k = max(1, -(-sum(sizes) // capacity)) if sizes else 0
    while True:
        groups = differencing(sizes, k) if k else []
        excess = sum(max(0, sum(sizes[i] for i in g) - capacity) for g in groups)
        if not excess:
            return [g for g in groups if g]
        k += -(-excess // capacity)


Piece = tuple[int, int, int]  # text, start, length


def level(groups: list[list[Piece]], capacity: int) -> list[list[Piece]]:
    """Cut what exceeds the capacity from the largest pieces of a window and fill windows that have room; what none has room for opens new ones."""
    over: list[Piece] = []
    for group in groups:
        excess = sum(p[2] for p in group) - capacity
        while excess > 0:
            text, start, length = piece = max(group, key=lambda p: p[2])
            cut = min(excess, length)
            group.remove(piece)
            if length > cut:
                group.append((text, start, length - cut))
            over.append((text, start + length - cut, cut))
            excess -= cut
    over.sort(key=lambda p: p[2])
    rooms = sorted(((capacity - sum(p[2] for p in g), i) for i, g in enumerate(groups)), reverse=True)
    for room, i in rooms:
        while room and over:
            text, start, length = over.pop()
            taken = min(room, length)
            groups[i].append((text, start, taken))
            if length > taken:
                over.append((text, start + taken, length - taken))
            room -= taken
    left = sum(p[2] for p in over)
    if left:
        groups = groups + split(over, [min(capacity, left - a) for a in range(0, left, capacity)])
    return [g for g in groups if g]


def split(pieces: list[Piece], lengths: list[int]) -> list[list[Piece]]:
    """Pieces, one after the other, cut to windows of exactly these lengths."""
    out, todo = [], list(reversed(pieces))
    for room in lengths:
        out.append([])
        while room and todo:
            text, start, length = todo.pop()
            taken = min(room, length)
            out[-1].append((text, start, taken))
            if length > taken:
                todo.append((text, start + taken, length - taken))
            room -= taken
    return out


def powers(n: int) -> list[int]:
    """The powers of two that add up to n, largest first."""
    return [1 << b for b in reversed(range(n.bit_length())) if n >> b & 1]


def _grouped(pieces: list[Piece], groups: list[list[int]]) -> list[list[Piece]]:
    return [[pieces[i] for i in g] for g in groups]


def balance(pieces: list[Piece], capacity: int, cut: bool) -> list[list[Piece]]:
    """Windows of a block's pieces, each of at most ``capacity``."""
    sizes = [p[2] for p in pieces]
    if not cut:
        return _grouped(pieces, windows(sizes, capacity))
    k, rest = divmod(sum(sizes), capacity)
    tail: list[Piece] = []
    while rest and pieces:  # a last block: its odd ids go to windows of powers of two
        text, start, length = pieces.pop()
        taken = min(rest, length)
        tail.append((text, start + length - taken, taken))
        if length > taken:
            pieces.append((text, start, length - taken))
        rest -= taken
    tail.reverse()
    full = level(_grouped(pieces, differencing([p[2] for p in pieces], k)), capacity) if k else []
    return full + split(tail, powers(sum(p[2] for p in tail)))


class Packer:
    """Packs one task's texts block by block."""

    def __init__(self, capacity: int, block: int, cut: bool):
        self.capacity, self.limit, self.cut = capacity, block * capacity, cut
        self.made = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        self.texts: list[tuple[object, int, int, np.ndarray]] = []  # id, ids in all, where what is held starts, what is held
        self.open: list[Piece] = []
        self.size = 0
        self.rows: list[tuple] = []

    def add(self, doc, ids: np.ndarray) -> None:
        """Take in one text's ids; windows that it fills by itself go out at once."""
        n = len(ids)
        whole = n - n % self.capacity
        for start in range(0, whole, self.capacity):
            self._row(doc, n, start, ids[start : start + self.capacity], 0)
            self.made += 1
        if whole == n:
            return
        held = (doc, n, whole, ids[whole:].copy())
        start, length = whole, n - whole
        if self.cut and self.size + length >= self.limit:
            here = self.limit - self.size
            self.open.append((len(self.texts), start, here))
            self.texts.append(held)
            self._close()
            start, length = start + here, length - here
        elif self.size + length > self.limit:
            self._close()
        if length:
            self.open.append((len(self.texts), start, length))
            self.texts.append(held)
            self.size += length

    def _close(self) -> None:
        for window in balance(self.open, self.capacity, self.cut):
            at = 0
            for text, start, length in window:
                doc, n, base, ids = self.texts[text]
                self._row(doc, n, start, ids[start - base : start - base + length], at)
                at += length
            self.made += 1
        self.open, self.texts, self.size = [], [], 0

    def _row(self, doc, n: int, start: int, ids: np.ndarray, at: int) -> None:
        self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), n, self.made, at))

    def taken(self, end: bool = False) -> list[tuple]:
        """Rows that are ready; at the end, all."""
        if end and self.open:
            self._close()
        rows, self.rows = self.rows, []
        return rows


def _pack_batches(batches: Iterator[pa.RecordBatch], capacity: int, block: int, cut: bool, paths: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    packer, kind = Packer(capacity, block, cut), None

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *[pa.array(c, pa.int64()) for c in columns[1:]]], names)

    for batch in batches:
        kind = batch.schema.field(0).type
        for doc, text in zip(batch.column(0), batch.column(1)):
            packer.add(doc.as_py(), np.append(tokens.encode(text.as_py(), paths), np.uint32(CLOSE)).astype("<u4", copy=False))
            if len(packer.rows) >= 20_000:
                yield out(packer.taken())
    if rows := packer.taken(end=True):
        yield out(rows)


def pack_balanced(
    docs: DataFrame, capacity: int = CAPACITY, block: int = WINDOWS, cut: bool = True, paths: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces of all documents and their places; without ``cut`` only documents over the capacity are cut."""
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    work = partial(_pack_batches, capacity=capacity, block=block, cut=cut, paths=paths or tokens.vocabulary_paths())
    return src.mapInArrow(work, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")


def padding(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: sequences, ids, and the padding that fills sequences to the capacity, none where a length is a power of two."""
    n = F.sum("length")
    each = packed.groupBy("sequence_id").agg(n.alias("n"))
    exact = F.bit_count("n") == 1
    return each.agg(F.count("*").alias("sequences"), F.sum("n").alias("ids"), F.sum(F.when(exact, 0).otherwise(capacity - F.col("n"))).alias("padding"))


def op12_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids."""
    return pack_balanced(table(spark, sf_dir, "documents"))
