"""SimHash near-duplicates by a self-join of binary tries.

A document's fingerprint has 64 bits; two link when at most three differ.  All distinct
fingerprints form binary tries, one bit a level.  The join walks pairs of nodes together, adds
up the bits in which their paths differ, and gives a pair up as soon as there are more than
three.

So that the walk spreads over a cluster, the trie is kept in four rotations of the bits.  Three
differing bits leave at least one of four 16-bit blocks untouched, so in the rotation that
starts with this block the pair meets below one node of depth 16.  Subtrees of depth 16 are
therefore joined with themselves only, each in one task; a subtree of more than ``SPLIT``
fingerprints is dealt once more by the same rule over its remaining 48 bits, in four blocks of
12.  Each task gives back one link for a fingerprint at most, to the smallest member of its
class there, so a group of near copies never becomes all its pairs.  Classes then meet by
distributed connected components.

Defined results: a null text is empty; a text without words has fingerprint zero; equal and
repeated rows share a class; a null id never becomes a class id while the class has another
id; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, materialize, table, text_of
from .components import components

DISTANCE = 3
SHINGLE = 3
#: Fingerprints below one node beyond which the subtree is dealt again.
SPLIT = 50_000
#: Node pairs that are walked at once; the others wait on a stack.
FRONT = 1_000_000

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def hashes(text: bytes, k: int) -> list[int]:
    """XXH64 values of all k-word shingles of a UTF-8 text, of the whole text if it has fewer words."""
    words = text.translate(LOWER).split()  # bytes.split() takes the same six white-space bytes
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= k:
        return [xxhash.xxh64_intdigest(joined, 42)]
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    return [xxhash.xxh64_intdigest(joined[a : b - 1], 42) for a, b in zip(starts, starts[k:])]


def majority(found: Sequence[int]) -> int:
    """The bits that are set in over half of the values, as a signed 64-bit number."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), 65_536):
        part = np.asarray(found[at : at + 65_536], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found), bitorder="little").view("<i8")[0])


def fingerprint(text: bytes, k: int = SHINGLE) -> int:
    """The fingerprint of one UTF-8 text: the majority over all its k-word shingles, repeats included."""
    return majority(hashes(text, k))


def _print_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        found = pa.array([fingerprint(t.as_py()) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], found], ["id", *batch.schema.names[2:], "print"])


def prints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed: bool = False) -> DataFrame:
    """(id, print) for each row; with ``hashed`` (id, h, print), where h is a hash of the text."""
    src = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))
    src = src.withColumn("h", F.xxhash64("text")) if hashed else src
    return src.mapInArrow(_print_batches, f"id {src.schema['id'].dataType.simpleString()}, {'h bigint, ' * hashed}print bigint")


class _Classes:
    """Smallest known member of each row's class, over rows 0 .. n-1."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, u: np.ndarray, v: np.ndarray) -> None:
        while len(u):
            a, b = self.label[u], self.label[v]
            open_ = a != b
            u, v, low, high = u[open_], v[open_], np.minimum(a, b)[open_], np.maximum(a, b)[open_]
            np.minimum.at(self.label, high, low)
            while True:
                up = self.label[self.label]
                if np.array_equal(up, self.label):
                    break
                self.label = up


def walk(codes: np.ndarray, lo: np.ndarray, hi: np.ndarray, bits: int) -> np.ndarray:
    """Class labels of ``codes`` (sorted, distinct within each root) under links of at most DISTANCE bits.

    ``lo`` and ``hi`` bound the roots: subtrees whose codes agree above the lowest ``bits`` bits.
    A stack entry is (bit, node pairs); a node is a range of ``codes``.
    """
    classes = _Classes(len(codes))
    stack = [(bits - 1, lo, hi, lo.copy(), hi.copy(), np.zeros(len(lo), np.int8))]
    upto = {}
    while stack:
        bit, alo, ahi, blo, bhi, diff = stack.pop()
        if len(alo) > FRONT:
            cut = len(alo) // 2
            stack += [(bit, *(x[s] for x in (alo, ahi, blo, bhi, diff))) for s in (slice(cut, None), slice(cut))]
            continue
        # What is one class already needs no more links: a pair of nodes within it is done.
        turns = np.concatenate(([0], np.cumsum(classes.label[1:] != classes.label[:-1])))
        one = (turns[alo] == turns[ahi - 1]) & (turns[blo] == turns[bhi - 1]) & (classes.label[alo] == classes.label[blo])
        leaf = (ahi - alo == 1) & (bhi - blo == 1) & ~one
        if leaf.any():
            a, b = alo[leaf], blo[leaf]
            near = np.bitwise_count(codes[a] ^ codes[b]) <= DISTANCE
            classes.link(a[near], b[near])
        more = ~(leaf | one)
        if bit < 0 or not more.any():
            continue
        alo, ahi, blo, bhi, diff = (x[more] for x in (alo, ahi, blo, bhi, diff))
        if bit not in upto:
            upto[bit] = np.concatenate(([0], np.cumsum((codes >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)))
        ones = upto[bit]
        amid, bmid = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo])
        self_ = alo == blo
        cross = np.concatenate
        pairs = [
            (alo, amid, blo, bmid, diff, ...),
            (amid, ahi, bmid, bhi, diff, ...),
            (alo, amid, bmid, bhi, diff + 1, ...),
            (amid, ahi, blo, bmid, diff + 1, ~self_),
        ]
        parts = [[x[m] for x in row[:5]] for *row, m in ((*p[:5], p[5]) for p in pairs)]
        alo, ahi, blo, bhi, diff = (cross([p[i] for p in parts]) for i in range(5))
        live = (alo < ahi) & (blo < bhi) & (diff <= DISTANCE)
        stack.append((bit - 1, *(x[live] for x in (alo, ahi, blo, bhi, diff))))
    return classes.label


def _join_roots(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Joins the subtrees of one partition; rows come sorted by root, then code."""

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for bits, part in rows.groupby("bits", sort=False):
            codes = part["code"].to_numpy().view(np.uint64)
            root = part["root"].to_numpy()
            lo = np.flatnonzero(np.concatenate(([True], root[1:] != root[:-1])))
            hi = np.append(lo[1:], len(root))
            label = walk(codes, lo, hi, int(bits))
            own = np.flatnonzero(label != np.arange(len(label)))
            plain = part["print"].to_numpy()
            out.append(pd.DataFrame({"a": plain[own], "b": plain[label[own]]}))
        return pd.concat(out)

    held = None
    for frame in frames:
        held = frame if held is None else pd.concat([held, frame], ignore_index=True)
        if len(held) < 4 * SPLIT:
            continue
        cut = int(np.searchsorted(held["root"].to_numpy(), held["root"].iloc[-1]))  # the last root may go on
        if cut:
            yield joined(held.iloc[:cut].reset_index(drop=True))
            held = held.iloc[cut:].reset_index(drop=True)
    if held is not None and len(held):
        yield joined(held)


def _rotations(value, width: int, step: int, n: int):
    """``value`` (its lowest ``width`` bits) rotated left by each of 0, step, .. bits."""
    low = lambda c, b: c.bitwiseAND(F.lit((1 << b) - 1 if b < 64 else -1))
    return [low(F.shiftleft(value, i * step), width).bitwiseOR(low(F.shiftrightunsigned(low(value, width), width - i * step), i * step)) if i else low(value, width) for i in range(n)]


def links(distinct: DataFrame) -> DataFrame:
    """Distinct ``print`` values become (a, b) rows that connect each class within distance."""
    p = F.col("print")
    first = distinct.select("print", F.posexplode(F.array(*_rotations(p, 64, 16, 4))).alias("turn", "code"))
    # The root's number: the turn and the block that all codes below the root share.
    first = first.select("print", "code", (F.shiftrightunsigned("code", 48) + F.col("turn") * 65_536).alias("root"))
    hot = first.groupBy("root").count().where(F.col("count") > SPLIT).select("root", F.lit(True).alias("hot"))
    first = first.join(hot, "root", "left")
    cool = first.where("hot is null").select("print", "code", "root", F.lit(48).alias("bits"))
    c = F.col("code")
    again = first.where("hot").select("print", "root", F.posexplode(F.array(*_rotations(c, 48, 12, 4))).alias("turn2", "code"))
    again = again.select("print", "code", (((F.col("root") * 4 + F.col("turn2")) * 4096) + F.shiftrightunsigned("code", 36) + (1 << 40)).alias("root"), F.lit(36).alias("bits"))
    dealt = cool.union(again).repartition("root").sortWithinPartitions("root", "code")
    return dealt.mapInPandas(_join_roots, "a bigint, b bigint")


def classes(printed: DataFrame, link: Callable[[DataFrame], DataFrame] = links) -> DataFrame:
    """(id, print) rows get a class_id, the smallest id reachable over links, and the class's smallest print, root.

    ``link`` turns the distinct prints into (a, b) rows.
    """
    by_print = materialize(printed.groupBy("print").agg(F.min("id").alias("first")), "prints")
    found = components(link(by_print.select("print")))
    members = by_print.join(found, F.col("print") == F.col("node")).select("print", "first", "component")
    least = members.groupBy("component").agg(F.min("first").alias("least"))
    moved = members.join(least, "component").select("print", "component", "least")
    place = by_print.join(moved, "print", "left").select("print", F.coalesce("least", "first").alias("class_id"), F.coalesce("component", "print").alias("root"))
    return printed.join(place, "print").select(*printed.columns, "class_id", "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed: bool = False) -> DataFrame:
    """(id, print, class_id, root), with ``hashed`` also h, for each row of ``docs``; texts are read once."""
    return classes(materialize(prints(docs, id_col, text_col, hashed), "simhash"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", find: Callable[..., DataFrame] | None = None) -> DataFrame:
    """One row of each class: that of the smallest id; of several texts of this id, that of the smallest hash.

    A row is known by its id and a hash of its text, so only exact repeats of a kept row are folded.
    ``find`` gives (id, h, class_id, root) of each row.
    """
    found = find(docs, id_col, text_col) if find else near_duplicates(docs, id_col, text_col, hashed=True)
    first = found.where(F.col("id").eqNullSafe(F.col("class_id"))).groupBy("root", "id", "h").count()
    chosen = materialize(first.groupBy("root").agg(F.min_by(F.struct("id", "h", "count"), "h").alias("row")).select("row.*"), "kept")
    # Both sides are dealt by id and hash at every size: the list of kept rows grows with the documents.
    key, text_hash = F.col(f"`{id_col}`"), F.xxhash64(text_of(text_col))
    kept_id, kept_h = fresh(docs, "_kept_id"), fresh(docs, "_kept_h")
    keys = chosen.select(F.col("id").alias(kept_id), F.col("h").alias(kept_h)).hint("merge")
    kept = docs.join(keys, key.eqNullSafe(F.col(kept_id)) & (text_hash == F.col(kept_h)), "left_semi")
    if not chosen.where("count > 1").isEmpty():  # repeated rows: take one of each
        src = kept.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), key.alias("id"), text_hash.alias("h"))
        kept = src.groupBy("id", "h").agg(F.any_value("row").alias("row")).select(*[F.col("row")[c].alias(c) for c in docs.columns])
    return kept


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), F.col("class_id").alias("component_id"))
