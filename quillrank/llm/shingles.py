"""The pipeline's near copies: five-word shingle sets of likeness 0.8 or more, checked exactly.

Two texts link when the Jaccard likeness of their sets of ``SHINGLE``-word shingles is at least
``LEAST``.  Texts of one set are one ``print``.

The trie self-join of SimHash (``simhash.links``) gives the first candidates, over SimHash values of
the same five-word shingles: a star for each class of values within three bits.  At likeness 0.8
two values are ten bits apart on average, which no trie with a useful budget finds.  So each print
has ``BANDS`` bands of ``ROWS`` min-hashes too, and prints that share a band are candidates: a pair of
likeness j shares none with probability (1 - j**ROWS) ** BANDS, which is 3e-5 at 0.8 and falls from
there.  This is all that can be missed.

Every candidate is checked exactly, and a group of near copies never becomes all its pairs.
First the stars of the trie are checked, and each print against the smallest print of each of its
bands.  Then the prints of a band that are not of one class yet are dealt to cells of at most two
blocks of ``BLOCK`` prints.  A cell compares its prints by products of incidence matrices and gives
back the links that span its classes, at most one for a print.

Defined results: words and letter case are those of SimHash; a null text is empty; texts without
words share a print; a text of fewer words than a shingle is one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import materialize, text_of
from .components import components
from .simhash import classes, hashes, keep_one, majority

SHINGLE = 5
#: Least likeness of a link, as a fraction so that the check is one of whole numbers.
LEAST = (4, 5)
BANDS, ROWS = 20, 4
#: Pairs of one print for each copy of its set; prints of several copies whose list is broadcast, 16 bytes each.
HOT, LISTED = 5_000, 100_000
#: Prints, and shingles, that a block of a cell holds on average; shingles that one matrix has as columns.
BLOCK, BLOCK_SHINGLES, COLUMNS = 1_024, 2_000_000, 8_192

_DRAW = np.random.default_rng(11)
_XOR = _DRAW.integers(0, 2**64, (BANDS * ROWS, 1), np.uint64)
_TIMES = _DRAW.integers(0, 2**64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)


def shingle_set(text: bytes, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct XXH64 values of the k-word shingles of a UTF-8 text."""
    return np.unique(np.array(hashes(text, k), np.uint64))


def bands(shingles: np.ndarray) -> np.ndarray:
    """One number for each band of min-hashes, none for an empty set."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 2048):
        mixed = (shingles[None, at : at + 2048] ^ _XOR) * _TIMES
        mixed ^= mixed >> np.uint64(32)
        least = np.minimum(least, mixed.min(axis=1))
    return np.array([xxhash.xxh64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i) for i in range(BANDS)], np.uint64).view(np.int64)


def _print(shingles: np.ndarray) -> int:
    return int(np.array(xxhash.xxh64_intdigest(shingles.tobytes(), 1), np.uint64).view(np.int64))


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(t.as_py()) for t in batch.column(2).cast(pa.binary())]
        columns = [batch.column(0), batch.column(1), pa.array(map(_print, sets), pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array(map(majority, sets), pa.int64()), pa.array(map(bands, sets), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["id", "h", "print", "n", "simhash", "bands"])


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(t.as_py()).view(np.int64) for t in batch.column(1).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["print", "shingles"])


def _with_set(rows: DataFrame, sets: DataFrame, side: str, pairs: DataFrame) -> DataFrame:
    """``rows`` of ``pairs`` with the set of the print in column ``side``.

    A print of many pairs has a copy of its set for every ``HOT`` of them, and its pairs are dealt to these, so
    neither a set nor its pairs are one task's work.  The list of such prints is counted before it is broadcast.
    """
    own = sets.select(F.col("print").alias(side), F.col("shingles").alias(f"{side}_set"))
    hot = pairs.groupBy(side).count().where(F.col("count") > HOT)
    hot = materialize(hot.select(side, F.ceil(F.col("count") / HOT).cast("int").alias("copies")), "hot")
    small = F.broadcast if hot.count() <= LISTED else lambda df: df
    n = F.coalesce("copies", F.lit(1))
    dealt = rows.join(small(hot), side, "left").withColumn("copy", F.pmod(F.xxhash64("a", "b"), n).cast("int")).drop("copies")
    copies = own.join(small(hot), side, "left").withColumn("copy", F.explode(F.sequence(F.lit(0), n - 1))).drop("copies")
    return dealt.join(copies.hint("merge"), [side, "copy"]).drop("copy")


def sets_of(wanted: DataFrame, sketches: DataFrame, texts: DataFrame) -> DataFrame:
    """(print, shingles) of the distinct prints in ``wanted``, written down."""
    at = sketches.join(wanted, "print", "left_semi").groupBy("print").agg(F.min("h").alias("h"))
    found = texts.join(at, "h").select("print", "text").dropDuplicates(["print"])
    return materialize(found.mapInArrow(_set_batches, "print bigint, shingles array<bigint>"), "sets")


def alike(pairs: DataFrame, sketches: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the distinct (a, b) prints whose likeness is at least ``LEAST``."""
    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("print")).distinct(), sketches, texts)
    both = _with_set(_with_set(pairs.select("a", "b"), sets, "a", pairs), sets, "b", pairs)
    common = F.size(F.array_intersect("a_set", "b_set"))
    return both.where(common * LEAST[1] >= (F.size("a_set") + F.size("b_set") - common) * LEAST[0]).select("a", "b")


def stars(one: DataFrame) -> DataFrame:
    """(a, b) prints whose SimHash values are of one class of the trie: each print and the class's smallest."""
    at = one.groupBy("simhash").agg(F.min("print").alias("first"))
    place = components(simhash.links(at.select(F.col("simhash").alias("print"))))
    members = one.join(place, F.col("simhash") == F.col("node"), "left").select("print", F.coalesce("component", "simhash").alias("class"))
    least = members.groupBy("class").agg(F.min("print").alias("b"), F.count("*").alias("n")).where("n > 1")
    return members.join(least, "class").where("print <> b").select(F.col("print").alias("a"), "b")


def spanning(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """(i, j) that span the classes of sets under links of likeness ``LEAST``; all pairs are compared."""
    n = np.array([len(s) for s in sets])
    ids, count = np.unique(np.concatenate(sets), return_counts=True)
    ids = ids[count > 1]  # others are in no intersection
    common = np.zeros((len(sets), len(sets)), np.float32)  # whole numbers, exact below 2 ** 24
    for at in range(0, len(ids), COLUMNS):
        part = ids[at : at + COLUMNS]
        has = np.zeros((len(sets), len(part)), np.float32)
        for i, s in enumerate(sets):
            own = s[np.searchsorted(s, part[0]) : np.searchsorted(s, part[-1], "right")]
            place = np.searchsorted(part, own)
            has[i, place[part[place] == own]] = 1
        common += has @ has.T
    near = common * LEAST[1] >= (n[:, None] + n[None, :] - common) * LEAST[0]
    out, left = [], np.ones(len(sets), bool)
    for i in range(len(sets)):
        if left[i]:
            left[i], front = False, [i]
            while front:
                k = front.pop()
                met = np.flatnonzero(near[k] & left)
                left[met] = False
                out += [(k, int(j)) for j in met]
                front += met.tolist()
    return out


def _cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of each cell; rows come sorted by cell."""

    def linked(rows: pd.DataFrame) -> list[tuple[int, int]]:
        prints = rows["print"].to_numpy()
        return [(prints[i], prints[j]) for i, j in spanning([np.asarray(s, np.int64).view(np.uint64) for s in rows["shingles"]])]

    held = None
    for frame in frames:
        held = frame if held is None else pd.concat([held, frame], ignore_index=True)
        ends = np.flatnonzero((held[["band", "i", "j"]].to_numpy()[1:] != held[["band", "i", "j"]].to_numpy()[:-1]).any(axis=1)) + 1
        found = [pair for a, b in zip([0, *ends], ends) for pair in linked(held.iloc[a:b])]
        held = held.iloc[ends[-1] if len(ends) else 0 :].reset_index(drop=True)  # the last cell may go on
        yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")
    if held is not None and len(held):
        yield pd.DataFrame(linked(held), columns=["a", "b"], dtype="int64")


def compared(rows: DataFrame, sketches: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) links that span the classes of each band's prints, of (band, print, n, component) rows."""
    size = rows.groupBy("band").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"), F.min("component").alias("low"), F.max("component").alias("high"))
    size = size.where("low <> high").select("band", F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    dealt = materialize(rows.select("band", "print").join(size, "band").withColumn("block", F.pmod(F.xxhash64("print", "band"), "blocks").cast("int")), "dealt")
    sets = sets_of(dealt.select("print").distinct(), sketches, texts)
    # With one block there is one cell; of several, each pair of blocks is a cell.
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda m: m != F.col("block"))))
    cells = dealt.select("band", "print", "block", other.alias("m"))
    cells = cells.select("band", F.least("block", "m").alias("i"), F.greatest("block", "m").alias("j"), "print").join(sets, "print")
    return cells.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").select("band", "i", "j", "print", "shingles").mapInPandas(_cells, "a bigint, b bigint")


def links(sketches: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) rows that connect all candidates of enough likeness."""
    one = materialize(sketches.groupBy("print").agg(F.any_value("n").alias("n"), F.any_value("simhash").alias("simhash"), F.any_value("bands").alias("bands")), "prints")
    member = one.select("print", "n", F.explode("bands").alias("band"))
    shared = member.groupBy("band").agg(F.min("print").alias("low"), F.count("*").alias("members")).where("members > 1").select("band", "low")
    rows = materialize(member.join(shared, "band"), "bands")
    nearest = rows.groupBy(F.col("print").alias("a")).agg(F.collect_set("low").alias("lows"))  # ``BANDS`` at most
    nearest = nearest.select("a", F.explode("lows").alias("b")).where("a <> b")
    first = materialize(stars(one.where("n > 0").select("print", "simhash")).union(nearest).distinct(), "pairs")
    found = materialize(alike(first, sketches, texts), "links")
    place = components(found).select(F.col("node").alias("print"), "component")
    open_ = rows.select("band", "n", "print").join(place, "print", "left").select("band", "print", "n", F.coalesce("component", "print").alias("component"))
    return found.union(compared(open_, sketches, texts))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, print, class_id, root) for each row of ``docs``."""
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text")).select("id", F.xxhash64("text").alias("h"), "text")
    schema = f"id {texts.schema['id'].dataType.simpleString()}, h bigint, print bigint, n bigint, simhash bigint, bands array<bigint>"
    sketches = materialize(texts.mapInArrow(_sketch_batches, schema), "sketches")
    return classes(sketches.select("id", "h", "print"), lambda _: links(sketches, texts.select("h", "text")))


def keep_one_copy(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class of near copies, as ``simhash.keep_one`` chooses it."""
    return keep_one(docs, id_col, text_col, near_copies)
