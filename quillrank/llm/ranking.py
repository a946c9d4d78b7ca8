"""Ranked lexical search over a two-level quantised index.

An index covers every document.  Tasks deal their documents to shards of at most ``SHARD``
positions, so postings are never shuffled to be built.  A row holds one term of one shard: the
positions that have it, level one's impact of each as a byte, rounded up in steps of ``STEP``, and
level two's exact frequencies.  The corpus' size and each term's document frequency are one more
table.  Texts with the same words in the same order share a position.

A search reads only the rows of its terms.  Level one gives each (item, position) an upper bound, the
sum of its impacts, and a lower bound, where each impact is one step less.  An item's k-th best
lower bound over the corpus is its threshold; every position whose upper bound reaches it is scored
again from level two in exact integers.  Nothing that could be among the k best is left out, so
there is no other cap.

Items are met in blocks of about ``ITEMS``; a task holds two arrays of ``SHARD`` numbers for each
item of a block.

Defined results: a null or empty text has no terms and isn't found; rows that repeat an id are
documents of their own; a null id is ranked after the others of its score; items that share
an id are one item with all their terms; an item without terms, or an empty table, gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, table

#: Distinct texts of a shard; positions are 16-bit numbers.
SHARD = 8192
#: Documents of a shard at most, copies included.
ROWS = 65_536
#: Impacts are below a million, so 255 steps of this reach over them.
STEP = 3922
#: Items that are searched for at once.
ITEMS = 256
#: Terms that a task counts before it hands their counts on.
COUNTED = 500_000
#: (item, term) rows up to which the terms of the items are broadcast.
ASKED = 500_000

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, digits and all characters beyond ASCII; only A to Z are lower-cased."""
    return (text or b"").translate(_FOLD).split()


def _texts(batch: pa.RecordBatch) -> Iterator[list[bytes]]:
    for value in batch.column(batch.num_columns - 1).cast(pa.binary()):
        yield terms(value.as_py())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df: Counter = Counter()
    n = words = 0

    def out() -> pa.RecordBatch:
        names = pa.array([None, *df], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([names, pa.array([n, *df.values()], pa.int64()), pa.array([words] + [0] * len(df), pa.int64())], ["term", "df", "words"])

    for batch in batches:
        for found in _texts(batch):
            if found:
                df.update(set(found))
                n, words = n + 1, words + len(found)
            if len(df) > COUNTED:
                yield out()
                df.clear()
                n = words = 0
    if n:
        yield out()


class _Shard:
    """One shard while it is gathered."""

    def __init__(self, number: int):
        self.number = number
        self.vocabulary: dict[bytes, int] = {}
        self.where: dict[bytes, int] = {}  # digest of a text's terms -> position
        self.term, self.freq, self.width, self.sizes = [], [], [], []
        self.ids, self.places = [], []

    def add(self, doc, found: list[bytes]) -> None:
        digest = hashlib.blake2b(b" ".join(found), digest_size=16).digest()
        place = self.where.setdefault(digest, len(self.where))
        if place == len(self.sizes):
            counts = Counter(found)
            known = self.vocabulary
            self.term += [known.setdefault(t, len(known)) for t in counts]
            self.freq += counts.values()
            self.width.append(len(counts))
            self.sizes.append(len(found))
        self.ids.append(doc)
        self.places.append(place)

    def full(self) -> bool:
        return len(self.sizes) >= SHARD or len(self.ids) >= ROWS

    def rows(self, n: int, words: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        """The shard's documents as one row without a term, then its terms in order."""
        sizes = np.array(self.sizes, np.int64)
        columns = [pa.array([self.number], pa.int64()), pa.array([None], pa.string()), *[pa.array([None], pa.binary())] * 3,
                   pa.array([sizes.astype("<u4").tobytes()], pa.binary()), pa.array([np.array(self.places, "<u2").tobytes()], pa.binary()), pa.array([self.ids], pa.list_(kind))]
        yield pa.RecordBatch.from_arrays(columns, _NAMES)
        names = sorted(self.vocabulary)
        order = np.empty(len(names), np.int64)
        order[[self.vocabulary[t] for t in names]] = np.arange(len(names))
        term = order[np.array(self.term, np.int64)]
        place, freq = np.repeat(np.arange(len(sizes)), self.width), np.array(self.freq, np.int64)
        by = np.argsort(term, kind="stable")  # positions ascend within a term
        place, freq = place[by], freq[by]
        size = 75 + 25 * sizes * n // words
        impact = impacts(freq, size[place])
        ends = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(names)))])
        for a in range(0, len(names), 20_000):
            b = min(a + 20_000, len(names))
            x, y = ends[a], ends[b]
            blob = lambda v, width: pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(((ends[a : b + 1] - x) * width).astype(np.int32)), pa.py_buffer(v.tobytes())])  # noqa: B023, E731
            levels = [blob(place[x:y].astype("<u2"), 2), blob((-(-impact[x:y] // STEP)).astype(np.uint8), 1), blob(freq[x:y].astype("<u4"), 4)]
            none = [pa.nulls(b - a, pa.binary())] * 2 + [pa.nulls(b - a, pa.list_(kind))]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, self.number)), pa.array(names[a:b], pa.binary()).cast(pa.string()), *levels, *none], _NAMES)


_NAMES = ["shard", "term", "places", "bytes", "freqs", "sizes", "owners", "ids"]


def impacts(freq: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The part of a score that doesn't depend on the term."""
    return 1_000_000_000 * freq // (1000 * freq + 12 * size)


def _shards(batches: Iterator[pa.RecordBatch], n: int, words: int) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 24
    shard, kind = _Shard(number), None
    for batch in batches:
        kind = batch.schema.field(0).type
        for doc, found in zip(batch.column(0), _texts(batch)):
            if found:
                shard.add(doc.as_py(), found)
                if shard.full():
                    yield from shard.rows(n, words, kind)
                    number += 1
                    shard = _Shard(number)
    if shard.ids:
        yield from shard.rows(n, words, kind)


def build(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the index of all documents below ``path``: ``terms`` (a row without a term has the corpus' size) and ``postings``."""
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    counted = src.select("text").mapInArrow(_count, "term string, df bigint, words bigint").groupBy("term").agg(F.sum("df").alias("df"), F.sum("words").alias("words"))
    counted.write.parquet(f"{path}/terms")
    n, words = _corpus(docs.sparkSession, path)
    kind = src.schema["doc_id"].dataType.simpleString()
    schema = f"shard bigint, term string, places binary, bytes binary, freqs binary, sizes binary, owners binary, ids array<{kind}>"
    src.mapInArrow(partial(_shards, n=n, words=words), schema).write.parquet(f"{path}/postings")


def _corpus(spark: SparkSession, path: str) -> tuple[int, int]:
    row = spark.read.parquet(f"{path}/terms").where("term is null").select("df", "words").first()
    return (row[0], row[1]) if row else (0, 1)


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        item, term, times = [], [], []
        for i, found in enumerate(_texts(batch)):
            for t, q in Counter(found).items():
                item.append(i), term.append(t), times.append(q)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(item, pa.int64())), pa.array(term, pa.binary()).cast(pa.string()), pa.array(times, pa.int64())], ["item", "term", "times"])


def query_terms(items: DataFrame, path: str, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(block, term, items, weights): the items that have each term of the corpus and what a full impact of it counts for them."""
    spark = items.sparkSession
    src = items.select(F.col(f"`{id_col}`").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text")).where("item is not null")
    n, _ = _corpus(spark, path)
    rows = src.mapInArrow(_asked, f"item {src.schema['item'].dataType.simpleString()}, term string, times bigint").groupBy("item", "term").agg(F.sum("times").alias("times"))
    small = F.broadcast if rows.limit(ASKED + 1).count() <= ASKED else lambda df: df
    weight = F.floor(1000 * F.log((2 * n + 2) / (2 * F.col("df") + 1).cast("double"))).cast("bigint")
    weighed = spark.read.parquet(f"{path}/terms").join(small(rows), "term").select("item", "term", (weight * F.col("times")).alias("weight")).where("weight > 0")
    blocks = max(1, -(-src.select("item").distinct().count() // ITEMS))
    block = F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int").alias("block")
    grouped = weighed.groupBy(block, "term").agg(F.collect_list(F.struct("item", "weight")).alias("who"))
    return grouped.select("block", "term", F.col("who.item").alias("items"), F.col("who.weight").alias("weights"))


def _bound(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    best: dict = {}  # an item's k best lower bounds in this task so far
    upper: dict = {}
    lower: dict = {}
    key = None

    def done() -> Iterator[pa.RecordBatch]:
        shard, block = key
        found = []
        for item, high in upper.items():
            low = lower[item]
            top = np.concatenate([best.get(item, low[:0]), np.partition(low, max(0, len(low) - k))[-k:]])
            best[item] = top = np.sort(top)[-k:]
            at = np.flatnonzero((high >= (top[0] if len(top) == k else 0)) & (high > 0))
            found.append((item, at, high[at], low[at]))
        if found:
            sizes = [len(at) for _, at, _, _ in found]
            many = sum(sizes)
            items = pa.array([item for item, *_ in found], kind).take(pa.array(np.repeat(np.arange(len(found)), sizes)))
            columns = [pa.array(np.full(many, shard)), pa.array(np.full(many, block, np.int32)), items, *[pa.array(np.concatenate([f[i] for f in found]).astype(t)) for i, t in ((1, np.int32), (2, np.int64), (3, np.int64))]]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "block", "item", "place", "upper", "lower"])

    for batch in batches:
        kind = batch.schema.field(4).type.value_type
        for shard, block, places, steps, items, weights in zip(*[c.to_pylist() for c in batch.columns]):
            if key != (shard, block):
                if key is not None:
                    yield from done()
                key = (shard, block)
                upper.clear(), lower.clear()
            at, step = np.frombuffer(places, "<u2"), np.frombuffer(steps, np.uint8).astype(np.int64)
            less = np.maximum(step - 1, 0)
            for item, weight in zip(items, weights):
                if item not in upper:
                    upper[item], lower[item] = np.zeros(SHARD, np.int64), np.zeros(SHARD, np.int64)
                upper[item][at] += weight * step
                lower[item][at] += weight * less
    if key is not None:
        yield from done()


def bounds(postings: DataFrame, asked: DataFrame, k: int, small=F.broadcast) -> DataFrame:
    """(shard, block, item, place, upper, lower) in steps, from level one, of what may reach an item's threshold."""
    near = postings.where("term is not null").select("shard", "term", "places", "bytes").join(small(asked), "term")
    rows = near.select("shard", "block", "places", "bytes", "items", "weights").repartition("shard", "block").sortWithinPartitions("shard", "block")
    kind = asked.schema["items"].dataType.elementType.simpleString()
    return rows.mapInArrow(partial(_bound, k=k), f"shard bigint, block int, item {kind}, place int, upper bigint, lower bigint")


def candidates(bounded: DataFrame, k: int) -> DataFrame:
    """Every (shard, block, item, place) whose upper bound reaches the item's k-th best lower bound."""
    order = Window.partitionBy("item").orderBy(F.desc("lower"))
    last = bounded.select("item", "lower", F.row_number().over(order).alias("n")).where(F.col("n") <= k).groupBy("item").agg(F.when(F.count("*") == k, F.min("lower")).otherwise(0).alias("threshold"))
    return bounded.join(last, "item").where("upper >= threshold").select("shard", "block", "item", "place")


def _rescore(batches: Iterator[pa.RecordBatch], k: int, n: int, words: int) -> Iterator[pa.RecordBatch]:
    """Rows of a (shard, block) come as its candidates, its documents, its terms."""
    wanted: dict = {}
    scores: dict = {}
    key = size = members = None

    def done() -> list[tuple]:
        if not wanted:
            return []
        ids, owners = members
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0))
        held: dict[int, list] = {}
        needed = {int(p) for at in wanted.values() for p in at}
        for i in order:  # the k smallest ids of a position are enough: its documents tie
            if owners[i] in needed and len(own := held.setdefault(int(owners[i]), [])) < k:
                own.append(ids[i])
        return [(item, doc, int(s)) for item, at in wanted.items() for p, s in zip(at, scores[item]) if s > 0 for doc in held[int(p)]]

    for batch in batches:
        out = []
        kind, doc_kind = batch.schema.field(3).type, batch.schema.field(10).type.value_type
        for shard, block, part, item, at, places, freqs, items, weights, sizes, ids, owners in zip(*[c.to_pylist() for c in batch.columns]):
            if key != (shard, block):
                out += done()
                key = (shard, block)
                wanted, scores = {}, {}
            if part == 0:
                wanted[item] = np.sort(np.array(at, np.int64))
                scores[item] = np.zeros(len(at), np.int64)
            elif not wanted:
                continue
            elif part == 1:
                size = 75 + 25 * np.frombuffer(sizes, "<u4").astype(np.int64) * n // words
                members = ids, np.frombuffer(owners, "<u2")
            else:
                have, freq = np.frombuffer(places, "<u2").astype(np.int64), np.frombuffer(freqs, "<u4").astype(np.int64)
                for item, weight in zip(items, weights):
                    if item in wanted:
                        spots = wanted[item]
                        i = np.minimum(np.searchsorted(have, spots), len(have) - 1)
                        hit = have[i] == spots
                        scores[item][hit] += weight * impacts(freq[i[hit]], size[spots[hit]])
        if out:
            yield _found(out, kind, doc_kind)
    if key is not None and (out := done()):
        yield _found(out, kind, doc_kind)


def _found(rows: list[tuple], kind: pa.DataType, doc_kind: pa.DataType) -> pa.RecordBatch:
    item, doc, score = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(item, kind), pa.array(doc, doc_kind), pa.array(score, pa.int64())], ["item", "doc_id", "score"])


def rescored(postings: DataFrame, asked: DataFrame, chosen: DataFrame, k: int, corpus: tuple[int, int], small=F.broadcast) -> DataFrame:
    """(item, doc_id, score): exact scores of the candidates, from level two of their shards only."""
    item_kind, doc_kind = chosen.schema["item"].dataType.simpleString(), postings.schema["ids"].dataType.elementType.simpleString()
    columns = {
        "shard": "bigint", "block": "int", "part": "int", "item": item_kind, "at": "array<int>", "places": "binary", "freqs": "binary",
        "items": f"array<{item_kind}>", "weights": "array<bigint>", "sizes": "binary", "ids": f"array<{doc_kind}>", "owners": "binary",
    }
    row = lambda df, part: df.select(*[F.lit(part).alias(c) if c == "part" else (F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])
    shards = chosen.select("shard", "block").distinct()
    own = postings.where("term is null").select("shard", "sizes", "ids", "owners").join(shards, "shard")
    level2 = postings.where("term is not null").select("shard", "term", "places", "freqs").join(shards.select("shard").distinct(), "shard", "left_semi").join(small(asked), "term")
    rows = row(chosen.groupBy("shard", "block", "item").agg(F.collect_list("place").alias("at")), 0).union(row(own, 1)).union(row(level2, 2))
    rows = rows.repartition("shard", "block").sortWithinPartitions("shard", "block", "part")
    return rows.mapInArrow(partial(_rescore, k=k, n=corpus[0], words=corpus[1]), f"item {item_kind}, doc_id {doc_kind}, score bigint")


def search(path: str, items: DataFrame, k: int = 20, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents of the index below ``path``."""
    spark = items.sparkSession
    postings, corpus = spark.read.parquet(f"{path}/postings"), _corpus(spark, path)
    stem = new_path(spark, "search")
    query_terms(items, path, id_col, text_col).write.parquet(f"{stem}/asked")
    asked = spark.read.parquet(f"{stem}/asked")
    small = F.broadcast if (asked.agg(F.sum(F.size("items"))).first()[0] or 0) <= ASKED else lambda df: df
    bounds(postings, asked, k, small).write.parquet(f"{stem}/bounds")
    candidates(spark.read.parquet(f"{stem}/bounds"), k).write.parquet(f"{stem}/chosen")
    scored = rescored(postings, asked, spark.read.parquet(f"{stem}/chosen"), k, corpus, small)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias("item_id"), "rank", "doc_id", "score")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for each benchmark item, over an index of all documents."""
    path = new_path(spark, "index")
    build(table(spark, sf_dir, "documents"), path)
    return search(path, table(spark, sf_dir, "benchmark"))


_TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_TERM}) AS t FROM documents),
k AS (SELECT doc_id, row_number() OVER () AS row, t, len(t)::BIGINT AS n FROM d WHERE len(t) > 0),
s AS (SELECT count(*)::BIGINT AS big, sum(n)::BIGINT AS words FROM k),
tf AS (SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(t) AS term FROM k) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * big + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY term, big),
m AS (SELECT row, doc_id, 75 + (25 * n * big) // words AS m FROM k, s),
q AS (SELECT item_id, term, count(*)::BIGINT AS times FROM (SELECT item_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_TERM})) AS term FROM benchmark) GROUP BY ALL),
x AS (SELECT item_id, row, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (row) GROUP BY item_id, row),
r AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM x JOIN m USING (row) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""
