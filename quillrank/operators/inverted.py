"""A stored inverted index for BM25, read only where a query's terms are.

Chunks are numbered by segment and place: a segment has up to ``SEGMENT`` chunks of one task.
Below the index's path lie

* ``segments``: for each segment its chunks' ids, text hashes and lengths,
* ``postings``: for each term and segment the places that have the term, ascending, how often, and
  how many they are; cut into ``BUCKETS`` folders by a hash of the term, by the task that read the chunks.
  Places and counts are bytes of whole numbers, so Spark moves a row's lists as they are,
* ``terms``: for each batch the document frequency of each term, in the same buckets,
* ``manifest``: one row for each batch of chunks that was added, with the version of the source,
  the corpus' size and the mean idf after it.  It is written last: a batch without it doesn't exist.

``refresh`` does nothing if the source's version is the manifest's.  Else chunks are compared by id
and text hash: new ones are added as a batch of their own, and only a changed or vanished one
has the index built anew.  One writer at a time.

``search`` reads the buckets of its terms (``PartitionFilters`` in the plan), joins their rows with the
queries' weights, gathers them by segment and adds up a segment's scores in arrays.  A task
hands on the k best of a query, so neither scored pairs nor texts are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import exists, remove
from . import lexical

SEGMENT = 4096
#: Words after which a segment is closed, so that a task's memory doesn't follow the texts' lengths.
WORDS = 4_000_000
BUCKETS = 32
#: A term is scored by a matrix product if its pairs of a query and a chunk are this fraction of all pairs; so many terms at once.
WIDE, TERMS = 64, 256
#: Queries that are scored at once; a task holds a number for each of them and each chunk of a segment.
QUERIES = 2048

_MANIFEST = "batch int, version string, n bigint, words bigint, mean double"
_HEAD = "ids array<string>, hashes array<bigint>, lengths array<int>"
_SEGMENTS = f"segment bigint, {_HEAD}"
_POSTINGS = "term string, segment bigint, n int, places array<int>, counts array<int>"
#: As they are stored: places take two bytes each and counts four, least first.
_STORED = _POSTINGS.replace("array<int>", "binary")
#: Where a batch's segments lie among its postings until they have their own folder.
_HEADS = -1


def bucket(term: str | Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


class Index:
    """A stored index below ``path``; build or bring it up to date with ``refresh``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, table: str, schema: str) -> DataFrame:
        last = self.state()["batch"]
        return self.spark.read.schema(schema).parquet(f"{self.path}/{table}").where(F.col("batch") <= last)

    def state(self):
        """The last batch's row of the manifest, or None."""
        if not exists(self.spark, f"{self.path}/manifest"):
            return None
        return self.spark.read.schema(_MANIFEST).json(f"{self.path}/manifest/*").orderBy(F.desc("batch")).first()

    def segments(self) -> DataFrame:
        return self._read("segments", f"{_SEGMENTS}, batch int")

    def postings(self) -> DataFrame:
        return self._read("postings", f"{_STORED}, batch int, bucket int")

    def terms(self) -> DataFrame:
        return self._read("terms", "term string, df bigint, batch int, bucket int")

    def refresh(self, chunks: DataFrame, version: str | None = None, id_col: str = "node_id", text_col: str = "full_text") -> int:
        """Bring the index up to date with all chunks; gives the number of chunks that were read into it."""
        src = chunks.select(F.col(id_col).alias("node_id"), T.text(F.col(text_col)).alias("text")).withColumn("h", F.xxhash64("text"))
        last = self.state()
        if last is not None and version is not None and last["version"] == version:
            return 0
        if last is not None:
            own = self.segments().select(F.explode(F.arrays_zip("ids", "hashes")).alias("x")).select(F.col("x.ids").alias("node_id"), F.col("x.hashes").alias("h"))
            if own.join(src.select("node_id", "h"), ["node_id", "h"], "left_anti").isEmpty():
                return self._add(src.join(own, ["node_id", "h"], "left_anti"), last["batch"] + 1, version)
            remove(self.spark, self.path)
        return self._add(src, 0, version)

    def _add(self, src: DataFrame, batch: int, version: str | None) -> int:
        # A task packs its own chunks and writes them as they are: a row is one term of one segment, so no shuffle is needed
        # to part a term of all chunks.  Segments and postings are two parts of what it wrote, so they agree.
        path = f"{self.path}/postings/batch={batch}"
        rows = src.select("node_id", "h", F.lower("text").alias("text"))
        packed = rows.mapInArrow(partial(_pack_texts, first=batch << 48), f"{_STORED}, {_HEAD}")
        own = F.when(F.col("term").isNull(), _HEADS).otherwise(bucket("term")).alias("bucket")
        packed.select("*", own).write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(path)
        written = self.spark.read.schema(f"{_STORED}, {_HEAD}, bucket int").option("basePath", path)
        heads = written.parquet(path).where(F.col("bucket") == _HEADS)
        heads.select("segment", "ids", "hashes", "lengths").write.mode("overwrite").parquet(f"{self.path}/segments/batch={batch}")
        remove(self.spark, f"{path}/bucket={_HEADS}")
        made = written.parquet(path)
        df = made.groupBy("bucket", "term").agg(F.sum("n").alias("df"))
        df.repartitionByRange("bucket", "term").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/terms/batch={batch}")
        here = self.spark.read.schema(_SEGMENTS).parquet(f"{self.path}/segments/batch={batch}")
        added = here.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)), F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x)), F.lit(0))).first()
        before = self.state() if batch else None
        n, words = added[0] + (before["n"] if before else 0), added[1] + (before["words"] if before else 0)
        every = self.spark.read.schema("term string, df bigint, batch int, bucket int").parquet(f"{self.path}/terms").where(F.col("batch") <= batch)
        mean = every.groupBy("term").agg(F.sum("df").alias("df")).agg(F.sum(_raw(n)) / F.count("*")).first()[0]
        state = self.spark.createDataFrame([(batch, version, n, words, float(mean or 0.0))], _MANIFEST)
        state.write.mode("overwrite").json(f"{self.path}/manifest/{batch}")
        return added[0]

    def statistics(self) -> DataFrame:
        """term, df and idf of the whole corpus."""
        state = self.state()
        return self.terms().groupBy("term").agg(F.sum("df").alias("df")).select("term", "df", _idf(state).alias("idf"))

    def weights(self, queries: DataFrame) -> tuple[DataFrame, list[int], int, object]:
        """((block, term, queries, weights) rows, the buckets they are in, the number of blocks, how to send them)."""
        state = self.state()
        words = queries.agg(F.sum(F.size(T.tokens(F.col("query")))), F.count("*")).first()
        sent = F.broadcast if (words[0] or 0) <= lexical.MAX_TERMS else lambda df: df
        asked = lexical.query_terms(queries)
        buckets = sorted(r[0] for r in asked.select(bucket("term")).distinct().collect())  # ``BUCKETS`` at most
        df = self.terms().where(F.col("bucket").isin(buckets)).join(sent(asked.select("term").distinct()), "term").groupBy("term").agg(F.sum("df").alias("df"))
        weighed = asked.join(df, "term").select("query_id", "term", (F.col("qtf") * _idf(state)).alias("weight"))
        blocks = max(1, -(-words[1] // QUERIES))
        block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")
        grouped = weighed.groupBy(block, "term").agg(F.collect_list(F.struct("query_id", "weight")).alias("x"))
        return grouped.select("block", "term", F.col("x.query_id").alias("queries"), F.col("x.weight").alias("weights")), buckets, blocks, sent

    def search(self, queries: DataFrame, k: int | None = None, positive: bool = False) -> DataFrame:
        """(query_id, node_id, score) of the pairs that share a term, of each query's k best at least; scores have 6 digits.

        Query ids are plain values; with ``k`` only the k best of each task are given, to be ranked by
        ``lexical.top_k``.  ``positive`` leaves scores of 0 and less out before that.
        """
        state = self.state()
        asked, buckets, n, sent = self.weights(queries)
        kind = queries.schema["query_id"].dataType.simpleString()
        found = self.postings().where(F.col("bucket").isin(buckets)).select("term", "segment", "places", "counts").join(sent(asked), "term")
        none = lambda t: F.lit(None).cast(t)
        rows = found.select("segment", "block", "places", "counts", "queries", "weights", none("array<string>").alias("ids"), none("array<int>").alias("lengths"))
        blocks = self.spark.range(n).select(F.col("id").cast("int").alias("block"))
        heads = self.segments().select("segment", "ids", "lengths").join(F.broadcast(blocks), F.lit(True))  # a row for each block of queries
        heads = heads.select("segment", "block", none("binary").alias("places"), none("binary").alias("counts"), none(f"array<{kind}>").alias("queries"), none("array<double>").alias("weights"), "ids", "lengths")
        dealt = heads.unionByName(rows).repartition("segment", "block").sortWithinPartitions("segment", "block", F.asc(F.col("ids").isNull()))
        average = state["words"] / state["n"] if state["n"] else 0.0
        work = partial(_score, average=average, k=k, positive=positive)
        return dealt.mapInArrow(work, f"query_id {kind}, node_id string, score double")


def _pack(batches: Iterator[pa.RecordBatch], first: int, most: int = WORDS) -> Iterator[pa.RecordBatch]:
    """(node_id, hash, tokens) rows to segments: one row of its chunks without a term, then a row for each term."""
    number = first + (TaskContext.get().partitionId() << 24)
    held: list[pa.RecordBatch] = []
    chunks = words = 0
    for batch in batches:
        ends, at = np.cumsum(_lengths(batch.column(2)), dtype=np.int64), 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            fit = int(np.searchsorted(ends, before + most - words, "right"))
            to = min(max(fit, at if held else at + 1), at + SEGMENT - chunks)
            if to > at:
                held.append(batch.slice(at, to - at))
                chunks, words, at = chunks + to - at, words + int(ends[to - 1]) - before, to
            if at < batch.num_rows or chunks == SEGMENT:  # no more fits
                yield from _segment(held, number)
                held, chunks, words, number = [], 0, 0, number + 1
    if held:
        yield from _segment(held, number)


def _pack_texts(batches: Iterator[pa.RecordBatch], first: int) -> Iterator[pa.RecordBatch]:
    """(node_id, hash, text in lower case) rows to segments as they are stored."""

    def cut() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for words in T.words(batch.column(2).cast(pa.string())):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(words)), batch.column(1).slice(at, len(words)), words], ["node_id", "h", "tokens"])
                at += len(words)

    for batch in _pack(cut(), first):
        yield pa.RecordBatch.from_arrays([_bytes(c, "<u2" if name == "places" else "<i4") if name in ("places", "counts") else c for name, c in zip(batch.schema.names, batch.columns)], batch.schema.names)


def _bytes(lists: pa.Array, kind: str) -> pa.Array:
    """Each list's numbers as bytes; no list is empty bytes."""
    ends = np.concatenate([np.zeros(1, np.int32), np.cumsum(np.maximum(_lengths(lists.fill_null([])), 0), dtype=np.int32)])
    values = lists.flatten().to_numpy().astype(kind)
    return pa.BinaryArray.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends * values.itemsize), pa.py_buffer(values)])


def _numbers(column: pa.Array, kind: str) -> list[np.ndarray]:
    """The numbers of each row of such bytes."""
    data = column.buffers()[2] or b""
    width = np.dtype(kind).itemsize
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    return [np.frombuffer(data, kind, (b - a) // width, a) if b > a else np.zeros(0, kind) for a, b in zip(ends, ends[1:])]


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int32)


def _segment(held: list[pa.RecordBatch], number: int) -> Iterator[pa.RecordBatch]:
    """A segment's words are numbered by their first place and counted by a sort of (word, place) keys; no object is made for a word."""
    names = ["term", "segment", "n", "places", "counts", "ids", "hashes", "lengths"]
    none = lambda n, kind: pa.nulls(n, pa.list_(kind))
    one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(kind))
    column = lambda i: pa.concat_arrays([b.column(i) for b in held])
    lengths = np.concatenate([_lengths(b.column(2)) for b in held])
    head = [pa.array([None], pa.string()), pa.array([number], pa.int64()), pa.nulls(1, pa.int32()), none(1, pa.int32()), none(1, pa.int32()), one(column(0), pa.string()), one(column(1), pa.int64()), one(pa.array(lengths), pa.int32())]
    yield pa.RecordBatch.from_arrays(head, names)
    coded = pa.concat_arrays([b.column(2).flatten() for b in held]).dictionary_encode()
    n, size = len(coded.dictionary), len(lengths)
    keys = coded.indices.to_numpy().astype(np.int64) * size + np.repeat(np.arange(size), lengths)
    keys, count = np.unique(keys, return_counts=True)  # places ascend within a term
    ends = np.searchsorted(keys, np.arange(n + 1) * size).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (keys % size, count)]
    rows = [coded.dictionary.cast(pa.string()), pa.array(np.full(n, number)), pa.array(np.diff(ends)), *lists, none(n, pa.string()), none(n, pa.int64()), none(n, pa.int32())]
    whole = pa.RecordBatch.from_arrays(rows, names)
    for i in range(0, n, 20_000):
        yield whole.slice(i, 20_000)


def _raw(n: int) -> Column:
    return F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def _idf(state) -> Column:
    raw = _raw(state["n"])
    return F.when(raw < 0, lexical.EPSILON * state["mean"]).otherwise(raw)


def _score(batches: Iterator[pa.RecordBatch], average: float, k: int | None, positive: bool) -> Iterator[pa.RecordBatch]:
    """A segment's chunks come first, then the rows of its terms."""
    best: dict = {}
    rows: list = []
    key = ids = norm = kind = None

    def done() -> Iterator[pa.RecordBatch]:
        out_q, out_n, out_s = [], [], []
        asked, total, met = _totals(rows, norm, not positive) if rows else ([], [], None)
        for i, query in enumerate(asked):
            value = np.round(total[i], 6)
            had = best.get(query, [])
            if positive:  # once k are found, only what may be among them
                at = np.flatnonzero(value >= -had[-1][0] if k is not None and len(had) == k else value > 0)
            else:
                at = np.flatnonzero(met[i])
            value = value[at]
            if k is None:
                out_q += [query] * len(at)
                out_n += [ids[i] for i in at]
                out_s.append(value)
                continue
            if len(at) > k:  # ties with the last one stay until ids decide
                least = np.partition(value, len(value) - k)[len(value) - k]
                at, value = at[value >= least], value[value >= least]
            if len(at):
                best[query] = sorted(had + [(-v, ids[i]) for i, v in zip(at, value.tolist())])[:k]
        if out_q:
            yield pa.RecordBatch.from_arrays([pa.array(out_q, kind), pa.array(out_n), pa.array(np.concatenate(out_s))], ["query_id", "node_id", "score"])

    for batch in batches:
        kind = batch.schema.field(4).type.value_type
        columns = [_numbers(c, "<u2") if i == 2 else _numbers(c, "<i4") if i == 3 else c if i in (5, 7) else c.to_pylist() for i, c in enumerate(batch.columns)]
        for segment, block, places, counts, queries, weights, own, lengths in zip(*columns):
            if (segment, block) != key:
                yield from done()
                key, ids, rows = (segment, block), own, []
                norm = lexical.K1 * (1 - lexical.B + lexical.B * lengths.values.to_numpy() / average)
            else:
                rows.append((places, counts, queries, weights.values.to_numpy()))
    yield from done()
    found = [(query, node, -minus) for query, nodes in best.items() for minus, node in nodes]
    if found:
        q, n, s = zip(*found)
        yield pa.RecordBatch.from_arrays([pa.array(q, kind), pa.array(n), pa.array(s, pa.float64())], ["query_id", "node_id", "score"])


def _totals(rows: list, norm: np.ndarray, marked: bool) -> tuple[list, np.ndarray, np.ndarray | None]:
    """(queries, their scores of a segment's chunks, which of them share a term) of (places, counts, queries, weights) rows.

    A term of many chunks and queries is a row of a matrix product; others are added place by place.
    """
    asked = list(dict.fromkeys(q for _, _, queries, _ in rows for q in queries))
    number = {q: i for i, q in enumerate(asked)}
    total = np.zeros((len(asked), len(norm)))
    met = np.zeros(total.shape, bool) if marked else None
    wide = []
    for at, tf, queries, weights in rows:
        own = [number[q] for q in queries]
        if marked:
            met[np.ix_(own, at)] = True
        part = tf * (lexical.K1 + 1) / (tf + norm[at])
        if len(own) * len(at) * WIDE >= total.size:
            wide.append((at, part, own, weights))
            if len(wide) == TERMS:
                _multiply(wide, total)
                wide = []
            continue
        for i, weight in zip(own, weights.tolist()):
            total[i][at] += weight * part
    _multiply(wide, total)
    return asked, total, met


def _multiply(wide: list, total: np.ndarray) -> None:
    terms, weighed = np.zeros((len(wide), total.shape[1])), np.zeros((total.shape[0], len(wide)))
    for j, (at, part, own, weights) in enumerate(wide):
        terms[j, at] = part
        weighed[own, j] = weights
    for i in range(0, len(total), TERMS):
        total[i : i + TERMS] += weighed[i : i + TERMS] @ terms
