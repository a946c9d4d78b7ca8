"""Exact inner-product search for batches of query vectors.

Query vectors are counted and go to all tasks as a matrix, ``MAX_QUERIES`` at a time.  A task
multiplies each Arrow batch of vectors with it and keeps the k best of each query as it goes, so no
row is made for a pair and the vectors are never shuffled; only each task's k best are.  Products
are in double precision and rounded to 6 digits before they are ranked.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .lexical import top_k
from .sizing import bounded, meet

MAX_QUERIES = 10_000
#: Vectors of a batch that meet all queries at once, and scores that a worker holds for it.
ROWS, CELLS = 1024, 1 << 20


def scores(vectors: DataFrame, queries: DataFrame, id_col: str = "node_id") -> DataFrame:
    """query_id, node_id and score of every vector for each of a stated set of queries: a row for each pair."""
    pairs = meet(vectors, queries, F.lit(True), MAX_QUERIES)
    return pairs.select("query_id", F.col(id_col).alias("node_id"), F.round(T.dot(F.col("embedding"), F.col("query")), 6).alias("score"))


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _best(batches: Iterator[pa.RecordBatch], sent, k: int) -> Iterator[pa.RecordBatch]:
    """Each query's k best of a task; equal scores by node id."""
    query_ids, queries = sent.value
    best: list[list[tuple]] = [[] for _ in query_ids]
    full = np.full(len(query_ids), -np.inf)  # the k-th best score of each query, once it has k
    width = max(1, min(ROWS, CELLS // len(query_ids)))
    node_kind = None
    for batch in batches:
        node_kind = batch.schema.field(0).type
        for at in range(0, batch.num_rows, width):
            part = batch.slice(at, width)
            names = part.column(0).to_pylist()
            score = queries @ matrix(part.column(1)).T
            np.round(score, 6, out=score)
            # A score below the k-th best of this part or of those before is none of the best; equal ones stay until ids decide.
            for i in np.flatnonzero(np.fmax.reduce(score, axis=1) >= full):
                row = score[i]
                bound = max(full[i], np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -np.inf)
                best[i] = sorted(best[i] + [(-float(row[j]), names[j]) for j in np.flatnonzero(row >= bound)])[:k]
                if len(best[i]) == k:
                    full[i] = -best[i][-1][0]
    rows = [(i, name, -minus) for i, own in enumerate(best) for minus, name in own]
    if rows:
        i, name, score = zip(*rows)
        yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(i)), pa.array(name, node_kind), pa.array(score)], ["query_id", "node_id", "score"])


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, node_id, score, rank): the k best vectors of each query; null vectors are none."""
    spark, schema = vectors.sparkSession, ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for df, c in ((queries, "query_id"), (vectors, "node_id"))) + ", score double"
    asked = queries.select("query_id", "query").where("query is not null")
    n = max(1, -(-asked.count() // MAX_QUERIES))
    block = F.pmod(F.xxhash64("query_id"), F.lit(n))
    src, out = vectors.select("node_id", "embedding").where("embedding is not null"), []
    for i in range(n):  # a block of about ``MAX_QUERIES`` vectors at a time
        own = asked.where(block == i).toArrow().combine_chunks()
        if not own.num_rows:
            continue
        ids, rows = own.column(0).combine_chunks(), own.column(1).combine_chunks()
        sent = spark.sparkContext.broadcast((ids if isinstance(ids, pa.Array) else ids.chunk(0), matrix(rows if isinstance(rows, pa.Array) else rows.chunk(0))))
        out.append(src.mapInArrow(lambda batches, sent=sent: _best(batches, sent, k), schema))
    if not out:
        return spark.createDataFrame([], f"{schema}, rank bigint")
    return top_k(reduce(DataFrame.union, out), k)


def dense_scoped(vectors: DataFrame, queries: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """Only members of the query's document, positive scores only."""
    near = vectors.join(members, "node_id").join(bounded(queries, MAX_QUERIES), "query_id")
    scored = near.select("query_id", "node_id", F.round(T.dot(F.col("embedding"), F.col("query")), 6).alias("score"))
    return top_k(scored.where("score > 0"), k)
