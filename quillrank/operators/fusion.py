"""Rank fusion, document votes, ordered unions and slot selection."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF = 60


def rrf(lists: DataFrame) -> DataFrame:
    """(query_id, list_id, rank from 0, node_id) rows become query_id, node_id, rrf and rank."""
    fused = lists.groupBy("query_id", "node_id").agg(F.round(F.sum(1.0 / (RRF + F.col("rank") + 1)), 9).alias("rrf"))
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf"), "node_id")
    return fused.withColumn("rank", (F.row_number().over(order) - 1).cast("bigint"))


def document_vote(fused: DataFrame) -> DataFrame:
    """(query_id, document, rrf, rank) rows become a score for each document."""
    votes = fused.groupBy("query_id", "document").agg(F.count("*").alias("n"), F.sum("rrf").alias("total"), F.max("rrf").alias("best"), F.min("rank").alias("first"))
    score = F.col("best") + 0.3 * F.log1p(F.col("n").cast("double")) * (F.col("total") / F.col("n"))
    return votes.select("query_id", "document", "n", F.round("best", 9).alias("best"), F.round(score, 9).alias("rank_score"), "first")


def targets_first(ranked: DataFrame, targets: DataFrame) -> DataFrame:
    """Put each target before all others in turn, so the last one leads; (query_id, document, rank) and (query_id, document, ord)."""
    both = ranked.join(targets, ["query_id", "document"], "full")
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("ord"), F.asc_nulls_last("rank"), "document")
    return both.select("query_id", "document", (F.row_number().over(order) - 1).cast("bigint").alias("place"))


def balanced_slots(scored: DataFrame, min_per_doc: int, total: int) -> DataFrame:
    """Each document's best ``min_per_doc`` first, then the best of the rest, ``total`` in all."""
    within = Window.partitionBy("query_id", "document").orderBy(F.desc("score"), "node_id")
    over = Window.partitionBy("query_id").orderBy("overflow", F.desc("score"), "node_id")
    slotted = scored.withColumn("overflow", (F.row_number().over(within) > min_per_doc).cast("int"))
    return slotted.withColumn("place", (F.row_number().over(over) - 1).cast("bigint")).where(F.col("place") < total)


def ordered_union(lists: DataFrame, key: str) -> DataFrame:
    """(query_id, list_id, rank, key) rows in list order, each key once where it comes first."""
    first = Window.partitionBy("query_id", key).orderBy("list_id", "rank")
    order = Window.partitionBy("query_id").orderBy("list_id", "rank")
    once = lists.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return once.withColumn("place", (F.row_number().over(order) - 1).cast("bigint"))


def mmr(candidates: DataFrame, k: int | Column, weight: float = 0.7) -> DataFrame:
    """Greedy choice of relevant and unlike texts; (query_id, node_id, score, text) rows, a bounded list for each query.

    ``k`` is a number or a column of the query's rows.
    """

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(frame.itertuples(index=False), key=lambda r: (-r.score, r.node_id))
        words = {r.node_id: set(r.text.lower().split()) for r in rows}
        near = dict.fromkeys(words, 0.0)
        out: list = []
        most = rows[0].k
        while rows and len(out) < most:
            best = min(rows, key=lambda r: (-(weight * r.score - (1 - weight) * near[r.node_id]) if out else -r.score, r.node_id))
            rows.remove(best)
            for r in rows:
                a, b = words[r.node_id], words[best.node_id]
                near[r.node_id] = max(near[r.node_id], len(a & b) / max(1, len(a | b)))
            out.append((best.query_id, best.node_id, best.score, len(out)))
        return pd.DataFrame(out, columns=["query_id", "node_id", "score", "place"])

    src = candidates.select("query_id", "node_id", "score", "text", (F.lit(k) if isinstance(k, int) else k).alias("k"))
    return src.groupBy("query_id").applyInPandas(pick, f"query_id {src.schema['query_id'].dataType.simpleString()}, node_id string, score double, place bigint")


def prompt_budget(rows: DataFrame, most: int = 3, limit: int = 25_000, shrink: int = 10_000) -> DataFrame:
    """(query_id, canonical, first, large, small): of a query's ``most`` first documents those whose tables of contents fit.

    One takes its large form while less than ``shrink`` characters are used, else its small one; one that
    doesn't fit is passed over, but the first is always taken.
    """
    order = Window.partitionBy("query_id").orderBy("first")
    ranked = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)

    def step(a, x):
        size = F.when(a["used"] < shrink, x["large"]).otherwise(x["small"])
        fits = (F.size(a["documents"]) == 0) | (a["used"] + size <= limit)
        return F.when(fits, F.struct((a["used"] + size).alias("used"), F.concat(a["documents"], F.array(x["canonical"])).alias("documents"))).otherwise(a)

    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<string>").alias("documents"))
    taken = F.aggregate(F.sort_array(F.collect_list(F.struct("place", "canonical", "large", "small"))), start, step)
    return ranked.groupBy("query_id").agg(taken.alias("t")).select("query_id", "t.documents", "t.used")


def budget_skip(rows: DataFrame, limit: int) -> DataFrame:
    """(query_id, place, size): what a budget takes when it passes over what doesn't fit, but always takes the first."""
    fold = F.aggregate(
        F.sort_array(F.collect_list(F.struct("place", "size"))),
        F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<bigint>").alias("taken")),
        lambda a, x: F.when((F.size(a["taken"]) > 0) & (a["used"] + x["size"] > limit), a).otherwise(
            F.struct((a["used"] + x["size"]).alias("used"), F.concat(a["taken"], F.array(x["place"])).alias("taken"))
        ),
        lambda a: a["taken"],
    )
    return rows.groupBy("query_id").agg(fold.alias("taken")).select("query_id", F.explode("taken").alias("place"))
