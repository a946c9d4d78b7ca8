"""Document catalog: one entry for each document, filtered by type and year and searched by two rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def build(chunks: DataFrame) -> DataFrame:
    """(file, source, so_hieu, article, full_text, ord) rows become catalog entries in file order."""
    body = F.when(F.col("full_text") != "", F.substring("full_text", 1, 300))
    prio = F.struct((F.col("article") != "1").cast("int").alias("later"), "ord")
    usable = (F.col("full_text") != "") & (F.col("article") != "CAN_CU")
    entry = chunks.where("source <> ''").groupBy("file").agg(
        F.min_by("source", "ord").alias("source"), F.min_by("so_hieu", "ord").alias("so_hieu"), F.coalesce(F.min_by(F.when(usable, body), F.when(usable, prio)), F.lit("")).alias("summary")
    )
    canonical = F.coalesce(F.nullif("so_hieu", F.lit("")), T.first_match(F.col("source"), T.U + T.K.NUMBER), F.col("source"))
    return entry.select("file", "source", "so_hieu", canonical.alias("canonical"), T.doc_type(F.col("source")).alias("doc_type"), T.year(F.col("so_hieu")).alias("year"), "summary")


def metadata_filter(catalog: DataFrame, doc_type: str | None = None, year: str | None = None) -> DataFrame:
    if doc_type:
        catalog = catalog.where(F.lower("doc_type") == doc_type.lower())
    if year:
        catalog = catalog.where(F.col("year") == year)
    return catalog


def search(catalog: DataFrame, dense: DataFrame, sparse: DataFrame, pool: int = 20, show: int = 15) -> DataFrame:
    """Fuse (query_id, id, score) rankings and list what they find in catalog order.

    Ranks count rows that the thresholds then drop.  Fewer than three common documents leave the
    whole filtered catalog.  The list is cut in catalog order, not by rank.
    """
    def ranked(scored: DataFrame, least: float) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return scored.withColumn("rank", F.row_number().over(order) - 1).where((F.col("rank") < 2 * pool) & (F.col("score") > least)).select("query_id", "id", "rank")

    lists = ranked(dense, 0.15).union(ranked(sparse, 0.0))
    fused = lists.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (61 + F.col("rank"))), 9).alias("rrf"))
    best = fused.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rrf"), "id"))).where(F.col("n") <= pool)
    asked = dense.select("query_id").union(sparse.select("query_id")).distinct()
    hit = best.join(catalog.select("id"), "id").select("query_id", "id", F.lit(True).alias("hit"))
    enough = hit.groupBy("query_id").agg(F.count("*").alias("hits"))
    # A batch of queries against the whole (filtered) catalog, which is a table of documents.
    rows = F.broadcast(asked.join(enough, "query_id", "left")).join(catalog, F.lit(True)).join(hit, ["query_id", "id"], "left")
    rows = rows.where((F.coalesce("hits", F.lit(0)) < 3) | F.col("hit"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("ord"))
    return rows.withColumn("place", (place - 1).cast("bigint")).where(F.col("place") < show)
