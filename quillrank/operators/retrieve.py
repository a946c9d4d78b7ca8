"""Retrieval flows: compositions of search, expansion, reranking and fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import fusion, graph, lexical
from .inverted import Index
from .sizing import bounded

#: Depths as (times k, plus) for dense and sparse search and for the rerank cut.
STRATEGIES = {
    "single_lookup": ((1, 0), (2, 0), (2, 0)),
    "comparison": ((1, 3), (1, 0), (2, 0)),
    "listing": ((1, 3), (1, 3), (1, 3)),
    "eligibility_check": ((1, 0), (1, 0), (1, 3)),
    "procedure": ((1, 0), (3, 0), (2, 0)),
    "cross_document": ((2, 0), (1, 3), (1, 3)),
    "definition": ((1, 0), (2, 0), (2, 0)),
    "default": ((2, 0), (2, 0), (2, 0)),
}
#: The older flow by query type: dense, sparse, cut and hops.
LEGACY = {"tra_cuu": (1, 2, 2, 1), "so_sanh": (2, 1, 2, 2), "thu_tuc": (1, 1, 2, 1), "other": (2, 1, 2, 1)}


def strategy_depths(spark: SparkSession, k: int) -> DataFrame:
    rows = [(name, k, *[a * k + b for a, b in spec]) for name, spec in STRATEGIES.items()]
    return spark.createDataFrame(rows, "strategy string, k int, dense int, sparse int, cut int")


def sub_query_depth(k: Column, n: Column) -> Column:
    return F.greatest(F.lit(3), F.floor(k / n)).cast("bigint")


def rerank(lists: DataFrame, queries: DataFrame, chunks: DataFrame, n: int | None, scorer=lexical.score_column, cut: int | None = None) -> DataFrame:
    """Score the distinct candidates of each query with an injected scorer and keep the n best."""
    seen = lists.select("query_id", "node_id").where(F.col("node_id").startswith("node:")).distinct()
    body = F.substring("full_text", 1, cut) if cut else F.col("full_text")
    scored = seen.join(bounded(queries), "query_id").join(chunks, "node_id").select("query_id", "node_id", scorer(F.col("query"), body).alias("score"))
    return lexical.top_k(scored, n)


def retrieve_as_docs(lists: DataFrame, queries: DataFrame, chunks: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """Candidates, their neighbours one edge away, the n best of all, as documents."""
    seeds = lists.select("query_id", F.col("node_id").alias("node")).distinct()
    near = graph.expand(seeds, edges, 1).select("query_id", F.col("node").alias("node_id"))
    best = rerank(near, queries, chunks, n, cut=1024)
    crumb = T.breadcrumb(F.col("node_id"), F.col("canonical"), F.col("chapter"), F.col("name"))
    return best.join(chunks, "node_id").select("query_id", F.col("node_id").alias("chunk_id"), "rank", "score", crumb.alias("breadcrumb"))


def sub_searches(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, list_id, query) rows become (query_id, list_id, node_id, rank): each list's k best by the stored index."""
    kind = asked.schema["query_id"].dataType.simpleString()
    one = asked.select(F.concat_ws(":", F.col("query_id").cast("string"), F.col("list_id").cast("string")).alias("query_id"), "query")
    best = lexical.top_k(index.search(one, k, positive=True), k)
    cut = lambda i: F.substring_index("query_id", ":", i)
    whole = F.substr("query_id", F.lit(1), F.length("query_id") - F.length(cut(-1)) - 1)
    return best.select(whole.cast(kind).alias("query_id"), cut(-1).cast("int").alias("list_id"), "node_id", "rank")


def wide(index: Index, asked: DataFrame, main: int = 20, extra: int = 8) -> DataFrame:
    """(query_id, list_id, query): the query itself as list 0 and wider ones, fused by rank."""
    ranked = sub_searches(index, asked, main).where((F.col("list_id") == 0) | (F.col("rank") < extra))
    return fusion.rrf(ranked.select("query_id", "node_id", "rank"))


def dispatch(lists: DataFrame, chosen: DataFrame, queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Each query takes the depths of its strategy; unknown strategies take the default's."""
    depths = strategy_depths(lists.sparkSession, k)
    known = chosen.join(depths.select("strategy", F.lit(True).alias("known")), "strategy", "left").select("query_id", F.when(F.col("known"), F.col("strategy")).otherwise("default").alias("strategy"))
    plan = bounded(known.join(depths, "strategy").select("query_id", "dense", "sparse", "cut"))
    taken = lists.join(plan, "query_id").where(((F.col("list_id") == 0) & (F.col("rank") < F.col("dense"))) | ((F.col("list_id") == 1) & (F.col("rank") < F.col("sparse"))))
    return rerank(taken, queries, chunks, None).join(plan, "query_id").where(F.col("rank") < F.col("cut")).select("query_id", "node_id", "score", "rank")


def legacy(lists: DataFrame, typed: DataFrame, queries: DataFrame, chunks: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """The older flow: (query_id, kind) choose depths and hops; texts are scored whole."""
    rows = [(t, d * k, s * k, c * k, h) for t, (d, s, c, h) in LEGACY.items()]
    depths = lists.sparkSession.createDataFrame(rows, "kind string, dense int, sparse int, cut int, hops int")
    plan = bounded(typed.join(depths, "kind").select("query_id", "dense", "sparse", "cut", "hops"))
    taken = lists.join(plan, "query_id").where(((F.col("list_id") == 0) & (F.col("rank") < F.col("dense"))) | ((F.col("list_id") == 1) & (F.col("rank") < F.col("sparse"))))
    near = graph.expand(taken.select("query_id", F.col("node_id").alias("node")).distinct(), edges, 2).join(plan, "query_id").where(F.col("hop") <= F.col("hops"))
    best = rerank(near.select("query_id", F.col("node").alias("node_id")), queries, chunks, None)
    return best.join(plan, "query_id").where(F.col("rank") < F.col("cut")).select("query_id", "node_id", "score", "rank")


def direct_article(members: DataFrame, number: int) -> DataFrame:
    """Members whose id ends with the article, in either spelling; the first spelling goes first."""
    low = F.lower("node_id")
    tier = F.when(F.endswith(low, F.lit(f"_d{number}")), 0).when(F.endswith(low, F.lit(f":d{number}")), 1)
    hits = members.withColumn("tier", tier).where("tier is not null")
    best = hits.groupBy("canonical").agg(F.min("tier").alias("best"))
    return hits.join(best, "canonical").where("tier = best")


def direct_articles(members: DataFrame, asked: DataFrame) -> DataFrame:
    """For each (query_id, canonical, number): the document's members whose id ends with the article, in either spelling; the first spelling goes first."""
    met = members.join(bounded(asked), "canonical")
    low, number = F.lower("node_id"), F.col("number").cast("string")
    tier = F.when(F.endswith(low, F.concat(F.lit("_d"), number)), 0).when(F.endswith(low, F.concat(F.lit(":d"), number)), 1)
    hits = met.withColumn("tier", tier).where("tier is not null")
    best = hits.groupBy("query_id").agg(F.min("tier").alias("best"))
    return hits.join(best, "query_id").where("tier = best")


def document_chunks(numbered: DataFrame, canonical: str | None = None) -> DataFrame:
    """All chunks of one document, or of each, in article order; a missing number counts as 999."""
    own = numbered if canonical is None else numbered.where(F.col("canonical") == canonical)
    order = Window.partitionBy("canonical").orderBy(F.coalesce("article", F.lit(999)), "node_id")
    return own.select("canonical", "node_id", (F.row_number().over(order) - 1).cast("bigint").alias("place"))


def dominant(found: DataFrame, least: int = 3) -> DataFrame:
    """The document that most results come from, if there are enough of them."""
    counted = found.groupBy("query_id", "canonical").agg(F.count("*").alias("n"), F.min("rank").alias("first"))
    best = counted.groupBy("query_id").agg(F.min_by("canonical", F.struct(-F.col("n"), "first")).alias("canonical"), F.max("n").alias("n"))
    return best.where(F.col("n") >= least)


def full_texts(chunks: DataFrame, order: str) -> DataFrame:
    """Each document's chunks in order, joined by line feeds."""
    texts = F.transform(F.sort_array(F.collect_list(F.struct(order, "full_text"))), lambda x: x["full_text"])
    return chunks.groupBy("canonical").agg(F.array_join(texts, "\n").alias("text"), F.count("*").alias("n"))
