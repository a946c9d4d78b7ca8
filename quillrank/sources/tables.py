"""The given tables as the engine's chunk, query and session tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import extract, graph
from ..operators.inverted import Index
from ..operators.sizing import bounded
from .shared import exists, home, version


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks: a node, its document (the source), chapter (the language) and text."""
    docs = load(spark, sf_dir, "documents")
    return docs.select(
        F.concat(F.lit("node:"), F.col("doc_id").cast("string")).alias("node_id"),
        "doc_id",
        F.col("source").alias("canonical"),
        F.col("lang").alias("chapter"),
        T.title(F.lit(""), F.col("text")).alias("name"),
        T.text(F.col("text")).alias("full_text"),
    )


#: Ids of a document's chunks that are numbered together.
SPAN = 100_000


def numbered(chunks_: DataFrame) -> DataFrame:
    """Chunks with an article number: their place within the document.

    Chunks are numbered within ranges of ids, and the counts of the ranges before are added, so no task gets a whole document.
    """
    span = F.floor(F.col("doc_id") / SPAN)
    counts = chunks_.groupBy("canonical", span.alias("span")).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("canonical").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(F.col("canonical").alias("_canonical"), F.col("span").alias("_span"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    own = Window.partitionBy("canonical", "_span").orderBy("doc_id")
    met = chunks_.join(bounded(before), F.col("canonical").eqNullSafe(F.col("_canonical")) & (span == F.col("_span")))
    return met.withColumn("article", (F.row_number().over(own) + F.col("_before")).cast("int")).drop("_canonical", "_span", "_before")


#: The stated set of query vectors: those whose id is divisible by this.
EVERY = 50


def query_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark items as queries, each with its whole text."""
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated set of vectors as queries, numbered from 0 in the order of their ids."""
    asked = load(spark, sf_dir, "embeddings").where(F.col("vec_id") % EVERY == 0)
    return asked.select((F.col("vec_id") / EVERY).cast("bigint").alias("query_id"), F.col("embedding").alias("query"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("node:"), F.col("vec_id").cast("string")).alias("node_id"), "embedding", "label")


def _named(spark: SparkSession, sf_dir: str, stem: str) -> str:
    return f"{home(spark, stem)}-{hashlib.md5(sf_dir.encode()).hexdigest()[:12]}"


def stored(spark: SparkSession, sf_dir: str, name: str, source: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that is made from a given one: written once for each version of its source, and read from then on."""
    path = f"{_named(spark, sf_dir, name)}/{version(load(spark, sf_dir, source))}"
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def lexical_index(spark: SparkSession, sf_dir: str) -> Index:
    """The stored inverted index of all chunks, brought up to date with the table's files."""
    found = Index(spark, _named(spark, sf_dir, "bm25"))
    found.refresh(chunks(spark, sf_dir), version(load(spark, sf_dir, "documents")))
    return found


def graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model's answers for all chunks: (node_id, ord, entities, relations)."""
    return stored(spark, sf_dir, "graphs", "documents", lambda: extract.answers(chunks(spark, sf_dir).withColumn("ord", F.col("doc_id"))))


def node_index(spark: SparkSession, sf_dir: str) -> Index:
    """The stored inverted index of the whole graph's nodes by their search texts."""
    rows = extract.entity_rows(graphs(spark, sf_dir))
    found = Index(spark, _named(spark, sf_dir, "nodes"))
    found.refresh(graph.nodes(extract.entities(rows), chunks(spark, sf_dir)), version(load(spark, sf_dir, "documents")), text_col="search_text")
    return found


def intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an understanding model would say of each benchmark item, by rules that stand in for it.

    The item's lines are its sub-queries and its first words the topic; by its id it names no
    document, one, two (one of them twice) or an unknown one.
    """
    c, i = F.col, F.col("query_id")
    src = lambda n: F.concat(F.lit("src"), F.pmod(i + n, F.lit(20)).cast("string"))
    asked = query_texts(spark, sf_dir).withColumn("query", T.text(c("query"))).withColumn("w", F.split("query", " "))
    none = F.array().cast("array<string>")
    return asked.select(
        "query_id", "query",
        F.when(i % 4 == 0, none).when(i % 4 == 1, F.array(src(0))).when(i % 4 == 2, F.array(src(0), src(7), src(0))).otherwise(F.array(F.lit("no such document"))).alias("documents"),
        F.when(i % 5 == 1, (i % 30 + 1).cast("string")).alias("article_hint"),
        F.filter(F.split("query", "\n"), lambda x: x != "").alias("sub_queries"),
        F.array_join(F.slice("w", 1, 3), " ").alias("topic"),
        F.slice(F.filter(F.split(F.lower("query"), " "), lambda x: F.length(x) >= 8), 1, 2).alias("keywords"),
        F.slice("w", 4, 4).alias("check_aspects"), F.slice("w", 1, 1).alias("procedure_keywords"),
        F.get("w", F.lit(1)).alias("term"), (i % 2 == 0).alias("expand_search"),
    )
