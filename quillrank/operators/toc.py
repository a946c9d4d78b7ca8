"""Tables of contents: articles in number order under headings that are printed when they change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from . import lexical
from .sizing import bounded


def lines(articles: DataFrame, snippet: int = 0, distractors: list[str] | None = None) -> DataFrame:
    """(canonical, node_id, chapter, article, name, full_text) rows become ordered lines.

    A chapter heading precedes the first article of each run of one chapter; articles of the
    legal basis stay out.  A document whose name has one of ``distractors`` in it gets no snippets.
    """
    order = Window.partitionBy("canonical").orderBy(F.coalesce("article", F.lit(0)), "node_id")
    kept = articles.where(~F.contains(F.col("node_id"), F.lit("_CAN_CU")))
    before = F.last(F.nullif(F.col("chapter"), F.lit("")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.nullif("chapter", F.lit("")) != F.coalesce(before, F.lit("")), F.lit(False))
    line = F.concat(F.lit("- "), "name")
    if snippet:
        plain = T.contains_any(F.upper("canonical"), K.DISTRACTORS if distractors is None else distractors)
        line = F.when(plain, line).otherwise(F.concat(line, F.lit(": "), T.snippet(F.col("full_text"), snippet)))
    line = F.when(fresh, F.concat(F.lit("## "), "chapter", F.lit("\n"), line)).otherwise(line)
    return kept.select("canonical", "node_id", (F.row_number().over(order) - 1).cast("bigint").alias("place"), fresh.alias("heading"), line.alias("line"))


def outline(articles: DataFrame) -> DataFrame:
    """(canonical, node_id, chapter, section, article, name) rows become ordered lines under chapter and section headings.

    A heading is printed where it changes; a new chapter forgets the section, so one of the same name
    is printed again below it.  Lines below a section are indented further.
    """
    order = Window.partitionBy("canonical").orderBy(F.coalesce("article", F.lit(0)), "node_id")
    said = lambda c: F.nullif(T.text(F.col(c)), F.lit(""))
    rows = articles.where(~F.contains(F.col("node_id"), F.lit("_CAN_CU"))).withColumns({"chapter": said("chapter"), "section": said("section")})
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    changed = lambda now, before: F.coalesce(F.col(now) != F.coalesce(before, F.lit("")), F.lit(False))
    rows = rows.withColumn("new_chapter", changed("chapter", F.last("chapter", True).over(earlier)))
    # Each chapter heading starts a run of its own, in which sections are carried.
    rows = rows.withColumn("run", F.sum(F.col("new_chapter").cast("int")).over(order))
    within = Window.partitionBy("canonical", "run").orderBy(F.coalesce("article", F.lit(0)), "node_id")
    rows = rows.withColumn("new_section", changed("section", F.last("section", True).over(within.rowsBetween(Window.unboundedPreceding, -1))))
    rows = rows.withColumn("in_section", F.last("section", True).over(within).isNotNull())
    line = F.concat(
        F.when(F.col("new_chapter"), F.concat(F.lit("\n"), "chapter", F.lit("\n"))).otherwise(""),
        F.when(F.col("new_section"), F.concat(F.lit("  "), "section", F.lit("\n"))).otherwise(""),
        F.when(F.col("in_section"), "    - ").otherwise("  - "), "name",
    )
    return rows.select("canonical", "node_id", (F.row_number().over(order) - 1).cast("bigint").alias("place"), "new_chapter", "new_section", line.alias("line"))


def locally_ranked(articles: DataFrame, asked: DataFrame, more_than: int = 15, keep: int = 20) -> DataFrame:
    """(query_id, canonical, node_id, score, article): the articles of a table of contents that a query keeps.

    ``asked`` has (query_id, canonical, query) rows.  A document of more than ``more_than`` articles keeps its ``keep``
    best by BM25 over its own articles' names, equal scores in article order; others keep all, without a score.
    """
    named = articles.where(~F.contains(F.col("node_id"), F.lit("_CAN_CU"))).where("name <> ''").select("canonical", "node_id", "article", "name")
    size = named.groupBy("canonical").agg(F.count("*").alias("n_articles"))
    wanted = asked.join(size, "canonical").where(F.size(T.tokens(F.col("query"))) > 0)
    all_of = named.join(bounded(wanted.select("query_id", "canonical", "n_articles")), "canonical")
    scored = lexical.local_bm25(named, wanted.where(F.col("n_articles") > more_than))
    rows = all_of.join(scored, ["query_id", "canonical", "node_id"], "left").withColumn("score", F.when(F.col("n_articles") > more_than, F.coalesce("score", F.lit(0.0))))
    order = Window.partitionBy("query_id", "canonical").orderBy(F.desc("score"), "article", "node_id")
    cut = rows.withColumn("_n", F.row_number().over(order)).where((F.col("n_articles") <= more_than) | (F.col("_n") <= keep))
    return cut.select("query_id", "canonical", "node_id", "score", "article")


def render(lines_: DataFrame) -> DataFrame:
    """One text for each document, with a footer that counts its articles."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n")
    count = F.count("*")
    return lines_.groupBy("canonical").agg(F.concat(joined, F.lit("\n("), count.cast("string"), F.lit(" articles)")).alias("toc"), count.alias("n_articles"))
