"""Query skills and answer flows that ask a model first: rewriting, decomposing, focusing, hypothetical documents, comparison.

A skill is a prompt to an injected rewriter of ``models`` and a way to read its answer.  What it
asks for becomes further search requests of the same batch: all texts of all queries are searched
at once in the stored index, and a query's lists are joined in order, each chunk once where it
comes first.  An answer that can't be read changes nothing.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import fusion, lexical, models
from .inverted import Index
from .retrieve import sub_searches
from .sizing import bounded

#: Sub-questions that are searched for; characters that a reranker reads; shortest rewritten query.
SUBS, READ, SHORTEST = 4, 1024, 5
ANSWER = "sub_questions array<string>, focused_query string, hyde_document string, queries array<string>"


def lines(prompts: list[str]) -> list[str]:
    """The default model: a query's lines are its parts, its first line its shorter form, its last line its focus."""
    out = []
    for prompt in prompts:
        task, text = prompt.split("\n", 1)
        part = [x for x in text.split("\n") if x]
        if not part:
            out.append("nothing")
        elif task == "rewrite":
            out.append(f'"{part[0]}"')
        elif task == "hyde":
            out.append(f"It is held that {part[0]}")
        elif task == "focus":
            out.append("Here: " + json.dumps({"focused_query": part[-1]}, ensure_ascii=False))
        elif len(part) < 2:
            out.append("There is one part only.")
        elif task == "decompose":
            out.append(json.dumps({"sub_questions": part}, ensure_ascii=False))
        else:
            out.append(json.dumps({"hyde_document": f"It is held that {part[0]}", "queries": part}, ensure_ascii=False))
    return out


models.register_rewriter("lines", lines)


def asked(queries: DataFrame, task: str, model: str) -> DataFrame:
    """(query_id, query) with ``answer``, and ``said``: the JSON object in it, null fields where there is none."""
    prompts = queries.select("query_id", T.text(F.col("query")).alias("query")).withColumn("prompt", F.concat(F.lit(task + "\n"), "query"))
    done = models.rewrite(prompts, "prompt", model).drop("prompt")
    return done.withColumn("said", F.from_json(F.regexp_extract("answer", r"(?s)\{.*\}", 0), ANSWER))


def as_docs(index: Index, chunks: DataFrame, requests: DataFrame, deepest: int) -> DataFrame:
    """(query_id, list_id, query, k) become (query_id, list_id, rank, node_id): each list's k best of the 2k that the index finds."""
    found = sub_searches(index, requests.select("query_id", "list_id", "query"), 2 * deepest)
    wide = found.join(bounded(requests), ["query_id", "list_id"]).where(F.col("rank") < 2 * F.col("k")).drop("rank")
    score = lexical.score_column(F.col("query"), F.substring("full_text", 1, READ))
    scored = wide.join(chunks.select("node_id", "full_text"), "node_id").select("query_id", "list_id", "k", "node_id", score.alias("score"))
    order = Window.partitionBy("query_id", "list_id").orderBy(F.desc("score"), "node_id")
    return scored.withColumn("rank", (F.row_number().over(order) - 1).cast("bigint")).where("rank < k").select("query_id", "list_id", "rank", "node_id")


def joined(found: DataFrame) -> DataFrame:
    """(query_id, node_id, place): a query's lists in order, each chunk once."""
    return fusion.ordered_union(found, "node_id").select("query_id", "node_id", "place")


def _one(rows: DataFrame, list_id: int, query: Column | str, k: int) -> DataFrame:
    return rows.select("query_id", F.lit(list_id).alias("list_id"), (F.col(query) if isinstance(query, str) else query).alias("query"), F.lit(k).alias("k"))


def _each(rows: DataFrame, first: int, texts: str, k: int) -> DataFrame:
    return rows.select("query_id", F.posexplode(F.slice(texts, 1, SUBS)).alias("i", "query")).select("query_id", (F.col("i") + first).alias("list_id"), "query", F.lit(k).alias("k"))


def rewrite_requests(queries: DataFrame, model: str = "lines") -> DataFrame:
    """The query, and its rewritten form if that is another one and not too short."""
    rows = asked(queries, "rewrite", model)
    new = F.trim(F.btrim(F.btrim(F.trim("answer"), F.lit('"')), F.lit("'")))
    return _one(rows, 0, "query", 5).union(_one(rows.where((F.length(new) >= SHORTEST) & (new != F.col("query"))), 1, new, 5))


def decompose_requests(queries: DataFrame, model: str = "lines") -> DataFrame:
    """The query, and its first sub-questions if there are two or more."""
    rows = asked(queries, "decompose", model)
    several = rows.where(F.size("said.sub_questions") >= 2).select("query_id", F.col("said.sub_questions").alias("subs"))
    return _one(rows, 0, "query", 5).union(_each(several, 1, "subs", 3))


def hyde_requests(queries: DataFrame, model: str = "lines") -> DataFrame:
    """The query, and the hypothetical text that would answer it."""
    rows = asked(queries, "hyde", model)
    return _one(rows, 0, "query", 5).union(_one(rows.where(F.trim("answer") != ""), 1, F.trim("answer"), 5))


def focus(index: Index, chunks: DataFrame, queries: DataFrame, model: str = "lines") -> DataFrame:
    """What the focused query finds in place of what the query found, or this where it finds nothing."""
    rows = asked(queries, "focus", model)
    narrow = rows.where(F.coalesce("said.focused_query", F.lit("")) != "")
    found = as_docs(index, chunks, _one(rows, 0, "query", 5).union(_one(narrow, 1, F.col("said.focused_query"), 5)), 5)
    best = Window.partitionBy("query_id")
    return joined(found.withColumn("last", F.max("list_id").over(best)).where("list_id = last").drop("last"))


def comparison_requests(queries: DataFrame, model: str = "lines") -> DataFrame:
    """A hypothetical text's results first, then those of the compared sides, then the query's own."""
    rows = asked(queries, "compare", model)
    several = F.size("said.queries") >= 2
    texts = F.when(several, F.col("said.queries")).otherwise(F.array("query"))
    told = rows.where(F.coalesce("said.hyde_document", F.lit("")) != "")
    sides = _each(rows.select("query_id", texts.alias("texts")), 1, "texts", 5)
    return _one(told, 0, F.col("said.hyde_document"), 6).union(sides).union(_one(rows, SUBS + 1, "query", 5))


def found_by(index: Index, chunks: DataFrame, requests: DataFrame, deepest: int = 6) -> DataFrame:
    """(query_id, node_id, place) of a skill's requests."""
    return joined(as_docs(index, chunks, requests, deepest))


def statistical(queries: DataFrame, catalog_: DataFrame, year: Column, kind: Column) -> DataFrame:
    """(query_id, found, sources): the catalog's entries of the year and type that a question names.

    ``catalog_`` has (source, doc_type, year); a question that names neither is about all entries, and one without
    an entry has none to tell of.
    """
    said = queries.select("query_id", year.alias("_year"), kind.alias("_kind"))
    # Entries are counted for each (type, year) first: a question meets these groups and not all entries.
    groups = catalog_.groupBy("doc_type", "year").agg(F.count("*").alias("n"), F.min("source").alias("first"))
    ok = (F.col("_year").isNull() | (F.col("year") == F.col("_year"))) & (F.col("_kind").isNull() | (F.lower("doc_type") == F.lower("_kind")))
    met = said.join(bounded(groups), ok, "left")
    return met.groupBy("query_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("found"), F.min("first").alias("first_source"))


def injected(context: DataFrame, summaries: DataFrame, tocs: DataFrame, counted: DataFrame) -> DataFrame:
    """(query_id, context) with what a question needs before what was found for it.

    ``summaries`` are (query_id, canonical) rows of questions that ask to sum up a document: its table of contents
    (canonical, toc) goes first.  ``counted`` are (query_id, stats) rows of questions about numbers: these go before all.
    """
    # One table of contents of at most one document for each question.
    told = tocs.join(bounded(summaries), "canonical").select("query_id", "toc")
    both = context.join(told, "query_id", "left").join(counted, "query_id", "left")
    return both.select("query_id", F.concat_ws("\n\n", F.nullif("stats", F.lit("")), F.nullif("toc", F.lit("")), F.nullif("context", F.lit(""))).alias("context"))
