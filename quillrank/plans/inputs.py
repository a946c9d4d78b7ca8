"""Inputs of the queries, made of the given tables: texts, references, questions, retrieved lists and what follows from them.

Literal rows stand beside them for cases that the given tables don't hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lexical
from ..operators.sizing import bounded
from ..sources import tables as S
from ..sources.shared import written
from . import sql as Q
from .registry import Over
from .retrieval_queries import _LISTS, _SCORE, lists

#: Ids of made rows start here; literal ones are below.
BASE = 1000


def documents(*columns: Column):
    return lambda spark, sf: S.load(spark, sf, "documents").select(*columns)


_id = lambda c="doc_id": (F.col(c) + BASE).alias("id")
_title = lambda: T.title(F.lit(""), F.col("text"))


def texts(literal: list[tuple]) -> Over:
    """(id, text) of every document."""
    return Over("id int, text string", literal, lambda s, sf: documents(_id(), F.col("text"))(s, sf), f"SELECT doc_id + {BASE} AS id, text FROM documents")


def laws(literal: list[tuple]) -> Over:
    """(id, so_hieu, source): every document's source as its number and its first line as its name; German ones have no number."""
    number = lambda: F.when(F.col("lang") == "de", "").otherwise(F.col("source")).alias("so_hieu")
    return Over("id int, so_hieu string, source string", literal, lambda s, sf: documents(_id(), number(), _title().alias("source"))(s, sf),
                f"SELECT doc_id + {BASE} AS id, CASE WHEN lang = 'de' THEN '' ELSE source END AS so_hieu, {Q.title('text')} AS source FROM documents")


def sources(literal: list[tuple]) -> Over:
    """(id, so_hieu, source): every source of documents once, named after its first document's language."""
    def made(s, sf):
        first = S.load(s, sf, "documents").groupBy("source").agg(F.min("doc_id").alias("doc_id"), F.min_by("lang", "doc_id").alias("lang"))
        return first.select(_id(), F.col("source").alias("so_hieu"), F.concat(F.lit("Law "), "source", F.lit(" "), "lang").alias("source"))

    return Over("id int, so_hieu string, source string", literal, made, f"SELECT min(doc_id) + {BASE} AS id, source AS so_hieu, 'Law ' || source || ' ' || arg_min(lang, doc_id) AS source FROM documents GROUP BY source")


def references(literal: list[tuple]) -> Over:
    """(raw): the ways documents are referred to: by their source as it is, in capitals, cut, or with more behind it."""
    raw = lambda: F.when(F.col("doc_id") % 4 == 0, F.col("source")).when(F.col("doc_id") % 4 == 1, F.upper("source")).when(F.col("doc_id") % 4 == 2, F.concat("source", F.lit("x"))).otherwise(F.concat(F.lit("see "), "source"))
    return Over("raw string", literal, lambda s, sf: documents(raw().alias("raw"))(s, sf).distinct(),
                "SELECT DISTINCT CASE doc_id % 4 WHEN 0 THEN source WHEN 1 THEN upper(source) WHEN 2 THEN source || 'x' ELSE 'see ' || source END AS raw FROM documents")


def questions(literal: list[tuple]) -> Over:
    """(query_id, query): everything that users say in conversations."""
    def made(s, sf):
        said = S.load(s, sf, "conversations").where("role = 'user'")
        return said.select((F.col("conv_id") * 100 + F.col("turn") + BASE).alias("query_id"), T.text(F.col("text")).alias("query"))

    return Over("query_id int, query string", literal, made, f"SELECT conv_id * 100 + turn + {BASE} AS query_id, coalesce(text, '') AS query FROM conversations WHERE role = 'user'")


def articles(literal: list[tuple]) -> Over:
    """(id, full_text, article_number, is_base, title, file): every document as an article of its source's file."""
    def made(s, sf):
        number = F.when(F.col("doc_id") % 10 == 0, "CAN_CU").otherwise((F.col("doc_id") % 100).cast("string"))
        return documents(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), T.text(F.col("text")).alias("full_text"), number.alias("article_number"), (F.col("lang") == "fr").alias("is_base"), _title().alias("title"), F.concat("source", F.lit(".json")).alias("file"))(s, sf)

    return Over("id string, full_text string, article_number string, is_base boolean, title string, file string", literal, made,
                f"SELECT 'd' || doc_id AS id, coalesce(text, '') AS full_text, CASE WHEN doc_id % 10 = 0 THEN 'CAN_CU' ELSE (doc_id % 100)::VARCHAR END AS article_number, lang = 'fr' AS is_base, {Q.title('text')} AS title, source || '.json' AS file FROM documents")


def files(literal: list[tuple]) -> Over:
    """(file, source, so_hieu, article, full_text, ord): every document as a chunk of its source's file."""
    def made(s, sf):
        number = F.when(F.col("doc_id") % 10 == 0, "CAN_CU").otherwise((F.col("doc_id") % 5).cast("string"))
        return documents(F.concat("source", F.lit(".json")).alias("file"), "source", F.lit("").alias("so_hieu"), number.alias("article"), T.text(F.col("text")).alias("full_text"), F.col("doc_id").alias("ord"))(s, sf)

    return Over("file string, source string, so_hieu string, article string, full_text string, ord int", literal, made,
                "SELECT source || '.json' AS file, source, '' AS so_hieu, CASE WHEN doc_id % 10 = 0 THEN 'CAN_CU' ELSE (doc_id % 5)::VARCHAR END AS article, coalesce(text, '') AS full_text, doc_id AS ord FROM documents")


def node_ids(literal: list[tuple]) -> Over:
    """(id, node_id): article ids made of a document's source and number."""
    return Over("id int, node_id string", literal, lambda s, sf: documents(_id(), F.concat("source", F.lit("_2019_"), "lang", F.lit("_D"), F.col("doc_id").cast("string")).alias("node_id"))(s, sf),
                f"SELECT doc_id + {BASE} AS id, source || '_2019_' || lang || '_D' || doc_id AS node_id FROM documents")


def numbers(literal: list[tuple]) -> Over:
    """(raw): document numbers as they may be written: source and language."""
    return Over("raw string", literal, lambda s, sf: documents(F.concat("source", F.lit("/2019/"), "lang").alias("raw"))(s, sf).distinct(), "SELECT DISTINCT source || '/2019/' || lang AS raw FROM documents")


def answers(literal: list[tuple]) -> Over:
    """(id, answer): answers that cite articles of every document."""
    n = lambda k: (F.col("doc_id") % k).cast("string")
    text = lambda: F.concat(F.lit("Theo Điều "), n(50), F.lit(", "), n(7), F.lit(" và "), n(11), F.lit(" ("), _title(), F.lit("; "), "source", F.lit(")"))
    return Over("id int, answer string", literal, lambda s, sf: documents(_id(), text().alias("answer"))(s, sf),
                f"SELECT doc_id + {BASE} AS id, 'Theo Điều ' || (doc_id % 50) || ', ' || (doc_id % 7) || ' và ' || (doc_id % 11) || ' (' || {Q.title('text')} || '; ' || source || ')' AS answer FROM documents")


# --- From retrieved lists ------------------------------------------------------------------------


def retrieved(spark, sf) -> DataFrame:
    """(query_id, query, list_id, rank, node_id, canonical, chapter, article, name, full_text): the five best of either list for each item, written once."""

    def made():
        found = written(lists(spark, sf, 5, items=True), "lists")
        hit = bounded(found.select("node_id", F.lit(True).alias("hit")).distinct())
        # All chunks are numbered, but only those that were found take their texts through the shuffle.
        kept = lambda c: F.when(F.col("hit"), F.col(c)).alias(c)
        thin = S.chunks(spark, sf).join(hit, "node_id", "left").select("node_id", "doc_id", "canonical", "chapter", kept("name"), kept("full_text"), "hit")
        chunks = S.numbered(thin).where("hit").drop("hit")
        return chunks.join(bounded(found), "node_id").join(bounded(S.query_texts(spark, sf)), "query_id")

    return S.stored(spark, sf, "retrieved", "documents", made)


_RETRIEVED = f"(WITH {_LISTS}, {Q.NUMBERED} SELECT l.query_id, query, list_id, rank, l.node_id, canonical, chapter, article, name, full_text FROM lists l JOIN numbered USING (node_id) JOIN queries USING (query_id) WHERE rank < 5)"


def _of(list_id: int, value: str, below: int = 5) -> Column:
    """A list's values in order of rank."""
    kept = F.when((F.col("list_id") == list_id) & (F.col("rank") < below), F.struct("rank", value))
    return F.transform(F.sort_array(F.filter(F.collect_list(kept), lambda x: x.isNotNull())), lambda x: x[value])


def _of_sql(list_id: int, value: str, below: int = 5) -> str:
    return f"coalesce(list({value} ORDER BY rank) FILTER (WHERE list_id = {list_id} AND rank < {below}), [])"


def results(literal: list[tuple]) -> Over:
    """Each item's evaluation row: its nearest vectors' chunks are expected, the best by words were found, and the first of these is the answer."""
    schema = "qid int, kind string, expected array<string>, found array<string>, keywords array<string>, answer string, g double, car double, sim double, label string, confidence double"

    def made(s, sf):
        first = (F.col("list_id") == 1) & (F.col("rank") == 0)
        best = F.max(F.when(first, F.struct("chapter", "full_text", (F.floor(100 * lexical.score_column(F.col("query"), F.col("full_text"))) / 100).alias("sim"))))
        rows = retrieved(s, sf).groupBy("query_id", "query").agg(_of(0, "node_id", 3).alias("expected"), _of(1, "node_id").alias("found"), best.alias("best"))
        sim, i = F.coalesce("best.sim", F.lit(0.0)), F.col("query_id")
        label = F.when(i % 4 == 0, "Khong").when(i % 4 == 1, "Bia_Luat").when(i % 4 == 2, "Suy_Dien").otherwise("Vien_Dan_Bo_Sung")
        words = F.slice(F.filter(F.split(F.lower("query"), " "), lambda x: F.length(x) >= 8), 1, 2)
        return rows.select(
            (i + BASE).alias("qid"), F.col("best.chapter").alias("kind"), "expected", "found", words.alias("keywords"), F.col("best.full_text").alias("answer"),
            (4 * sim).alias("g"), F.round(F.size("expected") / 3, 2).alias("car"), sim.alias("sim"), label.alias("label"), sim.alias("confidence"),
        )

    sim = _SCORE.replace("q.query", "query").replace("c.full_text", "best.full_text")
    sql = f"""SELECT query_id + {BASE} AS qid, best.chapter AS kind, expected, found, list_filter(string_split(lower(query), ' '), lambda x: length(x) >= 8)[1:2] AS keywords, best.full_text AS answer, 4 * sim AS g,
      round(len(expected) / 3, 2) AS car, sim, CASE query_id % 4 WHEN 0 THEN 'Khong' WHEN 1 THEN 'Bia_Luat' WHEN 2 THEN 'Suy_Dien' ELSE 'Vien_Dan_Bo_Sung' END AS label, sim AS confidence
    FROM (SELECT *, CASE WHEN best IS NULL THEN 0 ELSE floor(100 * {sim}) / 100 END AS sim FROM (SELECT query_id, query, {_of_sql(0, 'node_id', 3)} AS expected, {_of_sql(1, 'node_id')} AS found,
      max(CASE WHEN list_id = 1 AND rank = 0 THEN {{'chapter': chapter, 'full_text': full_text}} END) AS best FROM {_RETRIEVED} GROUP BY query_id, query))"""
    return Over(schema, literal, made, sql)


def cited_pairs(literal: list[tuple]) -> Over:
    """(qid, side, doc, article): expected and found articles of each item."""
    def made(s, sf):
        side = F.when(F.col("list_id") == 0, "e").otherwise("f")
        return retrieved(s, sf).where("list_id = 1 or rank < 3").select((F.col("query_id") + BASE).alias("qid"), side.alias("side"), F.col("canonical").alias("doc"), "article")

    return Over("qid int, side string, doc string, article int", literal, made, f"SELECT query_id + {BASE} AS qid, CASE WHEN list_id = 0 THEN 'e' ELSE 'f' END AS side, canonical AS doc, article FROM {_RETRIEVED} WHERE list_id = 1 OR rank < 3")


def required(literal: list[tuple]) -> Over:
    """(qid, ord, articles): each of an item's nearest articles, or the one behind it, is required."""
    def made(s, sf):
        return retrieved(s, sf).where("list_id = 0 and rank < 3").select((F.col("query_id") + BASE).alias("qid"), F.col("rank").alias("ord"), F.array("article", F.col("article") + 1).alias("articles"))

    return Over("qid int, ord int, articles array<int>", literal, made, f"SELECT query_id + {BASE} AS qid, rank AS ord, [article, article + 1] AS articles FROM {_RETRIEVED} WHERE list_id = 0 AND rank < 3")


def found_items(literal: list[tuple]) -> Over:
    """(qid, item): what was found, as text."""
    def made(s, sf):
        return retrieved(s, sf).where("list_id = 1").select((F.col("query_id") + BASE).alias("qid"), F.concat("canonical", F.lit(" Điều "), F.col("article").cast("string"), F.lit(". "), "name").alias("item"))

    return Over("qid int, item string", literal, made, f"SELECT query_id + {BASE} AS qid, canonical || ' Điều ' || article || '. ' || name AS item FROM {_RETRIEVED} WHERE list_id = 1")


def reflections(literal: list[tuple]) -> Over:
    """(id, original, answered): the articles of either list, of items that have both."""
    def made(s, sf):
        rows = retrieved(s, sf).groupBy("query_id").agg(_of(0, "article").alias("original"), _of(1, "article").alias("answered"))
        return rows.where(F.size("original") > 0).select(_id("query_id"), "original", "answered")

    return Over("id int, original array<int>, answered array<int>", literal, made,
                f"SELECT * FROM (SELECT query_id + {BASE} AS id, {_of_sql(0, 'article')} AS original, {_of_sql(1, 'article')} AS answered FROM {_RETRIEVED} GROUP BY query_id) WHERE len(original) > 0")


def outputs(literal: list[tuple]) -> Over:
    """(id, output): what a model that picks the found articles would answer."""
    one = '"so_hieu": "'

    def made(s, sf):
        row = F.concat(F.lit("{" + one), "canonical", F.lit('", "dieu": '), F.col("article").cast("string"), F.lit("}"))
        rows = retrieved(s, sf).withColumn("picked", row).groupBy("query_id").agg(_of(1, "picked").alias("picked"))
        return rows.select(_id("query_id"), F.concat(F.lit("<selected_clauses>["), F.array_join("picked", ", "), F.lit("]</selected_clauses>")).alias("output"))

    picked = _of_sql(1, "picked")
    return Over("id int, output string", literal, made,
                f"""SELECT query_id + {BASE} AS id, '<selected_clauses>[' || array_to_string({picked}, ', ') || ']</selected_clauses>' AS output FROM (SELECT *, '{{{one}' || canonical || '", "dieu": ' || article || '}}' AS picked FROM {_RETRIEVED}) GROUP BY query_id""")


def ranked_documents(literal: list[tuple]) -> Over:
    """(query_id, place, document): the documents of what was found, in order."""
    def made(s, sf):
        return retrieved(s, sf).where("list_id = 1").select((F.col("query_id") + BASE).alias("query_id"), F.col("rank").alias("place"), F.col("canonical").alias("document"))

    return Over("query_id int, place int, document string", literal, made, f"SELECT query_id + {BASE} AS query_id, rank AS place, canonical AS document FROM {_RETRIEVED} WHERE list_id = 1")


def selected(literal: list[tuple]) -> Over:
    """An item's first result by vectors, as a selected article."""
    schema = "query_id int, query string, label string, doc string, article int, text string, doc_text string"

    def made(s, sf):
        rows = retrieved(s, sf).where("list_id = 0 and rank = 0")
        number = F.col("article").cast("string")
        return rows.select((F.col("query_id") + BASE).alias("query_id"), "query", F.concat(F.lit("Điều "), number, F.lit(" ("), "canonical", F.lit(")")).alias("label"), F.col("canonical").alias("doc"), "article",
                           F.concat(F.lit("Điều "), number, F.lit(" "), "full_text").alias("text"), F.concat(F.lit("Luật "), "canonical").alias("doc_text"))

    return Over(schema, literal, made, f"SELECT query_id + {BASE} AS query_id, query, 'Điều ' || article || ' (' || canonical || ')' AS label, canonical AS doc, article, 'Điều ' || article || ' ' || full_text AS text, 'Luật ' || canonical AS doc_text FROM {_RETRIEVED} WHERE list_id = 0 AND rank = 0")


def linked(literal: list[tuple]) -> Over:
    """An item's results by words, as candidates to be linked; every second one refers to the article before it."""
    schema = "query_id int, doc string, article int, text string, doc_text string, top boolean"

    def made(s, sf):
        number = F.col("article").cast("string")
        text = F.concat(F.lit("Điều "), number, F.when(F.col("rank") % 2 == 1, F.concat(F.lit(" theo Điều "), (F.col("article") - 1).cast("string"), F.lit(" "))).otherwise(" "), "full_text")
        return retrieved(s, sf).where("list_id = 1").select((F.col("query_id") + BASE).alias("query_id"), F.col("canonical").alias("doc"), "article", text.alias("text"), F.concat(F.lit("Luật "), "canonical").alias("doc_text"), (F.col("rank") < 3).alias("top"))

    return Over(schema, literal, made, f"SELECT query_id + {BASE} AS query_id, canonical AS doc, article, 'Điều ' || article || CASE WHEN rank % 2 = 1 THEN ' theo Điều ' || (article - 1) || ' ' ELSE ' ' END || full_text AS text, 'Luật ' || canonical AS doc_text, rank < 3 AS top FROM {_RETRIEVED} WHERE list_id = 1")


def picked(literal: list[tuple]) -> Over:
    """(so_hieu, dieu): the articles that were found, each once."""
    def made(s, sf):
        return retrieved(s, sf).where("list_id = 1").select(F.col("canonical").alias("so_hieu"), F.col("article").cast("string").alias("dieu")).distinct()

    return Over("so_hieu string, dieu string", literal, made, f"SELECT DISTINCT canonical AS so_hieu, article::VARCHAR AS dieu FROM {_RETRIEVED} WHERE list_id = 1")


def named_articles(literal: list[tuple]) -> Over:
    """(node_id, canonical, name): every chunk under an article's name."""
    def made(s, sf):
        return S.numbered(S.chunks(s, sf)).select("node_id", "canonical", F.concat(F.lit("Điều "), F.col("article").cast("string"), F.lit(". "), "name").alias("name"))

    return Over("node_id string, canonical string, name string", literal, made, f"SELECT node_id, canonical, 'Điều ' || article || '. ' || name AS name FROM (WITH {Q.CHUNKS}, {Q.NUMBERED} SELECT * FROM numbered)")


def stage_times(literal: list[tuple]) -> Over:
    """(qid, retrieve, choose, pick, write): seconds of four stages, which are a user's values by kind of event."""
    kinds = {"retrieve": "view", "choose": "click", "pick": "purchase", "write": "signup"}

    def made(s, sf):
        total = lambda kind: F.round(F.coalesce(F.sum(F.when(F.col("event_type") == kind, F.col("value"))), F.lit(0.0)), 2)
        return S.load(s, sf, "events").groupBy(F.col("user_id").alias("qid")).agg(*[total(k).alias(c) for c, k in kinds.items()])

    return Over("qid int, retrieve double, choose double, pick double, write double", literal, made,
                "SELECT user_id AS qid, " + ", ".join(f"round(coalesce(sum(value) FILTER (WHERE event_type = '{k}'), 0), 2) AS {c}" for c, k in kinds.items()) + " FROM events GROUP BY user_id")
