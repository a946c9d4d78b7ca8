"""Retrieval by strategy: each query takes its strategy's branches, in order, until one has a result.

An intent is what is known of a query: its strategy, the documents it names, sub-queries, topic,
keywords and so on.  A strategy is a list of attempts.  An attempt turns the intents it applies to
into search requests (a text, a document or the whole corpus, and how many results of either
search), and says how many of the reranked candidates stay and how they are chosen.  All queries of
a batch are searched at once; only those without a result go on to the next attempt, by an anti
join, and what an attempt found is written down before.

A request for an unknown document searches the whole corpus.  Vectors belong to queries: all
requests of a query have its vector.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import written
from . import fusion, graph, lexical, vector
from .inverted import Index
from .sizing import bounded

INTENT = (
    "query_id bigint, query string, documents array<string>, article_hint string, sub_queries array<string>, topic string, keywords array<string>, "
    "check_aspects array<string>, procedure_keywords array<string>, term string, expand_search boolean"
)
#: Aspects that are searched for, characters that a reranker reads if an attempt doesn't say otherwise, factors of a matched keyword.
ASPECTS, READ, BOOST, BALANCED_BOOST = 3, 1024, 1.2, 1.3
#: Candidates, each with its query's text, up to which they are broadcast to the texts.
CANDIDATES = 50_000


@dataclass
class Corpus:
    """What is searched: chunks (node_id, canonical, full_text), their stored index, vectors, the queries' vectors, numbered articles, and edges to expand over."""

    chunks: DataFrame
    index: Index
    vectors: DataFrame
    query_vectors: DataFrame
    articles: DataFrame | None = None
    edges: DataFrame | None = None


@dataclass
class Attempt:
    """A branch: which intents it is for, their requests, and how the candidates are chosen."""

    name: str
    requests: Callable[[DataFrame], DataFrame]
    n: Column
    applies: Column | None = None
    boost: Column | None = None
    mode: str = "best"  # or "mmr", or "balanced" with at least so many of each document
    least: Column | None = None
    read: int | None = READ  # characters of a candidate that are scored; None for its whole text


def _docs() -> Column:
    return F.coalesce("documents", F.array().cast("array<string>"))


def _named() -> Column:
    return F.size(_docs()) > 0


def _keywords(*more: Column) -> Column:
    return F.concat(*more, F.coalesce("keywords", F.array().cast("array<string>")))


def _request(intents: DataFrame, texts: Column, dense: Column, sparse: Column, scoped: bool = True) -> DataFrame:
    """(query_id, text, document, dense, sparse): every text for every document that the intent names, or for the whole corpus."""
    where = F.when(_named(), _docs()).otherwise(F.array(F.lit(None).cast("string"))) if scoped else F.array(F.lit(None).cast("string"))
    rows = intents.select("query_id", F.explode(texts).alias("text"), where.alias("where"), dense.cast("int").alias("dense"), sparse.cast("int").alias("sparse"))
    return rows.select("query_id", "text", F.explode("where").alias("document"), "dense", "sparse")


def multi_query(dense: Column, sparse: Column) -> Callable[[DataFrame], DataFrame]:
    """The distinct sub-queries, each with its share of the depth; a single one is joined by the topic."""
    key = lambda x: F.lower(F.trim(x))

    def make(intents: DataFrame) -> DataFrame:
        subs = F.coalesce("sub_queries", F.array().cast("array<string>"))
        once = F.filter(subs, lambda x, i: (F.trim(x) != "") & ~F.exists(F.slice(subs, F.lit(1), i), lambda y: key(y) == key(x)))
        ready = intents.withColumn("_subs", once).withColumn("_subs", F.when(F.size("_subs") == 0, F.array("query")).otherwise(F.col("_subs")))
        topic = F.trim(T.text(F.col("topic")))
        more = F.when((topic != "") & (F.lower(topic) != key(F.col("_subs")[0])), F.array(topic)).otherwise(F.array().cast("array<string>"))
        single = F.size("_subs") == 1
        share = lambda k: F.when(single, k).otherwise(F.greatest(F.lit(3), F.floor(k / F.size("_subs"))))
        return _request(ready, F.when(single, F.concat("_subs", more)).otherwise(F.col("_subs")), share(dense), share(sparse))

    return make


def plain(dense: Column, sparse: Column, scoped: bool) -> Callable[[DataFrame], DataFrame]:
    """The query itself, in its documents or in the whole corpus."""
    return lambda intents: _request(intents, F.array("query"), dense, sparse, scoped)


def with_aspects(dense: Column, sparse: Column) -> Callable[[DataFrame], DataFrame]:
    """Sub-queries, and the topic (or the query) with each of the first aspects."""

    def make(intents: DataFrame) -> DataFrame:
        head = F.coalesce(F.nullif("topic", F.lit("")), F.col("query"))
        aspects = F.slice(F.coalesce("check_aspects", F.array().cast("array<string>")), 1, ASPECTS)
        return multi_query(dense, sparse)(intents).union(_request(intents, F.transform(aspects, lambda a: F.concat(head, F.lit(" "), a)), F.lit(3), F.lit(3)))

    return make


def per_document(dense: Column, sparse: Column) -> Callable[[DataFrame], DataFrame]:
    """The i-th sub-query, or else the query, in the i-th of the distinct documents."""

    def make(intents: DataFrame) -> DataFrame:
        rows = intents.select("query_id", "query", "sub_queries", F.posexplode(F.array_distinct(_docs())).alias("i", "document"))
        text = F.coalesce(F.get("sub_queries", F.col("i")), F.col("query"))
        return rows.select("query_id", text.alias("text"), "document", dense.cast("int").alias("dense"), sparse.cast("int").alias("sparse"))

    return make


def strategies(k: int) -> dict[str, list[Attempt]]:
    """The attempts of each strategy for a depth of k."""
    c = lambda n: F.lit(n)
    wider = F.when(F.coalesce("expand_search", F.lit(False)), 2 * k).otherwise(k + 3)
    n_docs = F.size(F.array_distinct(_docs()))
    said = lambda name: F.coalesce(name, F.array().cast("array<string>"))
    term = F.when(F.coalesce("term", F.lit("")) != "", F.array("term")).otherwise(F.array().cast("array<string>"))

    def default(d: int) -> list[Attempt]:
        return [Attempt("scoped", plain(c(2 * d), c(2 * d), True), c(2 * d), _named()), Attempt("global", plain(c(2 * d), c(d), False), c(2 * d))]

    last = Attempt("fallback", plain(c(3 * k), c(2 * k), False), c(2 * k), _named())
    # What a question across documents asks for may stand anywhere in a text.
    whole = lambda attempts: [replace(a, read=None) for a in attempts]
    few = n_docs < 2
    small = [Attempt(a.name, a.requests, a.n, few if a.applies is None else few & a.applies) for a in default(2 * k)]
    return {
        "single_lookup": [Attempt("main", multi_query(c(k), c(2 * k)), c(2 * k)), *default(k), last],
        "comparison": [Attempt("main", per_document(c(k + 3), c(k)), c(2 * k), ~few, mode="balanced", least=F.greatest(c(3), F.floor(c(k) / n_docs))), *small, last],
        "listing": [Attempt("main", multi_query(wider, wider), wider, mode="mmr"), last],
        "eligibility_check": [Attempt("main", with_aspects(c(k), c(k)), c(k + 3)), last],
        "procedure": [Attempt("main", multi_query(c(k), c(3 * k)), c(2 * k), boost=_keywords(said("procedure_keywords"))), last],
        "cross_document": whole([Attempt("main", multi_query(c(2 * k), c(k + 3)), c(k + 3), mode="mmr"), Attempt("global", plain(c(3 * k), c(2 * k), False), c(2 * k)), last]),
        "definition": [Attempt("main", multi_query(c(k), c(2 * k)), c(2 * k), boost=_keywords(term)), Attempt("global", plain(c(k), c(2 * k), False), c(2 * k), boost=_keywords(term)), last],
        "default": [*default(k), last],
    }


def search(requests: DataFrame, corpus: Corpus) -> DataFrame:
    """(query_id, document, node_id): the distinct results of all requests, under the document that was asked for."""
    member = corpus.chunks.select("node_id", F.col("canonical").alias("place"))
    # The corpus' documents that are asked for: one row for each request at most.
    known = member.select("place").distinct().join(requests.select(F.col("document").alias("place")).distinct(), "place", "left_semi")
    asked = requests.distinct().join(known, F.col("document") == F.col("place"), "left")
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("text", "document", "dense", "sparse"))
    asked = written(asked.withColumn("request", F.concat_ws(":", F.col("query_id").cast("string"), number.cast("string"))), "requests")
    depth = asked.agg(F.max(F.when(F.col("place").isNull(), F.col("sparse")).otherwise(5 * F.col("sparse"))), F.max("dense")).first()
    if depth[0] is None:
        return asked.select("query_id", "document", F.lit("").alias("node_id"))
    texts = asked.select(F.col("request").alias("query_id"), F.col("text").alias("query"))
    wide = lexical.top_k(corpus.index.search(texts, depth[0], positive=True), depth[0], rank="wide").withColumnRenamed("query_id", "request")
    found = wide.join(bounded(asked), "request")
    free, bound = found.where("place is null and wide < sparse"), found.where("place is not null and wide < 5 * sparse")
    within = lexical.top_k(bound.join(member, ["node_id", "place"], "left_semi"), None, by="request").where("rank < sparse")
    sparse = free.select("query_id", "document", "node_id").union(within.select("query_id", "document", "node_id"))
    # A query's vector is met once for each place, however many texts are asked there.
    deep = asked.groupBy("query_id", "document", "place").agg(F.max("dense").alias("dense"))
    asking = corpus.query_vectors.join(bounded(deep.select("query_id").distinct()), "query_id", "left_semi")
    top = vector.dense_top_k(corpus.vectors, asking, depth[1]).join(bounded(deep.where("place is null")), "query_id").where("rank < dense")
    inside = corpus.vectors.join(member, "node_id").join(bounded(deep.where("place is not null")), "place").join(bounded(asking), "query_id")
    near = inside.select("query_id", "document", "dense", "node_id", F.round(T.dot(F.col("embedding"), F.col("query")), 6).alias("score")).where("score > 0")
    near = lexical.top_k(near.withColumn("at", F.struct("query_id", "document")), depth[1], by="at").where("rank < dense")
    dense = top.select("query_id", "document", "node_id").union(near.select("query_id", "document", "node_id"))
    return sparse.union(dense).distinct()


def choose(found: DataFrame, intents: DataFrame, corpus: Corpus, attempt: Attempt, scorer=lexical.score_column) -> DataFrame:
    """(query_id, node_id, score, rank) of the candidates that stay."""
    seeds = found
    if corpus.edges is not None:
        near = found.select(F.struct("query_id", "document").alias("query_id"), F.col("node_id").alias("node"))
        seeds = graph.expand(near, corpus.edges, 1).select("query_id.query_id", "query_id.document", F.col("node").alias("node_id"))
    balanced = attempt.mode == "balanced"
    seeds = seeds.where(F.col("node_id").startswith("node:")).select("query_id", *["document"] * balanced, "node_id").distinct()
    about = intents.select("query_id", "query", attempt.n.cast("int").alias("n"), (attempt.boost if attempt.boost is not None else _keywords()).alias("boost"), (attempt.least if balanced else F.lit(0)).cast("int").alias("least"))
    texts = corpus.chunks.where("full_text <> ''").select("node_id", "canonical", "full_text")
    body = F.concat("canonical", F.lit(" - "), "full_text")
    body = body if attempt.read is None else F.substring(body, 1, attempt.read)
    score = T.boost(scorer(F.col("query"), body), F.col("full_text"), F.col("boost"), BALANCED_BOOST if balanced else BOOST)
    # The candidates are written and counted, so the texts aren't shuffled to meet a few of them.
    met = bounded(written(seeds.join(bounded(about), "query_id"), "candidates"), CANDIDATES)
    scored = texts.join(met, "node_id").withColumn("score", F.round(score, 6))
    if attempt.mode == "mmr":
        picked = fusion.mmr(scored.select("query_id", "node_id", "score", "n", F.col("full_text").alias("text")), F.col("n"))
        return picked.select("query_id", "node_id", "score", F.col("place").alias("rank"))
    if balanced:
        within = Window.partitionBy("query_id", "document").orderBy(F.desc("score"), "node_id")
        scored = scored.withColumn("slot", (F.row_number().over(within) <= F.col("least")).cast("int"))
        # What two documents' searches found is one candidate.
        scored = scored.groupBy("query_id", "node_id", "n").agg(F.max("slot").alias("slot"), F.max("score").alias("score"))
        ranked = lexical.top_k(scored.withColumn("order", F.struct("slot", "score")), None, score="order")
        return ranked.where("slot = 1 or rank < n").select("query_id", "node_id", "score", "rank")
    return lexical.top_k(scored, None).where("rank < n").select("query_id", "node_id", "score", "rank")


def direct(intents: DataFrame, articles: DataFrame) -> DataFrame:
    """(query_id, node_id): the article that an intent names in the first of its documents, if it has a text; the smallest id of several."""
    asked = intents.where(F.col("article_hint").isNotNull() & _named()).select("query_id", F.element_at(_docs(), 1).alias("canonical"), F.col("article_hint").alias("number"))
    own = articles.where("full_text <> ''").select("canonical", F.col("article").cast("string").alias("number"), "node_id")
    return own.join(bounded(asked), ["canonical", "number"]).groupBy("query_id").agg(F.min("node_id").alias("node_id"))


def retrieve(intents: DataFrame, strategy: str, corpus: Corpus, k: int = 5, scorer=lexical.score_column) -> DataFrame:
    """(query_id, attempt, node_id, score, rank): the result of each intent's first attempt that has one."""
    out, left = [], intents
    if strategy == "single_lookup" and corpus.articles is not None:
        hit = written(direct(left, corpus.articles), "direct")
        out.append(hit.select("query_id", F.lit("direct").alias("attempt"), "node_id", F.lit(None).cast("double").alias("score"), F.lit(0).cast("bigint").alias("rank")))
        left = left.join(hit, "query_id", "left_anti")
    for attempt in strategies(k).get(strategy, strategies(k)["default"]):
        now = left if attempt.applies is None else left.where(attempt.applies)
        if now.isEmpty():
            continue
        found = search(attempt.requests(now), corpus)
        got = written(choose(found, now, corpus, attempt, scorer), "found")
        out.append(got.select("query_id", F.lit(attempt.name).alias("attempt"), "node_id", "score", "rank"))
        left = written(left.join(got.select("query_id").distinct(), "query_id", "left_anti"), "left")
    if not out:
        return intents.sparkSession.createDataFrame([], "query_id bigint, attempt string, node_id string, score double, rank bigint")
    return reduce(DataFrame.unionByName, out)
