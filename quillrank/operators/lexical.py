"""BM25 over many queries at once.

Texts are tokenised once.  Document frequencies come from the distinct tokens of each row, so
the shuffle holds a row for each (task, term); term frequencies are counted only for terms that
some query has, after a join with the queries' terms.  These are counted, broadcast up to
``MAX_TERMS`` and joined by a shuffle beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Words of a batch of queries up to which their terms are broadcast.
MAX_TERMS = 200_000


def tokenized(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("node_id"), T.tokens(F.col(text_col)).alias("tokens")).withColumn("dl", F.size("tokens").cast("bigint"))


def term_counts(tokens: DataFrame) -> DataFrame:
    """term, df, words: one pass over the texts; the null term stands for all texts, with their number and words."""
    some = F.explode(F.concat(F.array_distinct("tokens"), F.array(F.lit(None).cast("string")))).alias("term")
    return tokens.select(some, "dl").groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("dl"))).alias("words"))


def corpus_size(counts: DataFrame) -> DataFrame:
    """One row: n texts of avgdl words on average."""
    whole = F.col("words").isNotNull()
    return counts.agg(F.max(F.when(whole, F.col("df"))).alias("n"), F.max("words").alias("words")).select("n", (F.col("words") / F.col("n")).alias("avgdl"))


def term_stats(tokens: DataFrame) -> DataFrame:
    """term, df and idf; a negative idf becomes epsilon times the mean over all terms."""
    return _idf(term_counts(tokens))


def _idf(counts: DataFrame) -> DataFrame:
    # A filter on the term itself would be pushed below the shuffle, which is then made anew.
    df = counts.where(F.col("words").isNull())
    raw = df.join(F.broadcast(corpus_size(counts)), F.lit(True)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg((F.sum("raw") / F.count("*")).alias("mean"))
    return raw.join(F.broadcast(mean), F.lit(True)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term and how often the query has it."""
    return queries.select("query_id", F.explode(T.tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def bm25(docs: DataFrame, queries: DataFrame, id_col: str = "node_id", text_col: str = "full_text") -> DataFrame:
    """query_id, node_id and score, rounded to 6 digits, for every pair that shares a term."""
    tokens = tokenized(docs, id_col, text_col)
    asked = query_terms(queries)
    counts = term_counts(tokens)
    mean = corpus_size(counts).select("avgdl")
    terms = asked.select("term").distinct()
    # The words of the queries bound the rows of all three sides, and are counted without a shuffle.
    words = queries.agg(F.sum(F.size(T.tokens(F.col("query"))))).first()[0] or 0
    sent = F.broadcast if words <= MAX_TERMS else lambda df: df
    tf = tokens.select("node_id", "dl", F.explode("tokens").alias("term")).join(sent(terms), "term").groupBy("node_id", "dl", "term").agg(F.count("*").alias("tf"))
    idf = _idf(counts).join(sent(terms), "term", "left_semi")
    rows = tf.join(sent(idf), "term").join(sent(asked), "term").join(F.broadcast(mean), F.lit(True))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return rows.groupBy("query_id", "node_id").agg(F.round(F.sum(part), 6).alias("score"))


def local_bm25(named: DataFrame, asked: DataFrame, scope: str = "canonical") -> DataFrame:
    """(query_id, scope, node_id, score): BM25 within each scope alone, of the scopes that are asked for.

    ``named`` has (scope, node_id, name) rows and ``asked`` (query_id, scope, query).  Number, mean length, document
    frequencies and the mean idf are those of the scope; all scopes are scored in one pass.
    """
    wanted = asked.select(scope).distinct()
    tokens = named.join(wanted, scope, "left_semi").select(scope, "node_id", T.tokens(F.col("name")).alias("tokens")).withColumn("dl", F.size("tokens"))
    own = tokens.groupBy(scope).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    tf = tokens.select(scope, "node_id", "dl", F.explode("tokens").alias("term")).groupBy(scope, "node_id", "dl", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy(scope, "term").agg(F.count("*").alias("df")).join(own, scope)
    df = df.withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = df.groupBy(scope).agg((F.sum("raw") / F.count("*")).alias("mean"))
    idf = df.join(mean, scope).select(scope, "term", "avgdl", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    terms = asked.select("query_id", scope, F.explode(T.tokens(F.col("query"))).alias("term")).groupBy("query_id", scope, "term").agg(F.count("*").alias("qtf"))
    rows = terms.join(idf, [scope, "term"]).join(tf, [scope, "term"])
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return rows.groupBy("query_id", scope, "node_id").agg(F.round(F.sum(part), 6).alias("score"))


def top_k(scored: DataFrame, k: int | None, by: str = "query_id", score: str = "score", tie: str = "node_id", rank: str = "rank") -> DataFrame:
    """The k best of each query, or all, with a rank from 0; ties go to the smaller id."""
    order = Window.partitionBy(by).orderBy(F.desc(score), F.asc(tie))
    ranked = scored.withColumn(rank, (F.row_number().over(order) - 1).cast("bigint"))
    return ranked if k is None else ranked.where(F.col(rank) < k)


def scoped(scored: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """Within a document: of the 5k best overall, the k best members; positive scores only.

    A query whose document has no members is about an unknown one and takes the k best overall.
    """
    wide = top_k(scored.where("score > 0"), 5 * k, rank="wide")
    own = wide.join(members, ["query_id", "node_id"], "left_semi")
    free = wide.join(members.select("query_id").distinct(), "query_id", "left_anti").where(F.col("wide") < k)
    return top_k(own.union(free), k)


def score_column(query: Column, body: Column) -> Column:
    """Default reranker: the share of the query's distinct tokens that the body has."""
    q = F.array_distinct(T.tokens(query))
    return F.round(F.size(F.array_intersect(q, T.tokens(body))) / F.greatest(F.size(q), F.lit(1)), 6)
