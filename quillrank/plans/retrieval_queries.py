"""Queries of lexical, vector, fusion and retrieval operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fusion, lexical, retrieve, vector
from ..operators.sizing import bounded
from ..sources import tables as S
from . import sql as Q
from .registry import query

LONG = "::BIGINT"


@query("doc_frequency", f"""
WITH {Q.CHUNKS}, t AS (SELECT node_id, unnest(list_distinct({Q.tok('full_text')})) AS term FROM chunks)
SELECT term, count(*){LONG} AS df FROM t GROUP BY term""")
def doc_frequency(spark, sf):
    tokens = lexical.tokenized(S.chunks(spark, sf), "node_id", "full_text")
    return tokens.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


@query("bm25_statistics", f"""
WITH {Q.CHUNKS}, {Q.queries()}, {Q.bm25()} SELECT term, round(idf, 6) AS idf FROM bm25_idf""")
def bm25_statistics(spark, sf):
    return S.lexical_index(spark, sf).statistics().select("term", F.round("idf", 6).alias("idf"))


def bm25_scores(spark, sf, k: int | None = None) -> DataFrame:
    """Positive scores of all benchmark items from the stored index: all of them, or each task's k best of an item."""
    return S.lexical_index(spark, sf).search(S.query_texts(spark, sf), k, positive=True)


@query("bm25_topk", f"""
WITH {Q.CHUNKS}, {Q.queries()}, {Q.bm25()}, {Q.top('(SELECT * FROM bm25 WHERE score > 0)', 10, 'best')} SELECT query_id, node_id, score, rank FROM best""")
def bm25_topk(spark, sf):
    return lexical.top_k(bm25_scores(spark, sf, 10), 10)


MEMBERS = "members AS (SELECT q.query_id, c.node_id FROM queries q JOIN chunks c ON c.canonical = 'src' || (q.query_id % 20))"


def members(spark, sf, documents: int = 20) -> DataFrame:
    """The chunks of the document that each query is about; beyond 20 documents there are unknown ones."""
    q = S.query_texts(spark, sf).select("query_id", F.concat(F.lit("src"), (F.col("query_id") % documents).cast("string")).alias("canonical"))
    return S.chunks(spark, sf).join(bounded(q), "canonical").select("query_id", "node_id")


@query("bm25_scoped", f"""
WITH {Q.CHUNKS}, {Q.queries()}, {MEMBERS.replace("% 20", "% 25")}, {Q.bm25()}, {Q.top('(SELECT * FROM bm25 WHERE score > 0)', 50, 'wide', 'wide')},
kept AS (SELECT query_id, node_id, score, wide FROM wide SEMI JOIN members USING (query_id, node_id) UNION ALL SELECT query_id, node_id, score, wide FROM wide WHERE wide < 10 AND query_id NOT IN (SELECT query_id FROM members)), {Q.top('kept', 10, 'best')} SELECT query_id, node_id, score, wide, rank FROM best""")
def bm25_scoped(spark, sf):
    return lexical.scoped(bm25_scores(spark, sf, 50), members(spark, sf, 25), 10)


@query("dense_topk", f"WITH {Q.dense()}, {Q.top('dense', 10, 'best')} SELECT query_id, node_id, score, rank FROM best")
def dense_topk(spark, sf):
    return vector.dense_top_k(S.vectors(spark, sf), S.query_vectors(spark, sf), 10)


@query("dense_scoped", f"""
WITH {Q.CHUNKS}, {Q.queries()}, {MEMBERS}, {Q.dense()}, kept AS (SELECT * FROM dense SEMI JOIN members USING (query_id, node_id) WHERE score > 0), {Q.top('kept', 5, 'best')} SELECT query_id, node_id, score, rank FROM best""")
def dense_scoped(spark, sf):
    return vector.dense_scoped(S.vectors(spark, sf), S.query_vectors(spark, sf), members(spark, sf), 5)


_LISTS = f"""{Q.CHUNKS}, {Q.queries()}, {Q.bm25()}, {Q.dense()}, {Q.top('(SELECT * FROM bm25 WHERE score > 0)', 20, 'sparse_k')}, {Q.top('dense', 20, 'dense_k')},
lists AS (SELECT query_id, 0 AS list_id, rank, node_id FROM dense_k UNION ALL SELECT query_id, 1, rank, node_id FROM sparse_k)"""


def lists(spark, sf, k: int = 20, items: bool = False) -> DataFrame:
    """The k best of either search for each item and each query vector; with ``items`` only vectors whose query is an item are asked."""
    asked = S.query_vectors(spark, sf)
    if items:
        asked = asked.join(bounded(S.query_texts(spark, sf).select("query_id").distinct()), "query_id", "left_semi")
    dense = vector.dense_top_k(S.vectors(spark, sf), asked, k).select("query_id", F.lit(0).alias("list_id"), "rank", "node_id")
    sparse = lexical.top_k(bm25_scores(spark, sf, k), k).select("query_id", F.lit(1).alias("list_id"), "rank", "node_id")
    return dense.unionByName(sparse)


@query("hybrid_union", f"WITH {_LISTS} SELECT DISTINCT query_id, node_id FROM lists")
def hybrid_union(spark, sf):
    return lists(spark, sf).select("query_id", "node_id").distinct()


_RRF = f"""{_LISTS}, f AS (SELECT query_id, node_id, round(sum(1.0::DOUBLE / (60 + rank + 1)), 9) AS rrf FROM lists GROUP BY ALL),
rrf AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, node_id) - 1){LONG} AS rank FROM f)"""


@query("rrf_merge", f"WITH {_RRF} SELECT query_id, node_id, rrf, rank FROM rrf")
def rrf_merge(spark, sf):
    return fusion.rrf(lists(spark, sf))


_VOTE = f"""{_RRF}, v AS (SELECT query_id, canonical AS document, count(*){LONG} AS n, max(rrf) AS best, sum(rrf) AS total, min(rank) AS first FROM rrf JOIN chunks USING (node_id) GROUP BY ALL),
vote AS (SELECT query_id, document, n, round(best, 9) AS best, round(best + 0.3::DOUBLE * ln(1 + n) * (total / n), 9) AS rank_score, first FROM v)"""


def votes(spark, sf) -> DataFrame:
    docs = S.chunks(spark, sf).select("node_id", F.col("canonical").alias("document"))
    return fusion.document_vote(fusion.rrf(lists(spark, sf)).join(docs, "node_id"))


@query("doc_vote", f"WITH {_VOTE} SELECT query_id, document, n, best, rank_score, first FROM vote")
def doc_vote(spark, sf):
    return votes(spark, sf)


@query("top_documents", f"WITH {_VOTE} SELECT query_id, document, rank FROM (SELECT query_id, document, (row_number() OVER (PARTITION BY query_id ORDER BY rank_score DESC, document) - 1){LONG} AS rank FROM vote) WHERE rank < 5")
def top_documents(spark, sf):
    return lexical.top_k(votes(spark, sf), 5, score="rank_score", tie="document").select("query_id", "document", "rank")


@query("target_front", f"""
WITH {_VOTE}, r AS (SELECT query_id, document, (row_number() OVER (PARTITION BY query_id ORDER BY rank_score DESC, document) - 1){LONG} AS rank FROM vote),
t AS (SELECT query_id, 'src' || ((query_id + o) % 20) AS document, o AS ord FROM queries, (VALUES (0), (1)) x(o))
SELECT query_id, document, (row_number() OVER (PARTITION BY query_id ORDER BY ord DESC NULLS LAST, rank ASC NULLS LAST, document) - 1){LONG} AS place FROM r FULL JOIN t USING (query_id, document)""")
def target_front(spark, sf):
    ranked = lexical.top_k(votes(spark, sf), None, score="rank_score", tie="document").select("query_id", "document", "rank")
    targets = S.query_texts(spark, sf).select("query_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("ord"))
    targets = targets.select("query_id", F.concat(F.lit("src"), ((F.col("query_id") + F.col("ord")) % 20).cast("string")).alias("document"), "ord")
    return fusion.targets_first(ranked, targets)


@query("balanced_slots", f"""
WITH {Q.CHUNKS}, {Q.queries()}, {Q.bm25()}, s AS (SELECT query_id, node_id, score, canonical AS document FROM bm25 JOIN chunks USING (node_id) WHERE score > 0),
o AS (SELECT *, (row_number() OVER (PARTITION BY query_id, document ORDER BY score DESC, node_id) > 2)::INTEGER AS overflow FROM s)
SELECT query_id, node_id, score, document, overflow, place FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY overflow, score DESC, node_id) - 1){LONG} AS place FROM o) WHERE place < 12""")
def balanced_slots(spark, sf):
    scored = bm25_scores(spark, sf).join(S.chunks(spark, sf).select("node_id", F.col("canonical").alias("document")), "node_id")
    return fusion.balanced_slots(scored, 2, 12).select("query_id", "node_id", "score", "document", "overflow", "place")


@query("mmr_select")
def mmr_select(spark, sf):
    best = lexical.top_k(bm25_scores(spark, sf, 20), 20)
    return fusion.mmr(best.join(S.chunks(spark, sf).select("node_id", F.col("full_text").alias("text")), "node_id"), 5)


@query("ordered_union", f"""
WITH {_LISTS}, o AS (SELECT query_id, node_id, list_id, rank FROM lists QUALIFY row_number() OVER (PARTITION BY query_id, node_id ORDER BY list_id, rank) = 1)
SELECT query_id, node_id, (row_number() OVER (PARTITION BY query_id ORDER BY list_id, rank) - 1){LONG} AS place FROM o""")
def ordered_union(spark, sf):
    return fusion.ordered_union(lists(spark, sf), "node_id").select("query_id", "node_id", "place")


_SCORE = f"round(len(list_intersect(list_distinct({Q.tok('q.query')}), {Q.tok('c.full_text')}))::DOUBLE / greatest(len(list_distinct({Q.tok('q.query')})), 1), 6)"


@query("rerank_topn", f"""
WITH {_LISTS}, u AS (SELECT DISTINCT query_id, node_id FROM lists), s AS (SELECT u.query_id, u.node_id, {_SCORE} AS score FROM u JOIN queries q USING (query_id) JOIN chunks c USING (node_id)), {Q.top('s', 10, 'best')}
SELECT query_id, node_id, score, rank FROM best""")
def rerank_topn(spark, sf):
    return retrieve.rerank(lists(spark, sf), S.query_texts(spark, sf), S.chunks(spark, sf), 10)


_HOP = f"""{_LISTS}, u AS (SELECT DISTINCT query_id, node_id FROM lists WHERE rank < 5),
near AS (SELECT query_id, node_id FROM u UNION SELECT u.query_id, 'node:' || (replace(u.node_id, 'node:', '')::BIGINT + 20) FROM u)"""


@query("retrieve_docs", f"""
WITH {_HOP}, s AS (SELECT near.query_id, node_id, {_SCORE.replace('c.full_text', 'substr(c.full_text, 1, 1024)')} AS score, canonical, chapter, name FROM near JOIN queries q USING (query_id) JOIN chunks c USING (node_id)), {Q.top('s', 8, 'best')}
SELECT query_id, node_id AS chunk_id, rank, score, concat_ws(' > ', nullif(canonical, ''), nullif(chapter, ''), nullif(name, '')) AS breadcrumb FROM best""")
def retrieve_docs(spark, sf):
    chunks = S.chunks(spark, sf)
    edges = chunks.select(F.col("node_id").alias("src"), F.concat(F.lit("node:"), (F.col("doc_id") + 20).cast("string")).alias("dst"))
    return retrieve.retrieve_as_docs(lists(spark, sf).where("rank < 5"), S.query_texts(spark, sf), chunks, edges, 8)


@query("direct_article", """
WITH c AS (SELECT 'node:' || source || '_D' || row_number() OVER (PARTITION BY source ORDER BY doc_id) AS node_id, source AS canonical FROM documents)
SELECT item_id AS query_id, canonical, node_id FROM benchmark JOIN c ON canonical = 'src' || (item_id % 20) AND ends_with(lower(node_id), '_d' || (item_id % 30 + 1))""")
def direct_article(spark, sf):
    """The article that each item names, in its document."""
    c = S.numbered(S.chunks(spark, sf)).select("canonical", F.concat(F.lit("node:"), "canonical", F.lit("_D"), F.col("article").cast("string")).alias("node_id"))
    i = F.col("query_id")
    asked = S.query_texts(spark, sf).select("query_id", F.concat(F.lit("src"), (i % 20).cast("string")).alias("canonical"), (i % 30 + 1).alias("number"))
    return retrieve.direct_articles(c, asked).select("query_id", "canonical", "node_id")


@query("document_chunks", f"WITH {Q.CHUNKS}, {Q.NUMBERED} SELECT canonical, node_id, (row_number() OVER (PARTITION BY canonical ORDER BY coalesce(article, 999), node_id) - 1){LONG} AS place FROM numbered")
def document_chunks(spark, sf):
    return retrieve.document_chunks(S.numbered(S.chunks(spark, sf)))


@query("wide_retrieval", f"""
WITH {Q.CHUNKS}, {Q.queries()}, l AS (SELECT query_id, list_filter(string_split(coalesce(query, ''), chr(10)), lambda x: x <> '') AS l FROM queries),
wide AS (SELECT query_id, 0 AS list_id, coalesce(query, '') AS query FROM queries UNION ALL SELECT query_id, i, l[i] FROM (SELECT *, unnest(range(1, least(4, len(l)) + 1)) AS i FROM l)),
asked AS (SELECT query_id * 10 + list_id AS query_id, query FROM wide), {Q.bm25(asked='asked')}, {Q.top('(SELECT * FROM bm25 WHERE score > 0)', 20, 'r')},
cut AS (SELECT query_id // 10 AS query_id, node_id, rank FROM r WHERE rank < CASE WHEN query_id % 10 = 0 THEN 20 ELSE 8 END),
f AS (SELECT query_id, node_id, round(sum(1.0::DOUBLE / (60 + rank + 1)), 9) AS rrf FROM cut GROUP BY ALL)
SELECT query_id, node_id, rrf, (row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, node_id) - 1){LONG} AS rank FROM f""")
def wide_retrieval(spark, sf):
    """Each item, and its first lines as narrower wordings."""
    asked = S.intents(spark, sf)
    lines = asked.select("query_id", F.posexplode(F.slice("sub_queries", 1, 4)).alias("i", "query")).select("query_id", (F.col("i") + 1).alias("list_id"), "query")
    return retrieve.wide(S.lexical_index(spark, sf), asked.select("query_id", F.lit(0).alias("list_id"), "query").unionByName(lines))


_STRATEGY = "CASE query_id % 8 WHEN 0 THEN 'single_lookup' WHEN 1 THEN 'comparison' WHEN 2 THEN 'listing' WHEN 3 THEN 'eligibility_check' WHEN 4 THEN 'procedure' WHEN 5 THEN 'cross_document' WHEN 6 THEN 'definition' ELSE 'default' END"


@query("strategy_parameters", f"""WITH {Q.queries()}, v(s, k, d, p, c) AS (VALUES ('single_lookup', 5, 5, 10, 10), ('comparison', 5, 8, 5, 10), ('listing', 5, 8, 8, 8), ('eligibility_check', 5, 5, 5, 8),
 ('procedure', 5, 5, 15, 10), ('cross_document', 5, 10, 8, 8), ('definition', 5, 5, 10, 10), ('default', 5, 10, 10, 10)) SELECT query_id, s AS strategy, k, d, p, c FROM queries JOIN v ON s = {_STRATEGY}""")
def strategy_parameters(spark, sf):
    """The depths that each benchmark item is searched with."""
    depths = retrieve.strategy_depths(spark, 5).select("strategy", "k", F.col("dense").alias("d"), F.col("sparse").alias("p"), F.col("cut").alias("c"))
    names = F.array(*map(F.lit, retrieve.STRATEGIES))
    return S.query_texts(spark, sf).select("query_id", names[(F.col("query_id") % 8).cast("int")].alias("strategy")).join(F.broadcast(depths), "strategy")


@query("strategy_dispatch", f"""
WITH {_LISTS.replace(', 20, ', ', 40, ')}, kinds(kind, dense, sparse, cut) AS (VALUES (0, 5, 10, 10), (1, 8, 8, 8), (2, 5, 15, 10), (3, 10, 8, 8), (4, 10, 10, 10)), s AS (SELECT query_id, dense, sparse, cut FROM queries JOIN kinds ON query_id % 5 = kind),
u AS (SELECT DISTINCT l.query_id, node_id FROM lists l JOIN s USING (query_id) WHERE (list_id = 0 AND rank < dense) OR (list_id = 1 AND rank < sparse)),
x AS (SELECT u.query_id, u.node_id, {_SCORE} AS score FROM u JOIN queries q USING (query_id) JOIN chunks c USING (node_id)),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) - 1){LONG} AS rank FROM x)
SELECT query_id, node_id, score, rank FROM r JOIN s USING (query_id) WHERE rank < cut""")
def strategy_dispatch(spark, sf):
    kinds = F.array(*map(F.lit, ["single_lookup", "listing", "procedure", "cross_document", "default"]))
    asked = S.query_texts(spark, sf)
    chosen = asked.select("query_id", kinds[(F.col("query_id") % 5).cast("int")].alias("strategy"))
    return retrieve.dispatch(lists(spark, sf, 40), chosen, asked, S.chunks(spark, sf), 5)


@query("sub_query_depth", f"SELECT query_id, n, greatest(3, 20 // n){LONG} AS depth FROM (SELECT item_id AS query_id, greatest(1, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> '')))::INTEGER AS n FROM benchmark)")
def sub_query_depth(spark, sf):
    """How deep each of an item's lines is searched as a sub-query."""
    n = F.greatest(F.lit(1), F.size("sub_queries")).alias("n")
    return S.intents(spark, sf).select("query_id", n).select("query_id", "n", retrieve.sub_query_depth(F.lit(20), F.col("n")).alias("depth"))


@query("sub_query_dedupe", "SELECT DISTINCT ON (lower(trim(lang))) lower(trim(lang)) AS sub_query, min(doc_id) OVER (PARTITION BY lower(trim(lang))) AS first_id FROM documents")
def sub_query_dedupe(spark, sf):
    return S.load(spark, sf, "documents").groupBy(F.lower(F.trim("lang")).alias("sub_query")).agg(F.min("doc_id").alias("first_id"))


@query("dominant_document", f"""
WITH {_RRF}, n AS (SELECT query_id, canonical, count(*){LONG} AS n, min(rank) AS first FROM rrf JOIN chunks USING (node_id) GROUP BY ALL)
SELECT query_id, arg_min(canonical, (-n, first)) AS canonical, max(n) AS n FROM n GROUP BY query_id HAVING max(n) >= 3""")
def dominant_document(spark, sf):
    docs = fusion.rrf(lists(spark, sf)).join(S.chunks(spark, sf).select("node_id", "canonical"), "node_id")
    return retrieve.dominant(docs)


@query("document_full_text", "SELECT source AS canonical, md5(string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id)) AS digest, count(*)::BIGINT AS n FROM documents GROUP BY source")
def document_full_text(spark, sf):
    return retrieve.full_texts(S.chunks(spark, sf), "doc_id").select("canonical", F.md5("text").alias("digest"), "n")
