"""Queries of skills and flows that ask a model first, over all benchmark items; and statistical questions over all that users say."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..operators import intent, skills, toc
from ..sources import tables as S
from . import sql as Q
from .corpus_queries import _pat
from .graph_queries import _toc
from .registry import ORACLES, query
from .retrieval_queries import _SCORE
from .text_queries import ASKED

LONG = "::BIGINT"
_LINES = "lines AS (SELECT query_id, coalesce(query, '') AS query, list_filter(string_split(coalesce(query, ''), chr(10)), lambda x: x <> '') AS l FROM queries)"


def _flow(requests: str, keep: str = "") -> str:
    """A flow's SQL from that of its (query_id, list_id, query, k) requests."""
    score = _SCORE.replace("c.full_text", "substr(c.full_text, 1, 1024)").replace("q.query", "r.query")
    return f"""WITH {Q.CHUNKS}, {Q.queries()}, {_LINES}, asked AS MATERIALIZED (SELECT *, row_number() OVER () AS request FROM ({requests})),
{Q.bm25(asked="(SELECT request AS query_id, query FROM asked)")},
w AS (SELECT r.*, node_id FROM bm25 b JOIN asked r ON r.request = b.query_id WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY request ORDER BY score DESC, node_id) <= 2 * k),
d AS (SELECT r.query_id, r.list_id, r.k, r.node_id, {score} AS score FROM w r JOIN chunks c USING (node_id)),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, list_id ORDER BY score DESC, node_id) AS rank FROM d QUALIFY rank <= k),
g AS (SELECT * FROM f {keep}),
o AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY query_id, node_id ORDER BY list_id, rank) = 1)
SELECT query_id, node_id, (row_number() OVER (PARTITION BY query_id ORDER BY list_id, rank) - 1){LONG} AS place FROM o"""


_OWN = "SELECT query_id, 0 AS list_id, query, 5 AS k FROM lines"
_FIRST = "trim(trim(trim(l[1]), '\"'), '''')"


def _run(spark, sf, requests, deepest: int = 6):
    return skills.found_by(S.lexical_index(spark, sf), S.chunks(spark, sf), requests, deepest)


@query("skill_rewrite", _flow(f"{_OWN} UNION ALL SELECT query_id, 1, trim({_FIRST}), 5 FROM lines WHERE len(l) > 0 AND length(trim({_FIRST})) >= 5 AND trim({_FIRST}) <> query UNION ALL SELECT query_id, 1, 'nothing', 5 FROM lines WHERE len(l) = 0"))
def skill_rewrite(spark, sf):
    return _run(spark, sf, skills.rewrite_requests(S.query_texts(spark, sf)))


@query("skill_decompose", _flow(f"{_OWN} UNION ALL SELECT query_id, i, l[i], 3 FROM (SELECT *, unnest(range(1, least(4, len(l)) + 1)) AS i FROM lines WHERE len(l) >= 2)"))
def skill_decompose(spark, sf):
    return _run(spark, sf, skills.decompose_requests(S.query_texts(spark, sf)))


@query("skill_hyde", _flow(f"{_OWN} UNION ALL SELECT query_id, 1, CASE WHEN len(l) = 0 THEN 'nothing' ELSE trim('It is held that ' || l[1]) END, 5 FROM lines"))
def skill_hyde(spark, sf):
    return _run(spark, sf, skills.hyde_requests(S.query_texts(spark, sf)))


@query("skill_focus", _flow(f"{_OWN} UNION ALL SELECT query_id, 1, l[-1], 5 FROM lines WHERE len(l) > 0", "QUALIFY list_id = max(list_id) OVER (PARTITION BY query_id)"))
def skill_focus(spark, sf):
    return skills.focus(S.lexical_index(spark, sf), S.chunks(spark, sf), S.query_texts(spark, sf))


@query("comparison_flow", _flow("""SELECT query_id, 0 AS list_id, 'It is held that ' || l[1] AS query, 6 AS k FROM lines WHERE len(l) >= 2 UNION ALL SELECT query_id, i, l[i], 5 FROM (SELECT *, unnest(range(1, least(4, len(l)) + 1)) AS i FROM lines WHERE len(l) >= 2)
  UNION ALL SELECT query_id, 1, query, 5 FROM lines WHERE len(l) < 2 UNION ALL SELECT query_id, 5, query, 5 FROM lines"""))
def comparison_flow(spark, sf):
    """Hypothetical text, sides and query, each searched, joined in order."""
    return _run(spark, sf, skills.comparison_requests(S.query_texts(spark, sf)))


@query("listing_flow", _flow("SELECT query_id, 0 AS list_id, query, 10 AS k FROM lines"))
def listing_flow(spark, sf):
    """The ten best chunks of each item, each once, in order."""
    asked = S.query_texts(spark, sf).select("query_id", F.lit(0).alias("list_id"), T.text(F.col("query")).alias("query"), F.lit(10).alias("k"))
    return _run(spark, sf, asked, 10)


_Q = "lower(trim(query))"


@query("statistical_flow", f"""WITH catalog AS (SELECT 'page ' || page_id AS source, CASE page_id % 4 WHEN 0 THEN 'Luật' WHEN 1 THEN 'Nghị định' WHEN 2 THEN 'Thông tư' ELSE 'Khác' END AS doc_type, (2019 + page_id % 5)::VARCHAR AS year FROM pages),
q AS (SELECT query_id, nullif(regexp_extract({_Q}, '(20\\d{{2}})', 1), '') AS y, CASE WHEN contains({_Q}, 'nghị định') THEN 'Nghị định' WHEN contains({_Q}, 'thông tư') THEN 'Thông tư' WHEN contains({_Q}, 'luật') THEN 'Luật' END AS t FROM {ASKED.sql})
SELECT query_id, count(source){LONG} AS found, min(source) AS first_source FROM q LEFT JOIN catalog c ON (y IS NULL OR c.year = y) AND (t IS NULL OR lower(doc_type) = lower(t)) GROUP BY query_id""")
def statistical_flow(spark, sf):
    """How many pages a question about numbers of documents is answered with."""
    i = F.col("page_id")
    kind = F.when(i % 4 == 0, "Luật").when(i % 4 == 1, "Nghị định").when(i % 4 == 2, "Thông tư").otherwise("Khác")
    entries = S.load(spark, sf, "pages").select(F.concat(F.lit("page "), i.cast("string")).alias("source"), kind.alias("doc_type"), (2019 + i % 5).cast("string").alias("year"))
    return skills.statistical(ASKED.df(spark, sf), entries, *intent.year_and_type(F.col("query")))


_FLAGS = f"flags AS (SELECT query_id, {_pat(K.SUMMARY_PATTERNS)} AS summary, {_pat(K.STATISTICAL_PATTERNS)} AS statistical FROM {ASKED.sql})"


@query("context_injection", f"""WITH {_toc(0)}, {_FLAGS}, tocs AS (SELECT canonical, string_agg(line, chr(10) ORDER BY place) || chr(10) || '(' || count(*) || ' articles)' AS toc FROM lines GROUP BY canonical),
stats AS ({ORACLES["statistical_flow"]})
SELECT f.query_id, summary, statistical, md5(concat_ws(chr(10) || chr(10), CASE WHEN statistical THEN found || ' documents, first ' || coalesce(first_source, '-') END, CASE WHEN summary THEN toc END, 'question ' || f.query_id)) AS digest
FROM flags f JOIN stats USING (query_id) LEFT JOIN tocs ON canonical = 'src' || (f.query_id % 20)""")
def context_injection(spark, sf):
    """What goes before the context of every question: counts for statistical ones, a table of contents for summaries."""
    q = F.lower(F.trim("query"))
    flags = ASKED.df(spark, sf).select("query_id", T.matches_any(q, K.SUMMARY_PATTERNS).alias("summary"), T.matches_any(q, K.STATISTICAL_PATTERNS).alias("statistical"))
    named = flags.where("summary").select("query_id", F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")).alias("canonical"))
    tocs = toc.render(toc.lines(S.numbered(S.chunks(spark, sf)))).select("canonical", "toc")
    line = F.concat(F.col("found").cast("string"), F.lit(" documents, first "), F.coalesce("first_source", F.lit("-"))).alias("stats")
    counted = statistical_flow(spark, sf).join(flags.where("statistical").select("query_id"), "query_id", "left_semi").select("query_id", line)
    context = flags.select("query_id", F.concat(F.lit("question "), F.col("query_id").cast("string")).alias("context"))
    return skills.injected(context, named, tocs, counted).join(flags, "query_id").select("query_id", "summary", "statistical", F.md5("context").alias("digest"))
