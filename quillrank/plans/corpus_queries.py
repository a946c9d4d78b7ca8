"""Queries of corpus building, query understanding and answer contexts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..operators import context, corpus, fusion, graph, intent, toc
from ..sources import tables as S
from . import inputs
from . import sql as Q
from .registry import Rows, query, quote
from .retrieval_queries import _RRF, lists
from .text_queries import ASKED, TITLES

LONG = "::BIGINT"
ARTICLES = inputs.articles([
    ("a1", "Điều 1. Phạm vi\nLời dẫn\n1. Khoản một:\na) Điểm a;\nb) Điểm b\ntiếp b;\nđ) Điểm đ\n2. Khoản hai\n10. Khoản mười", "1", False, "Điều 1. Phạm vi", "x.json"),
    ("a2", "Điều 2. Không khoản\nChỉ một đoạn", "2", False, "Điều 2. Sửa đổi, bổ sung", "x.json"),
    ("a3", "Điều 1. Sửa đổi\nLời mở đầu\n1. Sửa đổi, bổ sung Điều 3 như sau:\nnội dung\n2. Bãi bỏ khoản 2 Điều 16a.\n3. Không liên quan", "1", None, "Điều 1. Sửa đổi một số điều", "y.json"),
    ("a4", "Căn cứ Luật Giáo dục", "CAN_CU", True, "Căn cứ", "y.json"), ("a5", "", "", None, "", "z.json"),
])
_BODY = "array_to_string(string_split(full_text, chr(10))[2:], chr(10))"


def _parts(source: str, body: str, head: str, keep: str) -> str:
    """Lines grouped under header lines: (keep, part, first line number, text)."""
    return f"""ln AS (SELECT {keep}, generate_subscripts(l, 1) AS n, unnest(l) AS line FROM (SELECT {keep}, string_split({body}, chr(10)) AS l FROM {source})),
pt AS (SELECT *, sum(regexp_matches(line, '{head}')::INT) OVER (PARTITION BY {keep} ORDER BY n) AS part FROM ln),
parts AS (SELECT {keep}, part, string_agg(line, chr(10) ORDER BY n) AS body FROM pt WHERE part > 0 GROUP BY {keep}, part)"""


@query("clause_split", f"""WITH {_parts(ARTICLES.sql, _BODY, '^[0-9]+[.][ ]', 'id')}
SELECT id, regexp_extract(body, '^(\\d+)\\.', 1) AS clause_id, trim(regexp_replace(body, '^\\d+\\.\\s+|\\n+$', '', 'g')) AS text FROM parts""")
def clause_split(spark, sf):
    return corpus.clauses(ARTICLES.df(spark, sf))


@query("point_split", f"""WITH c0 AS (WITH {_parts(ARTICLES.sql, _BODY, '^[0-9]+[.][ ]', 'id')}
SELECT id, regexp_extract(body, '^(\\d+)\\.', 1) AS clause_id, trim(regexp_replace(body, '^\\d+\\.\\s+|\\n+$', '', 'g')) AS text FROM parts),
{_parts('c0', 'text', '^[a-zđ][)][ ]', 'id, clause_id')}
SELECT id, clause_id, regexp_extract(body, '^([a-zđ])\\)', 1) AS label, trim(regexp_replace(body, '^[a-zđ]\\)\\s+|\\n+$', '', 'g')) AS text FROM parts""")
def point_split(spark, sf):
    return corpus.points(corpus.clauses(ARTICLES.df(spark, sf)))


@query("chunk_statistics", f"""WITH {_parts(ARTICLES.sql, _BODY, '^[0-9]+[.][ ]', 'id')}, n AS (SELECT id, count(*) AS n FROM parts GROUP BY id),
c0 AS (SELECT id, part AS clause_id, trim(regexp_replace(body, '^\\d+\\.\\s+|\\n+$', '', 'g')) AS text FROM parts),
pp AS (SELECT id, clause_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^[a-zđ][)][ ]'))) AS points FROM c0)
SELECT count(*){LONG} AS n_articles, count(*) FILTER (WHERE n IS NULL){LONG} AS n_without, coalesce(sum(n), 0){LONG} AS n_clauses, coalesce((SELECT sum(points) FROM pp), 0){LONG} AS n_points FROM {ARTICLES.sql} a LEFT JOIN n USING (id)""")
def chunk_statistics(spark, sf):
    a = ARTICLES.df(spark, sf)
    n = corpus.clauses(a).groupBy("id").agg(F.count("*").alias("n"))
    points = corpus.points(corpus.clauses(a)).agg(F.count("*").alias("n_points"))
    return a.join(n, "id", "left").agg(F.count("*").alias("n_articles"), F.count_if(F.col("n").isNull()).alias("n_without"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_clauses")).join(points, F.lit(True))


_AMEND = "^(\\d+)\\.\\s*(?:Sửa đổi|Bổ sung|Bãi bỏ).*?Điều\\s*(\\d+[a-z]?)"


@query("amendment_split", f"""WITH ln AS (SELECT id, generate_subscripts(l, 1) AS n, unnest(l) AS line FROM (SELECT id, string_split(full_text, chr(10)) AS l FROM {ARTICLES.sql})),
pt AS (SELECT *, nullif(regexp_extract(line, '{_AMEND}', 2), '') AS target FROM ln), gr AS (SELECT *, sum((target IS NOT NULL)::INT) OVER (PARTITION BY id ORDER BY n){LONG} AS part FROM pt)
SELECT id, part, coalesce(max(target), 'Lời dẫn/Mở đầu') AS target, string_agg(line, chr(10) ORDER BY n) AS text FROM gr GROUP BY id, part""")
def amendment_split(spark, sf):
    return corpus.amendments(ARTICLES.df(spark, sf))


@query("legal_basis", f"SELECT id, CASE WHEN is_base OR article_number = 'CAN_CU' THEN 'basis' ELSE 'article' END AS prompt FROM {ARTICLES.sql}")
def legal_basis(spark, sf):
    base = F.coalesce("is_base", F.lit(False)) | (F.col("article_number") == "CAN_CU")
    return ARTICLES.df(spark, sf).select("id", F.when(base, "basis").otherwise("article").alias("prompt"))


@query("amendment_files", f"SELECT id, file FROM {ARTICLES.sql} QUALIFY count(*) OVER (PARTITION BY file) < 15 AND (contains(title, 'Sửa đổi') OR contains(title, 'Bổ sung'))")
def amendment_files(spark, sf):
    n = F.count("*").over(Window.partitionBy("file"))
    return ARTICLES.df(spark, sf).withColumn("n", n).where((F.col("n") < 15) & (F.contains(F.col("title"), F.lit("Sửa đổi")) | F.contains(F.col("title"), F.lit("Bổ sung")))).select("id", "file")


#: A document's lines by length: up to two words are a chapter's heading, up to five a section's; longer ones that start with A to M open an article.
_words = lambda c: F.size(F.split(c, " "))
BY_LENGTH = {
    "chapter": lambda c: (c != "") & (_words(c) <= 2),
    "section": lambda c: _words(c).between(3, 5),
    "article": lambda c: (_words(c) > 5) & F.substring(c, 1, 1).between("A", "M"),
}
_FILL = """l AS (SELECT doc_id AS page_id, no - 1 AS line_no, l[no] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS no FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
m AS (SELECT page_id, line_no, line, line <> '' AND n <= 2 AS c, n BETWEEN 3 AND 5 AS s, n > 5 AND substr(line, 1, 1) BETWEEN 'A' AND 'M' AS a FROM (SELECT *, len(string_split(line, ' ')) AS n FROM l)),
f AS (SELECT *, coalesce(last_value(CASE WHEN c THEN line END IGNORE NULLS) OVER w, '') AS chapter, last_value(CASE WHEN s THEN line END IGNORE NULLS) OVER w AS sl, max(CASE WHEN c THEN line_no END) OVER w AS cn,
  max(CASE WHEN s THEN line_no END) OVER w AS sn, last_value(CASE WHEN a THEN line_no END IGNORE NULLS) OVER w AS article_no FROM m WINDOW w AS (PARTITION BY page_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
filled AS MATERIALIZED (SELECT page_id, article_no, arg_min(chapter, line_no) AS chapter, arg_min(CASE WHEN coalesce(sn, -1) > coalesce(cn, -1) THEN sl ELSE '' END, line_no) AS section, string_agg(line, chr(10) ORDER BY line_no) AS full_text
FROM f WHERE article_no IS NOT NULL AND NOT c AND NOT s GROUP BY page_id, article_no)"""
_ARTICLES = _FILL + """, arts AS MATERIALIZED (SELECT 'node:' || page_id || '_D' || article AS node_id, page_id::VARCHAR AS canonical, chapter, section, article, substr(trim(string_split(full_text, chr(10))[1]), 1, 120) AS name, full_text
  FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY article_no) AS article FROM filled))"""


def filled(spark, sf):
    line = F.posexplode(F.split(T.text(F.col("text")), "\n")).alias("line_no", "line")
    return corpus.articles(S.load(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), line).withColumn("line_no", F.col("line_no").cast("bigint")), BY_LENGTH, first="")


@query("segment_fill", f"WITH {_FILL} SELECT page_id, article_no, chapter, section, full_text FROM filled")
def segment_fill(spark, sf):
    return filled(spark, sf)


_SECTIONED = f"""{_ARTICLES}, hung AS (SELECT 'sec:' || canonical || ':' || section AS sec, arg_min(canonical, node_id) AS canonical, arg_min(chapter, node_id) AS chapter FROM arts WHERE section <> '' GROUP BY ALL),
up AS (SELECT node_id AS a, 'doc:' || canonical AS b, 'THUOC_VAN_BAN' AS t FROM arts UNION ALL SELECT node_id, 'chap:' || canonical || ':' || chapter, 'THUOC_CHUONG' FROM arts WHERE chapter <> ''
  UNION ALL SELECT DISTINCT 'chap:' || canonical || ':' || chapter, 'doc:' || canonical, 'THUOC_VAN_BAN' FROM arts WHERE chapter <> '' UNION ALL SELECT node_id, 'sec:' || canonical || ':' || section, 'THUOC_MUC' FROM arts WHERE section <> ''
  UNION ALL SELECT sec, CASE WHEN chapter <> '' THEN 'chap:' || canonical || ':' || chapter ELSE 'doc:' || canonical END, CASE WHEN chapter <> '' THEN 'THUOC_CHUONG' ELSE 'THUOC_VAN_BAN' END FROM hung),
edges AS MATERIALIZED (SELECT a AS src, b AS dst, t AS type FROM up UNION ALL SELECT b, a, 'REV_' || t FROM up)"""


@query("section_edges", f"WITH {_SECTIONED} SELECT src, dst, type FROM edges")
def section_edges(spark, sf):
    return graph.structure(corpus.as_chunks(filled(spark, sf)))


@query("section_parents", f"""WITH {_SECTIONED}, p AS (SELECT src, type, min(dst) AS dst FROM edges WHERE type IN ('THUOC_VAN_BAN', 'THUOC_CHUONG', 'THUOC_MUC') AND starts_with(src, 'node:') GROUP BY ALL)
SELECT src, max(dst) FILTER (WHERE type = 'THUOC_VAN_BAN') AS document, max(dst) FILTER (WHERE type = 'THUOC_CHUONG') AS chapter, max(dst) FILTER (WHERE type = 'THUOC_MUC') AS section FROM p GROUP BY src""")
def section_parents(spark, sf):
    """The first parent of each kind; a missing one is null."""
    return graph.parents(section_edges(spark, sf).where(F.col("src").startswith("node:")))


@query("toc_sections", f"""WITH {_ARTICLES}, n AS (SELECT canonical, node_id, article, name, nullif(chapter, '') AS chapter, nullif(section, '') AS section FROM arts WHERE NOT contains(node_id, '_CAN_CU')),
c AS (SELECT *, coalesce(chapter <> coalesce(last_value(chapter IGNORE NULLS) OVER (PARTITION BY canonical ORDER BY article ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''), false) AS new_chapter FROM n),
r AS (SELECT *, sum(new_chapter::INT) OVER (PARTITION BY canonical ORDER BY article) AS run FROM c),
s AS (SELECT *, coalesce(section <> coalesce(last_value(section IGNORE NULLS) OVER (PARTITION BY canonical, run ORDER BY article ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''), false) AS new_section,
  last_value(section IGNORE NULLS) OVER (PARTITION BY canonical, run ORDER BY article) IS NOT NULL AS in_section FROM r)
SELECT canonical, node_id, (article - 1)::BIGINT AS place, new_chapter, new_section, CASE WHEN new_chapter THEN chr(10) || chapter || chr(10) ELSE '' END || CASE WHEN new_section THEN '  ' || section || chr(10) ELSE '' END
  || CASE WHEN in_section THEN '    - ' ELSE '  - ' END || name AS line FROM s""")
def toc_sections(spark, sf):
    return toc.outline(corpus.as_chunks(filled(spark, sf)))


@query("html_lines")
def html_lines(spark, sf):
    return corpus.html_lines(S.load(spark, sf, "pages"))


@query("stale_filter", "SELECT page_id FROM pages WHERE NOT contains(html, 'the') ")
def stale_filter(spark, sf):
    """Pages that don't have a given status text."""
    return S.load(spark, sf, "pages").where(~F.contains(F.col("html"), F.lit("the"))).select("page_id")


_CRAWL = """WITH RECURSIVE p AS (SELECT page_id, html, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host, split_part(regexp_extract(html, '<h1>([^<]*)</h1>', 1), ' ', 1) AS head FROM pages),
l AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '<a href="/([^"]*)"', 1)) AS name FROM p),
r AS (SELECT min(page_id) AS page_id FROM p GROUP BY host UNION SELECT p.page_id FROM r JOIN l ON l.page_id = r.page_id JOIN p ON p.head = l.name WHERE l.name <> ''),
i AS (SELECT page_id, x AS place, trim(regexp_replace(m, '<[^>]*>', '', 'g')) AS title FROM (SELECT page_id, unnest(range(len(f))) AS x, unnest(f) AS m FROM (SELECT page_id, regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1) AS f FROM p)))"""


@query("paged_crawl", f"{_CRAWL} SELECT page_id, count(i.page_id){LONG} AS n_items FROM r LEFT JOIN (SELECT * FROM i WHERE title <> '') i USING (page_id) GROUP BY page_id")
def paged_crawl(spark, sf):
    """The pages that each host's first page leads to, link by link, and how many list items they have."""
    pages = S.load(spark, sf, "pages")
    seeds = pages.groupBy(F.regexp_extract("url", "^https?://([^/?#]*)", 1)).agg(F.min("page_id").alias("page_id"))
    reached = corpus.crawl(*corpus.page_links(pages), seeds)
    n = corpus.items(pages).groupBy("page_id").agg(F.count("*").alias("n_items"))
    return reached.join(n, "page_id", "left").select("page_id", F.coalesce("n_items", F.lit(0)).alias("n_items"))


@query("crawl_links", """SELECT page_id, len(regexp_extract_all(html, '<a href="([^"]*)"', 1))::BIGINT AS n_links, len(regexp_extract_all(html, '<li>', 0))::BIGINT AS n_items FROM pages""")
def crawl_links(spark, sf):
    count = lambda p, g: F.size(F.regexp_extract_all("html", F.lit(p), F.lit(g))).cast("bigint")
    return S.load(spark, sf, "pages").select("page_id", count('<a href="([^"]*)"', 1).alias("n_links"), count("<li>", 0).alias("n_items"))


# --- Query understanding ------------------------------------------------------------------------

_q = "lower(trim(query))"
_has = lambda n: Q.any_of(_q, K.INTENT_KEYWORDS[n])
_FAST = f"""CASE WHEN length({_q}) < 30 AND ({' OR '.join(f'starts_with({_q}, {quote(g)})' for g in K.INTENT_KEYWORDS['GREETING'])}) THEN 'GREETING' WHEN length({_q}) < 40 AND {_has('THANKS')} THEN 'THANKS' END"""
_LEGAL = " + ".join(f"contains({_q}, {quote(w)})::INT" for w in K.LEGAL_KEYWORDS)


@query("intent_cascade", f"""SELECT query_id, coalesce({_FAST}, CASE WHEN {_has('SUMMARY')} THEN 'SUMMARY' WHEN {_has('STATISTICAL')} THEN CASE WHEN {Q.any_of(_q, K.LOOKUP_CONTEXT)} THEN 'LOOKUP' WHEN {_has('UNANSWERABLE')} THEN 'UNANSWERABLE' ELSE 'STATISTICAL' END
  WHEN {_has('LISTING')} THEN 'LISTING' WHEN {_has('COMPARISON')} THEN 'COMPARISON' ELSE 'LOOKUP' END) AS intent,
  {_FAST} IS NOT NULL OR {_has('SUMMARY')} OR {_has('STATISTICAL')} OR {_has('LISTING')} OR {_has('COMPARISON')} OR (({_LEGAL}) >= 2 AND length({_q}) > 20) AS decided FROM {ASKED.sql}""")
def intent_cascade(spark, sf):
    return ASKED.df(spark, sf).select("query_id", intent.intent(F.col("query")).alias("intent"), intent.decided(F.col("query")).alias("decided"))


_INTENT = f"""coalesce({_FAST}, CASE WHEN {_has('SUMMARY')} THEN 'SUMMARY' WHEN {_has('STATISTICAL')} THEN CASE WHEN {Q.any_of(_q, K.LOOKUP_CONTEXT)} THEN 'LOOKUP' WHEN {_has('UNANSWERABLE')} THEN 'UNANSWERABLE' ELSE 'STATISTICAL' END END)"""


@query("instant_answers", f"""WITH i AS (SELECT query_id, {_INTENT} AS intent FROM {ASKED.sql})
SELECT query_id, CASE intent {' '.join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in K.REPLIES.items())} END AS answer FROM i""")
def instant_answers(spark, sf):
    """Replies to questions that need no search; null for the others."""
    return ASKED.df(spark, sf).select("query_id", intent.instant_reply(F.col("query")).alias("answer"))


_pat = lambda ps: f"regexp_matches({_q}, {quote('|'.join(f'(?:{p})' for p in ps))})"


@query("question_patterns", f"SELECT query_id, {_pat(K.SUMMARY_PATTERNS)} AS summary, {_pat(K.STATISTICAL_PATTERNS)} AS statistical FROM {ASKED.sql}")
def question_patterns(spark, sf):
    q = F.lower(F.trim("query"))
    return ASKED.df(spark, sf).select("query_id", T.matches_any(q, K.SUMMARY_PATTERNS).alias("summary"), T.matches_any(q, K.STATISTICAL_PATTERNS).alias("statistical"))


@query("year_type_extract", f"""SELECT query_id, nullif(regexp_extract({_q}, '(20\\d{{2}})', 1), '') AS year, CASE WHEN contains({_q}, 'nghị định') THEN 'Nghị định' WHEN contains({_q}, 'thông tư') THEN 'Thông tư' WHEN contains({_q}, 'luật') THEN 'Luật' END AS doc_type FROM {ASKED.sql}""")
def year_type_extract(spark, sf):
    year, kind = intent.year_and_type(F.col("query"))
    return ASKED.df(spark, sf).select("query_id", year.alias("year"), kind.alias("doc_type"))


EXPANSIONS = Rows("ord int, keywords array<string>, expansion string", [(0, ["học phí", "bồi hoàn"], "mức thu học phí"), (1, ["hiệu trưởng"], "nhiệm kỳ hiệu trưởng"), (2, ["giáo viên", "nhà giáo"], "chuẩn nghề nghiệp")])


@query("query_expansion", f"SELECT query_id, ord, query || ' ' || expansion AS expanded FROM {ASKED.sql} q, {EXPANSIONS.sql} e WHERE len(list_filter(keywords, lambda k: contains(lower(query), k))) > 0")
def query_expansion(spark, sf):
    return intent.expansions(ASKED.df(spark, sf), EXPANSIONS.df(spark, sf))


ROUTES = Rows("ord int, cond int, keywords array<string>, requires array<string>, match string, targets array<string>", [
    row for o, words, targets, conds in K.ROUTING_RULES for row in ([(o, -1, words, [], "all", targets)] if targets else []) + [(o, c, words, req, how, t) for c, req, how, t in conds]
])
_CLEAN = "trim(regexp_replace(lower(title), '" + K.TITLE_LEAD + "', ''))"
_KEYS = f"list_filter(string_split_regex({_CLEAN}, '\\s+'), lambda w: w <> '' AND NOT list_contains([{', '.join(quote(w) for w in K.TITLE_STOP_WORDS)}], w))"


@query("target_routing", f"""WITH q AS (SELECT query_id, lower(query) AS q FROM {ASKED.sql}),
n AS (SELECT query_id, -1 AS a, -1 AS b, ord AS c, so_hieu AS target FROM q, {TITLES.sql} WHERE length({_CLEAN}) >= 15 AND len({_KEYS}) >= 4 AND (len(list_filter({_KEYS}, lambda w: contains(q, w)))::DOUBLE / len({_KEYS}) >= 0.8 OR (length({_CLEAN}) > 20 AND contains(q, {_CLEAN})))),
r AS (SELECT query_id, ord AS a, cond AS b, generate_subscripts(targets, 1) - 1 AS c, unnest(targets) AS target FROM q, {ROUTES.sql} WHERE len(list_filter(keywords, lambda k: contains(q, k))) > 0
  AND (len(requires) = 0 OR CASE WHEN match = 'any' THEN len(list_filter(requires, lambda k: contains(q, k))) > 0 ELSE len(list_filter(requires, lambda k: contains(q, k))) = len(requires) END)),
o AS (SELECT * FROM (SELECT * FROM n UNION ALL SELECT * FROM r) QUALIFY row_number() OVER (PARTITION BY query_id, target ORDER BY a, b, c) = 1)
SELECT query_id, target, (row_number() OVER (PARTITION BY query_id ORDER BY a, b, c) - 1){LONG} AS place FROM o""")
def target_routing(spark, sf):
    return intent.targets(ASKED.df(spark, sf), TITLES.df(spark, sf), ROUTES.df(spark, sf))


REFLECT = inputs.reflections([(0, [1, 2, 3], [1]), (1, [1, 2], [1, 2, 5]), (2, [4], []), (3, [1, 2, 3, 4], [1, 2])])


@query("reflection_trigger", f"SELECT id, len(list_filter(list_distinct(original), lambda x: NOT list_contains(answered, x)))::DOUBLE / len(list_distinct(original)) > 0.5 AS again FROM {REFLECT.sql}")
def reflection_trigger(spark, sf):
    return REFLECT.df(spark, sf).select("id", (F.size(F.array_except("original", "answered")) / F.size(F.array_distinct("original")) > 0.5).alias("again"))


# --- Contexts -----------------------------------------------------------------------------------

_SIZED = f"{_RRF}, s AS (SELECT query_id, rank AS place, node_id, least(length(full_text), 4000){LONG} AS size FROM rrf JOIN chunks USING (node_id))"


def sized(spark, sf):
    docs = S.chunks(spark, sf).select("node_id", F.least(F.length("full_text"), F.lit(4000)).cast("bigint").alias("size"))
    return fusion.rrf(lists(spark, sf)).join(docs, "node_id").select("query_id", F.col("rank").alias("place"), "node_id", "size")


@query("context_budget", f"WITH {_SIZED} SELECT query_id, place, node_id, size, used FROM (SELECT *, sum(size) OVER (PARTITION BY query_id ORDER BY place){LONG} AS used FROM s) WHERE used <= 16000")
def context_budget(spark, sf):
    return context.within_budget(sized(spark, sf), 16_000).select("query_id", "place", "node_id", "size", "used")


_SIZES = f"""z AS (SELECT canonical, sum(length(name)){LONG} AS names, sum(length({Q.snippet('full_text', 200)})){LONG} AS large, sum(length({Q.snippet('full_text', 100)})){LONG} AS small FROM chunks GROUP BY canonical)"""


@query("toc_budget", f"""WITH {_RRF}, {_SIZES}, r AS (SELECT query_id, canonical, min(rank) AS first FROM rrf JOIN chunks USING (node_id) GROUP BY ALL),
t AS (SELECT query_id, canonical, names + large AS a, names + small AS b, row_number() OVER (PARTITION BY query_id ORDER BY first) AS place FROM r JOIN z USING (canonical) QUALIFY place <= 3),
p AS (SELECT query_id, max(canonical) FILTER (WHERE place = 1) AS c1, max(a) FILTER (WHERE place = 1) AS n1, max(canonical) FILTER (WHERE place = 2) AS c2, max(a) FILTER (WHERE place = 2) AS a2, max(b) FILTER (WHERE place = 2) AS b2,
  max(canonical) FILTER (WHERE place = 3) AS c3, max(a) FILTER (WHERE place = 3) AS a3, max(b) FILTER (WHERE place = 3) AS b3 FROM t GROUP BY query_id),
q AS (SELECT *, CASE WHEN n1 < 10000 THEN a2 ELSE b2 END AS n2 FROM p), s AS (SELECT *, coalesce(n1 + n2 <= 25000, false) AS take2 FROM q),
u AS (SELECT *, n1 + CASE WHEN take2 THEN n2 ELSE 0 END AS used2 FROM s), v AS (SELECT *, CASE WHEN used2 < 10000 THEN a3 ELSE b3 END AS n3 FROM u), w AS (SELECT *, coalesce(used2 + n3 <= 25000, false) AS take3 FROM v)
SELECT query_id, list_filter([c1, CASE WHEN take2 THEN c2 END, CASE WHEN take3 THEN c3 END], lambda x: x IS NOT NULL) AS documents, (used2 + CASE WHEN take3 THEN n3 ELSE 0 END){LONG} AS used FROM w""")
def toc_budget(spark, sf):
    """The tables of contents of an item's first three documents that fit into a prompt; snippets shrink past 10,000 characters."""
    chunks = S.chunks(spark, sf)
    size = lambda n: F.sum(F.length(T.snippet(F.col("full_text"), n)))
    sizes = chunks.groupBy("canonical").agg(F.sum(F.length("name")).alias("names"), size(200).alias("large"), size(100).alias("small"))
    first = fusion.rrf(lists(spark, sf)).join(chunks.select("node_id", "canonical"), "node_id").groupBy("query_id", "canonical").agg(F.min("rank").alias("first"))
    return fusion.prompt_budget(first.join(sizes, "canonical").select("query_id", "canonical", "first", (F.col("names") + F.col("large")).alias("large"), (F.col("names") + F.col("small")).alias("small")))


@query("context_blocks", f"""WITH {_RRF}, b AS (SELECT query_id, rank AS place, '[' || (rank + 1) || '] ' || concat_ws(' > ', canonical, chapter) || ' (Hiệu lực: ' || canonical || ')' || CASE WHEN chapter = 'de' THEN ' [ĐÃ SỬA ĐỔI]' ELSE '' END || chr(10) ||
  CASE WHEN length(full_text) > 4000 THEN substr(full_text, 1, 4000) || '...' ELSE full_text END AS block FROM rrf JOIN chunks USING (node_id) WHERE rank < 5)
SELECT query_id, md5(string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY place)) AS digest FROM b GROUP BY query_id""")
def context_blocks(spark, sf):
    docs = fusion.rrf(lists(spark, sf)).where("rank < 5").join(S.chunks(spark, sf), "node_id")
    status = F.when(F.col("chapter") == "de", "da_sua_doi").otherwise("con_hieu_luc")
    made = context.block(F.col("rank"), F.concat_ws(" > ", "canonical", "chapter"), F.col("canonical"), status, F.col("full_text"))
    return context.assemble(docs.select("query_id", F.col("rank").alias("place"), made.alias("block"))).select("query_id", F.md5("context").alias("digest"))


@query("hierarchical_context", f"WITH {Q.CHUNKS} SELECT DISTINCT '[' || concat_ws(' -> ', nullif(canonical, ''), nullif(chapter, ''), nullif(name, '')) || ']' || chr(10) || full_text || chr(10) AS block FROM chunks")
def hierarchical_context(spark, sf):
    part = [F.nullif(F.col(c), F.lit("")) for c in ("canonical", "chapter", "name")]
    block = F.concat(F.lit("["), F.concat_ws(" -> ", *part), F.lit("]\n"), "full_text", F.lit("\n"))
    return S.chunks(spark, sf).select(block.alias("block")).distinct()


OUTPUTS = inputs.outputs([
    (0, '<selected_clauses>[{"so_hieu": "43/2019/QH14", "dieu": 12}]</selected_clauses>'), (1, '```json\n[{"so_hieu": "71/2020", "dieu": "16a"}, {"so_hieu": "08/2023", "dieu": 1}]\n```'),
    (2, "[{'so_hieu': '22/2021', 'dieu': 3}]"), (3, 'text {"so_hieu": "05/2023", "dieu": 7} and {"so_hieu": "06", "dieu": "8"} tail'), (4, "nothing"),
])
_TAG = "coalesce(nullif(regexp_extract(output, '(?s)<selected_clauses>(.*?)</selected_clauses>', 1), ''), output)"
_PLAIN = f"replace({_TAG}, '''', '\"')"
_FOUND = f"""regexp_extract_all({_PLAIN}, '"so_hieu"\\s*:\\s*"[^"]*"\\s*,\\s*"dieu"\\s*:\\s*"?[^",}}\\]]+"?')"""


@query("selection_parse", f"""SELECT id, pos, trim(regexp_extract(m, '"so_hieu"\\s*:\\s*"([^"]*)"', 1)) AS so_hieu, trim(regexp_extract(m, '"dieu"\\s*:\\s*"?([^",}}\\]]+)"?', 1)) AS dieu
FROM (SELECT id, (generate_subscripts(f, 1) - 1)::INTEGER AS pos, unnest(f) AS m FROM (SELECT id, {_FOUND} AS f FROM {OUTPUTS.sql}))""")
def selection_parse(spark, sf):
    return OUTPUTS.df(spark, sf).select("id", F.posexplode(context.selection(F.col("output"))).alias("pos", "s")).select("id", "pos", "s.so_hieu", "s.dieu")


@query("citation_rewrite")
def citation_rewrite(spark, sf):
    """Numbers in brackets become document names, in a fixed answer for each source."""
    src = S.load(spark, sf, "documents").groupBy("source").agg(F.max("lang").alias("lang"))
    sources = F.array(F.struct(F.col("source").alias("name"), F.lit("5").alias("article")), F.struct(F.col("lang").alias("name"), F.lit(None).cast("string").alias("article")))
    return src.select("source", context.rewrite_citations(F.lit("See [1], [2, khoản 3], [2] and [9]."), sources).alias("answer"))


@query("answer_sources", f"""WITH {Q.CHUNKS}, {Q.NUMBERED} SELECT node_id AS doc_id, canonical AS so_hieu, name AS ten_van_ban, article AS so_dieu, concat_ws(' > ', nullif(canonical, ''), nullif(chapter, ''), nullif(name, '')) AS breadcrumb,
  CASE WHEN toxic = 1 THEN 'bi_bai_bo' WHEN quality = 0 THEN 'da_sua_doi' ELSE 'con_hieu_luc' END AS tinh_trang, full_text AS content FROM numbered LEFT JOIN labels USING (doc_id)""")
def answer_sources(spark, sf):
    """Every chunk as a source of an answer, with its status."""
    status = F.when(F.col("toxic") == 1, "bi_bai_bo").when(F.col("quality") == 0, "da_sua_doi").otherwise("con_hieu_luc")
    rows = S.numbered(S.chunks(spark, sf)).join(S.load(spark, sf, "labels"), "doc_id", "left")
    return context.sources(rows.withColumn("status", status))


_WARNED = f"""{_RRF}, w AS (SELECT query_id, bool_or(coalesce(quality = 0 AND toxic = 0, false)) AS any_amended, count(*){LONG} AS n FROM rrf JOIN chunks USING (node_id) LEFT JOIN labels USING (doc_id) WHERE rank < 5 GROUP BY query_id)"""


@query("amended_warning", f"WITH {_WARNED} SELECT query_id, any_amended, n FROM w")
def amended_warning(spark, sf):
    """Whether an answer has to warn that one of its five sources was amended."""
    docs = fusion.rrf(lists(spark, sf)).where("rank < 5").join(S.chunks(spark, sf).select("node_id", "doc_id"), "node_id").join(S.load(spark, sf, "labels"), "doc_id", "left")
    amended = F.coalesce((F.col("quality") == 0) & (F.col("toxic") == 0), F.lit(False))
    return docs.groupBy("query_id").agg(F.bool_or(amended).alias("any_amended"), F.count("*").alias("n"))
