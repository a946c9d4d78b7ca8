"""Queries of graph, table-of-contents, catalog and reference operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..operators import catalog, graph, lexical, resolve, toc, vector
from ..sources import tables as S
from . import inputs
from . import sql as Q
from .registry import Rows, query, quote
from .text_queries import SOURCES

LONG = "::BIGINT"
_STRUCTURE = f"""{Q.CHUNKS}, u AS (SELECT node_id AS a, 'doc:' || canonical AS b, 'THUOC_VAN_BAN' AS t FROM chunks UNION ALL SELECT node_id, 'chap:' || canonical || ':' || chapter, 'THUOC_CHUONG' FROM chunks WHERE chapter <> ''
  UNION ALL SELECT DISTINCT 'chap:' || canonical || ':' || chapter, 'doc:' || canonical, 'THUOC_VAN_BAN' FROM chunks WHERE chapter <> ''), edges AS (SELECT a AS src, b AS dst, t AS type FROM u UNION ALL SELECT b, a, 'REV_' || t FROM u)"""


@query("structural_edges", f"WITH {_STRUCTURE} SELECT src, dst, type FROM edges")
def structural_edges(spark, sf):
    return graph.structure(S.chunks(spark, sf))


@query("typed_neighbour", f"WITH {_STRUCTURE} SELECT src, min(dst) AS dst FROM edges WHERE type = 'THUOC_CHUONG' GROUP BY src")
def typed_neighbour(spark, sf):
    return graph.first_neighbour(graph.structure(S.chunks(spark, sf)), "THUOC_CHUONG")


#: Each item starts from the chunk of its own number and from a chapter.
_SEEDS = "seeds AS (SELECT item_id AS query_id, 'node:' || item_id AS node FROM benchmark UNION ALL SELECT item_id, 'chap:src' || (item_id % 20) || ':en' FROM benchmark WHERE item_id % 4 = 0)"


def seeds(spark, sf):
    i = F.col("query_id")
    asked = S.query_texts(spark, sf)
    chapter = F.concat(F.lit("chap:src"), (i % 20).cast("string"), F.lit(":en"))
    return asked.select(i, F.concat(F.lit("node:"), i.cast("string")).alias("node")).union(asked.where(i % 4 == 0).select(i, chapter))


def _hops(n: int) -> str:
    out = [_STRUCTURE, _SEEDS, "h0 AS (SELECT DISTINCT query_id, node, 0 AS hop FROM seeds)", "all0 AS (SELECT * FROM h0)"]
    for i in range(1, n + 1):
        out.append(f"h{i} AS (SELECT DISTINCT h.query_id, e.dst AS node, {i} AS hop FROM h{i - 1} h JOIN edges e ON e.src = h.node WHERE NOT EXISTS (SELECT 1 FROM all{i - 1} o WHERE o.query_id = h.query_id AND o.node = e.dst))")
        out.append(f"all{i} AS (SELECT * FROM all{i - 1} UNION ALL SELECT * FROM h{i})")
    return f"WITH {', '.join(out)} SELECT query_id, node, hop FROM all{n}"


@query("hop1_expand", _hops(1))
def hop1_expand(spark, sf):
    return graph.expand(seeds(spark, sf), graph.structure(S.chunks(spark, sf)), 1)


@query("hop2_expand", _hops(2))
def hop2_expand(spark, sf):
    return graph.expand(seeds(spark, sf), graph.structure(S.chunks(spark, sf)), 2)


def mapped(spark, sf):
    return S.load(spark, sf, "labels").select(F.concat(F.lit("node:"), F.col("doc_id").cast("string")).alias("tree_node"))


@query("coverage_missing", "SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def coverage_missing(spark, sf):
    return graph.coverage(S.load(spark, sf, "documents"), mapped(spark, sf)).select("doc_id")


@query("coverage_by_group", f"""SELECT source, count(*){LONG} AS total, count(l.doc_id){LONG} AS covered, round(count(l.doc_id) * 100.0::DOUBLE / count(*), 2) AS percent
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY source""")
def coverage_by_group(spark, sf):
    marked = S.load(spark, sf, "labels").select("doc_id", F.lit(True).alias("hit")).distinct()
    covered = F.count("hit")
    return S.load(spark, sf, "documents").join(marked, "doc_id", "left").groupBy("source").agg(F.count("*").alias("total"), covered.alias("covered"), F.round(covered * 100.0 / F.count("*"), 2).alias("percent"))


@query("coverage_by_type", f"""SELECT lang AS type, count(*){LONG} AS total, count(l.doc_id){LONG} AS covered, count(*) FILTER (WHERE l.doc_id IS NULL){LONG} AS missing, round(count(l.doc_id) * 100.0::DOUBLE / count(*), 2) AS percent
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY ROLLUP (lang)""")
def coverage_by_type(spark, sf):
    """Covered and missing chunks of each type, and of all."""
    return graph.coverage_summary(S.load(spark, sf, "documents"), S.load(spark, sf, "labels"), "doc_id", "lang").withColumnRenamed("lang", "type")


@query("coverage_files", f"""SELECT source, count(*) FILTER (WHERE l.doc_id IS NULL){LONG} AS missing, count(*){LONG} AS total
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY source HAVING missing > 0 ORDER BY missing DESC, source LIMIT 20""")
def coverage_files(spark, sf):
    return graph.missing_by_file(S.load(spark, sf, "documents").select("doc_id", "source"), S.load(spark, sf, "labels"), "doc_id", "source")


# --- Tables of contents --------------------------------------------------------------------------


#: Documents without snippets: the fixed ones, and one of the given table's.
PLAIN = [*K.DISTRACTORS, "SRC7"]


def _toc(n: int) -> str:
    body = f"'- ' || name" + (f" || CASE WHEN {Q.any_of('upper(canonical)', PLAIN)} THEN '' ELSE ': ' || {Q.snippet('full_text', n)} END" if n else "")
    return f"""{Q.CHUNKS}, {Q.NUMBERED},
p AS (SELECT *, lag(nullif(chapter, '') IGNORE NULLS) OVER (PARTITION BY canonical ORDER BY coalesce(article, 0), node_id) AS before FROM numbered WHERE NOT contains(node_id, '_CAN_CU')),
l AS (SELECT canonical, node_id, (row_number() OVER (PARTITION BY canonical ORDER BY coalesce(article, 0), node_id) - 1){LONG} AS place, coalesce(nullif(chapter, '') <> coalesce(before, ''), false) AS heading, chapter, {body} AS body FROM p),
lines AS (SELECT canonical, node_id, place, heading, CASE WHEN heading THEN '## ' || chapter || chr(10) || body ELSE body END AS line FROM l)"""


@query("toc_lines", f"WITH {_toc(0)} SELECT canonical, node_id, place, heading, line FROM lines")
def toc_lines(spark, sf):
    return toc.lines(S.numbered(S.chunks(spark, sf)))


@query("toc_enriched", f"WITH {_toc(200)} SELECT canonical, md5(string_agg(line, chr(10) ORDER BY place) || chr(10) || '(' || count(*) || ' articles)') AS digest, count(*){LONG} AS n_articles FROM lines GROUP BY canonical")
def toc_enriched(spark, sf):
    return toc.render(toc.lines(S.numbered(S.chunks(spark, sf)), 200, PLAIN)).select("canonical", F.md5("toc").alias("digest"), "n_articles")


@query("toc_local", f"""WITH {Q.CHUNKS}, {Q.NUMBERED}, {Q.queries()}, a AS (SELECT canonical, node_id, article, name, {Q.tok('name')} AS t FROM numbered WHERE name <> '' AND NOT contains(node_id, '_CAN_CU')),
o AS (SELECT canonical, count(*) AS n, avg(len(t)) AS avgdl FROM a GROUP BY canonical), asked AS (SELECT query_id, 'src' || (query_id % 20) AS canonical, query FROM queries WHERE len({Q.tok('query')}) > 0),
tf AS (SELECT canonical, node_id, len(t) AS dl, term, count(*) AS tf FROM (SELECT *, unnest(t) AS term FROM a) GROUP BY ALL),
d AS (SELECT canonical, term, ln(n - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS raw, avgdl FROM tf JOIN o USING (canonical) GROUP BY canonical, term, n, avgdl),
idf AS (SELECT canonical, term, avgdl, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (sum(raw) OVER (PARTITION BY canonical) / count(*) OVER (PARTITION BY canonical)) ELSE raw END AS idf FROM d),
q AS (SELECT query_id, canonical, term, count(*) AS qtf FROM (SELECT query_id, canonical, unnest({Q.tok('query')}) AS term FROM asked) GROUP BY ALL),
s AS (SELECT query_id, canonical, node_id, round(sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM q JOIN idf USING (canonical, term) JOIN tf USING (canonical, term) GROUP BY ALL),
x AS (SELECT asked.query_id, canonical, a.node_id, article, n, CASE WHEN n > 15 THEN coalesce(score, 0) END AS score FROM asked JOIN a USING (canonical) JOIN o USING (canonical) LEFT JOIN s USING (query_id, canonical, node_id))
SELECT query_id, canonical, node_id, score, article FROM x QUALIFY n <= 15 OR row_number() OVER (PARTITION BY query_id, canonical ORDER BY score DESC, article, node_id) <= 20""")
def toc_local(spark, sf):
    """The part of a document's table of contents that a query is about."""
    asked = S.query_texts(spark, sf).withColumn("canonical", F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")))
    return toc.locally_ranked(S.numbered(S.chunks(spark, sf)), asked)


# --- Catalog ------------------------------------------------------------------------------------

FILES = inputs.files([
    ("a.json", "Luật Giáo dục", "43/2019/QH14", "CAN_CU", "Căn cứ", 0), ("a.json", "Luật Giáo dục", "43/2019/QH14", "2", "Điều 2. Đối tượng", 1), ("a.json", "Luật Giáo dục", "43/2019/QH14", "1", "Điều 1. Phạm vi", 2),
    ("b.json", "Nghị định 71/2020/NĐ-CP", "", "3", "", 0), ("b.json", "Nghị định 71/2020/NĐ-CP", "", "4", "Điều 4. Lộ trình", 1), ("c.json", "", "x", "1", "Không có nguồn", 0), ("d.json", "Thông tư liên tịch", None, "CAN_CU", "Căn cứ", 0),
])
_CATALOG = f"""f AS (SELECT * FROM {FILES.sql} WHERE source <> ''),
g AS (SELECT file, arg_min(source, ord) AS source, arg_min_null(so_hieu, ord) AS so_hieu, coalesce(arg_min(substr(full_text, 1, 300), ((article <> '1')::INTEGER, ord)) FILTER (WHERE full_text <> '' AND article <> 'CAN_CU'), '') AS summary FROM f GROUP BY file),
catalog AS (SELECT file, source, so_hieu, coalesce(nullif(so_hieu, ''), nullif(regexp_extract(source, '{Q.NUMBER}', 1), ''), source) AS canonical,
  CASE WHEN starts_with(lower(source), 'nghị định') THEN 'Nghị định' WHEN starts_with(lower(source), 'thông tư') THEN 'Thông tư' WHEN starts_with(lower(source), 'luật') THEN 'Luật' ELSE 'Khác' END AS doc_type,
  regexp_extract(coalesce(so_hieu, ''), '(\\d{{4}})', 1) AS year, summary FROM g)"""


@query("catalog_build", f"WITH {_CATALOG} SELECT file, source, so_hieu, canonical, doc_type, year, summary FROM catalog")
def catalog_build(spark, sf):
    return catalog.build(FILES.df(spark, sf))


@query("catalog_filter", f"WITH {_CATALOG} SELECT canonical FROM catalog WHERE lower(doc_type) = 'luật' AND year = '2019'")
def catalog_filter(spark, sf):
    return catalog.metadata_filter(catalog.build(FILES.df(spark, sf)), "LUẬT", "2019").select("canonical")


_SOURCES = """c AS (SELECT source AS id, row_number() OVER (ORDER BY source) AS ord, lang || ' ' || substr(text, 1, 300) AS text FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1),
cat AS (SELECT id, row_number() OVER (ORDER BY id)::INTEGER AS ord, text FROM c)"""


@query("catalog_query", f"""
WITH {_SOURCES}, {Q.queries()}, {Q.bm25('SELECT id AS node_id, text FROM cat')},
v AS (SELECT source AS id, arg_min(embedding, doc_id) AS e FROM documents JOIN embeddings ON vec_id = doc_id GROUP BY source),
dn AS (SELECT q.vec_id // 50 AS query_id, v.id, round(list_inner_product(v.e::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM v, embeddings q WHERE q.vec_id % 50 = 0),
dr AS (SELECT query_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM dn) WHERE rank < 40 AND score > 0.15),
sr AS (SELECT query_id, id, rank FROM (SELECT query_id, node_id AS id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) - 1 AS rank FROM bm25) WHERE rank < 40 AND score > 0),
fu AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (61 + rank)), 9) AS rrf FROM (SELECT * FROM dr UNION ALL SELECT * FROM sr) GROUP BY ALL),
best AS (SELECT query_id, id FROM fu QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, id) <= 20),
n AS (SELECT query_id, count(*) AS hits FROM best GROUP BY query_id),
asked AS (SELECT query_id FROM dn UNION SELECT query_id FROM bm25)
SELECT query_id, id, place FROM (SELECT asked.query_id, cat.id, (row_number() OVER (PARTITION BY asked.query_id ORDER BY ord) - 1){LONG} AS place FROM asked LEFT JOIN n USING (query_id), cat
  WHERE coalesce(hits, 0) < 3 OR EXISTS (SELECT 1 FROM best b WHERE b.query_id = asked.query_id AND b.id = cat.id)) WHERE place < 15""")
def catalog_query(spark, sf):
    from pyspark.sql import Window

    docs = S.load(spark, sf, "documents")
    first = docs.groupBy("source").agg(F.min_by(F.concat("lang", F.lit(" "), F.substring("text", 1, 300)), "doc_id").alias("text"))
    # One row for each document of the corpus: an ordered dimension table.
    cat = first.select(F.col("source").alias("id"), "text", F.row_number().over(Window.orderBy("source")).alias("ord"))
    v = docs.join(S.load(spark, sf, "embeddings"), F.col("vec_id") == F.col("doc_id")).groupBy("source").agg(F.min_by("embedding", "doc_id").alias("embedding"))
    dense = vector.scores(v, S.query_vectors(spark, sf), "source").withColumnRenamed("node_id", "id")
    sparse = lexical.bm25(cat, S.query_texts(spark, sf), "id", "text").withColumnRenamed("node_id", "id")
    return catalog.search(cat.select("id", "ord"), dense, sparse).select("query_id", "id", "place")


# --- References ---------------------------------------------------------------------------------

_CANON = f"coalesce(nullif(trim(coalesce(so_hieu, '')), ''), nullif(regexp_extract(source, '{Q.NUMBER}', 1), ''), source)"
_REGISTRY = f"""docs AS (SELECT id AS ord, source, {_CANON} AS canonical FROM {SOURCES.sql}),
forms AS (SELECT alias, arg_max(canonical, ord) AS canonical, max(ord) AS ord FROM (SELECT canonical, ord, unnest([canonical, lower(canonical), source, lower(source),
  CASE WHEN contains(canonical, '/') THEN string_split(canonical, '/')[1] || '/' || regexp_extract(string_split(canonical, '/')[2], '^([^-]*)', 1) END]) AS alias FROM docs) WHERE alias <> '' GROUP BY alias),
bare AS (SELECT alias, arg_min(canonical, ord) AS canonical, min(ord) AS ord FROM (SELECT canonical, ord, regexp_extract(canonical, '^(\\d+)', 1) AS alias FROM docs) WHERE length(alias) >= 2 GROUP BY alias),
registry AS (SELECT * FROM forms UNION ALL SELECT * FROM bare ANTI JOIN forms USING (alias))"""


def registry(spark, sf):
    return resolve.registry(SOURCES.df(spark, sf).withColumnRenamed("id", "ord"))


@query("registry_build", f"WITH {_REGISTRY} SELECT alias, canonical, ord FROM registry")
def registry_build(spark, sf):
    return registry(spark, sf)


REFS = inputs.references([("43/2019/QH14",), ("Luật số 43/2019/QH14 về giáo dục",), ("71/2020/ND-CP",), ("08/2023",), ("luật giáo dục đại học",), ("xyz",), ("34-2018-QH14",), ("71",), ("43/2019/qh14",), ("71-2020-NĐ-CP",), ("71/2020/",)])


@query("registry_resolve", f"""
WITH {_REGISTRY}, reg AS (SELECT *, {Q.bare('alias')} AS bare FROM registry), raw AS (SELECT raw, {Q.bare('raw')} AS norm FROM {REFS.sql}),
hits AS (SELECT raw, canonical, ord, alias, CASE WHEN alias = raw THEN 1 WHEN bare = norm THEN 2 WHEN length(bare) > 3 AND length(norm) > 3 AND (contains(norm, bare) OR contains(bare, norm)) THEN 3 END AS tier FROM raw, reg),
best AS (SELECT raw, canonical, tier FROM hits WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY raw ORDER BY tier, ord, alias) = 1)
SELECT raw, coalesce(canonical, raw) AS canonical, coalesce(tier, 4)::INTEGER AS tier FROM {REFS.sql} LEFT JOIN best USING (raw)""")
def registry_resolve(spark, sf):
    return resolve.resolve(REFS.df(spark, sf), registry(spark, sf))


@query("router_resolve", f"""
WITH {_REGISTRY}, hits AS (SELECT raw, canonical, ord, alias, CASE WHEN alias = raw THEN 1 WHEN alias = lower(raw) THEN 2 WHEN alias = translate(raw, '-/', '/-') THEN 3 WHEN starts_with(alias, raw) AND length(alias) - length(raw) < 5 THEN 4 END AS tier FROM {REFS.sql}, registry),
best AS (SELECT raw, canonical, tier FROM hits WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY raw ORDER BY tier, ord, alias) = 1)
SELECT raw, coalesce(canonical, raw) AS canonical, coalesce(tier, 5)::INTEGER AS tier FROM {REFS.sql} LEFT JOIN best USING (raw)""")
def router_resolve(spark, sf):
    return resolve.route(REFS.df(spark, sf), registry(spark, sf))


@query("evaluation_resolve", f"""
WITH {_REGISTRY}, k AS (SELECT canonical, ord, alias, {Q.norm('alias')} AS plain, {Q.bare('alias')} AS bare FROM registry), a AS (SELECT raw, {Q.norm('raw')} AS plain, {Q.bare('raw')} AS bare FROM {REFS.sql}),
p AS (SELECT plain, arg_min(canonical, (ord, alias, canonical)) AS by_plain FROM k GROUP BY plain), b AS (SELECT bare, arg_min(canonical, (ord, alias, canonical)) AS by_bare FROM k GROUP BY bare)
SELECT raw, coalesce(by_plain, by_bare, raw) AS canonical, CASE WHEN by_plain IS NOT NULL THEN 1 WHEN by_bare IS NOT NULL THEN 2 ELSE 3 END AS tier FROM a LEFT JOIN p USING (plain) LEFT JOIN b USING (bare)""")
def evaluation_resolve(spark, sf):
    return resolve.evaluate(REFS.df(spark, sf), registry(spark, sf))


CROSS = Rows("child string, parent string, n int", K.CROSS_REFERENCES)
RANKED = inputs.ranked_documents([(0, 0, "71/2020/NĐ-CP"), (0, 1, "08/2023/TT-BGDĐT"), (0, 2, "43/2019/QH14"), (1, 0, "34/2018/QH14"), (1, 1, "08/2012/QH13"), (1, 2, "99/2019/ND-CP")])


@query("xref_inject", f"""
WITH r AS (SELECT * FROM {RANKED.sql}), x AS (SELECT query_id, document, place, 0 AS k, 0 AS n FROM r UNION ALL SELECT query_id, parent, place, 1, n FROM r JOIN {CROSS.sql} c ON c.child = r.document),
b AS (SELECT *, {Q.bare('document')} AS bare FROM x), o AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY query_id, bare ORDER BY place, k, n) = 1)
SELECT query_id, document, (row_number() OVER (PARTITION BY query_id ORDER BY place, k, n) - 1){LONG} AS place FROM o""")
def xref_inject(spark, sf):
    return resolve.inject_parents(RANKED.df(spark, sf), CROSS.df(spark, sf))


SELECTED = inputs.selected([
    (0, "quyền của nhà giáo", "Điều 5 (43/2019/QH14)", "43/2019/QH14", 5, "Điều 5. Quyền của nhà giáo theo Điều 9", "Luật 43/2019/QH14"),
    (1, "giáo viên mầm non", "Điều 3 (71/2020/NĐ-CP)", "71/2020/NĐ-CP", 3, "Điều 3. Giáo viên mầm non theo 43/2019/QH14 Điều 7", "Nghị định dẫn 43/2019/QH14"),
])
CANDIDATES = inputs.linked([
    (0, "43/2019/QH14", 5, "Điều 5. Quyền của nhà giáo theo Điều 9", "Luật 43/2019/QH14", True), (0, "43/2019/QH14", 9, "Điều 9. Khác", "Luật 43/2019/QH14", True),
    (0, "43/2019/QH14", 12, "Điều 12. Hành vi bị nghiêm cấm đối với nhà giáo", "Luật 43/2019/QH14", True), (0, "43/2019/QH14", 13, "Điều 13. Học phí", "Luật 43/2019/QH14", True),
    (1, "43/2019/QH14", 7, "Điều 7. Trình độ", "Luật", True), (1, "43/2019/QH14", 8, "Điều 8. Trường mầm non", "Luật", True), (1, "08/2023/TT-BGDĐT", 1, "Điều 1. Sửa đổi 71/2020/NĐ-CP", "Thông tư dẫn 71/2020/NĐ-CP", False),
    (1, "08/2023/TT-BGDĐT", 2, "Điều 2. Thay thế Điều 3 của 71/2020/NĐ-CP", "Thông tư dẫn 71/2020/NĐ-CP", False), (1, "22/2021/TT-BGDĐT", 3, "Điều 3. Mầm non", "Thông tư", True),
])
def _word(text: str, number: str) -> str:
    return f"regexp_matches({text}, '\\bdieu\\s+' || {number} || '\\b')"


_three = lambda words: "(" + " OR ".join(f"(contains(q, {quote(w)}) AND contains(ct, {quote(w)}) AND contains(st, {quote(w)}))" for w in words) + ")"


@query("article_linking", f"""
WITH p AS (SELECT s.query_id, s.doc AS s_doc, s.article AS s_article, c.doc AS c_doc, c.article AS c_article, c.top, s.label, c.text AS c_text, {Q.bare('s.doc')} AS sb, {Q.bare('c.doc')} AS cb, {Q.norm('s.text')} AS st, {Q.norm('c.text')} AS ct,
  {Q.norm('s.query')} AS q, {Q.norm('s.doc_text')} AS sd, {Q.norm('c.doc_text')} AS cd FROM {SELECTED.sql} s JOIN {CANDIDATES.sql} c USING (query_id)),
r AS (SELECT *, CASE WHEN sb = cb AND ({_word('ct', 's_article')} OR {_word('st', 'c_article')}) THEN 'A1'
  WHEN sb = cb AND ({Q.any_of('st', K.RIGHTS)} OR contains(lower(label), 'quyen')) AND {Q.any_of('ct', K.PROHIBITIONS)} AND {_three(K.ACTORS)} THEN 'A2'
  WHEN sb = cb OR NOT (contains(sd, cb) OR contains(cd, sb)) THEN NULL WHEN contains(ct, sb) AND {_word('ct', 's_article')} THEN 'B1' WHEN contains(st, cb) AND {_word('st', 'c_article')} THEN 'B2'
  WHEN contains(ct, sb) AND {Q.any_of('ct', K.AMENDING)} THEN CASE WHEN NOT {Q.any_of("lower(string_split(c_text, chr(10))[1])", K.IMPLEMENTING)} THEN 'B3' END
  WHEN top AND {_three(K.CONCEPTS)} THEN 'B4' END AS rule FROM p WHERE NOT (sb = cb AND s_article = c_article))
SELECT query_id, s_doc, s_article, c_doc, c_article, rule FROM r WHERE rule IS NOT NULL""")
def article_linking(spark, sf):
    return resolve.link_articles(SELECTED.df(spark, sf), CANDIDATES.df(spark, sf))


PICKED = inputs.picked([("43/2019/QH14", "12"), ("71/2020/NĐ-CP", "16a"), ("43/2019/QH14", "99")])
ARTICLES = inputs.named_articles([
    ("n1", "43/2019/QH14", "Điều 12. Tên"), ("n2", "43/2019/QH14", "Điều 120. Khác"), ("n3", "71/2020/NĐ-CP", "Điều 16a. Bổ sung"), ("n4", "71/2020/NĐ-CP", "Điều 16. Gốc"), ("n5", "43/2019/QH14", "điều 12 viết thường"),
])


@query("selection_nodes", f"""SELECT so_hieu, dieu, node_id FROM {PICKED.sql} p JOIN {ARTICLES.sql} a ON a.canonical = p.so_hieu
WHERE CASE WHEN regexp_full_match(dieu, '\\d+') THEN nullif(regexp_extract(name, 'Điều\\s+(\\d+)', 1), '')::INTEGER = dieu::VARCHAR::INTEGER ELSE regexp_matches(lower(name), 'điều\\s+' || lower(dieu)) END""".replace("dieu::VARCHAR::INTEGER", "try_cast(dieu AS INTEGER)"))
def selection_nodes(spark, sf):
    return resolve.selected_nodes(PICKED.df(spark, sf), ARTICLES.df(spark, sf))
