"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..operators import intent, resolve
from ..sources import tables as S
from . import inputs
from . import sql as Q
from .registry import Rows, query, quote

_LAWS = [
    (0, "43/2019/QH14", "Luật Giáo dục 43/2019/QH14"), (1, "71/2020/NĐ-CP", "Nghị định 71/2020/NĐ-CP nâng trình độ chuẩn"),
    (2, "", "Thông tư 08/2023/TT-BGDĐT sửa đổi"), (3, "07/BGDĐT-VBHN", "Văn bản hợp nhất"), (4, "  01-2021-TT ", "thông tư 01-2021-TT"),
    (5, "ĐIỀU LỆ", "Quyết định không số"), (6, "34/2018/QH14", "luật giáo dục đại học"), (7, None, "Nghị định về học phí năm 2021"),
]
LAWS, SOURCES = inputs.laws(_LAWS), inputs.sources(_LAWS)
PHRASES = inputs.texts([
    (0, "Trường Đại học Sư phạm"), (1, "  HỌC  PHÍ năm 2022 "), (2, ""), (3, "Điều 16. Quyền của nhà giáo\nNội dung thứ nhất\n\n  Nội dung thứ hai  "),
    (4, "a/b: c*d? \"e\" <f>|g"), (5, "**Đậm** và # tiêu đề\n- mục một\n- mục hai"), (6, "```json\n{\"a\": 1}\n```"), (7, "suy nghĩ</think> {\"b\": 2}"),
    (8, "không  dấu​cách"), (9, "Điều 7a về lương"), (10, "__gạch__ dưới__"), (12, "e\u0301 a\u0302\u0323 o\u031b"), (11, None),
])


@query("tokenize_count", f"SELECT doc_id, len({Q.tok('text')})::BIGINT AS n_tokens, coalesce({Q.tok('text')}[1], '') AS first_token FROM documents")
def tokenize_count(spark, sf):
    t = T.tokens(F.col("text"))
    return S.load(spark, sf, "documents").select("doc_id", F.size(t).cast("bigint").alias("n_tokens"), F.coalesce(F.get(t, F.lit(0)), F.lit("")).alias("first_token"))


@query("slug_source", f"""
WITH t AS (SELECT DISTINCT source || ' - ' || lang || ' Đạo!' AS text FROM documents UNION ALL SELECT substr(text, 1, 200) FROM {PHRASES.sql})
SELECT text, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(lower(trim(coalesce(text, ''))), '\\s+', '_', 'g'), '[^\\p{{L}}\\p{{N}}_]', '', 'g'), '^_+|_+$', '', 'g'), ''), 'unknown') AS slug FROM t""")  # fmt: skip
def slug_source(spark, sf):
    own = S.load(spark, sf, "documents").select(F.concat("source", F.lit(" - "), "lang", F.lit(" Đạo!")).alias("text")).distinct()
    return own.union(PHRASES.df(spark, sf).select(F.substring("text", 1, 200))).select("text", T.slug(F.col("text")).alias("slug"))


@query("normalize_text", f"WITH t AS (SELECT text FROM {PHRASES.sql} UNION ALL SELECT source FROM {LAWS.sql}) SELECT text, {Q.norm('text')} AS normalized FROM t")
def normalize_text(spark, sf):
    rows = PHRASES.df(spark, sf).select("text").union(LAWS.df(spark, sf).select("source"))
    return rows.select("text", T.normalize(F.col("text")).alias("normalized"))


@query("bare_number", f"SELECT id, {Q.bare('so_hieu')} AS bare, {Q.bare('source', False)} AS bare_source FROM {LAWS.sql}")
def bare_number(spark, sf):
    return LAWS.df(spark, sf).select("id", T.bare_number(F.col("so_hieu")).alias("bare"), T.bare_number(F.col("source"), False).alias("bare_source"))


@query("canonical_source", f"SELECT id, coalesce(nullif(trim(coalesce(so_hieu, '')), ''), nullif(regexp_extract(source, '{Q.NUMBER}', 1), ''), source) AS canonical FROM {LAWS.sql}")
def canonical_source(spark, sf):
    c = F.coalesce(F.nullif(F.trim(T.text(F.col("so_hieu"))), F.lit("")), T.first_match(F.col("source"), T.U + K.NUMBER), F.col("source"))
    return LAWS.df(spark, sf).select("id", c.alias("canonical"))


@query("doc_type_year", f"""SELECT id, CASE WHEN starts_with(lower(trim(source)), 'nghị định') THEN 'Nghị định' WHEN starts_with(lower(trim(source)), 'thông tư') THEN 'Thông tư'
  WHEN starts_with(lower(trim(source)), 'luật') THEN 'Luật' ELSE 'Khác' END AS doc_type, regexp_extract(coalesce(so_hieu, ''), '(\\d{{4}})', 1) AS year FROM {LAWS.sql}""")
def doc_type_year(spark, sf):
    return LAWS.df(spark, sf).select("id", T.doc_type(F.col("source")).alias("doc_type"), T.year(F.col("so_hieu")).alias("year"))


@query("article_number", f"SELECT id, nullif(regexp_extract(coalesce(text, ''), 'Điều\\s+(\\d+)', 1), '')::INTEGER AS article FROM {PHRASES.sql}")
def article_number(spark, sf):
    return PHRASES.df(spark, sf).select("id", T.article_number(F.col("text")).alias("article"))


@query("title_fallback", f"SELECT doc_id, {Q.title('text')} AS title FROM documents")
def title_fallback(spark, sf):
    return S.load(spark, sf, "documents").select("doc_id", T.title(F.lit(None).cast("string"), F.col("text")).alias("title"))


@query("snippet_cut", f"SELECT doc_id, {Q.snippet('text', 100)} AS snippet FROM documents")
def snippet_cut(spark, sf):
    return S.load(spark, sf, "documents").select("doc_id", T.snippet(F.col("text"), 100).alias("snippet"))


@query("breadcrumb", f"WITH {Q.CHUNKS} SELECT node_id, concat_ws(' > ', nullif(canonical, ''), nullif(chapter, ''), nullif(name, '')) AS breadcrumb FROM chunks")
def breadcrumb(spark, sf):
    return S.chunks(spark, sf).select("node_id", T.breadcrumb(F.col("node_id"), F.col("canonical"), F.col("chapter"), F.col("name")).alias("breadcrumb"))


NODES = inputs.node_ids([(0, "node:ND71_D5"), (1, "Luat_2019_QH14_D12"), (2, "plain"), (3, "a_1b_2c_D33_x"), (4, None)])


@query("node_doc_id", f"SELECT id, nullif(regexp_extract(coalesce(node_id, ''), '^([^_]+(?:_\\d+[^_]*)*?)_D\\d+', 1), '') AS doc FROM {NODES.sql}")
def node_doc_id(spark, sf):
    return NODES.df(spark, sf).select("id", T.doc_of_node(F.col("node_id")).alias("doc"))


@query("cache_key", "SELECT item_id, 'qcache:' || md5(lower(trim(text))) AS cache_key FROM benchmark")
def cache_key(spark, sf):
    return S.load(spark, sf, "benchmark").select("item_id", T.cache_key(F.col("text")).alias("cache_key"))


@query("jaccard_pairs", """
WITH w AS (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM benchmark)
SELECT a.item_id, round(len(list_intersect(a.w, b.w))::DOUBLE / greatest(len(list_distinct(list_concat(a.w, b.w))), 1), 9) AS jaccard FROM w a JOIN w b ON b.item_id = a.item_id + 1""")
def jaccard_pairs(spark, sf):
    a = S.load(spark, sf, "benchmark")
    b = a.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return a.join(b, "item_id").select("item_id", F.round(T.jaccard(F.col("text"), F.col("other")), 9).alias("jaccard"))


STOP = "[" + ", ".join(quote(w) for w in K.PROBE_STOP_WORDS) + "]"
_WORD3 = "'([\\p{L}\\p{N}_]{3,})'"


@query("term_overlap_probe", f"""
WITH j AS (SELECT item_id, lower(b.text) AS q, lower(substr(coalesce(d.text, ''), 1, 300)) AS t FROM benchmark b JOIN documents d ON d.doc_id = b.item_id),
w AS (SELECT item_id, list_filter(list_distinct(regexp_extract_all(q, {_WORD3}, 1)), lambda x: NOT list_contains({STOP}, x)) AS a, list_distinct(regexp_extract_all(t, {_WORD3}, 1)) AS b, q FROM j)
SELECT item_id, CASE WHEN len(a) = 0 THEN NULL WHEN len(list_intersect(a, b))::DOUBLE / len(a) < 0.15 THEN 'SURFACE_MISMATCH' WHEN len(list_intersect(a, b))::DOUBLE / len(a) < 0.25 THEN 'LOW_RELEVANCE'
  WHEN {" + ".join(f"contains(q, {quote(m)})::INT" for m in K.CONDITION_MARKERS)} > 1 THEN 'ENTANGLED_PREMISES' END AS state FROM w""")
def term_overlap_probe(spark, sf):
    docs = S.load(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), F.substring(T.text(F.col("text")), 1, 300).alias("t"))
    return S.load(spark, sf, "benchmark").join(docs, "item_id").select("item_id", intent.probe(F.col("text"), F.col("t"), F.lit(1)).alias("state"))


@query("min_length_filter", "SELECT doc_id, length(trim(text))::BIGINT AS n FROM documents WHERE length(trim(text)) >= 30")
def min_length_filter(spark, sf):
    n = F.length(F.trim("text"))
    return S.load(spark, sf, "documents").where(n >= 30).select("doc_id", n.cast("bigint").alias("n"))


@query("search_text_nodes", "SELECT doc_id FROM documents WHERE text <> ''")
def search_text_nodes(spark, sf):
    return S.load(spark, sf, "documents").where("text <> ''").select("doc_id")


@query("keyword_boost", "SELECT doc_id, CASE WHEN contains(lower(text), 'the') OR contains(lower(text), 'und') THEN n_chars * 1.2::DOUBLE ELSE n_chars::DOUBLE END AS score FROM documents")
def keyword_boost(spark, sf):
    return S.load(spark, sf, "documents").select("doc_id", T.boost(F.col("n_chars").cast("double"), F.col("text"), F.array(F.lit("the"), F.lit("und")), 1.2).alias("score"))


TITLES = Rows("ord int, so_hieu string, title string", [
    (0, "22/2021/TT-BGDĐT", "Thông tư quy định về đánh giá học sinh trung học cơ sở và phổ thông"), (1, "116/2020/NĐ-CP", "Nghị định quy định về chính sách hỗ trợ tiền đóng học phí sinh viên sư phạm"),
    (2, "43/2019/QH14", "Luật Giáo dục"), (3, "86/2021/NĐ-CP", "Nghị định quy định việc công dân Việt Nam ra nước ngoài học tập"),
])
ASKED = inputs.questions([
    (0, "Xin chào"), (1, "Cảm ơn bạn nhiều"), (2, "Tóm tắt nội dung chính của Luật Giáo dục"), (3, "Có bao nhiêu thông tư năm 2021"), (4, "Mức học phí là bao nhiêu"),
    (5, "Liệt kê các loại trường"), (6, "So sánh nghị định 71 và thông tư 08"), (7, "Bao nhiêu trường top 100 thế giới"), (8, "Nhiệm kỳ của hiệu trưởng trường đại học công lập"), (9, "abc"),
    (10, "Đánh giá học sinh trung học phổ thông thế nào"), (11, "Tai nạn thương tích ở trường mầm non"), (12, "thăng hạng giáo viên tiểu học và bồi hoàn học phí"),
    (13, "những nghị định nào ban hành trong năm 2020"), (14, "chuyển đổi trường đại học tư thục"),
])

_CLEAN = "trim(regexp_replace(lower(title), '" + K.TITLE_LEAD + "', ''))"
_KEYS = f"list_filter(string_split_regex({_CLEAN}, '\\s+'), lambda w: w <> '' AND NOT list_contains([{', '.join(quote(w) for w in K.TITLE_STOP_WORDS)}], w))"


@query("title_match", f"""SELECT query_id, so_hieu FROM {ASKED.sql} q, {TITLES.sql} t WHERE length({_CLEAN}) >= 15 AND len({_KEYS}) >= 4
  AND (len(list_filter({_KEYS}, lambda w: contains(lower(query), w)))::DOUBLE / len({_KEYS}) >= 0.8 OR (length({_CLEAN}) > 20 AND contains(lower(query), {_CLEAN})))""")
def title_match(spark, sf):
    return ASKED.df(spark, sf).join(F.broadcast(TITLES.df(spark, sf)), intent.title_match(F.lower("query"), F.col("title"))).select("query_id", "so_hieu")


@query("json_fence_clean", f"""SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(?s)^.*</think>', ''), '^\\s+|\\s+$', '', 'g'), '^```(?:json)?\\s*', ''), '\\s*```$', '') AS clean FROM {PHRASES.sql}""")
def json_fence_clean(spark, sf):
    return PHRASES.df(spark, sf).select("id", T.clean_json(F.col("text")).alias("clean"))


@query("markdown_clean", f"""SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\\*\\*|#+', '', 'g'), '(?m)^[ \\t]*[-*•][ \\t]+', '', 'g'), '\\n+', ' ', 'g'), ' +', ' ', 'g')) AS clean FROM {PHRASES.sql}""")
def markdown_clean(spark, sf):
    return PHRASES.df(spark, sf).select("id", T.clean_markdown(F.col("text")).alias("clean"))


@query("token_estimate", "SELECT doc_id, (length(coalesce(text, '')) // 4)::BIGINT AS tokens FROM documents")
def token_estimate(spark, sf):
    return S.load(spark, sf, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("title_cut", "SELECT item_id, CASE WHEN length(text) > 40 THEN substr(text, 1, 40) || '...' ELSE text END AS title FROM benchmark")
def title_cut(spark, sf):
    return S.load(spark, sf, "benchmark").select("item_id", T.cut_title(F.col("text")).alias("title"))


@query("whitespace_clean", f"SELECT id, trim(regexp_replace(translate(nfc_normalize(coalesce(text, '')), chr(160) || chr(8203) || chr(8204) || chr(8205) || chr(65279), ' '), '[ \\t\\r\\n\\f\\x0b]+', ' ', 'g')) AS clean FROM {PHRASES.sql}")
def whitespace_clean(spark, sf):
    return PHRASES.df(spark, sf).select("id", T.clean_space(F.col("text")).alias("clean"))


@query("safe_file_name", f"SELECT id, regexp_replace(coalesce(text, ''), '[/\\\\:*?\"<>|]', '_', 'g') AS name FROM {PHRASES.sql}")
def safe_file_name(spark, sf):
    return PHRASES.df(spark, sf).select("id", T.safe_file_name(F.col("text")).alias("name"))


_HEAD = "regexp_replace(string_split(coalesce(source, ''), '/')[1], '[^\\p{L}\\p{N}_]+', '', 'g')"


@query("chunk_id", f"SELECT id, {_HEAD} || '_D' || coalesce(so_hieu, '') AS chunk_id, {_HEAD} || '_Mod_D' || regexp_replace(coalesce(so_hieu, ''), '\\D', '', 'g') AS amended_id FROM {LAWS.sql}")
def chunk_id(spark, sf):
    a, b = F.col("source"), F.col("so_hieu")
    return LAWS.df(spark, sf).select("id", T.chunk_id(a, b).alias("chunk_id"), T.chunk_id(a, b, True).alias("amended_id"))


@query("status_note", "SELECT doc_id, CASE WHEN toxic = 1 THEN ' [BỊ BÃI BỎ]' WHEN quality = 0 THEN ' [ĐÃ SỬA ĐỔI]' ELSE '' END AS note FROM labels")
def status_note(spark, sf):
    status = F.when(F.col("toxic") == 1, "bi_bai_bo").when(F.col("quality") == 0, "da_sua_doi").otherwise("con_hieu_luc")
    return S.load(spark, sf, "labels").select("doc_id", T.status_note(status).alias("note"))


RULES = Rows("ord int, needle string, also string, target string", K.CANONICAL_NUMBERS)
NUMBERS = inputs.numbers([("07/BGDĐT",), ("luật 43/2019",), ("04/2021/nđ-cp",), ("04/2021/tt-bgdđt",), ("99/1999/XX",), ("34-2018",), ("34/2018/qh14 và 08/2012",)])


@query("legal_number_canonical", f"SELECT raw, coalesce(arg_min(target, ord), raw) AS canonical FROM {NUMBERS.sql} n LEFT JOIN {RULES.sql} r ON contains(upper(raw), needle) AND contains(upper(raw), also) GROUP BY raw")
def legal_number_canonical(spark, sf):
    return resolve.canonical_number(NUMBERS.df(spark, sf), RULES.df(spark, sf))


ANSWERS = inputs.answers([
    (0, "Theo Điều 16, 17 và 20 của Luật, và điều 7a khoản 2."), (1, "Không có."), (2, None), (3, "Điều 5 Nghị định 71/2020/NĐ-CP; Điều 12, 13 Luật 43/2019/QH14"),
])


def _cited(x: str, cls: str) -> str:
    return f"flatten(list_transform(regexp_extract_all(coalesce({x}, ''), '[Đđ]iều\\s+({cls}+)', 1), lambda r: list_transform(regexp_extract_all(r, '(\\d+)', 1), lambda n: n::INTEGER)))"


@query("citation_extract", f"""SELECT id, {_cited('answer', '[\\d\\sa-zA-Z,và]')} AS articles, {_cited('answer', '[\\d\\s,và]')} AS strict_articles, regexp_extract_all(coalesce(answer, ''), '{Q.NUMBER}', 1) AS numbers FROM {ANSWERS.sql}""")
def citation_extract(spark, sf):
    a = F.col("answer")
    return ANSWERS.df(spark, sf).select("id", T.cited_articles(a).alias("articles"), T.cited_articles(a, False).alias("strict_articles"), T.sha_list(a).alias("numbers"))
