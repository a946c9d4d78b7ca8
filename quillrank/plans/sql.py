"""SQL fragments that the oracles share."""

from __future__ import annotations

from ..functions import constants as K
from .registry import quote


def tok(x: str) -> str:
    return f"list_filter(string_split_regex(translate(lower(coalesce({x}, '')), {quote(K.PUNCTUATION)}, ''), '[\\s\\p{{Z}}]+'), lambda w: w <> '')"


def norm(x: str) -> str:
    return f"strip_accents(replace(lower(trim(coalesce({x}, ''))), 'đ', 'd'))"


NUMBER = r"(\d+[/-]\d{4}[/-]?[\p{L}\p{N}_-]*)"


def bare(x: str, normalized: bool = True) -> str:
    c = norm(x) if normalized else f"coalesce({x}, '')"
    return f"coalesce(nullif(regexp_extract({c}, '{NUMBER}', 1), ''), {c})"


def any_of(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {quote(w)})" for w in words) + ")"


def title(body: str) -> str:
    return f"substr(trim(string_split(coalesce({body}, ''), chr(10))[1]), 1, 120)"


def snippet(body: str, n: int) -> str:
    joined = f"array_to_string(list_filter(list_transform(string_split(coalesce({body}, ''), chr(10))[2:], lambda l: trim(l)), lambda l: l <> ''), ' ')"
    return f"CASE WHEN length({joined}) > {n} THEN substr({joined}, 1, {n}) || '...' ELSE {joined} END"


CHUNKS = f"""chunks AS (SELECT 'node:' || doc_id AS node_id, doc_id, source AS canonical, lang AS chapter, {title('text')} AS name, coalesce(text, '') AS full_text FROM documents)"""
NUMBERED = "numbered AS (SELECT *, row_number() OVER (PARTITION BY canonical ORDER BY doc_id)::INTEGER AS article FROM chunks)"


def queries() -> str:
    return "queries AS (SELECT item_id AS query_id, text AS query FROM benchmark)"


def bm25(docs: str = "SELECT node_id, full_text AS text FROM chunks", asked: str = "queries", name: str = "bm25") -> str:
    """A CTE of (query_id, node_id, score) for every pair that shares a term."""
    p = name
    return f"""
{p}_d AS MATERIALIZED (SELECT node_id, {tok('text')} AS t FROM ({docs})),
{p}_tf AS MATERIALIZED (SELECT node_id, term, count(*)::DOUBLE AS tf FROM (SELECT node_id, unnest(t) AS term FROM {p}_d) GROUP BY ALL),
{p}_n AS (SELECT count(*)::DOUBLE AS n, avg(len(t))::DOUBLE AS avgdl FROM {p}_d),
{p}_raw AS MATERIALIZED (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*)::DOUBLE AS df FROM {p}_tf GROUP BY term), {p}_n),
{p}_idf AS MATERIALIZED (SELECT term, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT sum(raw) / count(*) FROM {p}_raw) ELSE raw END AS idf FROM {p}_raw),
{p}_q AS MATERIALIZED (SELECT query_id, term, count(*)::DOUBLE AS qtf FROM (SELECT query_id, unnest({tok('query')}) AS term FROM {asked}) GROUP BY ALL),
{name} AS (SELECT query_id, tf.node_id, round(sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(d.t) / avgdl))), 6) AS score
  FROM {p}_q q JOIN {p}_tf tf USING (term) JOIN {p}_idf USING (term) JOIN {p}_d d ON d.node_id = tf.node_id, {p}_n GROUP BY query_id, tf.node_id)"""


def dense(name: str = "dense") -> str:
    return f"""{name} AS (SELECT q.vec_id // 50 AS query_id, 'node:' || v.vec_id AS node_id, round(list_inner_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
  FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0)"""


def top(source: str, k: int, name: str, rank: str = "rank") -> str:
    return f"{name} AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) - 1)::BIGINT AS {rank} FROM {source} QUALIFY {rank} < {k})"
