"""Every retrieval strategy, with its fallbacks, over all benchmark items."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..operators import strategies
from ..sources import tables as S
from . import sql as Q
from .registry import query
from .retrieval_queries import _SCORE

K = 5
_INTENTS = """intents AS (SELECT item_id AS query_id, coalesce(text, '') AS query,
  CASE item_id % 4 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['src' || (item_id % 20)] WHEN 2 THEN ['src' || (item_id % 20), 'src' || ((item_id + 7) % 20)] ELSE ['no such document'] END AS documents,
  CASE WHEN item_id % 5 = 1 THEN item_id % 30 + 1 END AS article_hint, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> '') AS subs, string_split(coalesce(text, ''), ' ') AS w FROM benchmark),
i AS (SELECT *, array_to_string(w[1:3], ' ') AS topic, list_filter(string_split(lower(query), ' '), lambda x: length(x) >= 8)[1:2] AS keywords,
  list_filter(subs, lambda x, n: trim(x) <> '' AND NOT list_contains(list_transform(subs[1:n - 1], lambda y: lower(trim(y))), lower(trim(x)))) AS once FROM intents),
u AS MATERIALIZED (SELECT *, CASE WHEN len(once) = 0 THEN [query] ELSE once END AS unique_subs FROM i)"""
_WHERE = "unnest(CASE WHEN len(documents) > 0 THEN documents ELSE [NULL]::VARCHAR[] END) AS document"


def _multi(dense: str, sparse: str) -> str:
    single = "len(unique_subs) = 1"
    texts = f"CASE WHEN {single} AND trim(topic) <> '' AND lower(trim(topic)) <> lower(trim(unique_subs[1])) THEN list_concat(unique_subs, [trim(topic)]) ELSE unique_subs END"
    share = lambda k: f"CASE WHEN {single} THEN {k} ELSE greatest(3, {k} // len(unique_subs)) END"
    return f"SELECT query_id, text, {_WHERE}, dense, sparse FROM (SELECT query_id, documents, unnest({texts}) AS text, {share(dense)} AS dense, {share(sparse)} AS sparse FROM {{left}})"


def _plain(dense: int, sparse: int, scoped: bool) -> str:
    return f"SELECT query_id, query AS text, {_WHERE if scoped else 'NULL::VARCHAR AS document'}, {dense} AS dense, {sparse} AS sparse FROM {{left}}"


def _aspects(dense: int, sparse: int) -> str:
    head = "coalesce(nullif(topic, ''), query)"
    return f"{_multi(str(dense), str(sparse))} UNION ALL SELECT query_id, text, {_WHERE}, 3, 3 FROM (SELECT query_id, documents, {head} || ' ' || unnest(w[4:6]) AS text FROM {{left}})"


_PER_DOCUMENT = f"SELECT query_id, coalesce(subs[n], query) AS text, documents[n] AS document, {K + 3} AS dense, {K} AS sparse FROM (SELECT *, unnest(range(1, len(documents) + 1)) AS n FROM {{left}})"
_NAMED, _FEW = "len(documents) > 0", "len(documents) < 2"
_LAST = ("fallback", _plain(3 * K, 2 * K, False), 2 * K, _NAMED, "keywords")


def _default(k: int, also: str = "true") -> list[tuple]:
    return [("scoped", _plain(2 * k, 2 * k, True), 2 * k, f"{also} AND {_NAMED}", "keywords"), ("global", _plain(2 * k, k, False), 2 * k, also, "keywords")]


#: (attempt, requests, how many stay, for whom, boosted words); None for those whose choice SQL can't express.
_PLANS = {
    "single_lookup": [("main", _multi(str(K), str(2 * K)), 2 * K, "true", "keywords"), *_default(K), _LAST],
    "comparison": [("main", _PER_DOCUMENT, "balanced", "len(documents) >= 2", "keywords"), *_default(2 * K, _FEW), _LAST],
    "eligibility_check": [("main", _aspects(K, K), K + 3, "true", "keywords"), _LAST],
    "procedure": [("main", _multi(str(K), str(3 * K)), 2 * K, "true", "list_concat(w[1:1], keywords)"), _LAST],
    "definition": [("main", _multi(str(K), str(2 * K)), 2 * K, "true", "list_concat(CASE WHEN coalesce(w[2], '') <> '' THEN [w[2]] ELSE [] END, keywords)"),
                   ("global", _plain(K, 2 * K, False), 2 * K, "true", "list_concat(CASE WHEN coalesce(w[2], '') <> '' THEN [w[2]] ELSE [] END, keywords)"), _LAST],
    "default": [*_default(K), _LAST],
    "listing": None,
    "cross_document": None,
}


def _candidates(j: int, requests: str) -> list[str]:
    """The CTEs from the intents a{j} to their candidates c{j}."""
    return [
        f"r{j} AS ({requests.format(left=f'a{j}')})",
        f"k{j} AS MATERIALIZED (SELECT *, row_number() OVER () AS request FROM (SELECT DISTINCT query_id, text, document AS named, CASE WHEN document IN (SELECT canonical FROM chunks) THEN document END AS document, dense, sparse FROM r{j}))",
        Q.bm25(asked=f"(SELECT request AS query_id, text AS query FROM k{j})", name=f"b{j}"),
        f"w{j} AS MATERIALIZED (SELECT k.*, node_id, score, row_number() OVER (PARTITION BY request ORDER BY score DESC, node_id) - 1 AS wide FROM b{j} JOIN k{j} k ON k.request = b{j}.query_id WHERE score > 0)",
        f"v{j} AS (SELECT w.* FROM w{j} w JOIN chunks c USING (node_id) WHERE c.canonical = w.document AND wide < 5 * sparse QUALIFY row_number() OVER (PARTITION BY request ORDER BY score DESC, w.node_id) <= sparse)",
        f"p{j} AS (SELECT query_id, named, document, max(dense) AS dense FROM k{j} GROUP BY ALL)",
        f"d{j} AS (SELECT p.query_id, named, e.node_id FROM p{j} p JOIN dense e USING (query_id) LEFT JOIN chunks c USING (node_id) WHERE p.document IS NULL OR (c.canonical = p.document AND e.score > 0) QUALIFY row_number() OVER (PARTITION BY p.query_id, named ORDER BY e.score DESC, e.node_id) <= p.dense)",
        f"c{j} AS (SELECT query_id, named, node_id FROM w{j} WHERE document IS NULL AND wide < sparse UNION SELECT query_id, named, node_id FROM v{j} UNION SELECT * FROM d{j})",
    ]


def _sql(name: str) -> str:
    parts, left, got = [Q.CHUNKS, Q.NUMBERED, _INTENTS, Q.dense()], "u", []
    if name == "single_lookup":
        parts.append("""g0 AS MATERIALIZED (SELECT u.query_id, 'direct' AS attempt, min(node_id) AS node_id, NULL::DOUBLE AS score, 0::BIGINT AS rank FROM u JOIN numbered n ON n.canonical = documents[1] AND n.article = article_hint WHERE full_text <> '' GROUP BY u.query_id)""")
        parts.append("l0 AS MATERIALIZED (SELECT * FROM u ANTI JOIN g0 USING (query_id))")
        left, got = "l0", ["g0"]
    for j, (attempt, requests, n, applies, boost) in enumerate(_PLANS[name], 1):
        balanced = n == "balanced"
        parts.append(f"a{j} AS MATERIALIZED (SELECT * FROM {left} WHERE {applies})")
        parts += _candidates(j, requests)
        score = _SCORE.replace("c.full_text", "substr(c.canonical || ' - ' || c.full_text, 1, 1024)")
        key = "x.query_id, x.named, x.node_id" if balanced else "x.query_id, x.node_id"
        parts += [
            f"s{j} AS MATERIALIZED (SELECT {key}, any_value(round({score} * CASE WHEN len(list_filter({boost}, lambda y: contains(lower(c.full_text), lower(y)))) > 0 THEN {1.3 if balanced else 1.2} ELSE 1 END, 6)) AS score, any_value(len(documents)) AS n_docs FROM c{j} x JOIN a{j} q USING (query_id) JOIN chunks c USING (node_id) WHERE c.full_text <> '' GROUP BY {key})",
        ]
        if balanced:
            parts += [
                f"t{j} AS (SELECT *, (row_number() OVER (PARTITION BY query_id, named ORDER BY score DESC, node_id) <= greatest(3, {K} // n_docs))::INTEGER AS slot FROM s{j})",
                f"o{j} AS (SELECT query_id, node_id, max(slot) AS slot, max(score) AS score FROM t{j} GROUP BY query_id, node_id)",
                f"z{j} AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY slot DESC, score DESC, node_id) - 1)::BIGINT AS rank FROM o{j})",
                f"g{j} AS MATERIALIZED (SELECT query_id, '{attempt}' AS attempt, node_id, score, rank FROM z{j} WHERE slot = 1 OR rank < {2 * K})",
            ]
        else:
            parts.append(f"g{j} AS MATERIALIZED (SELECT query_id, '{attempt}' AS attempt, node_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) - 1)::BIGINT AS rank FROM s{j} QUALIFY rank < {n})")
        parts.append(f"l{j} AS MATERIALIZED (SELECT * FROM {left} ANTI JOIN g{j} USING (query_id))")
        left = f"l{j}"
        got.append(f"g{j}")
    return f"WITH {', '.join(parts)} " + " UNION ALL ".join(f"SELECT query_id, attempt, node_id, score, rank FROM {g}" for g in got)


def corpus(spark, sf) -> strategies.Corpus:
    # Neighbours of chunks in this graph are documents, chapters and entities, so chunks alone don't lead to others.
    chunks = S.chunks(spark, sf)
    return strategies.Corpus(chunks, S.lexical_index(spark, sf), S.vectors(spark, sf), S.query_vectors(spark, sf), S.numbered(chunks))


def _run(spark, sf, strategy: str):
    return strategies.retrieve(S.intents(spark, sf), strategy, corpus(spark, sf), K)


for _name, _plan in _PLANS.items():
    query(f"strategy_{_name}", _sql(_name) if _plan else None)(partial(_run, strategy=_name))


_MULTI = ", ".join([Q.CHUNKS, Q.NUMBERED, _INTENTS, Q.dense(), "a1 AS (SELECT * FROM u)", *_candidates(1, _multi("10", "10"))])


@query("multi_query_retrieve", f"WITH {_MULTI} SELECT DISTINCT query_id, node_id FROM c1")
def multi_query_retrieve(spark, sf):
    """What all sub-queries of an item find by words and by vectors, in its documents or everywhere."""
    requests = strategies.multi_query(F.lit(10), F.lit(10))(S.intents(spark, sf))
    return strategies.search(requests, corpus(spark, sf)).select("query_id", "node_id").distinct()
