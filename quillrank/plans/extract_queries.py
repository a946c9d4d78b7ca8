"""Queries of the entity graph: extraction, merging, resolution, and the whole graph's nodes and edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extract, graph, lexical
from ..sources import tables as S
from . import sql as Q
from .graph_queries import _STRUCTURE
from .registry import query

LONG = "::BIGINT"
_SLUG = "coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '\\s+', '_', 'g'), '[^\\p{{L}}\\p{{N}}_]', '', 'g'), '^_+|_+$', '', 'g'), ''), 'unknown')"
#: What the default model finds: names in the order of their first place in a text.
_RAW = f"""sent AS (SELECT doc_id, node_id, string_split(full_text, chr(10)) AS l FROM chunks WHERE length(trim(full_text)) >= 30),
ln AS (SELECT doc_id, node_id, no, l[no] AS line FROM (SELECT *, unnest(range(1, len(l) + 1)) AS no FROM sent)),
hit AS (SELECT doc_id, node_id, line, no * 1000000 + i AS place, n[i] AS name FROM (SELECT *, unnest(range(1, len(n) + 1)) AS i FROM (SELECT *, regexp_extract_all(line, '\\p{{Lu}}\\p{{L}}{{5,}}') AS n FROM ln))),
firsts AS (SELECT doc_id, node_id, name, min(place) AS place, substr(arg_min(line, place), 1, 120) AS description FROM hit GROUP BY ALL),
raw AS MATERIALIZED (SELECT doc_id AS ord, node_id, (row_number() OVER (PARTITION BY node_id ORDER BY place) - 1)::INTEGER AS pos, 'ent:' || {_SLUG.format("name")} AS id, name,
  CASE WHEN length(name) >= 10 THEN 'Organization' ELSE 'Concept' END AS type, description FROM firsts),
pairs AS (SELECT ord, pos, id AS source, lead(id) OVER (PARTITION BY node_id ORDER BY pos) AS target FROM raw)"""
_ENTITIES = f"""{Q.CHUNKS}, {_RAW}, ent AS MATERIALIZED (SELECT id, name, type, description FROM raw QUALIFY row_number() OVER (PARTITION BY id ORDER BY length(description) DESC, ord, pos) = 1)"""
_RELATIONS = "rel AS MATERIALIZED (SELECT source, target, 'PRECEDES' AS relation, min((ord, pos)) AS place FROM pairs WHERE target IS NOT NULL GROUP BY ALL)"
_ALIASES = f"""names AS (SELECT id, {Q.norm('name')} AS plain FROM ent),
aliases AS (SELECT id AS alias, least AS canonical FROM (SELECT id, min(id) OVER (PARTITION BY plain) AS least FROM names) WHERE id <> least)"""


def rows(spark, sf):
    return extract.entity_rows(S.graphs(spark, sf))


@query("entity_rows", f"WITH {Q.CHUNKS}, {_RAW} SELECT node_id, pos, id, name, type, description FROM raw")
def entity_rows(spark, sf):
    return rows(spark, sf).drop("ord")


@query("entity_dedupe", f"WITH {_ENTITIES} SELECT id, name, type, description FROM ent")
def entity_dedupe(spark, sf):
    return extract.entities(rows(spark, sf))


@query("mention_rows", f"WITH {Q.CHUNKS}, {_RAW} SELECT node_id AS tree_node, id AS entity, 'MENTIONS' AS relation, pos FROM raw")
def mention_rows(spark, sf):
    return extract.mentions(rows(spark, sf)).drop("ord")


@query("relation_rows", f"WITH {Q.CHUNKS}, {_RAW}, {_RELATIONS} SELECT source, target, relation FROM rel")
def relation_rows(spark, sf):
    return extract.relations(S.graphs(spark, sf)).drop("ord", "pos")


@query("graph_totals", f"""WITH {_ENTITIES}, {_RELATIONS}
SELECT (SELECT count(*) FROM ent){LONG} AS total_entities, (SELECT count(*) FROM rel){LONG} AS total_relations, (SELECT count(*) FROM raw){LONG} AS total_mappings""")
def graph_totals(spark, sf):
    graphs, count = S.graphs(spark, sf), lambda df, name: df.agg(F.count("*").alias(name))
    found = extract.entity_rows(graphs)
    one = count(extract.entities(found), "total_entities").join(count(extract.relations(graphs), "total_relations"), F.lit(True))
    return one.join(count(found, "total_mappings"), F.lit(True))


def halves(spark, sf):
    """The graph of the chunks with even ids and a patch from the others, as (entities, relations) each."""
    out = []
    for odd in (0, 1):
        part = S.graphs(spark, sf).where(F.col("ord") % 2 == odd)
        out.append((extract.entities(extract.entity_rows(part)).withColumn("ord", F.lit(0).cast("bigint")), extract.relations(part).drop("ord", "pos")))
    return out


@query("graph_merge", f"""WITH {Q.CHUNKS}, {_RAW}, half AS (SELECT *, ord % 2 AS odd FROM raw QUALIFY row_number() OVER (PARTITION BY id, ord % 2 ORDER BY length(description) DESC, ord, pos) = 1)
SELECT id, name, type, description FROM half QUALIFY row_number() OVER (PARTITION BY id ORDER BY length(description) DESC, odd) = 1""")
def graph_merge(spark, sf):
    return graph.merge(*halves(spark, sf))[0].drop("ord")


@query("relation_merge", f"WITH {Q.CHUNKS}, {_RAW} SELECT DISTINCT source, target, 'PRECEDES' AS relation FROM pairs WHERE target IS NOT NULL")
def relation_merge(spark, sf):
    return graph.merge(*halves(spark, sf))[1]


def resolved(spark, sf):
    graphs = S.graphs(spark, sf)
    found = extract.entity_rows(graphs)
    kept = extract.entities(found)
    return extract.resolved(kept, extract.relations(graphs), extract.mentions(found), extract.similar_names(kept))


@query("alias_groups", f"WITH {_ENTITIES}, {_ALIASES} SELECT alias, canonical FROM aliases")
def alias_groups(spark, sf):
    return extract.similar_names(extract.entities(rows(spark, sf)))


@query("alias_resolution", f"""WITH {_ENTITIES}, {_ALIASES}
SELECT ent.id, name, type, d.description FROM ent JOIN (SELECT coalesce(canonical, id) AS id, arg_min(description, (-length(description), canonical IS NOT NULL, id)) AS description FROM ent LEFT JOIN aliases ON alias = id GROUP BY ALL) d USING (id)""")
def alias_resolution(spark, sf):
    return resolved(spark, sf)[0]


@query("relation_resolution", f"""WITH {_ENTITIES}, {_RELATIONS}, {_ALIASES}
SELECT DISTINCT coalesce(a.canonical, source) AS source, coalesce(b.canonical, target) AS target, relation FROM rel LEFT JOIN aliases a ON a.alias = source LEFT JOIN aliases b ON b.alias = target WHERE coalesce(a.canonical, source) <> coalesce(b.canonical, target)""")
def relation_resolution(spark, sf):
    return resolved(spark, sf)[1].drop("ord", "pos")


@query("mention_resolution", f"WITH {_ENTITIES}, {_ALIASES} SELECT node_id AS tree_node, coalesce(canonical, id) AS entity, 'MENTIONS' AS relation, pos FROM raw LEFT JOIN aliases ON alias = id")
def mention_resolution(spark, sf):
    return resolved(spark, sf)[2].drop("ord")


@query("edge_last_writer", f"""WITH {Q.CHUNKS}, {_RAW}, {_RELATIONS}, w AS (SELECT source AS src, target AS dst, relation AS type, (place, 0) AS o FROM rel UNION ALL SELECT target, source, 'REV_' || relation, (place, 1) FROM rel)
SELECT src, dst, arg_max(type, o) AS type FROM w GROUP BY src, dst""")
def edge_last_writer(spark, sf):
    return graph.with_reverse(extract.relations(S.graphs(spark, sf)).withColumn("ord", F.struct("ord", "pos")))


def edges(spark, sf):
    graphs = S.graphs(spark, sf)
    return graph.all_edges(extract.relations(graphs), extract.mentions(extract.entity_rows(graphs)), S.chunks(spark, sf))


_EDGES = f"""{_STRUCTURE.replace("edges AS", "built AS")}, {_RAW}, {_RELATIONS},
w AS (SELECT source AS src, target AS dst, relation AS type, 0 AS o, place[1] AS ord, place[2] AS pos, 0 AS back FROM rel
  UNION ALL SELECT target, source, 'REV_' || relation, 0, place[1], place[2], 1 FROM rel
  UNION ALL SELECT node_id, id, 'MENTIONS', 1, ord, pos, 0 FROM raw UNION ALL SELECT id, node_id, 'MENTIONED_IN', 1, ord, pos, 1 FROM raw UNION ALL SELECT src, dst, type, 2, 0, 0, 0 FROM built),
edges AS MATERIALIZED (SELECT src, dst, arg_max(type, (o, ord, pos, back)) AS type FROM w GROUP BY src, dst)"""


@query("graph_edges", f"WITH {_EDGES} SELECT src, dst, type FROM edges")
def graph_edges(spark, sf):
    return edges(spark, sf)


_NODES = f"""{_ENTITIES}, nodes AS MATERIALIZED (SELECT id AS node_id, type, name, type || ': ' || name || ' - ' || description AS search_text FROM ent
  UNION ALL SELECT node_id, 'Article', name, canonical || ' - ' || substr(full_text, 1, 512) FROM chunks UNION ALL SELECT DISTINCT 'doc:' || canonical, 'Document', canonical, canonical FROM chunks
  UNION ALL SELECT DISTINCT 'chap:' || canonical || ':' || chapter, 'Chapter', chapter, 'Chapter: ' || chapter || ' of ' || canonical FROM chunks WHERE chapter <> '')"""


@query("graph_nodes", f"WITH {_NODES} SELECT node_id, type, name, search_text FROM nodes")
def graph_nodes(spark, sf):
    return graph.nodes(extract.entities(rows(spark, sf)), S.chunks(spark, sf))


@query("graph_search", f"""WITH {_NODES}, {Q.queries()}, {Q.bm25("SELECT node_id, search_text AS text FROM nodes")}, {Q.top('(SELECT * FROM bm25 WHERE score > 0)', 10, 'best')}
SELECT query_id, best.node_id, type, score, rank FROM best JOIN nodes USING (node_id)""")
def graph_search(spark, sf):
    """Entities, chunks, chapters and documents found together by their search texts."""
    best = lexical.top_k(S.node_index(spark, sf).search(S.query_texts(spark, sf), 10, positive=True), 10)
    return best.join(graph_nodes(spark, sf).select("node_id", "type"), "node_id").select("query_id", "node_id", "type", "score", "rank")
