"""Graph tables: nodes and typed edges with one edge for each ordered pair."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_writer(edges: DataFrame) -> DataFrame:
    """(src, dst, type, ord): of the edges of an ordered pair, the one written last stays."""
    return edges.groupBy("src", "dst").agg(F.max_by("type", F.struct("ord", "type")).alias("type"))


def with_reverse(relations: DataFrame) -> DataFrame:
    """(source, target, relation, ord) become edges and their REV_ edges, in writing order; ord is of any orderable type."""
    order = lambda back: F.struct(F.col("ord").alias("at"), F.lit(back).alias("back")).alias("ord")
    ahead = relations.select(F.col("source").alias("src"), F.col("target").alias("dst"), F.col("relation").alias("type"), order(0))
    back = relations.select(F.col("target").alias("src"), F.col("source").alias("dst"), F.concat(F.lit("REV_"), "relation").alias("type"), order(1))
    return last_writer(ahead.unionByName(back))


def all_edges(relations: DataFrame, mentions: DataFrame, chunks: DataFrame) -> DataFrame:
    """The whole graph's edges: relations are written first, then MENTIONS and MENTIONED_IN, then the corpus' structure.

    ``relations`` and ``mentions`` have ord and pos.  Of an ordered pair's edges the one written last stays.
    """
    order = lambda source, *at: F.struct(F.lit(source).alias("source"), *at).alias("ord")
    place = (F.col("ord").cast("bigint").alias("ord"), F.col("pos").cast("bigint").alias("pos"))
    none = (F.lit(0).cast("bigint").alias("ord"), F.lit(0).cast("bigint").alias("pos"))
    step = lambda back: F.lit(back).alias("back")
    edge = lambda df, a, b, kind, o: df.select(F.col(a).alias("src"), F.col(b).alias("dst"), kind.alias("type"), o)
    written = [
        edge(relations, "source", "target", F.col("relation"), order(0, *place, step(0))),
        edge(relations, "target", "source", F.concat(F.lit("REV_"), "relation"), order(0, *place, step(1))),
        edge(mentions, "tree_node", "entity", F.lit("MENTIONS"), order(1, *place, step(0))),
        edge(mentions, "entity", "tree_node", F.lit("MENTIONED_IN"), order(1, *place, step(1))),
        edge(structure(chunks), "src", "dst", F.col("type"), order(2, *none, step(0))),
    ]
    # Pairs hardly repeat within a task, so a sort of what it reads would combine nothing: edges are dealt first and sorted once, by pairs.
    return last_writer(reduce(DataFrame.unionByName, written).repartition("src", "dst"))


def nodes(entities: DataFrame, chunks: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """(node_id, kind, name, search_text): entities and the corpus' chunks, documents, chapters and sections.

    ``titles`` has (canonical, title) rows; a document without one has its own name as title.
    """
    ent = entities.select(F.col("id").alias("node_id"), "type", "name", F.concat("type", F.lit(": "), "name", F.lit(" - "), "description").alias("search_text"))
    named = chunks.withColumn("title", F.col("canonical")) if titles is None else chunks.join(titles, "canonical", "left").withColumn("title", F.coalesce("title", "canonical"))
    own = named.select("node_id", F.lit("Article").alias("type"), "name", F.concat("title", F.lit(" - "), F.substring("full_text", 1, 512)).alias("search_text"))
    docs = named.select(F.concat(F.lit("doc:"), "canonical").alias("node_id"), F.lit("Document").alias("type"), F.col("canonical").alias("name"), F.col("title").alias("search_text")).distinct()
    part = lambda kind, column: named.where(F.col(column) != "").select(
        F.concat(F.lit("sec:" if kind == "Section" else "chap:"), "canonical", F.lit(":"), column).alias("node_id"), F.lit(kind).alias("type"), F.col(column).alias("name"),
        F.concat(F.lit(f"{kind}: "), column, F.lit(" of "), "canonical").alias("search_text"),
    ).distinct()
    parts = [part("Chapter", "chapter")] + ([part("Section", "section")] if "section" in chunks.columns else [])
    return reduce(DataFrame.unionByName, [ent, own, docs, *parts])


def expand(seeds: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(query_id, node) seeds become every node within so many hops, with the fewest hops."""
    reached = seeds.select("query_id", "node", F.lit(0).alias("hop")).distinct()
    layer = reached
    for hop in range(1, hops + 1):
        step = layer.join(edges, layer["node"] == edges["src"]).select("query_id", F.col("dst").alias("node")).distinct()
        layer = step.join(reached, ["query_id", "node"], "left_anti").withColumn("hop", F.lit(hop))
        reached = reached.unionByName(layer)
    return reached


def first_neighbour(edges: DataFrame, type_: str) -> DataFrame:
    """The first out-neighbour over edges of one type."""
    return edges.where(F.col("type") == type_).groupBy("src").agg(F.min("dst").alias("dst"))


def parents(edges: DataFrame) -> DataFrame:
    """(src, document, chapter, section): each node's first parent of each kind, null without one."""
    first = lambda kind, name: F.min(F.when(F.col("type") == kind, F.col("dst"))).alias(name)
    up = edges.where(F.col("type").isin("THUOC_VAN_BAN", "THUOC_CHUONG", "THUOC_MUC"))
    return up.groupBy("src").agg(first("THUOC_VAN_BAN", "document"), first("THUOC_CHUONG", "chapter"), first("THUOC_MUC", "section"))


def structure(chunks: DataFrame) -> DataFrame:
    """Edges between chunks, sections, chapters and documents, and back; a null or empty heading makes no node.

    A section belongs to its chapter, or to the document where there is none; ``section`` is an optional column.
    """
    doc, chap = F.concat(F.lit("doc:"), "canonical"), F.concat(F.lit("chap:"), "canonical", F.lit(":"), "chapter")
    up = chunks.select(F.col("node_id").alias("source"), doc.alias("target"), F.lit("THUOC_VAN_BAN").alias("relation"))
    within = chunks.where("chapter <> ''")
    up = up.union(within.select("node_id", chap, F.lit("THUOC_CHUONG"))).union(within.select(chap, doc, F.lit("THUOC_VAN_BAN")).distinct())
    if "section" in chunks.columns:
        sec, inner = F.concat(F.lit("sec:"), "canonical", F.lit(":"), "section"), chunks.where("section <> ''")
        # A section's first chunk decides where it hangs, as it is made there.
        first = inner.groupBy(sec.alias("source")).agg(F.min_by(F.struct(doc.alias("doc"), chap.alias("chap"), "chapter"), "node_id").alias("at"))
        hung = F.col("at.chapter") != ""
        above = first.select("source", F.when(hung, F.col("at.chap")).otherwise(F.col("at.doc")), F.when(hung, "THUOC_CHUONG").otherwise("THUOC_VAN_BAN"))
        up = up.union(inner.select("node_id", sec, F.lit("THUOC_MUC"))).union(above)
    return with_reverse(up.withColumn("ord", F.lit(0)))


def dedupe_entities(entities: DataFrame) -> DataFrame:
    """One row for each id: the longest description, the first of equals by ord."""
    size = F.struct((-F.length(F.coalesce("description", F.lit("")))).alias("size"), "ord")
    best = entities.groupBy("id").agg(F.min_by(F.struct(*[c for c in entities.columns if c != "id"]), size).alias("e"))
    return best.select("id", "e.*")


def merge(main: tuple[DataFrame, DataFrame], patch: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of a main graph and a patch; the main graph comes first."""
    tag = lambda df, i: df.withColumn("ord", F.col("ord") + i * 1_000_000_000)
    entities = dedupe_entities(tag(main[0], 0).unionByName(tag(patch[0], 1)))
    relations = main[1].unionByName(patch[1]).dropDuplicates(["source", "target", "relation"])
    return entities, relations


def alias_map(groups: DataFrame) -> DataFrame:
    """(canonical, aliases array) become (alias, canonical) rows without self."""
    return groups.select("canonical", F.explode("aliases").alias("alias")).where("alias <> canonical").groupBy("alias").agg(F.min("canonical").alias("canonical"))


def missing_by_file(chunks: DataFrame, covered: DataFrame, key: str, file: str, top: int = 20) -> DataFrame:
    """The ``top`` files with the most chunks that ``covered`` doesn't name, most first, then by name."""
    marked = chunks.join(covered.select(key, F.lit(True).alias("hit")).distinct(), key, "left")
    counted = marked.groupBy(file).agg(F.count_if(F.col("hit").isNull()).alias("missing"), F.count("*").alias("total"))
    return counted.where("missing > 0").orderBy(F.desc("missing"), file).limit(top)


def coverage_summary(chunks: DataFrame, covered: DataFrame, key: str, by: str) -> DataFrame:
    """Totals, covered, missing and percentage for each value of ``by``, and for all under null."""
    marked = chunks.join(covered.select(key, F.lit(True).alias("hit")).distinct(), key, "left")
    n, hit = F.count("*"), F.count("hit")
    return marked.rollup(by).agg(n.alias("total"), hit.alias("covered"), (n - hit).alias("missing"), F.round(hit * 100.0 / n, 2).alias("percent"))


def coverage(chunks: DataFrame, mapped: DataFrame) -> DataFrame:
    """Chunks that no mapping names, by anti join."""
    return chunks.join(mapped.select(F.regexp_replace("tree_node", "^node:", "").alias("chunk")).distinct(), F.col("doc_id").cast("string") == F.col("chunk"), "left_anti")
