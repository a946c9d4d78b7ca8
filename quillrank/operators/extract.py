"""Entity graphs from texts: prompts in batches to an injected model, its answers to tables.

The model is a named rewriter of ``models``: it gets prompts, 64 at a time, and answers each with a
JSON object of entities and relations, perhaps behind a thinking part or in a code fence.  An
answer that can't be parsed is an empty graph, as is one of a batch whose calls all failed.  The
answers are written once; entities, relations and mentions are exploded from them in the JVM.

Of an entity's descriptions the longest stays, of equal ones the first in text order; this is an
aggregate, so an entity of every text is combined before the shuffle.
"""

from __future__ import annotations

import json

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import models

#: Characters that a text needs to be sent to the model.
LEAST = 30
MARK = "=== TEXT ===\n"
GRAPH = "entities array<struct<name:string,type:string,description:string>>, relations array<struct<source:string,target:string,relation:string>>"
_NAME = regex.compile(r"\p{Lu}\p{L}{5,}")


def names(prompts: list[str]) -> list[str]:
    """The default model: capitalised words of six letters or more, each with the line it first stands in, and which follows which.

    Without such a word the answer is a sentence and no JSON.
    """
    out = []
    for prompt in prompts:
        first: dict[str, str] = {}
        for line in prompt.split(MARK, 1)[-1].split("\n"):
            for name in _NAME.findall(line):
                first.setdefault(name, line[:120])
        known = list(first)
        graph = {
            "entities": [{"name": n, "type": "Organization" if len(n) >= 10 else "Concept", "description": d} for n, d in first.items()],
            "relations": [{"source": a, "target": b, "relation": "PRECEDES"} for a, b in zip(known, known[1:])],
        }
        out.append("```json\n" + json.dumps(graph, ensure_ascii=False) + "\n```" if first else "There is no name in this text.")
    return out


models.register_rewriter("names", names)


def prompt(title: Column, body: Column) -> Column:
    return F.concat(F.lit("Name the entities of this text and their relations as JSON.\nDocument: "), T.text(title), F.lit("\n" + MARK), T.text(body))


def answers(chunks: DataFrame, model: str = "names") -> DataFrame:
    """(node_id, ord, canonical, full_text) chunks become (node_id, ord, entities, relations); short texts aren't sent."""
    sent = chunks.where(F.length(F.trim("full_text")) >= LEAST).select("node_id", "ord", prompt(F.col("canonical"), F.col("full_text")).alias("prompt"))
    graph = F.from_json(T.clean_json(F.col("answer")), GRAPH)
    parsed = models.rewrite(sent, "prompt", model).select("node_id", "ord", graph.alias("graph"))
    none = lambda c, t: F.coalesce(F.col(f"graph.{c}"), F.array().cast(t)).alias(c)
    kinds = {f.name: f.dataType.simpleString() for f in parsed.schema["graph"].dataType.fields}
    return parsed.select("node_id", "ord", *[none(c, t) for c, t in kinds.items()])


def entity_id(name: Column) -> Column:
    return F.concat(F.lit("ent:"), T.slug(name))


def entity_rows(graphs: DataFrame) -> DataFrame:
    """(node_id, ord, pos, id, name, type, description): every entity of every answer."""
    rows = graphs.select("node_id", "ord", F.posexplode("entities").alias("pos", "e"))
    name = F.trim(T.text(F.col("e.name")))
    kind, said = F.coalesce("e.type", F.lit("Entity")).alias("type"), T.text(F.col("e.description")).alias("description")
    return rows.where(name != "").select("node_id", "ord", "pos", entity_id(name).alias("id"), name.alias("name"), kind, said)


def entities(rows: DataFrame) -> DataFrame:
    """(id, name, type, description): the longest description of each id, the first of equals."""
    best = F.min_by(F.struct("name", "type", "description"), F.struct((-F.length("description")).alias("size"), "ord", "pos"))
    return rows.groupBy("id").agg(best.alias("e")).select("id", "e.*")


def mentions(rows: DataFrame) -> DataFrame:
    """(tree_node, entity, relation) for every entity row, with its place."""
    return rows.select(F.col("node_id").alias("tree_node"), F.col("id").alias("entity"), F.lit("MENTIONS").alias("relation"), "ord", "pos")


def relations(graphs: DataFrame) -> DataFrame:
    """(source, target, relation, ord, pos): each relation once, at the place where it stands first."""
    rows = graphs.select("ord", F.posexplode("relations").alias("pos", "r"))
    side = lambda c: F.trim(T.text(F.col(f"r.{c}")))
    kind = F.trim(F.coalesce("r.relation", F.lit("RELATED_TO")))
    found = rows.where((side("source") != "") & (side("target") != "")).select(entity_id(side("source")).alias("source"), entity_id(side("target")).alias("target"), kind.alias("relation"), "ord", "pos")
    return found.groupBy("source", "target", "relation").agg(F.min(F.struct("ord", "pos")).alias("at")).select("source", "target", "relation", "at.*")


def similar_names(found: DataFrame) -> DataFrame:
    """(alias, canonical): entities whose names are the same without accents; the smallest id stands for all.

    This is the default resolver; a model's groups go through ``graph.alias_map``.
    """
    plain = found.select("id", T.normalize(F.col("name")).alias("plain"))
    least = plain.groupBy("plain").agg(F.min("id").alias("canonical"), F.count("*").alias("n")).where("n > 1").drop("n")
    return plain.join(least, "plain").where("id <> canonical").select(F.col("id").alias("alias"), "canonical")


def resolved(found: DataFrame, linked: DataFrame, mentioned: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, relations, mentions) under canonical ids.

    A canonical entity keeps its name and type and takes an alias's description if that is longer;
    relations that become self loops go, equal ones meet, and mentions move to the canonical entity.
    """
    to = lambda c, as_: aliases.select(F.col("alias").alias(c), F.col("canonical").alias(as_))
    moved = found.join(to("id", "to"), "id", "left")
    own = F.col("to").isNull()
    size = F.struct((-F.length("description")).alias("size"), F.col("to").isNotNull().alias("moved"), "id")
    groups = moved.groupBy(F.coalesce("to", "id").alias("key")).agg(
        F.max(F.when(own, F.struct("name", "type"))).alias("own"), F.min_by("description", size).alias("description")
    )
    kept = groups.where("own is not null").select(F.col("key").alias("id"), "own.name", "own.type", "description")
    rel = linked.join(to("source", "s"), "source", "left").join(to("target", "t"), "target", "left")
    rel = rel.select(F.coalesce("s", "source").alias("source"), F.coalesce("t", "target").alias("target"), "relation", "ord", "pos").where("source <> target")
    rel = rel.groupBy("source", "target", "relation").agg(F.min(F.struct("ord", "pos")).alias("at")).select("source", "target", "relation", "at.*")
    told = mentioned.join(to("entity", "e"), "entity", "left").select("tree_node", F.coalesce("e", "entity").alias("entity"), "relation", "ord", "pos")
    return kept, rel, told
