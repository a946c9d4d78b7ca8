"""Entity extraction with models that fail, answer badly or oddly; the whole graph's edges."""

from __future__ import annotations

import json

import pytest

from quillrank.operators import extract, graph, models

CHUNKS = "node_id string, ord bigint, canonical string, chapter string, name string, full_text string"


def chunk(i, text):
    return (f"node:{i}", i, "law", "I", f"Article {i}", text)


def answered(spark, name, rows):
    return extract.answers(spark.createDataFrame(rows, CHUNKS), name)


LONG = "x" * 40


def odd(prompts):
    """One answer for each kind of text."""
    out = []
    for p in prompts:
        text = p.split(extract.MARK)[1]
        if text.startswith("bad"):
            out.append("{not json")
        elif text.startswith("list"):
            out.append("[1, 2]")
        elif text.startswith("part"):
            out.append(json.dumps({"entities": [{"name": "  Sân   Trường "}, {"name": " "}, {"name": None, "type": "x"}, {"name": "Other", "type": "Role", "description": "d"}]}))
        elif text.startswith("think"):
            out.append("so {} </think>\n```json\n" + json.dumps({"entities": [{"name": "OTHER", "type": "Policy", "description": "longer"}], "relations": [{"source": "Other", "target": " Sân Trường", "relation": None}, {"source": "", "target": "x"}]}) + "\n```")
        else:
            out.append(json.dumps({"entities": [{"name": "Other", "type": "Last", "description": "equal!"}], "relations": [{"source": "Other", "target": "Sân Trường", "relation": " LEADS "}] * 2}))
    return out


models.register_rewriter("odd", odd)


def broken(prompts):
    raise RuntimeError("no model")


models.register_rewriter("broken", broken)


def test_odd_answers(spark):
    rows = [chunk(0, "bad" + LONG), chunk(1, "list" + LONG), chunk(2, "part" + LONG), chunk(3, "think" + LONG), chunk(4, "last" + LONG), chunk(5, "short"), chunk(6, None), chunk(7, " " * 50)]
    graphs = answered(spark, "odd", rows).cache()
    assert sorted((r.node_id, len(r.entities), len(r.relations)) for r in graphs.collect()) == [("node:0", 0, 0), ("node:1", 0, 0), ("node:2", 4, 0), ("node:3", 1, 2), ("node:4", 1, 2)]
    found = extract.entity_rows(graphs)
    assert {r.id: (r.name, r.type, r.description) for r in extract.entities(found).collect()} == {"ent:sân_trường": ("Sân   Trường", "Entity", ""), "ent:other": ("OTHER", "Policy", "longer")}
    assert sorted((r.tree_node, r.entity) for r in extract.mentions(found).collect()) == [("node:2", "ent:other"), ("node:2", "ent:sân_trường"), ("node:3", "ent:other"), ("node:4", "ent:other")]
    assert sorted((r.source, r.target, r.relation) for r in extract.relations(graphs).collect()) == [("ent:other", "ent:sân_trường", "LEADS"), ("ent:other", "ent:sân_trường", "RELATED_TO")]


def test_failed_calls_are_empty_graphs(spark, monkeypatch):
    monkeypatch.setattr(models, "WAITS", (0.0, 0.0))
    real = models.rewrite
    monkeypatch.setattr(models, "rewrite", lambda df, prompt, name, **kw: real(df, prompt, name, waits=(0.0, 0.0)))
    got = answered(spark, "broken", [chunk(i, LONG) for i in range(130)]).collect()
    assert len(got) == 130 and all(r.entities == [] and r.relations == [] for r in got)


def test_batches_of_64():
    sizes = []
    models.patiently(lambda items: sizes.append(len(items)) or items, ["x"] * 64)
    assert sizes == [64] and models.BATCH == 64


def test_resolution(spark):
    ent = spark.createDataFrame([("ent:a", "A", "T", "dd"), ("ent:á", "Á", "U", "dddd"), ("ent:ã", "Ã", "V", "dddd"), ("ent:b", "B", "T", "")], "id string, name string, type string, description string")
    rel = spark.createDataFrame([("ent:a", "ent:á", "R", 0, 0), ("ent:á", "ent:b", "R", 0, 1), ("ent:a", "ent:b", "R", 1, 0), ("ent:b", "ent:ã", "S", 1, 1)], "source string, target string, relation string, ord bigint, pos int")
    men = spark.createDataFrame([("node:1", "ent:á", "MENTIONS", 0, 0), ("node:1", "ent:b", "MENTIONS", 0, 1)], "tree_node string, entity string, relation string, ord bigint, pos int")
    aliases = extract.similar_names(ent)
    assert sorted(map(tuple, aliases.collect())) == [("ent:á", "ent:a"), ("ent:ã", "ent:a")]
    e, r, m = extract.resolved(ent, rel, men, aliases)
    assert sorted(map(tuple, e.collect())) == [("ent:a", "A", "T", "dddd"), ("ent:b", "B", "T", "")]
    assert sorted((x.source, x.target, x.relation, x.ord) for x in r.collect()) == [("ent:a", "ent:b", "R", 0), ("ent:b", "ent:a", "S", 1)]
    assert sorted(x.entity for x in m.collect()) == ["ent:a", "ent:b"]


def test_last_writer_over_sources(spark):
    """Structure is written after mentions, and mentions after relations."""
    chunks = spark.createDataFrame([("doc:law", "law", "I", "", "t")], "node_id string, canonical string, chapter string, name string, full_text string")
    rel = spark.createDataFrame([("a", "b", "R", 0, 0), ("b", "a", "S", 5, 0), ("doc:law", "chap:law:I", "R", 0, 0), ("doc:law", "e", "R", 9, 9)], "source string, target string, relation string, ord bigint, pos int")
    men = spark.createDataFrame([("doc:law", "e", "MENTIONS", 0, 0)], "tree_node string, entity string, relation string, ord bigint, pos int")
    got = {(r.src, r.dst): r.type for r in graph.all_edges(rel, men, chunks).collect()}
    assert got["a", "b"] == "REV_S" and got["b", "a"] == "S" and got["doc:law", "e"] == "MENTIONS" and got["e", "doc:law"] == "MENTIONED_IN"
    assert got["doc:law", "chap:law:I"] in ("THUOC_CHUONG", "REV_THUOC_VAN_BAN")


@pytest.mark.parametrize("rows", [[]])
def test_empty(spark, rows):
    graphs = answered(spark, "names", rows)
    found = extract.entity_rows(graphs)
    assert extract.entities(found).collect() == [] and extract.relations(graphs).collect() == [] and extract.mentions(found).collect() == []
