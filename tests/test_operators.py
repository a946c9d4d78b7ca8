"""Operators whose results SQL doesn't give, and properties of those that it does."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from quillrank.operators import context, corpus, fusion, graph, sessions
from quillrank.sources import files


def test_mmr_matches_plain_greedy(spark):
    random.seed(2)
    words = "a b c d e f g h".split()
    rows = [(q, f"n{i}", round(random.random(), 3), " ".join(random.choices(words, k=4))) for q in (0, 1) for i in range(8)]
    got = {}
    for r in fusion.mmr(spark.createDataFrame(rows, "query_id bigint, node_id string, score double, text string"), 4).collect():
        got.setdefault(r.query_id, {})[r.place] = r.node_id
    for q in (0, 1):
        left, chosen = {n: (s, set(t.split())) for k, n, s, t in rows if k == q}, []
        while len(chosen) < 4:
            def value(n):
                sim = max((len(left[n][1] & w) / len(left[n][1] | w) for _, w in chosen), default=0)
                return (0.7 * left[n][0] - 0.3 * sim) if chosen else left[n][0]
            best = min(left, key=lambda n: (-value(n), n))
            chosen.append((best, left.pop(best)[1]))
        assert [got[q][i] for i in range(4)] == [n for n, _ in chosen]


def test_budget_skip(spark):
    rows = spark.createDataFrame([(0, 0, 90), (0, 1, 20), (0, 2, 10), (1, 0, 500), (1, 1, 1)], "query_id int, place bigint, size bigint")
    assert sorted(map(tuple, fusion.budget_skip(rows, 100).collect())) == [(0, 0), (0, 2), (1, 0)]


def test_rrf_ignores_list_order(spark):
    a = spark.createDataFrame([(0, 0, 0, "x"), (0, 0, 1, "y"), (0, 1, 0, "y"), (0, 1, 1, "z")], "query_id int, list_id int, rank bigint, node_id string")
    b = a.withColumn("list_id", 1 - F.col("list_id"))
    assert sorted(fusion.rrf(a).collect()) == sorted(fusion.rrf(b).collect())


def test_expand_grows_with_hops(spark):
    edges = spark.createDataFrame([("a", "b", "t"), ("b", "c", "t"), ("c", "a", "t"), ("c", "d", "t")], "src string, dst string, type string")
    seeds = spark.createDataFrame([(0, "a")], "query_id int, node string")
    sizes = [graph.expand(seeds, edges, k).count() for k in range(4)]
    assert sizes == [1, 2, 3, 4]


def test_rate_limit_replay(spark):
    rows = spark.createDataFrame([(i, 1, f"2024-01-01 00:00:{s:02d}") for i, s in enumerate([0, 1, 2, 31, 32])], "event_id bigint, client bigint, ts string").withColumn("ts", F.to_timestamp("ts"))
    got = {r.event_id: r.allowed for r in sessions.rate_limit(rows, 2).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: False}


def test_rewrite_citations(spark):
    sources = F.array(F.struct(F.lit("Law A").alias("name"), F.lit("5").alias("article")), F.struct(F.lit("B").alias("name"), F.lit(None).cast("string").alias("article")))
    row = spark.range(1).select(context.rewrite_citations(F.lit("[1] [2] [1, khoản 2] [7] [x]"), sources)).first()
    assert row[0] == "[Law A, Điều 5] [B] [Law A, khoản 2] [7] [x]"


def test_html_lines(spark):
    pages = spark.createDataFrame([(1, "<html><script>no</script><nav><p>no</p></nav><h1>T &amp; U</h1><div>a<p>b  c</p></div></html>"), (2, None)], "page_id bigint, html string")
    assert [tuple(r) for r in corpus.html_lines(pages).orderBy("line_no").collect()] == [(1, 0, "T & U"), (1, 1, "a"), (1, 2, "b c")]


def test_files(spark, tmp_path):
    (tmp_path / "law.json").write_text(json.dumps([{"id": "L_D1", "metadata": {"so_hieu": "1/2020"}, "content": {"full_text": "Điều 1"}}]))
    (tmp_path / "bad.json").write_text("{ not json")
    (tmp_path / "doc_titles.json").write_text(json.dumps({"1/2020": "Law"}))
    (tmp_path / "graph.txt").write_text(json.dumps({"entity_graph": {"metadata": {}, "entities": [{"id": "ent:a", "name": "A", "type": "Role", "description": "d"}], "relations": [], "mappings": [{"tree_node": "node:L_D1", "entity": "ent:a", "relation": "MENTIONS"}]}}))
    rows = files.chunk_files(spark, str(tmp_path)).collect()
    assert [(r.id, r.source, r.content.full_text) for r in rows] == [("L_D1", "law", "Điều 1")]
    assert [tuple(r) for r in files.title_map(spark, str(tmp_path / "doc_titles.json")).collect()] == [("1/2020", "Law")]
    entities, relations, mappings = files.graph_file(spark, str(tmp_path / "graph.txt"))
    assert (entities.count(), relations.count(), mappings.first().entity) == (1, 0, "ent:a")


def test_resumable_and_index(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "qid int, v string")
    path = str(tmp_path / "out")
    files.append_new(df, path, "qid")
    files.append_new(df.union(spark.createDataFrame([(3, "c")], "qid int, v string")), path, "qid")
    assert sorted(r.qid for r in spark.read.parquet(path).collect()) == [1, 2, 3]
    files.write_index({"t": df}, str(tmp_path / "index"))
    assert files.index_is_current(spark, df, str(tmp_path / "index"), "t")
    assert not files.index_is_current(spark, df.limit(1), str(tmp_path / "index"), "t")


def test_models(spark):
    from quillrank.operators import models

    calls = []

    def flaky(prompts):
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("busy")
        return [p.upper() for p in prompts]

    assert models.patiently(flaky, ["a"], (0.0, 0.0)) == (["A"], None)
    assert models.patiently(lambda p: 1 / 0, ["a"], (0.0, 0.0))[1] == "division by zero"
    models.register_rewriter("broken", lambda p: [""] * len(p))
    df = spark.createDataFrame([("x",), (None,)], "p string")
    assert [r.answer for r in models.rewrite(df, "p", "broken", waits=(0.0, 0.0)).collect()] == ["[LLM Error: empty answer]"] * 2
    pairs = spark.createDataFrame([("a b", "b c"), (None, "x")], "q string, t string")
    assert [r.score for r in models.score(pairs, "q", "t").collect()] == [0.5, 0.0]
    v = models.encode(df, "p").first().embedding
    assert len(v) == 64 and abs(sum(x * x for x in v) - 1) < 1e-6


def test_trace_and_backup(spark, tmp_path):
    log, path = str(tmp_path / "log"), str(tmp_path / "t")
    for word in ("one", "two"):
        files.append_trace(spark.createDataFrame([(word,)], "line string"), log)
    assert sorted(r.value for r in spark.read.text(log).collect()) == ["one", "two"]
    spark.range(3).write.parquet(path)
    files.rewrite_with_backup(spark.read.parquet(path).where("id > 0"), path)
    assert spark.read.parquet(path).count() == 2 and spark.read.parquet(f"{path}.bak").count() == 3


def test_streamed_cache_and_bucket(spark, sf_dir):
    from quillrank.streaming import stream

    key = F.concat("event_type", F.lit(":"), F.col("user_id").cast("string"))
    batch = spark.read.parquet(f"{sf_dir}/events.parquet").withColumns({"key": key, "client": F.col("user_id")})
    events = stream.events(spark, sf_dir)
    hits = stream.drain(stream.cached(events.withColumn("key", key)), "append")
    assert sorted(hits.collect()) == sorted(sessions.cache_hits(batch).collect())
    passed = stream.drain(stream.rate_limit(events, 2), "append")
    assert sorted(passed.collect()) == sorted(sessions.rate_limit(batch, 2).collect())
