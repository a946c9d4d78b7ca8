"""Recall by requirement, recency, blocks of query vectors, empty chapters, reports."""

from __future__ import annotations

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillrank.operators import graph, lexical, metrics, resolve, sessions, sizing, vector
from quillrank.sources import files


def test_requirement_recall(spark):
    rows = spark.createDataFrame([(0, [[5, 6], [9]], ["Điều 6", "Khoản 9", None]), (1, [], ["Điều 1"]), (2, [[4]], []), (3, [[3], [4]], ["Điều 3, Điều 4"])], "q int, r array<array<int>>, f array<string>")
    got = dict(rows.select("q", metrics.requirement_recall(F.col("r"), F.col("f"))).collect())
    assert got == {0: 0.5, 1: 1.0, 2: 0.0, 3: 0.5}  # an item names its first article only


def test_recency(spark):
    rows = spark.createDataFrame([("a", 3), ("b", 9), ("a", 5), ("c", None), ("d", 9)], "s string, at int")
    assert [tuple(r) for r in sessions.by_recency(rows, "s", "at").collect()] == [("b", 9, 1), ("d", 9, 1), ("a", 5, 2), ("c", None, 1)]
    assert sessions.by_recency(rows.limit(0), "s", "at").count() == 0


def test_blocks_of_query_vectors(spark, monkeypatch):
    rng = random.Random(3)
    draw = lambda n: [(i, [rng.random() for _ in range(4)]) for i in range(n)]
    vectors, queries = spark.createDataFrame(draw(30), "node_id bigint, embedding array<double>"), spark.createDataFrame(draw(11), "query_id bigint, query array<double>")
    whole = sorted(vector.dense_top_k(vectors, queries, 3).collect())
    monkeypatch.setattr(vector, "MAX_QUERIES", 4)
    assert sorted(vector.dense_top_k(vectors, queries, 3).collect()) == whole and len(whole) == 33


def test_empty_chapters_make_no_node(spark):
    rows = spark.createDataFrame([("n1", "d", "I"), ("n2", "d", ""), ("n3", "d", None)], "node_id string, canonical string, chapter string")
    got = {(r.src, r.dst) for r in graph.structure(rows).collect()}
    up = {("n1", "doc:d"), ("n2", "doc:d"), ("n3", "doc:d"), ("n1", "chap:d:I"), ("chap:d:I", "doc:d")}
    assert got == up | {(b, a) for a, b in up}


def test_missing_by_file(spark):
    chunks = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "z"), (5, "w")], "id int, file string")
    covered = spark.createDataFrame([(4,), (4,), (2,)], "id int")
    assert [tuple(r) for r in graph.missing_by_file(chunks, covered, "id", "file").collect()] == [("w", 1, 1), ("x", 1, 2), ("y", 1, 1)]
    assert [r.file for r in graph.missing_by_file(chunks, covered, "id", "file", 2).collect()] == ["w", "x"]


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a|b"), (2, None), (3, "c\nd")], "k int, v string").orderBy("k")
    read = lambda p: [line for f in sorted(Path(p).glob("part-*")) for line in f.read_text().splitlines()]
    for form in ("json", "text", "markdown"):
        files.write_report(rows, str(tmp_path / form), form)
    assert sorted(json.loads(x)["k"] for x in read(tmp_path / "json")) == [1, 2, 3]
    assert sorted(read(tmp_path / "text")) == ["1", "2", "3"]
    assert read(tmp_path / "markdown") == ["| k | v |", "| --- | --- |", "| 1 | a\\|b |", "| 2 |  |", "| 3 | c d |"]
    with pytest.raises(ValueError):
        files.write_report(rows, str(tmp_path / "x"), "pdf")


def test_joins_by_checked_size(spark):
    large = spark.createDataFrame([(i, f"w{i % 7} x") for i in range(40)] + [(None, None)], "i int, text string")
    small = spark.createDataFrame([(f"w{j}",) for j in range(9)] + [(None,), ("w1",)], "word string")
    near = F.contains(F.col("text"), F.col("word"))
    plain = sorted(map(tuple, large.join(small, near).collect()))
    assert sorted(map(tuple, sizing.meet(large, small, near, 3).collect())) == plain and plain
    assert sizing.meet(large, small.limit(0), near, 3).count() == 0
    for rows in (3, 100):
        held = sizing.bounded(small.withColumnRenamed("word", "w"), rows)
        assert large.join(held, F.substring("text", 1, 2) == F.col("w")).count() == 46


def test_bm25_beyond_the_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(f"n{i}", f"a{i % 3} b{i % 5} common") for i in range(20)], "node_id string, full_text string")
    asked = spark.createDataFrame([(0, "a1 b2"), (1, "common a0 a0"), (2, "")], "query_id int, query string")
    whole = sorted(map(tuple, lexical.bm25(docs, asked).collect()))
    monkeypatch.setattr(lexical, "MAX_TERMS", 1)
    assert sorted(map(tuple, lexical.bm25(docs, asked).collect())) == whole and whole


def test_canonical_numbers(spark):
    rules = spark.createDataFrame([("X", "1", "t0", 0), ("X", "", "t1", 1)], "needle string, also string, target string, ord int")
    numbers = spark.createDataFrame([("x1",), ("x2",), ("y",), ("y",), (None,)], "raw string")
    assert sorted(map(tuple, resolve.canonical_number(numbers, rules).collect()), key=str) == [("x1", "t0"), ("x2", "t1"), ("y", "y"), (None, None)]


def test_crawl_ends_on_cycles(spark):
    """Every page once, at the fewest steps, though links go round and names are shared."""
    from quillrank.operators import corpus

    links = spark.createDataFrame([(1, "b"), (2, "c"), (3, "a"), (3, "b"), (3, "d"), (9, "a"), (4, "d")], "page_id bigint, name string")
    heads = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "d"), (6, "e")], "page_id bigint, name string")
    seeds = spark.createDataFrame([(1,), (1,)], "page_id bigint")
    assert sorted(map(tuple, corpus.crawl(links, heads, seeds).collect())) == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 3)]
    assert corpus.crawl(links, heads, seeds.limit(0)).collect() == []
    pages = spark.createDataFrame([(1, '<ul><li><a href="/x">One</a></li><li> </li><li>Two\nlines</li></ul>'), (2, None)], "page_id bigint, html string")
    assert sorted(map(tuple, corpus.items(pages).collect())) == [(1, 0, "One"), (1, 2, "Two\nlines")]


def test_outline_forgets_the_section_in_a_new_chapter(spark):
    from quillrank.operators import corpus, graph, toc

    lines = ["before", "Chương I", "Mục 1", "Điều 1. a", "text", "Điều 2. b", "Chương II", "Điều 3. c", "Mục 1", "Điều 4. d", "chương I", "Mục 1", "Điều 5. e"]
    rows = spark.createDataFrame([(7, i, x) for i, x in enumerate(lines)], "page_id bigint, line_no bigint, line string")
    found = corpus.as_chunks(corpus.articles(rows))
    got = {r.name: (r.chapter, r.section) for r in found.collect()}
    assert got == {"Điều 1. a": ("Chương I", "Mục 1"), "Điều 2. b": ("Chương I", "Mục 1"), "Điều 3. c": ("Chương II", ""), "Điều 4. d": ("Chương II", "Mục 1"), "Điều 5. e": ("chương I", "Mục 1")}
    text = "\n".join(r.line for r in toc.outline(found).orderBy("place").collect())
    assert text == "\nChương I\n  Mục 1\n    - Điều 1. a\n    - Điều 2. b\n\nChương II\n  - Điều 3. c\n  Mục 1\n    - Điều 4. d\n\nchương I\n  Mục 1\n    - Điều 5. e"
    edges = graph.structure(found)
    up = {r.src: (r.document, r.chapter, r.section) for r in graph.parents(edges.where("src like 'node:%'")).collect()}
    assert up["node:7_D3"] == ("doc:7", "chap:7:Chương II", None) and up["node:7_D1"][2] == "sec:7:Mục 1"
    assert {r.dst for r in edges.where("src = 'sec:7:Mục 1' and type = 'THUOC_CHUONG'").collect()} == {"chap:7:Chương I"}


def test_dense_blocks_against_pairs(spark, monkeypatch):
    """Block products give what a row for each pair gives: ties by id, nulls, several blocks of queries, more than there is."""
    import random

    from quillrank.operators import vector
    from quillrank.operators.lexical import top_k

    rng = random.Random(1)
    rows = [(f"n{i}", [rng.choice([0.0, 0.5, 1.0]) for _ in range(3)] if i % 9 else None) for i in range(60)]
    vectors = spark.createDataFrame(rows, "node_id string, embedding array<float>").repartition(3)
    queries = spark.createDataFrame([(i, [rng.choice([-1.0, 0.5, 1.0]) for _ in range(3)] if i % 5 else None) for i in range(11)], "query_id bigint, query array<float>")
    want = {k: sorted(map(tuple, top_k(vector.scores(vectors.where("embedding is not null"), queries.where("query is not null")), k).collect())) for k in (1, 7, 99)}
    for most in (2, 10_000):
        monkeypatch.setattr(vector, "MAX_QUERIES", most)
        for k in (1, 7, 99):
            assert sorted(map(tuple, vector.dense_top_k(vectors, queries, k).collect())) == want[k]
    assert vector.dense_top_k(vectors.limit(0), queries, 3).collect() == [] and vector.dense_top_k(vectors, queries.limit(0), 3).collect() == []


def test_service_folds_match_plain_replay(spark):
    """Cache and limiter, cut at gaps, against requests taken one after the other."""
    import datetime as dt
    import random

    from quillrank.operators import sessions

    rng = random.Random(4)
    start, rows, at = dt.datetime(2024, 1, 1), [], 0.0
    for i in range(400):
        at += rng.choice([0, 0.5, 3, 29.9, 31, 59.999, 60, 61, 700, 1799.9, 1800])
        rows.append((i, rng.choice("ab"), rng.choice([1, 2]), start + dt.timedelta(seconds=at)))
    frame = spark.createDataFrame(rows, "event_id bigint, key string, client bigint, ts timestamp")
    written, hits = {}, {}
    tokens, last, allowed = {}, {}, {}
    for i, key, client, ts in rows:
        hits[i] = key in written and (ts - written[key]).total_seconds() < 1800
        if not hits[i]:
            written[key] = ts
        last.setdefault(client, ts)
        refill = int((ts - last[client]) // dt.timedelta(microseconds=1) * 3 // 60_000_000)
        if refill > 0:
            tokens[client], last[client] = min(3, tokens.get(client, 3) + refill), ts
        allowed[i] = tokens.setdefault(client, 3) > 0
        tokens[client] -= allowed[i]
    assert {r.event_id: r.hit for r in sessions.cache_hits(frame).collect()} == hits
    assert {r.event_id: r.allowed for r in sessions.rate_limit(frame, 3).collect()} == allowed


def test_articles_are_numbered_over_ranges(spark, sf_dir, monkeypatch):
    from quillrank.sources import tables

    rows = tables.chunks(spark, sf_dir)
    whole = {r.node_id: r.article for r in tables.numbered(rows).collect()}
    monkeypatch.setattr(tables, "SPAN", 7)
    assert {r.node_id: r.article for r in tables.numbered(rows).collect()} == whole
    by_doc = {}
    for r in rows.orderBy("doc_id").collect():
        by_doc.setdefault(r.canonical, []).append(r.node_id)
    assert whole == {n: i for nodes in by_doc.values() for i, n in enumerate(nodes, 1)}
