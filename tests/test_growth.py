"""What a task holds or moves doesn't follow the size of the tables."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillrank.functions import text as T
from quillrank.operators import inverted, models, resolve, vector
from quillrank.plans import QUERIES, retrieval_queries
from quillrank.sources import tables as S


def test_segments_are_closed_by_words(spark):
    texts = ["a b a", "", "c", "b b b b b b b", "a c", None, "d"]
    src = spark.createDataFrame([(str(i), i, None if t is None else t.split()) for i, t in enumerate(texts)], "node_id string, h bigint, tokens array<string>").select("node_id", "h", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))
    packed = src.coalesce(1).mapInArrow(partial(inverted._pack, first=0, most=4), f"{inverted._POSTINGS}, ids array<string>, hashes array<bigint>, lengths array<int>").collect()
    heads = {r.segment: r for r in packed if r.term is None}
    assert [h.ids for _, h in sorted(heads.items())] == [["0", "1", "2"], ["3"], ["4", "5", "6"]]
    assert [h.lengths for _, h in sorted(heads.items())] == [[3, 0, 1], [7], [2, 0, 1]]
    found = sorted((heads[r.segment].ids[p], r.term, n) for r in packed if r.term is not None for p, n in zip(r.places, r.counts))
    assert found == [("0", "a", 2), ("0", "b", 1), ("2", "c", 1), ("3", "b", 7), ("4", "a", 1), ("4", "c", 1), ("6", "d", 1)]


def test_prompts_are_answered_in_slices(spark):
    out = list(models.answered(iter([pa.array([str(i) for i in range(150)]), pa.array([None, "x"])]), lambda prompts: [f"<{p}>" for p in prompts]))
    assert [len(a) for a in out] == [64, 64, 22, 2]
    assert pa.concat_arrays(out).to_pylist() == [*[f"<{i}>" for i in range(150)], "<>", "<x>"]
    asked = spark.range(500).select("id", F.concat(F.lit("p"), F.col("id").cast("string")).alias("p")).coalesce(1)
    assert models.rewrite(asked, "p").where("answer <> p").isEmpty() and models.rewrite(asked, "p").count() == 500


def test_texts_are_composed_in_slices(spark):
    out = list(T.composed(iter([pa.array(["e\u0301", None, ""] * 50)])))
    assert [len(a) for a in out] == [64, 64, 22] and pa.concat_arrays(out).to_pylist() == ["é", None, ""] * 50
    texts = spark.range(500).select("id", F.concat(F.lit("e\u0301"), F.col("id").cast("string")).alias("t")).coalesce(1)
    assert texts.where(T.nfc(F.col("t")) != F.concat(F.lit("é"), F.col("id").cast("string"))).isEmpty()


def test_lists_of_items_ask_no_other_vectors(spark, sf_dir):
    items = S.query_texts(spark, sf_dir).select("query_id")
    asked = {tuple(r) for r in retrieval_queries.lists(spark, sf_dir, 5, items=True).collect()}
    assert asked == {tuple(r) for r in retrieval_queries.lists(spark, sf_dir).where("rank < 5").join(items, "query_id", "left_semi").collect()}


def test_whole_numbers_are_an_equality(spark):
    picked = spark.createDataFrame([("a", "12"), ("a", "16a"), ("b", "99"), ("b", None), ("a", "99999999999")], "so_hieu string, dieu string")
    articles = spark.createDataFrame([("n1", "a", "Điều 12. X"), ("n2", "a", "Điều 120. Y"), ("n3", "a", "Điều 16a. Z"), ("n4", "b", "Điều 12. X"), ("n5", "b", None)], "node_id string, canonical string, name string")
    found = resolve.selected_nodes(picked, articles)
    assert sorted(tuple(r) for r in found.collect()) == [("a", "12", "n1"), ("a", "16a", "n3")]


def test_summary_places_need_no_window_for_each_query(spark, sf_dir):
    plan = QUERIES["summary_flow"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("windowspecdefinition(query_id" in line for line in plan.split("\n"))


def test_best_vectors_in_narrow_parts(monkeypatch):
    monkeypatch.setattr(vector, "CELLS", 30)  # three vectors at a time
    rng = np.random.default_rng(1)
    queries, rows = rng.integers(-2, 3, (10, 4)).astype(float), rng.integers(-2, 3, (50, 4)).astype(float)
    batch = pa.RecordBatch.from_arrays([pa.array([f"n{i:02}" for i in range(50)]), pa.array(rows.tolist())], ["node_id", "embedding"])
    sent = type("Sent", (), {"value": (pa.array(range(10)), queries)})
    out = pa.Table.from_batches(vector._best(iter([batch.slice(0, 2), batch.slice(2)]), sent, 7)).to_pylist()
    for i in range(10):
        best = sorted((-float(s), f"n{j:02}") for j, s in enumerate(rows @ queries[i]))[:7]
        assert [(-r["score"], r["node_id"]) for r in out if r["query_id"] == i] == best


def test_edges_are_dealt_before_they_are_sorted(spark, sf_dir):
    plan = QUERIES["graph_edges"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [src" in plan
