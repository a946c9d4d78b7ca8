"""The stored index against BM25 without one; refreshes; what a search reads."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillrank.operators import inverted, lexical
from quillrank.sources import tables as S

ROWS = [("a", "the quick brown fox"), ("b", None), ("c", ""), ("d", "The fox, the FOX!"), ("e", "one two three " * 50), ("f", "quick quick quick"), ("g", "the the the the")]
ASKED = [(1, "the quick fox"), (2, "two"), (3, "nowhere"), (4, None), (5, "the the brown")]


def table(spark, rows):
    return spark.createDataFrame(rows, "node_id string, full_text string").withColumn("extra", F.lit(1))


def asked(spark):
    return spark.createDataFrame(ASKED, "query_id bigint, query string")


def rows(df):
    return sorted((r.query_id, r.node_id, r.score) for r in df.collect())


def test_scores_and_refreshes(spark, tmp_path):
    index = inverted.Index(spark, str(tmp_path / "index"))
    assert index.refresh(table(spark, ROWS[:4]), "v1") == 4
    assert rows(index.search(asked(spark))) == rows(lexical.bm25(table(spark, ROWS[:4]), asked(spark)))
    assert index.refresh(table(spark, ROWS), "v1") == 0  # the same version isn't read
    assert index.refresh(table(spark, ROWS), "v2") == 3  # only what is new
    assert index.state()["batch"] == 1 and index.postings().select("batch").distinct().count() == 2
    whole = lexical.bm25(table(spark, ROWS), asked(spark))
    assert rows(index.search(asked(spark))) == rows(whole)
    assert index.refresh(table(spark, ROWS), "v3") == 0
    assert rows(index.search(asked(spark))) == rows(whole)
    stats = {r.term: (r.df, round(r.idf, 9)) for r in index.statistics().collect()}
    plain = lexical.term_stats(lexical.tokenized(table(spark, ROWS), "node_id", "full_text"))
    assert stats == {r.term: (r.df, round(r.idf, 9)) for r in plain.collect()}
    changed = [("a", "another text"), *ROWS[1:]]
    assert index.refresh(table(spark, changed), "v4") == len(ROWS)  # built anew
    assert index.state()["batch"] == 0 and rows(index.search(asked(spark))) == rows(lexical.bm25(table(spark, changed), asked(spark)))


def test_a_batch_without_manifest_is_not_there(spark, tmp_path):
    index = inverted.Index(spark, str(tmp_path / "index"))
    index.refresh(table(spark, ROWS[:4]), "v1")
    before = rows(index.search(asked(spark)))
    for part in ("postings", "terms", "segments"):  # a writer that was lost
        own = spark.read.parquet(f"{index.path}/{part}/batch=0")
        own.write.partitionBy(*["bucket"] * ("bucket" in own.columns)).parquet(f"{index.path}/{part}/batch=1")
    assert rows(index.search(asked(spark))) == before


@pytest.mark.parametrize("k", [1, 3])
@pytest.mark.parametrize("block", [2, 4096])
def test_best_of_blocks(spark, tmp_path, monkeypatch, k, block):
    monkeypatch.setattr(inverted, "QUERIES", block)
    index = inverted.Index(spark, str(tmp_path / "index"))
    index.refresh(table(spark, ROWS), "v")
    want = rows(lexical.top_k(lexical.bm25(table(spark, ROWS), asked(spark)).where("score > 0"), k))
    assert rows(lexical.top_k(index.search(asked(spark), k, positive=True), k)) == want


def test_only_buckets_of_the_terms_are_read(spark, sf_dir):
    index = S.lexical_index(spark, sf_dir)
    one = spark.createDataFrame([(1, "the")], "query_id bigint, query string")
    found = index.search(one)
    plan = found._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.split("\n") if "places" in line and "FileScan" in line)
    wanted = one.select(inverted.bucket(F.lit("the"))).first()[0]
    assert f"= {wanted})" in scan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert found.count() > 0


def test_empty(spark, tmp_path):
    index = inverted.Index(spark, str(tmp_path / "index"))
    assert index.refresh(table(spark, []), "v") == 0
    assert rows(index.search(asked(spark))) == []
    assert index.refresh(table(spark, ROWS), "w") == len(ROWS)
    assert rows(index.search(asked(spark))) == rows(lexical.bm25(table(spark, ROWS), asked(spark)))
