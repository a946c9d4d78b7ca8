"""Every operator over nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillrank.llm import chat, fingerprints, licenses, mixing, packing, quality, simhash, tokencount, toxicity, warc
from quillrank.llm.common import new_path, text_of
from tests.llm.helpers import ODD, clashing, docs


def labels(spark):
    return spark.createDataFrame([(2, 1, 0), (4, 1, 0), (5, 0, 1), (None, 1, 1), (7, 1, None)], "doc_id bigint, quality int, toxic int")


def domains(spark):
    return spark.createDataFrame([(4, "en"), (6, "de"), (7, "fr"), (None, "x"), (5, None)], "doc_id bigint, domain string")


def toxic(spark, df):
    scorer = toxicity.fit(df, labels(spark))
    return df.select("doc_id", toxicity.score_column(scorer, text_of("text")).alias("score"))


OPERATORS = {
    "mixing": lambda s, d: mixing.mix(d, domains(s), {"en": 0.6, "de": 0.2, "fr": 0.2}),
    "packing": lambda s, d: packing.pack_documents(d),
    "counts": lambda s, d: tokencount.count_with_edits(d, tokencount.standard_edits(F.length(text_of("text")))),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "toxicity": toxic,
    "fingerprints": lambda s, d: fingerprints.fingerprints(d),
    "licenses": lambda s, d: licenses.scan(d),
    "quality": lambda s, d: quality.verdict(quality.ledger(d)),
}
#: Rows that come out for ODD: one each, but where equal rows meet or a text has several pieces.
EXPECTED = {"fingerprints": len(ODD) - 1, "packing": len(ODD) + 1}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd(spark, name):
    plain = OPERATORS[name](spark, docs(spark)).collect()
    assert len(plain) == EXPECTED.get(name, len(ODD))
    assert sorted(map(str, OPERATORS[name](spark, clashing(docs(spark))).collect())) == sorted(map(str, plain)) or name == "packing"


@pytest.mark.parametrize("name", OPERATORS)
def test_empty(spark, name):
    assert OPERATORS[name](spark, docs(spark, [])).collect() == []


def test_stages(spark, sf_dir):
    for rows in (ODD, []):
        df = clashing(docs(spark, rows))
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, sf_dir)
            if name != "best-fit packing":
                assert out.columns == df.columns
            assert out.count() <= 5 * len(rows)


def test_keep_one_of_repeated_ids(spark):
    kept = [r.doc_id for r in simhash.keep_one(docs(spark)).collect()]
    assert sorted(kept, key=str) == sorted([1, 4, None, 5, 6, 7], key=str)


def test_chat_odd(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, example int, segment string"
    rows = [(1, 0, "user", None, 0, ""), (1, 0, "assistant", "x\\<|end|>", 0, ""), (1, None, None, "first", 0, ""), (None, 5, "assistant", "", 0, ""), (2, 0, "user", "only", 0, ""), (1, 0, "user", None, 0, "")]
    got = {r.conv_id: r for r in chat.digest(chat.examples(spark.createDataFrame(rows, schema))).collect()}
    assert (got[1].n_turns, got[1].loss_chars, got[None].n_turns, got[2].loss_chars) == (4, 9, 1, 0)
    assert chat.digest(chat.examples(spark.createDataFrame([], schema))).collect() == []


def test_warc_odd(spark):
    schema = "page_id bigint, url string, html string, first string, sha1 string"
    rows = [(3, "u", "<p>x</p>", "", ""), (1, None, "<p>x</p>", "", ""), (2, "u v", None, "", ""), (4, "u", "", "", ""), (None, "u", "<p>y</p>", "", ""), (5, "u", "long " * 100_000, "", ""), (3, "u", "<p>x</p>", "", "")]
    folder = new_path(spark, "warc")
    got = sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_archives(warc.write_archives(spark.createDataFrame(rows, schema), folder), folder).collect())
    assert got == [(0, "response", None, 8), (1, "response", None, 8), (2, "response", None, 0), (3, "revisit", 1, 8), (3, "revisit", 1, 8), (4, "revisit", 2, 0), (5, "response", None, 500_000)]
    folder = new_path(spark, "warc")
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], schema), folder), folder).collect() == []


def test_null_columns(spark):
    df = docs(spark).withColumn("text", F.lit(None).cast("string"))
    assert quality.ledger(df).agg(F.max("n_words")).first()[0] == 0


@pytest.mark.parametrize("rows", [ODD, []])
def test_fingerprint_query(spark, tmp_path, rows):
    clashing(docs(spark, rows)).write.parquet(str(tmp_path / "documents.parquet"))
    got = fingerprints.op7_document_fingerprints(spark, str(tmp_path)).collect()
    assert len(got) == max(0, len(rows) - 1)
    by_id = {r.doc_id: r for r in got}
    if rows:  # ids run down: 7, 6, .., 1, null, and then 7 again
        assert by_id[None].n_chars == 10 and by_id[1].fingerprint == by_id[2].fingerprint and by_id[None].near_next == 0.0
        import hashlib

        assert by_id[6].edited_sha256 == hashlib.sha256((ODD[7][1][: len(ODD[7][1]) - len(ODD[7][1]) // 2] + ("word " * 4000)[: len(ODD[7][1]) // 2]).encode()).hexdigest()
