"""The stored index is packed and searched with work that follows the texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillrank.functions import text as T
from quillrank.operators import inverted, lexical

SPACES = [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
NO_SPACES = [0x1C, 0x1F, 0x84, 0xA1, 0x1681, 0x180E, 0x200B, 0x2010, 0x2027, 0x2060, 0x3001, 0xFEFF]
ODD = [
    "", " ", "...", "a", " a ", "a.b", "- -", "The  quick,\tbrown\nFOX.", "x" * 50, "Größe ÉTÉ İstanbul ΟΔΟΣ", "Điều 12/2020 Nghị-định", "🦊 fox 🦊🦊", "!", "#a#", "z", "é", "",
    *[f"{a}{chr(c)}{b}" for c in SPACES + NO_SPACES for a, b in (("x", "y"), ("", "é"), ("ß", ""), (".", "."))], "end　", " ", "tab\x0bline\x0cfeed\rback", "",
]


@pytest.mark.parametrize("size", [1, 40, 1 << 20])
def test_words_are_the_tokens(spark, monkeypatch, size):
    monkeypatch.setattr(T, "CUT_BYTES", size)
    rows = spark.createDataFrame(list(enumerate(ODD)), "id int, t string").select("id", F.lower("t").alias("low"), T.tokens(F.col("t")).alias("tokens")).orderBy("id").collect()
    texts = pa.array(["skipped words", *[r.low for r in rows]]).slice(1)
    assert [w for part in T.words(texts) for w in part.to_pylist()] == [r.tokens for r in rows]
    assert list(T.words(pa.array([], pa.string()))) == []


def test_postings_are_written_by_the_tasks_that_read_the_chunks(spark, tmp_path):
    chunks = spark.range(0, 600, 1, 3).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("node_id"), F.concat(F.lit("The word, "), F.col("id").cast("string"), F.when(F.col("id") % 2 == 0, " the").otherwise("")).alias("full_text"))
    index = inverted.Index(spark, str(tmp_path / "index"))
    assert index.refresh(chunks, "v") == 600
    found = index.postings().where("term = 'the'").select("n", "places", "counts", F.input_file_name().alias("file")).collect()
    assert len({r.file for r in found}) == 3 and sum(r.n for r in found) == 600
    for r in found:
        places, counts = np.frombuffer(r.places, "<u2"), np.frombuffer(r.counts, "<i4")
        assert places.tolist() == list(range(200)) and counts.tolist() == [2, 1] * 100
    assert index.postings().where("bucket < 0 or term is null").isEmpty() and index.segments().count() == 3
    asked = spark.createDataFrame([(1, "the word"), (2, "7 the")], "query_id bigint, query string")
    assert sorted(map(tuple, index.search(asked).collect())) == sorted((r.query_id, r.node_id, r.score) for r in lexical.bm25(chunks, asked).collect())


@pytest.mark.parametrize("wide", [0, 8, 10**9])
@pytest.mark.parametrize("marked", [False, True])
def test_products_and_places_give_the_same_totals(monkeypatch, wide, marked):
    monkeypatch.setattr(inverted, "WIDE", wide)
    monkeypatch.setattr(inverted, "TERMS", 3)
    rng = np.random.default_rng(2)
    norm = rng.uniform(0.5, 2, 50)
    rows, want, share = [], np.zeros((9, 50)), np.zeros((9, 50), bool)
    for _ in range(20):
        at = np.flatnonzero(rng.random(50) < rng.choice([0.05, 0.6])).astype("<u2")
        tf, own = rng.integers(1, 5, len(at)), rng.choice(9, rng.integers(1, 6), replace=False).tolist()
        weights = rng.uniform(-1, 3, len(own))
        rows.append((at, tf, [f"q{i}" for i in own], weights))
        for i, weight in zip(own, weights):
            for place, n in zip(at, tf):
                want[i, place] += weight * n * (lexical.K1 + 1) / (n + norm[place])
                share[i, place] = True
    asked, total, met = inverted._totals(rows, norm, marked)
    order = [int(q[1:]) for q in asked]
    assert np.allclose(total, want[order], atol=1e-12)
    assert (met is None) if not marked else (met == share[order]).all()
