"""Ranked search against a plain scorer over all pairs."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest

from quillrank.llm import ranking
from quillrank.llm.common import new_path, table
from tests.llm.helpers import ODD, clashing, docs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(rows, items, k):
    """item, rank -> (doc, score)."""
    texts = [(i, words(t)) for i, t in rows if words(t)]
    n, total = len(texts), sum(len(w) for _, w in texts)
    df = Counter(t for _, w in texts for t in set(w))
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, Counter()).update(words(text))
    out = {}
    for item, q in asked.items():
        scored = []
        for doc, w in texts:
            m, tf, score = 75 + 25 * len(w) * n // total, Counter(w), 0
            for t, times in q.items():
                if t in tf:
                    score += times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        for rank, (score, _, _, doc) in enumerate(sorted(scored)[:k], 1):
            out[item, rank] = (doc, -score)
    return out


def run(spark, src, items, k):
    path = new_path(spark, "index")
    ranking.build(src, path)
    got = ranking.search(path, spark.createDataFrame(items, "item_id bigint, text string"), k).collect()
    assert len({(r.item_id, r["rank"]) for r in got}) == len(got)
    return {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in got}


ITEMS = [(1, "word One TWO no id"), (2, None), (3, ""), (4, "tail 中文 a a b"), (5, "nowhere"), (4, "three"), (None, "word"), (6, "x" * 10_000)]


@pytest.mark.parametrize("k", [1, 3, 20])
def test_odd_rows(spark, k):
    rows = [*ODD, *[(100 + i, "one two copies of this", "en", "s", 1) for i in range(40)], (99, "One, two; copies of THIS", "en", "s", 1), (8, "x" * 10_000, "en", "s", 1)]
    assert run(spark, clashing(docs(spark, rows)), ITEMS, k) == plain([r[:2] for r in rows], ITEMS, k)


def test_empty(spark):
    assert run(spark, docs(spark, []), ITEMS, 5) == {}
    assert run(spark, docs(spark), [], 5) == {}


@pytest.mark.parametrize("shard,block", [(7, 3), (64, 256)])
def test_given_tables(spark, sf_dir, shard, block, monkeypatch):
    """Many shards and blocks of items; bounds hold for every candidate."""
    src, items = table(spark, sf_dir, "documents"), [tuple(r) for r in table(spark, sf_dir, "benchmark").collect()]
    monkeypatch.setattr(ranking, "ITEMS", block)
    rows = [(r.doc_id, r.text) for r in src.select("doc_id", "text").collect()]
    # Workers import the module anew, so the shard's size is set where they run.
    real = ranking._shards

    def small(batches, n, words):
        ranking.SHARD = shard
        yield from real(batches, n, words)

    monkeypatch.setattr(ranking, "_shards", small)
    assert run(spark, src, items, 20) == plain(rows, items, 20)


def test_steps_are_bounds():
    import numpy as np

    freq, size = np.repeat([1, 2, 7, 1000], 4), np.tile([75, 100, 5000, 10**9], 4)
    exact = ranking.impacts(freq, size)
    step = -(-exact // ranking.STEP)
    assert (step * ranking.STEP >= exact).all() and (np.maximum(step - 1, 0) * ranking.STEP <= exact).all() and step.max() <= 255
