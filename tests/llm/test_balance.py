"""Differencing against all partitions, packing against plain checks."""

from __future__ import annotations

import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillrank.llm import balance, tokens
from quillrank.llm.common import table
from tests.llm.helpers import clashing, docs


def sums(sizes, groups):
    return sorted(sum(sizes[i] for i in g) for g in groups)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=30), st.integers(1, 6))
def test_groups_are_a_partition(sizes, k):
    groups = balance.differencing(sizes, k)
    assert len(groups) == k and sorted(i for g in groups for i in g) == list(range(len(sizes)))
    if sizes:
        assert max(sums(sizes, groups)) - min(sums(sizes, groups)) <= max(sizes)  # never worse than one piece apart


def test_known_differences():
    """Karmarkar and Karp's own example: 8, 7, 6, 5, 4 differ by 2, where the best differ by 0."""
    assert sums([8, 7, 6, 5, 4], balance.differencing([8, 7, 6, 5, 4], 2)) == [14, 16]
    rng = np.random.default_rng(0)
    for _ in range(20):
        sizes = [int(x) for x in rng.integers(1, 50, 8)]
        best = min(max(sum(s for s, g in zip(sizes, c) if g == i) for i in range(3)) for c in product(range(3), repeat=8))
        assert max(sums(sizes, balance.differencing(sizes, 3))) <= best * 4 / 3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=60))
def test_count_rises(sizes):
    groups = balance.windows(sizes, 32)
    assert sorted(i for g in groups for i in g) == list(range(len(sizes))) and all(s <= 32 for s in sums(sizes, groups))
    assert len(groups) >= -(-sum(sizes) // 32)


def check(rows, texts, capacity, paths):
    """Each document's ids once and in order of start, each sequence gapless and within the capacity."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc, parts in by_doc.items():
        ids = np.append(tokens.encode(texts[doc] or "", paths), np.uint32(1)).astype("<u4")
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes()) and r.length > 0
            at += r.length
        assert at == len(ids)
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return [sum(r.length for r in p) for p in by_seq.values()]


@pytest.mark.parametrize("capacity,block", [(2048, 64), (16, 3), (64, 2)])
def test_pieces(spark, sf_dir, capacity, block):
    src = table(spark, sf_dir, "documents").where("doc_id < 60")
    texts = {r.doc_id: r.text for r in src.collect()}
    paths = tokens.vocabulary_paths()
    made = balance.pack_balanced(clashing(src), capacity, block)
    sizes = check(made.collect(), texts, capacity, paths)
    assert all(s == capacity or s & (s - 1) == 0 for s in sizes)  # nothing is padded
    whole = balance.pack_balanced(src, capacity, block, cut=False)
    sizes = check(whole.collect(), texts, capacity, paths)
    assert whole.where(f"start > 0 and doc_tokens <= {capacity}").count() == 0
    row = balance.padding(whole, capacity).first()
    assert row.sequences == len(sizes) and row.ids == sum(sizes) and row.padding == sum(0 if s & (s - 1) == 0 else capacity - s for s in sizes)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "word " * 30_000), (4, "Ünïcödé 中文 🙂 <|endoftext|> tail"), (None, "no id"), (5, "x")]
    src = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    sizes = check(balance.pack_balanced(src).collect(), dict(rows), 2048, tokens.vocabulary_paths())
    assert all(s & (s - 1) == 0 for s in sizes)
    again = src.union(src.where("doc_id = 4"))
    assert balance.pack_balanced(again).where("doc_id = 4").agg({"length": "sum"}).first()[0] == 2 * balance.pack_balanced(src).where("doc_id = 4").agg({"length": "sum"}).first()[0]
    assert balance.pack_balanced(docs(spark, [])).count() == 0
