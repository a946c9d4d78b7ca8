"""Token trees over special strings, markup and stored blocks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillrank.llm import tokencount, tokens
from quillrank.llm.common import materialize
from tests.llm.helpers import ODD, docs
from tests.llm.test_brute_force import slow_ids

PARTS = [tokens.SPECIAL, "<|", "endoftext", "|>", " ", "  ", "\n", " \n", "a", "it's", "12", "<p>", "中", "🙂", " word"]


@pytest.fixture(scope="module")
def counts():
    return tokencount.Counts(tokens.vocabulary_paths())


@pytest.mark.parametrize("again", [False, True])
def test_special_strings(counts, again):
    """Edits that make, break and touch special strings; with ``again`` the tree is stored before every edit."""
    rng = random.Random(7)
    for _ in range(250):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 300)))
        tree = tokencount.TokenTree(text, counts)
        assert tree.n_tokens == len(slow_ids(text))
        for _ in range(5):
            if again:
                tree = tokencount.TokenTree.stored(tree.kept(), counts)
            at, drop = rng.randint(0, len(text) + 2), rng.choice([0, 1, 2, 7, 13, 40])
            put = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 4)))
            tree.edit(at, drop, put)
            a = min(at, len(text))
            text = text[:a] + put + text[a + drop :]
            assert (tree.text(), tree.n_tokens, tree.n_chars) == (text, len(slow_ids(text)), len(text))


@pytest.mark.parametrize("block,full", [(2, 8), (1, 3), (5, 20)])
def test_small_blocks(counts, monkeypatch, block, full):
    """Trees that are rebuilt all the time and stored before every edit, over texts of white space and single letters."""
    monkeypatch.setattr(tokencount, "BLOCK", block)
    monkeypatch.setattr(tokencount, "FULL", full)
    rng = random.Random(11)
    parts = [*PARTS, " ", "  ", "\n", "\n\n", "x", " x", "'", "'s"]
    for _ in range(200):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 80)))
        tree = tokencount.TokenTree(text, counts)
        for _ in range(6):
            tree = tokencount.TokenTree.stored(tree.kept(), counts)
            at, drop = rng.randint(0, len(text)), rng.choice([0, 0, 1, 2, 5, 20])
            put = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
            tree.edit(at, drop, put)
            text = text[:at] + put + text[at + drop :]
            assert (tree.text(), tree.n_tokens, tree.n_chars) == (text, len(slow_ids(text)), len(text))


def test_one_pre_token_left_over(counts):
    """A rebuild leaves a block of one line feed between a block that ends in spaces and one that starts with a letter."""
    text = "w" + " w" * 61 + "  " + "\nx y z" + " q" * 200
    tree = tokencount.TokenTree(text, counts)
    tree.edit(0, 0, put := "b" + " b" * 1025)
    text = put + text
    tree = tokencount.TokenTree.stored(tree.kept(), counts)
    tree.edit(2154, 1, "k")
    text = text[:2154] + "k" + text[2155:]
    assert (tree.text(), tree.n_chars, tree.n_tokens) == (text, len(text), len(slow_ids(text)))


def test_a_block_that_is_no_pre_token_is_refused(counts):
    tree = tokencount.TokenTree.stored([("ab", 1), ("cd ef", 2)], counts)
    with pytest.raises(ValueError, match="isn't cut"):
        tree.edit(0, 1, "x")


def test_query(spark, sf_dir):
    """The query's counts against whole texts edited by hand; the edits are met in the stored trees."""
    from quillrank.llm.common import table

    texts = {r.doc_id: r.text or "" for r in table(spark, sf_dir, "documents").collect()}
    got = {r.doc_id: r for r in tokencount.op4_token_counts(spark, sf_dir).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        n, after = len(t), "Second draft:\n" + t
        after = after[: n // 2] + " these words stand in for others " + after[n // 2 + 40 :]
        at = max(n - 10, 0)
        after = after[:at] + "." + after[at + 25 :]
        assert (got[i].n_tokens, got[i].n_tokens_edited, got[i].n_chars_edited) == (len(slow_ids(t)), len(slow_ids(after)), len(after))


def test_markup_edits_encode_little(counts):
    text = " ".join(f"word{i % 700} <b>x</b>" for i in range(2000))
    for put in ("a < b", "<p>", "|x|", "endoftext", tokens.SPECIAL):
        for tree in (tokencount.TokenTree(text, counts), tokencount.TokenTree.stored(tokencount.TokenTree(text, counts).kept(), counts)):
            tree.edit(3000, 4, put)
            assert tree.n_tokens == len(slow_ids(text[:3000] + put + text[3004:]))
            assert tree.encoded <= 40


def test_very_long_text(counts):
    """Two megabytes, of which one word has a million characters."""
    text = "some words " * 90_000 + "x" * 1_000_000
    tree = tokencount.TokenTree(text, counts)
    n = tree.n_tokens
    tree.edit(5, 0, "<b>")
    assert tree.encoded <= 20 and tree.n_tokens == n + len(slow_ids("some <b>words some")) - len(slow_ids("some words some"))


def test_stored_trees_take_batch_after_batch(spark):
    df = docs(spark)
    texts = [(i, t or "") for i, t, *_ in ODD]
    trees = materialize(tokencount.stored(df), "trees")
    assert sorted(r.n_tokens for r in trees.collect()) == sorted(len(slow_ids(t)) for _, t in texts)
    for put in ("<i>", " and more"):
        edit = F.array(F.struct(F.lit(2).alias("at"), F.lit(1).alias("drop"), F.lit(put).alias("put")))
        trees = materialize(tokencount.edit_stored(trees, edit), "trees")
        texts = [(i, t[:2] + put + t[3:]) for i, t in texts]
        got = trees.collect()
        assert sorted((r.id or 0, "".join(b.text for b in r.blocks), r.n_tokens) for r in got) == sorted((i or 0, t, len(slow_ids(t))) for i, t in texts)
        assert max(r.n_reencoded for r in got) <= 20
    assert tokencount.stored(docs(spark, [])).collect() == []
    nulls = trees.withColumn("blocks", F.lit(None).cast(tokencount.BLOCKS)).limit(1)
    assert [(r.blocks, r.n_tokens) for r in tokencount.edit_stored(nulls, F.lit(None).cast("array<struct<at:int,drop:int,put:string>>")).collect()] == [([], 0)]
