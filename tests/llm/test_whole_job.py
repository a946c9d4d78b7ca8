"""Operators over what an earlier version left out."""

from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import pytest

from quillrank.llm import mixing, shingles, simhash
from tests.llm.helpers import docs


def test_near_copies_of_five_word_shingles(spark, monkeypatch):
    """Texts with changed words against all pairs of plain shingle sets; many copies of one text among them."""
    monkeypatch.setattr(shingles, "HOT", 5)
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = {}
    for c in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 40, 120, 300]))]
        for _ in range(40 if c == 0 else 6):
            own = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 8])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts[len(texts)] = " ".join(own)
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in texts.items()}
    up = {i: i for i in texts}
    for a, b in combinations(texts, 2):
        both = len(sets[a] & sets[b])
        if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both) and up[a] != up[b]:
            x, y = sorted((up[a], up[b]))
            up = {i: x if u == y else u for i, u in up.items()}
    df = docs(spark, [(i, t, "en", "s", len(t)) for i, t in texts.items()])
    assert {r.id: r.class_id for r in shingles.near_copies(df).collect()} == up
    assert {r.doc_id for r in shingles.keep_one_copy(df).collect()} == set(up.values())


def test_mixing_stage_meets_targets_of_a_rare_domain(spark):
    """A domain of 4 % of the tokens has to be repeated six times to get 15 %."""
    rng = random.Random(4)
    rows = []
    for lang, n in {"en": 400, "de": 40, "fr": 40, "es": 20}.items():
        for _ in range(n):
            rows.append((len(rows), " ".join(f"{lang}{rng.randrange(200)}" for _ in range(60)), lang, "s", 60))
    df = docs(spark, rows)
    got = Counter({r.lang: r["count"] for r in mixing.mix_stage(df, df.selectExpr("doc_id", "lang as domain")).groupBy("lang").count().collect()})
    for lang, share in mixing.TARGETS.items():
        assert abs(got[lang] / got.total() - share) < 0.02


@pytest.mark.parametrize("keep", [simhash.keep_one, shingles.keep_one_copy])
def test_keep_one_of_shared_ids(spark, keep):
    """One row of each class, though ids stand on several texts, repeat or are null."""
    text = {c: " ".join(f"{c}{i}" for i in range(400)) for c in "abcde"}
    near = text["e"].upper()
    rows = [(1, text["a"]), (1, text["b"]), (1, text["b"]), (2, text["c"]), (3, text["c"]), (3, text["d"]), (None, text["e"]), (None, near), (None, text["d"])]
    kept = keep(docs(spark, [(i, t, "en", "s", len(t)) for i, t in rows])).collect()
    assert sorted((r.doc_id or 0, r.text[0].lower()) for r in kept) == [(0, "e"), (1, "a"), (1, "b"), (2, "c"), (3, "d")]
