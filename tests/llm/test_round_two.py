"""Decoder over all lattice paths, classifier accuracy, likeness of fingerprints, clashing names, the shared folder."""

from __future__ import annotations

import math
import random
from itertools import product
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillrank.llm import common, fingerprints, mixing, registry, shingles, simhash, toxicity
from quillrank.llm.common import table, text_of
from tests.llm.helpers import clashing, docs

WORDS = "the idiot stupid moron with trash and loser scum clown this is a stupid idiot clown and trash moron"


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.letter_model(docs(spark, [(i, WORDS, "en", "s", 1) for i in range(5)]))


def test_decoder_finds_the_best_path(model):
    """The likeliest reading of short words against all paths of their lattices; no path is pruned."""
    rng = random.Random(2)
    for _ in range(150):
        word = "".join(rng.choice("idot1$@!.0s7") for _ in range(rng.randint(1, 6)))
        best = -math.inf
        for path in product(*toxicity._readings(word)):
            x = y = 0
            score = 0.0
            for letters, cost in path:
                score += cost
                for c in letters:
                    z = 0 if c == " " else ord(c) - 96 if "a" <= c <= "z" else 27
                    score += model[x, y, z]
                    x, y = y, z
            score += model[x, y, 0]
            if score > best + 1e-9:
                best, reading = score, " ".join("".join(letters for letters, _ in path).split())
            elif abs(score - best) <= 1e-9:
                reading = None  # a tie: either will do
        if reading is not None:
            assert toxicity.decode(word, model)[0] == reading, word


def test_words_without_a_letter(model):
    assert toxicity.readings("12345", model) == [] and toxicity.readings("--", model) == []
    assert ["scum"] in toxicity.readings("$(um", model) and any(toxicity.readings("@$$", model)) and any(toxicity.readings("1@$$", model))


def test_a_very_long_word(model):
    """A word of 300,000 characters, half of them with several readings, is read whole."""
    rng = random.Random(4)
    word = "".join(rng.choice("abcdefgh01234567") for _ in range(300_000))
    assert 250_000 < len(toxicity.decode(word, model.tolist(), 2)[0]) <= 310_000


def test_scorer_against_plain(spark):
    """Scores of every row from weights that plain Python counts."""
    rng = random.Random(5)
    filler = ["".join(rng.choices("aeioulnrst", k=6)) for _ in range(60)]
    rows = [(i, " ".join(rng.choices(filler, k=30) + (["moron", "1d10t"] if i % 3 == 0 else [])), "en", "s", 1) for i in range(150)]
    df = docs(spark, rows)
    scorer = toxicity.fit(df, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(150)], "doc_id bigint, toxic int"))
    model = toxicity.letter_model(df)
    terms = [{f for w in set(t.split()) for reading in toxicity.readings(w, model) for x in reading for f in toxicity.features_of(x)} for _, t, *_ in rows]
    weights = {}
    for term in set().union(*terms):
        a, b = (sum(term in own for i, own in enumerate(terms) if (i % 3 == 0) == side) for side in (True, False))
        if a >= 2:
            w = math.log((a + 0.5) / 51 / (b + 0.5) * 101) - 1.645 * math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
            if w > toxicity.LEAST:
                weights[term] = w
    assert scorer.weights.keys() == weights.keys() and "moron" in weights
    assert all(abs(scorer.weights[t] - w) < 1e-9 for t, w in weights.items())
    got = {r.doc_id: r.score for r in df.select("doc_id", toxicity.score_column(scorer, text_of("text")).alias("score")).collect()}
    assert all((got[i] >= toxicity.THRESHOLD) == (i % 3 == 0) for i in got)
    assert all(abs(got[i] - scorer.score(t, {})) < 1e-12 for i, t, *_ in rows)


def test_held_out_share(spark):
    """Held-out rows of the largest given tables, the ones README names: most toxic ones found, hardly a clean one marked."""
    sf_dir = "/root/testdata/sf0.1"
    scored = registry.queries()["op6_toxicity"](spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").where("held_out").toPandas()
    assert (scored[scored.toxic == 1].predicted == 1).mean() >= 0.85 and (scored[scored.toxic == 0].predicted == 0).mean() >= 0.98


def test_mixing_classifier(spark):
    """The language of documents that aren't labelled; one text has 100,000 distinct words."""
    sf_dir = "/root/testdata/sf0.01"
    all_, labelled = table(spark, sf_dir, "documents"), mixing.labelled_domains(spark, sf_dir)
    classifier = mixing.fit_classifier(all_, labelled)
    held = all_.join(labelled.select("doc_id"), "doc_id", "left_anti").where("n_chars > 200")
    got = held.select("lang", mixing.membership(classifier, text_of("text")).alias("m")).select("lang", "m.posterior").toPandas()
    right = [classifier.domains[int(np.argmax(p))] == lang for p, lang in zip(got.posterior, got.lang)]
    assert len(right) > 300 and np.mean(right) >= 0.97
    n, at, x = mixing.features(" ".join(f"w{i}" for i in range(100_000)), mixing.Buckets())
    assert n == 100_000 and len(at) == len(set(at.tolist())) <= mixing.BUCKETS and abs(x @ x - 1) < 1e-9


def test_mixing_bounds(spark):
    """A domain without a target keeps its share; where four repeats aren't enough the others shrink, and what comes out is told."""
    rows = [(i, " ".join(f"{lang}{j}" for j in range(50)), lang, "s", 1) for i, lang in enumerate(["en"] * 160 + ["de"] * 30 + ["it"] * 10)]
    members = docs(spark, rows).selectExpr("cast(50 as bigint) as tokens", "array(double(lang = 'de'), double(lang = 'en'), double(lang = 'it')) as posterior")
    members = common.materialize(members, "members")
    found = mixing.solve(members, ["de", "en", "it"], {"en": 0.5, "de": 0.5})
    assert abs(found.achieved["it"] - 0.05) < 1e-3 and abs(found.achieved["de"] - 0.475) < 1e-3 and found.off < 1e-3
    found = mixing.solve(members, ["de", "en", "it"], {"en": 0.1, "de": 0.8, "it": 0.1}, "keep", 1.0, 4.0)
    assert found.least == 0.0 and found.off < 1e-3


def test_near_columns(spark, sf_dir):
    """near_edited and near_next are the likeness of the fingerprints that stand beside them."""
    got = registry.queries()["op7_document_fingerprints"](spark, sf_dir).collect()

    def likeness(a: str, b: str) -> float:
        pairs = [(a[i : i + 4], b[i : i + 4]) for i in range(16, 16 + 4 * len(fingerprints.THINNED), 4)]
        some = [p for p in pairs if p != ("0000", "0000")]
        return 1.0 if a == b else sum(x == y for x, y in some) / len(some) if some else 0.0

    down = sorted(got, key=lambda r: -r.doc_id)
    for r, after in zip(down, down[1:] + down[:1]):
        assert abs(r.near_edited - likeness(r.fingerprint, r.edited_fingerprint)) < 1e-9
        assert abs(r.near_next - likeness(r.fingerprint, after.fingerprint)) < 1e-9


@pytest.mark.parametrize("keep", [simhash.keep_one, shingles.keep_one_copy])
def test_keep_one_with_clashing_names(spark, keep):
    df = docs(spark, [(4, "a " * 40, "en", "s", 1), (4, "b c " * 40, "en", "s", 1), (9, "d e f " * 40, "en", "s", 1), (9, "d e f " * 40, "en", "s", 1)])
    df = clashing(df).withColumns({c: F.lit(1) for c in ("__kept_id", "_kept_id", "_kept_h", "row", "count", "class_id", "root", "h")})
    kept = keep(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text[0]) for r in kept.collect()) == [(4, "a"), (4, "b"), (9, "d")]
    assert keep(df.limit(0)).collect() == []


def test_cells_find_the_links_of_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 200, dtype=np.uint64)
    sets = []
    for _ in range(120):
        own = base.copy()
        own[rng.integers(0, 200, rng.integers(0, 45))] = rng.integers(0, 2**63, 1, dtype=np.uint64)
        sets.append(np.unique(np.concatenate([own, rng.integers(0, 2**63, rng.integers(0, 20), dtype=np.uint64)])))
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(np.intersect1d(a, b))
            if 5 * both >= 4 * (len(a) + len(b) - both) and label[i] != label[j]:
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    found = list(range(len(sets)))
    links = shingles.spanning(sets)
    assert len(links) < len(sets)
    for i, j in links:
        found = [min(found[i], found[j]) if x in (found[i], found[j]) else x for x in found]
    assert found == label


def test_a_cluster_needs_a_shared_folder():
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context))
