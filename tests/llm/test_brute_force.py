"""Operators against brute force, exact round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from quillrank.llm import fingerprints, mixing, packing, quality, registry, simhash, tokencount, tokens, toxicity, warc
from quillrank.llm.common import materialize, table
from tests.llm.helpers import docs
from tests.oracle import check, connect

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.fixture(scope="module")
def texts(con):
    return dict(con.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, con, sf_dir, name):
    check(spark, con, registry.queries()[name], registry.oracle_sql()[name], sf_dir)


# --- SimHash ------------------------------------------------------------------------------------


def plain_print(text: str) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = WORD.findall(low)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints: dict) -> dict:
    ids = sorted(prints)
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3 and root(a) != root(b):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_simhash_documents(spark, sf_dir, texts):
    got = {r.doc_id: r for r in registry.queries()["op5_simhash_near_dedup"](spark, sf_dir).collect()}
    prints = {i: plain_print(t) for i, t in texts.items()}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == prints
    assert {i: r.component_id for i, r in got.items()} == plain_classes(prints)


@pytest.mark.parametrize("split", [50_000, 3])
def test_simhash_links_near_prints(spark, monkeypatch, split):
    """Clusters of prints a few bits apart, with subtrees dealt once and twice."""
    monkeypatch.setattr(simhash, "SPLIT", split)
    rng = random.Random(5)
    prints = {}
    for c in range(12):
        centre = rng.getrandbits(64)
        for _ in range(12):
            x = centre
            for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 4])):
                x ^= 1 << b
            prints[len(prints)] = x
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    rows = spark.createDataFrame([(i, signed(x)) for i, x in prints.items()], "id bigint, print bigint")
    assert {r.id: r.class_id for r in simhash.classes(rows).collect()} == plain_classes(prints)


# --- I-Match ------------------------------------------------------------------------------------


def spark_hash(values) -> int:
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(struct.pack("<q", v) if isinstance(v, int) else v.encode(), h)
    return h - 2**64 if h >= 2**63 else h


def test_fingerprints(spark, sf_dir, texts):
    got = {r.doc_id: r for r in registry.queries()["op7_document_fingerprints"](spark, sf_dir).collect()}
    terms = {t: {spark_hash([w]) for w in re.split(r"[\W_]+", t.lower()) if w} for t in set(texts.values())}
    df = Counter(h for t in texts.values() for h in terms[t])
    n = len(texts)
    band = {h for h, c in df.items() if max(2, -(-n // 1000)) <= c <= max(2, n * 5 // 100)}

    def plain(text):
        own = sorted({spark_hash([w]) for w in re.split(r"[\W_]+", text.lower()) if w} & band)
        if not own:
            return f"{spark_hash([text]) % 2**64:016x}" + "0000" * len(fingerprints.THINNED)
        parts = []
        for mask, value in fingerprints.subset_tests():
            kept = [t for t in own if t & mask == value]
            parts.append(f"{spark_hash(kept) % 65_535 + 1:04x}" if kept else "0000")
        return f"{spark_hash(own) % 2**64:016x}" + "".join(parts)

    ids = sorted(texts, reverse=True)
    for i, j in zip(ids, ids[1:] + ids[:1]):
        m = len(texts[i]) // 2
        edited = texts[i][: len(texts[i]) - m] + texts[j][:m]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (got[i].n_chars, got[i].fingerprint, got[i].edited_fingerprint) == (len(texts[i]), plain(texts[i]), plain(edited))
        assert 0 <= got[i].near_next <= 1 and 0 <= got[i].near_edited <= 1
    assert sum(r.near_edited > r.near_next for r in got.values()) > 0.8 * len(got)


# --- Tokens -------------------------------------------------------------------------------------


def slow_ids(text: str) -> list[int]:
    return tokens._slow(tokens.vocabulary_paths()[0]).encode(text, add_special_tokens=False).ids


def test_libraries_agree(texts):
    odd = ["", " ", "  x", "a\u0085b", "<|endoftext|>", "x <|endoftext|> y", "中文", "🙂🙂", "don't  we'll\n\n", "²½ª", "é", "–—…"]
    for text in [*texts.values(), *odd]:
        assert tokens.encode(text).tolist() == slow_ids(text)


def test_packing(spark, sf_dir, texts):
    rows = registry.queries()["op2_best_fit_packing"](spark, sf_dir).toPandas()
    lengths = {}
    for r in rows.itertuples():
        ids = np.array([*slow_ids(texts[r.doc_id]), 0], "<u4")
        assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
        assert r.length == 2048 or r.piece == 0
    assert lengths == {i: len(slow_ids(t)) + 1 for i, t in texts.items()}
    ordered = rows.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
    used = rows.groupby("sequence_id").length.sum()
    assert used.max() <= 2048 and len(used) <= 1.03 * -(-rows.length.sum() // 2048) + 1


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_histogram_up(seed):
    rng = np.random.default_rng(seed)
    h = np.zeros(257, np.int64)
    for v in rng.integers(1, 257, 300):
        h[v] += rng.integers(1, 50)
    used = np.zeros_like(h)
    for lengths, n in packing.plan(h, 256):
        assert sum(lengths) <= 256 and n > 0
        for v in lengths:
            used[v] += n
    assert (used == h).all()


def test_token_tree():
    rng, counts = random.Random(1), tokencount.Counts(tokens.vocabulary_paths())
    letters = " \n\tabc'sde12,.!?éß中🙂\u0085 <|"
    for _ in range(300):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 400)))
        tree = tokencount.TokenTree(text, counts)
        for _ in range(5):
            at, drop = rng.randint(0, len(text) + 2), rng.choice([0, 1, 5, 30, 1000])
            put = "".join(rng.choice(letters) for _ in range(rng.randint(0, 12)))
            tree.edit(at, drop, put)
            a = min(at, len(text))
            text = text[:a] + put + text[a + drop :]
            assert (tree.text(), tree.n_tokens, tree.n_chars) == (text, len(slow_ids(text)), len(text))


def test_token_counts(spark, sf_dir, texts):
    for r in registry.queries()["op4_token_counts"](spark, sf_dir).collect():
        text = texts[r.doc_id]
        edited = "Second draft:\n" + text
        half = len(text) // 2
        edited = edited[:half] + " these words stand in for others " + edited[half + 40 :]
        at = min(max(len(text) - 10, 0), len(edited))
        edited = edited[:at] + "." + edited[at + 25 :]
        assert (r.n_tokens, r.n_tokens_edited, r.n_chars_edited) == (len(slow_ids(text)), len(slow_ids(edited)), len(edited))
        assert r.n_reencoded <= 60 or r.n_pretokens < 200


# --- Toxicity -----------------------------------------------------------------------------------


def test_decoder(spark):
    words = "the idiot stupid moron with trash and loser scum clown this is a stupid idiot clown and trash moron"
    model = toxicity.letter_model(docs(spark, [(i, words, "en", "s", 1) for i in range(5)]))
    for written, plain in {"1d10t": "idiot", "i.d.i.o.t": "idiot", "stuuuupid": "stupid", "tr4sh!!!": "trash", "m0r0n": "moron", "the%%%": "the", "$cum": "scum", "l0$er": "loser", "plain": "plain"}.items():
        assert toxicity.restore(written, model) == [plain], written
    assert toxicity.restore("12345", model) == []
    assert ["idiot"] in toxicity.readings("1d!0t", model)
    spaced = toxicity.restored_words("you i d i o t here", model, {})
    assert ("idiot",) in spaced


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    scored = registry.queries()["op6_toxicity"](spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").where("held_out").toPandas()
    toxic, clean = scored[scored.toxic == 1], scored[scored.toxic == 0]
    assert (toxic.predicted == 1).mean() >= 0.6 and (clean.predicted == 0).mean() >= 0.95
    assert scored.score.between(0, 1).all()


def test_disguised_words_are_found(spark):
    rng = random.Random(3)
    filler = [f"w{''.join(rng.choices('aeioulnrst', k=5))}" for _ in range(200)]
    rows = [(i, " ".join(rng.choices(filler, k=60) + (["idiot", "moron"] if i % 4 == 0 else [])), "en", "s", 1) for i in range(200)]
    df = docs(spark, rows)
    scorer = toxicity.fit(df, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id bigint, toxic int"))
    memory: dict = {}
    clean = " ".join(filler[:60])
    assert scorer.score(clean, memory) < 0.3 <= scorer.score(clean + " 1diot m0ron", memory)


# --- WARC ---------------------------------------------------------------------------------------


def test_archive_bytes(tmp_path):
    import zstandard

    path = tmp_path / "a.warc.zst"
    archive = warc.Archive(open(path, "wb"))
    payloads = [f"<html>page {i} {'text ' * (i % 50)}</html>".encode() for i in range(400)]
    for i, p in enumerate(payloads):
        archive.add(warc.record_bytes(i, f"http://x/{i}", p, warc.digest(p), None))
    archive.close()
    data = path.read_bytes()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D and 0 < size <= warc.DICTIONARY_BYTES
    frames = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size])).decompressobj()
    assert frames.decompress(data[8 + size :]).startswith(b"WARC/1.1") and frames.unused_data  # a record is a frame of its own
    with open(path, "rb") as source:
        assert [block for _, block in warc.read_archive(source)] == payloads


# --- Mixing -------------------------------------------------------------------------------------


def test_mixing_meets_targets(spark, sf_dir):
    got = mixing.mix(table(spark, sf_dir, "documents"), mixing.labelled_domains(spark, sf_dir), mixing.TARGETS).toPandas()
    mass = np.array(got.posterior.tolist()) * got.tokens.to_numpy()[:, None]
    total = (mass * got.rate.to_numpy()[:, None]).sum(axis=0)
    assert np.allclose(total / total.sum(), [mixing.TARGETS[d] for d in ("de", "en", "es", "fr")], atol=1e-3)
    assert abs(total.sum() / got.tokens.sum() - 1) < 1e-3 and (got.rate >= 0).all()

    # The same descent on one machine.
    post, tok, rate = np.array(got.posterior.tolist()), got.tokens.to_numpy(float), np.ones(len(got))
    base = (post * tok[:, None]).sum(axis=0)
    aim = np.array([mixing.TARGETS[d] for d in ("de", "en", "es", "fr")]) * base.sum()
    for _ in range(mixing.ROUNDS):
        error = ((post * (tok * rate)[:, None]).sum(axis=0) - aim) / base
        if abs(error).max() <= mixing.CLOSE:
            break
        rate = np.maximum(0, rate - post @ error)
    assert np.allclose(rate, got.rate, atol=1e-5)


# --- Quality ------------------------------------------------------------------------------------


def test_ablation(spark, sf_dir):
    led = materialize(quality.ledger(table(spark, sf_dir, "documents")), "ledger")
    bits = [r.failed_bits for r in led.collect()]
    full = quality.mask("v1")
    for r in quality.ablation(led).collect():
        bit = 1 << quality.RULES[r.rule]
        rest = full & ~bit
        assert (r.n_failed, r.n_only_rule, r.n_kept_without) == (sum(b & bit > 0 for b in bits), sum(b & bit > 0 and b & rest == 0 for b in bits), sum(b & rest == 0 for b in bits))


# --- Pipeline -----------------------------------------------------------------------------------


def plain_near_copies(texts):
    """The smallest id reachable over pairs whose sets of five-word shingles have a likeness of 0.8 or more, by all pairs."""
    sets = {}
    for i, t in texts.items():
        w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if x]
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}
    up = {i: i for i in texts}
    for a, b in combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both) and up[a] != up[b]:
            x, y = sorted((up[a], up[b]))
            up = {i: x if u == y else u for i, u in up.items()}
    return up


def test_pipeline(spark, sf_dir, texts):
    """The stages against plain versions of their decisions, each over what the one before kept."""
    source = docs_ = table(spark, sf_dir, "documents")
    seen = [source]
    for _, stage in corpus_pipeline.STAGES:
        docs_ = materialize(stage(spark, docs_, sf_dir), "stage")
        seen.append(docs_)
    ids = [Counter(r.doc_id for r in d.select("doc_id").collect()) for d in seen]
    led = quality.verdict(quality.ledger(source))
    assert ids[1] == Counter(r.doc_id for r in led.where("kept").collect())
    scorer = toxicity.fit(seen[1], toxicity.training_labels(table(spark, sf_dir, "labels")))
    assert ids[2] == Counter({i: 1 for i in ids[1] if scorer.score(texts[i], {}) < toxicity.THRESHOLD})
    classes = plain_near_copies({i: texts[i] for i in ids[2]})
    assert ids[3] == Counter({i: 1 for i in ids[2] if classes[i] == i})
    assert set(ids[4]) == set(ids[3]) and max(ids[4].values()) <= mixing.EPOCHS
    assert seen[4].columns == source.columns
    lengths = seen[5].groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in lengths} == {i: k * (len(slow_ids(texts[i])) + 1) for i, k in ids[4].items()}
