"""Retrieval strategies against a plain walk through each query's branches."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillrank.operators import inverted, lexical, strategies

WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]
K = 3


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    rng = random.Random(5)
    chunks = []
    for d in range(4):
        for i in range(9):
            text = " ".join(rng.choice(WORDS[: 4 + d]) for _ in range(rng.randint(1, 12))) if (d, i) != (0, 2) else ""
            chunks.append((f"node:{d}{i}", f"law{d}", text, i))
    vectors = {c[0]: [rng.uniform(-1, 1) for _ in range(4)] for c in chunks if rng.random() < 0.9}
    intents = []
    for q in range(24):
        said = lambda n: " ".join(rng.choice([*WORDS, "nowhere"]) for _ in range(n))  # noqa: B023, E731
        docs = rng.choice([[], None, ["law0"], ["law1", "law2", "law1"], ["law3", "unknown"], ["unknown"], ["law2", "law0", "law3"]])
        subs = rng.choice([None, [], [" Alpha ", "alpha", ""], [said(2)], [said(2), said(1), said(3)]])
        intents.append((
            q, rng.choice([said(3), "nowhere", "theta"]), docs, rng.choice([None, "2", "5"]), subs, rng.choice([None, "", " alpha ", "Beta gamma"]), rng.choice([None, [], ["BETA"], ["theta", "zeta"]]),
            rng.choice([None, ["alpha", "beta", "gamma", "delta"]]), rng.choice([None, ["eta"]]), rng.choice([None, "", "gamma"]), rng.choice([None, True, False]),
        ))
    asked = {q: [rng.uniform(-1, 1) for _ in range(4)] for q in range(20)}  # some queries have no vector
    frame = spark.createDataFrame(chunks, "node_id string, canonical string, full_text string, article int")
    index = inverted.Index(spark, str(tmp_path_factory.mktemp("strategies") / "index"))
    index.refresh(frame.repartition(3, "node_id"))
    corpus = strategies.Corpus(
        frame, index, spark.createDataFrame(list(vectors.items()), "node_id string, embedding array<double>"), spark.createDataFrame(list(asked.items()), "query_id bigint, query array<double>"), frame
    )
    texts = {i[1] for i in intents} | {t for i in intents for t in i[4] or []} | {(i[5] or "").strip() for i in intents} | {f"{i[5] or i[1]} {a}" for i in intents for a in i[7] or []}
    texts = sorted(texts)
    found: dict = {t: [] for t in texts}
    for r in lexical.bm25(frame, spark.createDataFrame(list(enumerate(texts)), "query_id bigint, query string")).where("score > 0").collect():
        found[texts[r.query_id]].append((-r.score, r.node_id))
    return corpus, chunks, vectors, intents, asked, {t: sorted(v) for t, v in found.items()}


def plain(spark, world, strategy):
    """query -> (attempt, [node, ..] in order)."""
    corpus, chunks, vectors, intents, asked, found = world
    law = {c[0]: c[1] for c in chunks}
    text = {c[0]: c[2] for c in chunks}
    known, bm25 = set(law.values()), found.__getitem__

    def dense(query, k, doc=None):
        if query not in asked:
            return set()
        scored = [(-round(float(np.dot(v, asked[query])), 6), n) for n, v in vectors.items() if doc is None or law[n] == doc]
        return {n for s, n in sorted(scored)[:k] if doc is None or s < 0}

    def everywhere(query, q, dk, sk):
        return dense(query, dk) | {n for _, n in bm25(q)[:sk]}

    def inside(query, q, doc, dk, sk):
        if doc not in known:
            return everywhere(query, q, dk, sk)
        return dense(query, dk, doc) | set([n for _, n in bm25(q)[: 5 * sk] if law[n] == doc][:sk])

    def gather(query, texts, docs, dk, sk):
        out = set()
        for q in texts:
            for doc in docs or [None]:
                out |= everywhere(query, q, dk, sk) if doc is None else inside(query, q, doc, dk, sk)
        return out

    def score(q, node, boost, factor):
        a = set(lexical_tokens(q))
        body = set(lexical_tokens(f"{law[node]} - {text[node]}"[:1024]))
        s = round(len(a & body) / max(1, len(a)), 6)
        return round(s * factor, 6) if any(w.lower() in text[node].lower() for w in boost) else s

    def best(q, nodes, n, boost):
        ranked = sorted((-score(q, x, boost, 1.2), x) for x in nodes if text[x])
        return [x for _, x in ranked[:n]]

    def mmr(q, nodes, n, boost):
        left = sorted((-score(q, x, boost, 1.2), x) for x in nodes if text[x])
        out = []
        while left and len(out) < n:
            near = lambda x: max([len(set(text[x].lower().split()) & set(text[y].lower().split())) / max(1, len(set(text[x].lower().split()) | set(text[y].lower().split()))) for y in out] or [0.0])
            pick = min(left, key=lambda r: (-(0.7 * -r[0] - 0.3 * near(r[1])) if out else r[0], r[1]))
            left.remove(pick)
            out.append(pick[1])
        return out

    result = {}
    for q, query, docs, hint, subs, topic, kw, aspects, proc, term, expand in intents:
        docs, kw = docs or [], kw or []
        unique, seen = [], set()
        for s in subs or []:
            if s.strip() and s.strip().lower() not in seen:
                seen.add(s.strip().lower())
                unique.append(s)
        unique = unique or [query]

        def multi(dk, sk):
            if len(unique) == 1:  # noqa: B023
                t = (topic or "").strip()  # noqa: B023
                texts = unique + ([t] if t and t.lower() != unique[0].strip().lower() else [])  # noqa: B023
                return gather(q, texts, docs, dk, sk)  # noqa: B023
            return gather(q, unique, docs, max(3, dk // len(unique)), max(3, sk // len(unique)))  # noqa: B023

        def default(k):
            return ([("scoped", lambda: best(query, gather(q, [query], docs, 2 * k, 2 * k), 2 * k, kw))] if docs else []) + [("global", lambda: best(query, everywhere(q, query, 2 * k, k), 2 * k, kw))]  # noqa: B023

        last = [("fallback", lambda: best(query, everywhere(q, query, 3 * K, 2 * K), 2 * K, kw))] if docs else []  # noqa: B023
        distinct = list(dict.fromkeys(docs))
        if strategy == "single_lookup":
            direct = lambda: [n for n in sorted(law) if law[n] == docs[0] and n[-1] == hint and text[n]][:1] if hint and docs else []  # noqa: B023, E731
            steps = [("direct", direct), ("main", lambda: best(query, multi(K, 2 * K), 2 * K, kw)), *default(K), *last]  # noqa: B023
        elif strategy == "comparison" and len(distinct) >= 2:

            def compared():
                slot, value = {}, {}
                for i, doc in enumerate(distinct):  # noqa: B023
                    t = subs[i] if subs and i < len(subs) else query  # noqa: B023
                    ranked = sorted((-score(query, x, kw, 1.3), x) for x in inside(q, t, doc, K + 3, K) if text[x])  # noqa: B023
                    for place, (s, x) in enumerate(ranked):
                        slot[x] = max(slot.get(x, 0), int(place < max(3, K // len(distinct))))  # noqa: B023
                        value[x] = s
                order = sorted(slot, key=lambda x: (-slot[x], value[x], x))
                return [x for place, x in enumerate(order) if slot[x] or place < 2 * K]

            steps = [("main", compared), *last]
        elif strategy == "comparison":
            steps = [*default(2 * K), *last]
        elif strategy == "listing":
            n = 2 * K if expand else K + 3
            steps = [("main", lambda: mmr(query, multi(n, n), n, kw)), *last]  # noqa: B023
        elif strategy == "eligibility_check":
            more = [f"{topic or query} {a}" for a in (aspects or [])[:3]]
            steps = [("main", lambda: best(query, multi(K, K) | gather(q, more, docs, 3, 3), K + 3, kw)), *last]  # noqa: B023
        elif strategy == "procedure":
            steps = [("main", lambda: best(query, multi(K, 3 * K), 2 * K, (proc or []) + kw)), *last]  # noqa: B023
        elif strategy == "cross_document":
            steps = [("main", lambda: mmr(query, multi(2 * K, K + 3), K + 3, kw)), ("global", lambda: best(query, everywhere(q, query, 3 * K, 2 * K), 2 * K, kw)), *last]  # noqa: B023
        elif strategy == "definition":
            own = ([term] if term else []) + kw
            steps = [("main", lambda: best(query, multi(K, 2 * K), 2 * K, own)), ("global", lambda: best(query, everywhere(q, query, K, 2 * K), 2 * K, own)), *last]  # noqa: B023
        else:
            steps = [*default(K), *last]
        for name, step in steps:
            chosen = step()
            if chosen:
                result[q] = (name, chosen)
                break
    return result


def lexical_tokens(s):
    from quillrank.functions import constants as C

    return s.lower().translate(str.maketrans("", "", C.PUNCTUATION)).split()


NAMES = ["single_lookup", "comparison", "listing", "eligibility_check", "procedure", "cross_document", "definition", "default", "no such strategy"]


@pytest.mark.parametrize("strategy", NAMES)
def test_strategy(spark, world, strategy):
    corpus, _, _, intents, *_ = world
    got: dict = {}
    for r in sorted(strategies.retrieve(spark.createDataFrame(intents, strategies.INTENT), strategy, corpus, K).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, (r.attempt, []))[1].append(r.node_id)
    assert got == plain(spark, world, strategy)


def test_neighbours_are_candidates(spark, world):
    """With edges, an entity that a search finds leads to the chunks that mention it."""
    corpus, *_ = world
    edges = spark.createDataFrame([("node:00", "ent:x", "MENTIONS"), ("node:00", "node:38", "REFERS")], "src string, dst string, type string")
    found = spark.createDataFrame([(0, None, "node:00")], "query_id bigint, document string, node_id string")
    intent = spark.createDataFrame([(0, "alpha", None, None, None, None, None, None, None, None, None)], strategies.INTENT)
    attempt = strategies.strategies(K)["default"][-1]
    both = strategies.choose(found, intent, strategies.Corpus(corpus.chunks, corpus.index, corpus.vectors, corpus.query_vectors, edges=edges), attempt)
    assert {r.node_id for r in both.collect()} == {"node:00", "node:38"}


def test_cross_document_scores_whole_texts(spark, world):
    """Words that stand late in a long text count, in every attempt."""
    late = " ".join(["filler"] * 1000) + " alpha omega"
    chunks = spark.createDataFrame([("node:early", "law0", "alpha " + "filler " * 1000), ("node:late", "law0", late)], "node_id string, canonical string, full_text string")
    found = spark.createDataFrame([(0, None, "node:early"), (0, None, "node:late")], "query_id bigint, document string, node_id string")
    intent = spark.createDataFrame([(0, "alpha omega", None, None, None, None, None, None, None, None, None)], strategies.INTENT)
    corpus = strategies.Corpus(chunks, world[0].index, world[0].vectors, world[0].query_vectors)
    attempts = strategies.strategies(K)["cross_document"]
    assert [a.name for a in attempts] == ["main", "global", "fallback"]
    for attempt in attempts:
        got = sorted((r["rank"], r.node_id, r.score) for r in strategies.choose(found, intent, corpus, attempt).collect())
        assert got == [(0, "node:late", 1.0), (1, "node:early", 0.5)]


def test_no_intents(spark, world):
    none = spark.createDataFrame([], strategies.INTENT)
    assert strategies.retrieve(none, "listing", world[0], K).collect() == [] and strategies.retrieve(none, "single_lookup", world[0], K).where(F.lit(True)).count() == 0
