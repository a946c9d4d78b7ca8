"""Filter orders against a plain replay of all 120."""

from __future__ import annotations

from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest

from quillrank.llm import filters
from tests.llm.helpers import ODD, clashing, docs

LABELS = "doc_id bigint, quality int, toxic int"


def plain(rows, labels):
    """part, order, step -> the nine figures, by applying filters to lists of documents."""
    marks = {i: (any(r[1] == 1 for r in labels if r[0] == i), any(r[2] == 1 for r in labels if r[0] == i)) for i, _, _ in labels if i is not None}
    by_text = defaultdict(list)
    for i, text, *_ in rows:
        if i is not None:
            by_text[text or ""].append(i)
    by_part = defaultdict(list)
    for i, text, lang, *_ in rows:
        t = text or ""
        w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", t) if x]
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": i is not None and any(j < i for j in by_text[t]),
        }
        by_part[lang or ""].append((fails, marks.get(i, (False, False))))
    out = {}
    for part, members in by_part.items():
        shapley = defaultdict(int)
        for p in permutations("ABCDE"):
            left = members
            for step, f in enumerate(p, 1):
                gone = [m for m in left if m[0][f]]
                left = [m for m in left if not m[0][f]]
                shapley[f] += len(gone)
                fail = sum(m[0][f] for m in members)
                unique = sum(m[0][f] and sum(m[0].values()) == 1 for m in members)
                out[part, "".join(p), step] = [len(left), len(gone), fail - len(gone), unique, sum(m[1][0] for m in gone), sum(m[1][1] for m in gone), f]
        for key, v in out.items():
            if key[0] == part:
                v.insert(6, shapley[v[6]])
    return out


def found(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley, r["filter"]] for r in df.collect()}


MIXED = [
    *ODD, (20, "plain words " * 60, "en", "s", 0), (21, "PLAIN WORDS " * 60, "en", "s", 0), (22, " ".join(f"w{i}" for i in range(150)), "en", "s", 0),
    (23, " ".join(f"w{i}" for i in range(150)), "fr", "s", 0), (19, " ".join(f"w{i}" for i in range(150)), "fr", "s", 0), (24, "a # sign", "", "s", 0), (25, "a # sign", None, "s", 0),
    (26, "É" * 10 + "A", "de", "s", 0), (27, "É" * 9 + "A", "de", "s", 0), (None, "no id here", "en", "s", 10),
]
MARKS = [(20, 1, 0), (21, None, 1), (22, 1, 1), (22, 0, 0), (24, 0, None), (None, 1, 1), (99, 1, 1), (4, 1, 0)]


@pytest.mark.parametrize("rows", [MIXED, []])
def test_report(spark, rows):
    failing = filters.failures(clashing(docs(spark, rows)))
    got = found(filters.report(filters.tally(filters.labelled(failing, spark.createDataFrame(MARKS, LABELS)))))
    assert got == plain(rows, MARKS)


def test_table():
    steps = filters.first_failures()
    assert steps.shape == (32, 120)
    for bits in range(32):
        for j, order in enumerate(filters.ORDERS):
            hit = [s for s, f in enumerate(order) if bits >> "ABCDE".index(f) & 1]
            assert steps[bits, j] == (hit[0] if hit else 5)


def test_parts_are_handed_on(spark, monkeypatch):
    """More parts than a task may hold."""
    rows = [(i, "x", f"p{i % 30}", "s", 1) for i in range(300)]
    monkeypatch.setattr(filters, "PARTS", 4)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([r[2] for r in rows]), pa.array([1] * 300, pa.int32()), pa.array([0] * 300, pa.int32())], ["part", "bits", "label"])
    out = list(filters._count(iter([batch])))
    assert len(out) > 1 and sum(np.sum(x) for b in out for x in b.column(2).to_pylist()) == 300 * 120
    got = filters.tally(spark.createDataFrame([(r[2], 1, 0) for r in rows], "part string, bits int, label int")).collect()
    assert len(got) == 30 * 120 and all(sum(r.counts) == 10 for r in got)
