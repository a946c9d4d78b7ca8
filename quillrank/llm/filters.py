"""What each of five text filters removes under every order of applying them.

A text's failures are five bits.  The step at which a document with given bits goes under a given
order is a table of 32 by 120 cells, made once.  ``tally`` reads (part, bits, label) rows in
Arrow batches, looks each document's bits up in the table and counts (part, order, step, label)
cells with ``np.bincount``; a task gives back one array of counts for each part and order, and
these partial arrays are summed.  All reported figures follow from the summed cells: a filter's
failures are what it removes as the first step, its unique failures what it removes as the last.

Four bits follow from the text alone.  The fifth marks copies: the smallest id of each text is
found by an aggregation over text digests (128-bit BLAKE2b), which is combined before its
shuffle, and met again by (digest, id), so no task gets all copies of a text.

Defined results: a null text is empty, a null part is the empty string; rows that repeat an id
are documents of their own and no copies of each other; a null id is neither smaller nor larger
than another, so its row is no copy and makes none; labels count if any row of the id has them,
and null labels are 0; an empty table gives no rows; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Label classes: bit 0 is good, bit 1 is toxic.
LABELS = 4
#: Parts whose counts a task holds before it hands them on.
PARTS = 1_000
STEPS = len(FILTERS)
#: Step numbers and "never" by label class.
WIDTH = (STEPS + 1) * LABELS

_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_SIGNS = b"#$%&*|"
_REST = bytes(range(0x80, 0xC0))


def first_failures() -> np.ndarray:
    """The 32-by-120 table: the step, from 0, at which documents with these bits go under this order; 5 for never."""
    out = np.full((1 << STEPS, len(ORDERS)), STEPS, np.int64)
    for j, order in enumerate(ORDERS):
        for step in reversed(range(STEPS)):
            failing = (np.arange(1 << STEPS) >> FILTERS.index(order[step])) & 1 == 1
            out[failing, j] = step
    return out


def text_bits(text: bytes) -> int:
    """Bits 0 to 3: failures of A to D.  ``bytes.split`` cuts at the same six characters as the word definition."""
    words = text.split()
    n, chars = len(words), len(text.translate(None, _REST))
    a = n < 100
    b = 100 * len(set(words)) < 80 * n
    c = 100 * (len(text) - len(text.translate(None, _UPPER))) > 10 * chars
    d = len(text.translate(None, _SIGNS)) < len(text)
    return a | b << 1 | c << 2 | d << 3


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits, digest = [], []
        for value in batch.column(1).cast(pa.binary()):
            text = value.as_py() or b""
            bits.append(text_bits(text))
            digest.append(hashlib.blake2b(text, digest_size=16).digest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(bits, pa.int32()), pa.array(digest, pa.binary())], ["doc_id", "part", "bits", "digest"])


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc_id, part, bits): one row for each document, with all five failure bits."""
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"))
    kind = src.schema["doc_id"].dataType.simpleString()
    judged = materialize(src.mapInArrow(_judge, f"doc_id {kind}, part string, bits int, digest binary"), "judged")
    # The smallest id of a text: combined before the shuffle, one row for each text after it.
    first = judged.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    met = judged.join(first.withColumn("first", F.lit(True)), ["digest", "doc_id"], "left")
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return met.select("doc_id", "part", F.col("bits").bitwiseOR(F.when(copy, 16).otherwise(0)).alias("bits"))


def labelled(failing: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds ``label``: 1 for quality 1, plus 2 for toxic 1."""
    has = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int"))
    marks = labels.groupBy("doc_id").agg((has("quality") + 2 * has("toxic")).alias("label"))
    return failing.join(marks, "doc_id", "left").select("part", "bits", F.coalesce("label", F.lit(0)).alias("label"))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    steps, n = first_failures(), len(ORDERS)
    base = (np.arange(n) * WIDTH)[None, :]
    held: dict[str, np.ndarray] = {}

    def out() -> pa.RecordBatch:
        parts, orders = np.repeat(np.array(list(held), object), n), np.tile(np.arange(n, dtype=np.int32), len(held))
        flat = pa.array(np.concatenate(list(held.values())))
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.string()), pa.array(orders), pa.ListArray.from_arrays(np.arange(len(parts) + 1, dtype=np.int32) * WIDTH, flat)], ["part", "order", "counts"])

    for batch in batches:
        coded = batch.column(0).dictionary_encode()
        at, bits, label = coded.indices.to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        for i, part in enumerate(coded.dictionary.to_pylist()):
            own = at == i
            for some in np.array_split(np.flatnonzero(own), own.sum() // 8192 + 1):  # 8,192 by 120 cells at a time
                cells = base + steps[bits[some]] * LABELS + label[some][:, None]
                held[part] = held.get(part, 0) + np.bincount(cells.ravel(), minlength=n * WIDTH)
            if len(held) >= PARTS:
                yield out()
                held.clear()
    if held:
        yield out()


def tally(rows: DataFrame) -> DataFrame:
    """(part, order, counts) from (part, bits, label) rows: documents by step and label class, the partial arrays summed."""
    partial = rows.select("part", "bits", "label").mapInArrow(_count, "part string, order int, counts array<bigint>")
    summed = partial.groupBy("part", "order").agg(*[F.sum(F.col("counts")[i]).alias(f"c{i}") for i in range(WIDTH)])
    return summed.select("part", "order", F.array(*[f"c{i}" for i in range(WIDTH)]).alias("counts"))


def report(tallied: DataFrame) -> DataFrame:
    """A row for each part, order and step from the summed counts; 600 rows a part."""
    at = lambda step, label: F.col("counts")[step * LABELS + label]
    names = F.array(*map(F.lit, ORDERS))
    step = lambda s: F.struct(
        F.lit(s + 1).alias("step"),
        sum(at(s, b) for b in range(LABELS)).alias("removed"),
        (at(s, 1) + at(s, 3)).alias("good_lost"),
        (at(s, 2) + at(s, 3)).alias("toxic_lost"),
    )
    total = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x)
    rows = tallied.select("part", names[F.col("order")].alias("filter_order"), total.alias("n"), F.explode(F.array(*map(step, range(STEPS)))).alias("s")).select("part", "filter_order", "n", "s.*")
    rows = rows.withColumn("filter", F.substr("filter_order", F.col("step"), F.lit(1)))
    own, so_far = Window.partitionBy("part", "filter"), Window.partitionBy("part", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    when = lambda s: F.max(F.when(F.col("step") == s, F.col("removed"))).over(own)
    return rows.select(
        "part", "filter_order", "step", (F.col("n") - F.sum("removed").over(so_far)).alias("kept"), "removed", (when(1) - F.col("removed")).alias("redundant"),
        when(STEPS).alias("unique_fails"), "good_lost", "toxic_lost", F.sum("removed").over(own).alias("shapley"), "filter",
    )


def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under all 120 orders of the five filters, by language."""
    failing = failures(table(spark, sf_dir, "documents"))
    return report(tally(labelled(failing, table(spark, sf_dir, "labels"))))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    {'A': len(w) < 100, 'B': 100 * len(list_distinct(w)) < 80 * len(w),
     'C': 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text),
     'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(first < w.doc_id, false)} AS s
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
g AS (SELECT part, s.A AS a, s.B AS b, s.C AS c, s.D AS d, s.E AS e, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (SELECT p.x || q.x || r.x || s.x || t.x AS o FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
fails AS (SELECT *, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END
    || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS bits FROM g),
x AS (SELECT part, o, step, substr(o, step, 1) AS f, n, good, toxic, bits, contains(bits, substr(o, step, 1)) AS hit,
    translate(bits, substr(o, 1, step - 1), '') <> bits AS gone FROM fails, orders, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, o, step, f, coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0) AS kept, coalesce(sum(n) FILTER (hit AND NOT gone), 0) AS removed,
    coalesce(sum(n) FILTER (hit AND gone), 0) AS redundant, coalesce(sum(n) FILTER (bits = f), 0) AS unique_fails,
    coalesce(sum(good) FILTER (hit AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (hit AND NOT gone), 0) AS toxic_lost
  FROM x GROUP BY part, o, step, f)
SELECT part, o AS filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley, f AS filter FROM r
"""
