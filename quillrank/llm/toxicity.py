"""Toxicity of texts whose spelling may be disguised: a noisy-channel decoder, then a scorer.

A word that someone disguised (``1d10t``, ``i d i o t``, ``idiooot``) becomes a lattice: each
written character may stand for one or more plain letters, or for nothing.  The most likely
plain readings under a letter trigram model are found with Viterbi's algorithm over all states, in
time and memory that grow with the word's length.  A word of plain letters without a run of three
equal ones has a lattice with one path, and is read as it is.  A word of digits alone is a number;
one without a letter is read if all its characters may stand for letters.

The letter model counts the trigrams of every text of the table.  The scorer learns which
restored words, and which word beginnings of four and five letters, mark toxic texts, from at
most ``FIT_ROWS`` labelled rows (those of the smallest id hash); labels of rows outside the
training folds are never read.  Two numbers of a text, the summed weight of its marked words
and their share, enter a logistic model, which is calibrated on the same rows with each row's
own counts taken out of the weights.  The driver gets the marked words alone, which are few: the
cluster counts all terms and weighs them.

Defined results: a null text is empty and gets the score of a text without marked words;
repeated rows get equal scores; without labelled rows of both classes every score is the
share of toxic rows (0.0 if there are none); an empty table gives an empty result; other
columns are no inputs, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, materialize, table, text_of

#: Most labelled rows that the scorer is fit on.
FIT_ROWS = 20_000
THRESHOLD = 0.3
#: Words that one worker remembers.
MEMORY = 400_000

#: What a written character may stand for beside itself.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "µ": "u", "¥": "y",
}
#: Symbols of the letter model: 0 is anything between words, 1-26 are a-z, 27 is any other letter.
SYMBOLS = 28
SUBSTITUTE, DROP, DROP_DIGIT, LITERAL, SHORTEN = math.log(0.5), math.log(0.3), math.log(1e-6), math.log(0.1), math.log(0.5)
#: Readings of a disguised word that are looked up; any of them may be a marked word.
READINGS = 4
#: Least log odds, at their lower bound, of a term that marks toxic texts.
LEAST = 1.8

CLASS = np.zeros(0x250, np.uint8)
CLASS[ord("a") : ord("z") + 1] = CLASS[ord("A") : ord("Z") + 1] = np.arange(1, 27)
CLASS[[c for c in range(0xC0, 0x250) if chr(c).isalpha()]] = 27

PLAIN = re.compile(r"[^\W\d_]+")
EDGE = re.compile(r"^[^\w@$!|+(<€£¡]+|[^\w@$]+$")
RUN = re.compile(r"(.)\1\1")
SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")


def symbols(text: str) -> np.ndarray:
    """The letter-model symbols of a text; letters beyond the table count as other letters."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(code < len(CLASS), CLASS[np.minimum(code, len(CLASS) - 1)], np.uint8(27)).astype(np.int32)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SYMBOLS**3, np.int64)
    for batch in batches:
        for text in batch.column(0):
            s = np.concatenate(([0, 0], symbols(text.as_py()), [0]))
            total += np.bincount(s[:-2] * SYMBOLS**2 + s[1:-1] * SYMBOLS + s[2:], minlength=SYMBOLS**3)
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found], pa.int64())], ["gram", "n"])


def letter_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log probabilities of a symbol after two others, from every text.

    At most 28 ** 3 counts reach the driver, whatever the number of texts.
    """
    counted = docs.select(text_of(text_col).alias("text")).mapInArrow(_count_batches, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    n = np.full(SYMBOLS**3, 0.1)
    for gram, count in counted.collect():
        n[gram] += count
    n = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    return np.log(n / n.sum(axis=2, keepdims=True))


def _readings(written: str) -> list[list[tuple[str, float]]]:
    """The lattice: for each stretch of equal characters, (letters, log weight) choices."""
    out, i = [], 0
    while i < len(written):
        c, j = written[i], i
        while j < len(written) and written[j] == c:
            j += 1
        run, i = j - i, j
        if c.isalpha():
            choices = [(c * run, 0.0)] if run < 3 else [(c, SHORTEN), (c * 2, SHORTEN)]
            choices += [(x, SUBSTITUTE) for x in LEET.get(c, "")]
        else:
            choices = [("", DROP_DIGIT if c.isdigit() else DROP), (" ", LITERAL)]
            choices += [(x * k, SUBSTITUTE) for x in LEET.get(c, "") for k in {1, min(run, 2)}]
        out.append(choices)
    return out


def decode(written: str, model: np.ndarray | list, n: int = 1) -> list[str]:
    """The plain readings of the n likeliest paths of one lower-case word, or fewer; a space stands for a cut.

    Viterbi over the lattice with the last two symbols as state and n hypotheses for each.  A
    hypothesis is (score, what it came from, letters), so nothing is copied along the way.
    """
    best: dict[tuple[int, int], list[tuple]] = {(0, 0): [(0.0, None, "")]}
    for choices in _readings(written):
        ahead: dict[tuple[int, int], list[tuple]] = {}
        for (a, b), held in best.items():
            for letters, cost in choices:
                x, y, s = a, b, cost
                for c in letters:
                    z = 0 if c == " " else ord(c) - 96 if "a" <= c <= "z" else 27
                    s += model[x][y][z]
                    x, y = y, z
                ahead.setdefault((x, y), []).extend([(h[0] + s, h, letters) for h in held])
        for held in ahead.values():
            if len(held) > n:
                held.sort(key=_score, reverse=True)
                del held[n:]
        best = ahead
    ends = sorted(((h[0] + model[a][b][0], h) for (a, b), held in best.items() for h in held), key=_score, reverse=True)
    out: dict[str, None] = {}
    for _, h in ends:
        parts = []
        while h is not None:
            parts.append(h[2])
            h = h[1]
        out[" ".join("".join(reversed(parts)).split())] = None
        if len(out) == n:
            break
    return list(out)


_score = itemgetter(0)


def readings(word: str, model: np.ndarray, n: int = READINGS) -> list[list[str]]:
    """The likeliest plain lower-case readings of one written word, best first; each is a list of words."""
    word = word.lower()
    if PLAIN.fullmatch(word) and not RUN.search(word):
        return [[word]]
    word = EDGE.sub("", word)
    if PLAIN.fullmatch(word) and not RUN.search(word):
        return [[word]]
    if not any(c.isalpha() for c in word) and (not word or word.isdigit() or not all(c in LEET for c in word)):
        return []
    return [r.split() for r in decode(word, model, n)]


def restore(word: str, model: np.ndarray) -> list[str]:
    """The likeliest plain words that one written word stands for."""
    return next(iter(readings(word, model, 1)), [])


def restored_words(text: str, model: np.ndarray, memory: dict) -> set[tuple[str, ...]]:
    """Distinct words of a whole text, each with its likeliest readings; spaced-out letters are a word too."""
    out = set()
    written = set(text.split())
    for spaced in SPACED.finditer(text):
        letters = spaced[0].replace(" ", "").replace("\t", "")
        if len(set(letters)) > 2:
            written.add(letters)
    for w in written:
        found = memory.get(w)
        if found is None:
            if len(memory) > MEMORY:
                memory.clear()
            found = memory[w] = tuple(dict.fromkeys(x for reading in readings(w, model) for x in reading))
        out.add(found)
    return out


def features_of(word: str) -> list[str]:
    """A restored word, and its beginnings of four and five letters."""
    return [word] + ["^" + word[:k] for k in (4, 5) if len(word) > k]


def _terms(text: str, model: np.ndarray, memory: dict) -> set[str]:
    return {f for words in restored_words(text, model, memory) for w in words for f in features_of(w)}


def _count_terms(batches: Iterator[pa.RecordBatch], model: np.ndarray) -> Iterator[pa.RecordBatch]:
    toxic, clean, memory = Counter(), Counter(), {}
    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1)):
            (toxic if label.as_py() else clean).update(_terms(text.as_py(), model, memory))
    keys = list(toxic.keys() | clean.keys())
    for at in range(0, len(keys), 50_000):
        part = keys[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([toxic[k] for k in part], pa.int64()), pa.array([clean[k] for k in part], pa.int64())], ["term", "toxic", "clean"])


def _weight(toxic: float, clean: float, n_toxic: float, n_clean: float) -> float:
    """The lower bound (one-sided, 95 %) of a term's log odds where it is high, else 0."""
    a, b = toxic + 0.5, clean + 0.5
    w = math.log(a / (n_toxic + 1) / b * (n_clean + 1)) - 1.645 * math.sqrt(1 / a + 1 / b) if toxic >= 2 else 0.0
    return w if w > LEAST else 0.0


class Scorer:
    """What a worker needs to score texts."""

    def __init__(self, model: np.ndarray, counts: dict[str, tuple[int, int]], n_toxic: int, n_clean: int):
        self.model, self.counts, self.n = model.tolist(), counts, (n_toxic, n_clean)
        self.weights = {t: w for t, (a, b) in counts.items() if (w := _weight(a, b, n_toxic, n_clean)) > 0}
        rows = n_toxic + n_clean
        self.fit_to: np.ndarray | None = None
        self.prior = n_toxic / rows if rows else 0.0

    def measure(self, text: str, memory: dict, label: int | None = None) -> tuple[float, float]:
        """(summed weight, share of marked words); with a label, the text's own counts are taken out."""
        def weight(f: str) -> float:
            if label is None:
                return self.weights.get(f, 0.0)
            if f not in self.weights:
                return 0.0
            a, b = self.counts[f]
            return _weight(a - label, b - 1 + label, self.n[0] - label, self.n[1] - 1 + label)

        total = marked = 0.0
        words = restored_words(text, self.model, memory)
        seen: set[str] = set()
        for found in words:
            w, word = max(((weight(f), x) for x in found for f in features_of(x)), default=(0.0, ""))
            if w > 0 and word not in seen:
                seen.add(word)
                total += w
                marked += 1
        return math.log1p(total), math.log1p(100 * marked / max(1, len(words)))

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Ridge logistic regression by Newton's method."""
        if len(y) == 0 or y.min() == y.max():
            return
        x = np.column_stack([np.ones(len(x)), x])
        beta, ridge = np.zeros(x.shape[1]), np.diag([1e-6, 0.1, 0.1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ beta)
            beta += np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-9:
                break
        self.fit_to = beta

    def score(self, text: str, memory: dict) -> float:
        if self.fit_to is None:
            return self.prior
        a, b = self.measure(text, memory)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(self.fit_to @ (1.0, a, b))))))


def _measure_batches(batches: Iterator[pa.RecordBatch], scorer: Scorer) -> Iterator[pa.RecordBatch]:
    memory: dict = {}
    for batch in batches:
        found = [(*scorer.measure(t.as_py(), memory, label.as_py()), label.as_py()) for t, label in zip(batch.column(0), batch.column(1))]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.float64()) for i in range(3)], ["a", "b", "label"])


def fit(docs: DataFrame, labelled: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Scorer:
    """Learn from ``labelled`` (id, toxic) rows; rows with a null id or label teach nothing.

    The labelled ids are broadcast: at most ``fit_rows`` of them.
    """
    model = letter_model(docs, text_col)
    ids = labelled.select(F.col(f"`{id_col}`").alias("id"), F.col("toxic").cast("int").alias("label")).where("id is not null and label is not null")
    ids = ids.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    src = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))
    rows = materialize(src.join(F.broadcast(ids), "id").select("text", (F.col("label") > 0).cast("int").alias("label")), "labelled")
    n = dict(rows.groupBy("label").count().collect())
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    counted = rows.mapInArrow(partial(_count_terms, model=model.tolist()), "term string, toxic bigint, clean bigint")
    counted = counted.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where("toxic >= 2")
    weight = F.expr(f"ln((toxic + 0.5D) / {n_toxic + 1}D / (clean + 0.5D) * {n_clean + 1}D) - 1.645D * sqrt(1 / (toxic + 0.5D) + 1 / (clean + 0.5D))")
    scorer = Scorer(model, {t: (a, b) for t, a, b in counted.where(weight > LEAST).collect()}, n_toxic, n_clean)
    got = np.array(rows.mapInArrow(partial(_measure_batches, scorer=scorer), "a double, b double, label double").collect()).reshape(-1, 3)
    scorer.calibrate(got[:, :2], got[:, 2])
    return scorer


def score_column(scorer: Scorer, text: Column) -> Column:
    """The score of each text, computed in Arrow batches."""

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memory: dict = {}
        for texts in batches:
            yield pd.Series([scorer.score(t, memory) for t in texts], dtype="float64")

    scored.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(scored, "double")(text)


def _held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))) % 4 == 2


def filter_stage(docs: DataFrame, labelled: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with their own columns."""
    scorer, name = fit(docs, labelled), fresh(docs, "_toxicity")
    return docs.withColumn(name, score_column(scorer, text_of("text"))).where(F.col(name) < threshold).drop(name)


def training_labels(labels: DataFrame) -> DataFrame:
    """Label rows outside the held-out fold."""
    return labels.where(~_held_out("doc_id"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; labels of the held-out fold are not read."""
    docs = table(spark, sf_dir, "documents")
    scorer = fit(docs, training_labels(table(spark, sf_dir, "labels")))
    scored = docs.select("doc_id", _held_out("doc_id").alias("held_out"), score_column(scorer, text_of("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
