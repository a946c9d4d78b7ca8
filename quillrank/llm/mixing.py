"""Mixing documents to target domain weights with soft membership.

A classifier fit on a labelled table gives each document a posterior over domains, so its tokens
belong to all of them in part.  Non-negative rates, one for each document, are sought whose
expected domain totals match the targets in the least-squares sense, each domain's error taken
relative to its size.  Projected gradient descent from rate 1 finds them: in each round the
cluster sums the domain totals, and the driver turns the few totals into one step vector.  A
document's rate is the fold of its posterior over all step vectors, so no round stores
anything, and a lost task is simply run again.

Rates become whole copies: their integer part, and one more with the probability of the
fraction, decided by a hash of the id.

What the driver gets is bounded: two numbers a domain and round, and for the classifier at most
``FIT_ROWS`` rows of at most ``BUCKETS`` hashed words of four bytes, however long their texts are.

Defined results: a null text is empty, with no tokens and the labelled shares as posterior;
labelled rows with a null id or domain teach nothing; a domain that no document belongs to can't
be reached and its target is left out; a domain without a target keeps its own share; without
labelled rows there are no domains and every rate is 1; repeated rows get equal rates; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import logging
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, materialize, table, text_of

#: Most labelled rows that the classifier is fit on: those of the smallest id hash.
FIT_ROWS = 4_000
BUCKETS = 1 << 15
#: Rounds after which a descent that is still under way is ended, with a warning, and rounds after which rates are written down.
ROUNDS, STORED = 500, 10
#: Largest relative error of a domain total at which the descent ends.
CLOSE = 1e-4
#: Words that one worker remembers.
MEMORY = 400_000
#: Highest rate where none is asked for, and the one of the pipeline's stage.
MOST, EPOCHS = 1e9, 4.0
#: Share of what the highest rate allows that a lowered budget takes: soft members keep part of a domain from it.
SLACK = 0.9
#: Difference of an achieved share from its target beyond which it is reported.
OFF = 0.005
#: Target token shares of the production query.
TARGETS = {"de": 0.15, "en": 0.5, "es": 0.15, "fr": 0.2}


LOG = logging.getLogger(__name__)


class Buckets(dict):
    """Hash buckets of words, kept as they are asked for."""

    def __missing__(self, word: str) -> int:
        if len(self) > MEMORY:
            self.clear()
        n = self[word] = zlib.crc32(word.encode()) % BUCKETS
        return n


def features(text: str, buckets: Buckets) -> tuple[int, np.ndarray, np.ndarray]:
    """(number of words, buckets, weights of unit length) of a whole text."""
    words = text.lower().split()
    counted = Counter(words)
    hashed = np.fromiter(map(buckets.__getitem__, counted), np.int64, len(counted))
    at, place = np.unique(hashed, return_inverse=True)
    x = np.log1p(np.bincount(place, np.fromiter(counted.values(), np.float64, len(counted)), len(at)))
    return len(words), at, x / max(1e-12, float(np.sqrt(x @ x)))


class Classifier:
    """Multinomial logistic regression over hashed words."""

    def __init__(self, domains: list[str]):
        self.domains = domains
        self.weights = np.zeros((BUCKETS, len(domains)), np.float32)
        self.bias = np.zeros(len(domains))

    def posterior(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        z = self.bias + x @ self.weights[at]
        z = np.exp(z - z.max())
        return z / z.sum()

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 8, rate: float = 2.0) -> Classifier:
        """Stochastic gradient passes in a fixed order; the bias starts at the labelled shares."""
        shares = np.bincount([y for *_, y in rows], minlength=len(self.domains)) + 0.5
        self.bias = np.log(shares / shares.sum())
        order = np.random.default_rng(7)
        for epoch in range(epochs):
            for i in order.permutation(len(rows)):
                at, x, y = rows[i]
                miss = self.posterior(at, x)
                miss[y] -= 1
                np.subtract.at(self.weights, at, (rate / (1 + epoch) * x[:, None] * miss).astype(np.float32))
        return self


def fit_classifier(docs: DataFrame, labelled: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """Learn domains from ``labelled`` (id, domain) rows, of which at most ``fit_rows`` are used.

    The driver gets hashed word counts of these rows, not their texts.
    """
    ids = labelled.select(F.col(f"`{id_col}`").alias("id"), F.col("domain").cast("string").alias("domain")).where("id is not null and domain is not null")
    ids = ids.groupBy("id").agg(F.min("domain").alias("domain")).orderBy(F.xxhash64("id"), "id").limit(fit_rows)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for batch in batches:
            got = [features(t.as_py(), buckets) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([g[1].astype("<u2").tobytes() for g in got], pa.binary()), pa.array([g[2].astype("<f2").tobytes() for g in got], pa.binary()), batch.column(1)], ["at", "x", "domain"])

    src = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text")).join(F.broadcast(ids), "id").select("text", "domain")
    frame = src.mapInArrow(hashed, "at binary, x binary, domain string").toArrow()
    domains = sorted(set(frame["domain"].to_pylist()))
    place = {d: i for i, d in enumerate(domains)}
    rows = [(np.frombuffer(a, "<u2").astype(np.int64), np.frombuffer(x, "<f2").astype(np.float64), place[d]) for a, x, d in zip(*(frame[c].to_pylist() for c in ("at", "x", "domain")))]
    rows.sort(key=lambda r: (r[2], len(r[0]), r[0].tobytes()))  # the order that tasks end in doesn't matter
    return Classifier(domains).fit(rows) if rows else Classifier([])


def membership(classifier: Classifier, text: Column) -> Column:
    """struct(tokens, posterior) of each text, computed in Arrow batches."""

    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        buckets = Buckets()
        for texts in batches:
            got = [features(t.as_py(), buckets) for t in texts]
            post = [np.round(classifier.posterior(at, x), 9) if classifier.domains else np.zeros(0) for _, at, x in got]
            yield pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array(post, pa.list_(pa.float64()))], ["tokens", "posterior"])

    scored.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(scored, "struct<tokens:bigint, posterior:array<double>>")(text)


def rate_column(posterior: Column, steps: list[np.ndarray], least: float, most: float = MOST, start: Column | None = None) -> Column:
    """The rate after all steps: the fold of rate - posterior . step, held between ``least`` and ``most``."""
    start = F.lit(1.0) if start is None else start
    if not steps:
        return start
    vectors = F.array(*[F.array(*[F.lit(float(v)) for v in step]) for step in steps])
    dot = lambda c: reduce(lambda a, b: a + b, [posterior[i] * c[i] for i in range(len(steps[0]))])
    return F.aggregate(vectors, start, lambda r, c: F.least(F.lit(float(most)), F.greatest(F.lit(float(least)), r - dot(c))))


@dataclass
class Descent:
    """Step vectors, the bounds that rates are held between, and the token shares that come out beside those wanted."""

    steps: list[np.ndarray]
    least: float
    most: float
    achieved: dict[str, float]
    wanted: dict[str, float]

    def rate(self, posterior: Column) -> Column:
        return rate_column(posterior, self.steps, self.least, self.most)

    @property
    def off(self) -> float:
        """Largest difference of an achieved share from the wanted one."""
        return max((abs(self.achieved[d] - w) for d, w in self.wanted.items()), default=0.0)


def solve(members: DataFrame, domains: list[str], targets: dict[str, float], budget: float | str = "total", least: float = 0.0, most: float = MOST) -> Descent:
    """The descent over written (tokens, posterior) rows.

    ``targets`` are token shares; a domain without one keeps its own.  ``budget`` is the number of
    tokens wanted, "total" for as many as there are, or "keep" for the fewest at which no domain
    has to shrink.  Where "keep" would take a domain beyond ``most`` repeats, the budget is
    lowered to what ``most`` allows and the other domains shrink, so the shares still come out.
    """
    k = len(domains)

    def totals(state: DataFrame, steps: list[np.ndarray]) -> np.ndarray:
        rate = rate_column(F.col("posterior"), steps, least, most, F.col("rate"))
        row = state.select(*[(F.col("tokens") * rate * F.col("posterior")[i]).alias(f"m{i}") for i in range(k)]).agg(*[F.sum(f"m{i}") for i in range(k)]).first()
        return np.array([v or 0.0 for v in row])

    none = Descent([], least, most, {}, {})
    if not k:
        return none
    state = members.select("tokens", "posterior", F.lit(1.0).alias("rate"))
    base = totals(state, [])
    live = base > 1e-9 * max(1.0, base.sum())
    asked = np.array([targets.get(d, 0.0) for d in domains])
    named = np.array([d in targets for d in domains])
    if not live.any() or asked[live].sum() <= 0:
        return none
    own = np.where(live & ~named, base, 0.0) / base.sum()
    want = own + np.where(live, asked, 0.0) / asked[live].sum() * (1 - own.sum())
    if budget == "keep":
        room = (base[live & (want > 0)] / want[live & (want > 0)])
        budget = float(room.max())
        if most * room.min() < budget:
            budget, least = SLACK * most * float(room.min()), 0.0
    elif budget == "total":
        budget = float(base.sum())
    aim, scale = want * budget, np.where(live, base, 1.0)
    steps, since, before = [], [], np.full(k, np.inf)
    for _ in range(ROUNDS):
        got = totals(state, since)
        error = np.where(live, (got - aim) / scale, 0.0)
        # The bounds on rates may keep the targets out of reach: then the error ends to change.
        if np.abs(error).max() <= CLOSE or np.abs(error - before).max() <= CLOSE / 10:
            break
        before = error
        # The Hessian in this scale has no eigenvalue over 1, so a whole step never overshoots.
        steps.append(np.round(error, 12))
        since.append(steps[-1])
        if len(since) == STORED:  # so that a round folds ten steps at most
            state = materialize(state.select("tokens", "posterior", rate_column(F.col("posterior"), since, least, most, F.col("rate")).alias("rate")), "rates")
            since = []
    else:
        got = totals(state, since)
    share = lambda v: dict(zip(domains, (v / max(v.sum(), 1e-9)).tolist()))
    found = Descent(steps, least, most, share(got), share(want))
    report(found, dict(zip(domains, (got / np.maximum(base, 1e-9)).tolist())))
    return found


def report(found: Descent, repeats: dict[str, float]) -> None:
    """Log achieved and target shares, as a warning where a target is missed or a domain shrinks or is repeated over ``EPOCHS`` times."""
    text = ", ".join(f"{d} {found.achieved[d]:.4f} of {w:.4f} ({repeats[d]:.2f} times)" for d, w in found.wanted.items())
    odd = found.off > OFF or max(repeats.values()) > EPOCHS
    LOG.log(logging.WARNING if odd else logging.INFO, "mixing %s: token shares achieved of target (repeats) %s", "misses its targets" if found.off > OFF else "meets its targets", text)


def copies_column(rate: Column, id_: Column) -> Column:
    """Whole copies of a document, decided by its id."""
    chance = F.pmod(F.xxhash64(id_, F.lit("copies")), F.lit(1_000_000)) / 1_000_000.0
    return (F.floor(rate) + (chance < rate - F.floor(rate)).cast("int")).cast("int")


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], budget: float | str = "total", least: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tokens, posterior, rate, copies) for each row of ``docs``."""
    classifier = fit_classifier(docs, labelled, id_col=id_col, text_col=text_col)
    members = docs.select(F.col(f"`{id_col}`").alias("id"), membership(classifier, text_of(text_col)).alias("m")).select("id", "m.tokens", "m.posterior")
    members = materialize(members, "members")
    rate = solve(members, classifier.domains, targets, budget, least).rate(F.col("posterior"))
    return members.withColumn("rate", F.round(rate, 6)).withColumn("copies", copies_column(F.col("rate"), F.col("id")))


def labelled_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled table of the production query: (doc_id, domain) of labelled documents; the domain is their language."""
    labels = table(spark, sf_dir, "labels").select("doc_id").distinct()
    return table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("domain")).join(labels, "doc_id")


def mix_stage(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, most: float = EPOCHS) -> DataFrame:
    """Documents repeated by their copies until their domains have the target shares.

    Each document stays at least once, as long as no domain has to be repeated more than ``most``
    times; else the larger domains shrink.  Texts are classified once and written with the result.
    """
    classifier = fit_classifier(docs, labelled)
    names = [fresh(docs, s) for s in ("_member", "_copies", "_copy")]
    scored = materialize(docs.withColumn(names[0], membership(classifier, text_of("text"))), "members")
    found = solve(scored.select(f"{names[0]}.*"), classifier.domains, targets, "keep", 1.0, most)
    copied = scored.withColumn(names[1], copies_column(F.round(found.rate(F.col(names[0])["posterior"]), 6), F.col("doc_id")))
    return copied.withColumn(names[2], F.explode(F.array_repeat(F.lit(1), F.col(names[1])))).select(*[f"`{c}`" for c in docs.columns])


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates that give all documents the target shares of languages, at as many tokens as there are."""
    mixed = mix(table(spark, sf_dir, "documents"), labelled_domains(spark, sf_dir), TARGETS)
    return mixed.withColumnRenamed("id", "doc_id")
