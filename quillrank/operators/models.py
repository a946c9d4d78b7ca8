"""Injected models: named scorers, rewriters and encoders that run over Arrow batches.

A model is a function from a list of strings to a list of results.  A call that fails is tried
again, three times in all, after waits of 2 and 4 seconds; a text is then marked with the error.
The defaults are deterministic and need no network.

A worker holds one Arrow batch of texts, and Python strings and answers of ``BATCH`` of them.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ATTEMPTS, WAITS = 3, (2.0, 4.0)
BATCH = 64

_models: dict[str, dict[str, Callable]] = {"scorer": {}, "rewriter": {}, "encoder": {}}


def register_scorer(name: str, fn: Callable[[list[tuple[str, str]]], list[float]]) -> None:
    """``fn`` scores (query, text) pairs."""
    _models["scorer"][name] = fn


def register_rewriter(name: str, fn: Callable[[list[str]], list[str]]) -> None:
    """``fn`` answers prompts with texts."""
    _models["rewriter"][name] = fn


def register_encoder(name: str, fn: Callable[[list[str]], list[list[float]]]) -> None:
    """``fn`` turns texts into vectors."""
    _models["encoder"][name] = fn


def registered(kind: str) -> list[str]:
    return sorted(_models[kind])


def patiently(fn: Callable[[list], list], items: list, waits: tuple[float, ...] = WAITS) -> tuple[list | None, str | None]:
    """(results, None), or (None, error) after the last attempt; an empty text counts as a failure."""
    error = "empty answer"
    for attempt in range(ATTEMPTS):
        try:
            out = list(fn(items))
            if len(out) == len(items) and not any(isinstance(x, str) and not x for x in out):
                return out, None
        except Exception as failed:
            error = str(failed)
        if attempt < len(waits) and attempt + 1 < ATTEMPTS:
            time.sleep(waits[attempt])
    return None, error


def answered(batches: Iterator[pa.Array], fn: Callable, waits: tuple[float, ...] = WAITS) -> Iterator[pa.Array]:
    """Answers to Arrow arrays of prompts, ``BATCH`` at a time: no more of them are Python strings at once."""
    for prompts in batches:
        for at in range(0, len(prompts), BATCH):
            part = [p or "" for p in prompts.slice(at, BATCH).to_pylist()]
            got, error = patiently(fn, part, waits)
            yield pa.array(got if got is not None else [f"[LLM Error: {error}]"] * len(part), pa.string())


def rewrite(df: DataFrame, prompt: str, name: str = "echo", out: str = "answer", waits: tuple[float, ...] = WAITS) -> DataFrame:
    """Adds a rewriter's answers to the prompts of a column, in batches."""
    fn = _models["rewriter"][name]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from answered(batches, fn, waits)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return df.withColumn(out, F.arrow_udf(run, "string")(F.col(prompt)))


def encode(df: DataFrame, text: str, name: str = "hashed", out: str = "embedding") -> DataFrame:
    fn = _models["encoder"][name]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for at in range(0, len(texts), BATCH):
                yield pa.array(fn([t or "" for t in texts.slice(at, BATCH).to_pylist()]), pa.list_(pa.float32()))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return df.withColumn(out, F.arrow_udf(run, "array<float>")(F.col(text)))


def score(df: DataFrame, query: str, text: str, name: str = "overlap", out: str = "score") -> DataFrame:
    fn = _models["scorer"][name]

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for queries, texts in batches:
            yield pd.Series(fn([(q or "", t or "") for q, t in zip(queries, texts)]), dtype="float64")

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return df.withColumn(out, F.pandas_udf(run, "double")(F.col(query), F.col(text)))


def _overlap(pairs: list[tuple[str, str]]) -> list[float]:
    out = []
    for q, t in pairs:
        a, b = set(q.lower().split()), set(t.lower().split())
        out.append(round(len(a & b) / max(1, len(a)), 6))
    return out


def _hashed(texts: list[str], width: int = 64) -> list[list[float]]:
    out = []
    for t in texts:
        v = [0.0] * width
        for w in t.lower().split():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            v[h % width] += 1.0 if h >> 63 else -1.0
        norm = sum(x * x for x in v) ** 0.5 or 1.0
        out.append([x / norm for x in v])
    return out


register_scorer("overlap", _overlap)
register_rewriter("echo", lambda prompts: [p or " " for p in prompts])
register_encoder("hashed", _hashed)
