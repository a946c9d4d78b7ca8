"""Scalar text functions: Column to Column, all inside the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K

FROM, TO = K.accent_table()
#: Java's \\s, \\w and \\d are ASCII unless this flag is on.
U = "(?U)"
#: Texts that are Python strings at once.
NFC_ROWS = 64
#: Bytes of texts that are cut into words at once.
CUT_BYTES = 4 << 20
#: What a byte is to ``words``: 0 part of a word, 1 deleted, 2 white space.
_KINDS = np.zeros(256, np.uint8)
_KINDS[[ord(c) for c in K.PUNCTUATION]] = 1
_KINDS[[9, 10, 11, 12, 13, 32]] = 2
#: White space beyond ASCII in UTF-8, and the bytes that it starts with.
_SPACES = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_LEADS = np.isin(np.arange(256), [s[0] for s in _SPACES])


def text(c: Column) -> Column:
    """Missing text is empty text."""
    return F.coalesce(c, F.lit(""))


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null without one."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def tokens(c: Column) -> Column:
    """Lower case, ASCII punctuation deleted, cut at white space."""
    return F.filter(F.split(F.translate(F.lower(text(c)), K.PUNCTUATION, ""), U + r"[\s\p{Z}]+"), lambda w: w != "")


def words(lowered: pa.Array) -> Iterator[pa.Array]:
    """The words of ``tokens`` for texts that are in lower case and not null, in slices of about ``CUT_BYTES``; no object is made for a word."""
    ends = np.frombuffer(lowered.buffers()[1], np.int32)[lowered.offset : lowered.offset + len(lowered) + 1] if len(lowered) else np.zeros(1, np.int32)
    data = np.frombuffer(lowered.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(lowered):
        to = max(at + 1, int(np.searchsorted(ends, int(ends[at]) + CUT_BYTES, "right")) - 1)
        yield _cut(data[ends[at] : ends[to]], ends[at : to + 1] - ends[at])
        at = to


def _cut(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    kinds = _KINDS[data]
    leads = np.flatnonzero(_LEADS[data])
    if len(leads):
        padded = np.concatenate([data, np.zeros(2, np.uint8)])
        for space in _SPACES:
            found = leads[np.all([padded[leads + i] == b for i, b in enumerate(space)], axis=0)]
            for i in range(len(space)):
                kinds[found + i] = 2
    stay = kinds != 1
    before = np.concatenate([np.zeros(1, np.int32), np.cumsum(stay, dtype=np.int32)])
    data, inside, ends = data[stay], kinds[stay] == 0, before[ends]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    starts = ends[:-1][ends[:-1] < len(data)]
    first[starts] = inside[starts]  # a word ends with its text
    stops = ends[1:][ends[1:] > 0] - 1
    last[stops] = inside[stops]
    starts = np.flatnonzero(first)
    lengths = np.flatnonzero(last) + 1 - starts
    offsets = np.concatenate([np.zeros(1, np.int32), np.cumsum(lengths, dtype=np.int32)])
    found = pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(data[inside]))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, ends).astype(np.int32)), found)


def slug(c: Column) -> Column:
    s = F.regexp_replace(F.lower(F.trim(text(c))), U + r"\s+", "_")
    s = F.regexp_replace(F.regexp_replace(s, r"[^\p{L}\p{N}_]", ""), "^_+|_+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("unknown"))


def normalize(c: Column) -> Column:
    """Lower case without accents or combining marks."""
    return F.regexp_replace(F.translate(F.lower(F.trim(text(c))), FROM, TO), r"[̀-ͯ]", "")


def bare_number(c: Column, normalized: bool = True) -> Column:
    """The document number within a text, or the whole text."""
    c = normalize(c) if normalized else text(c)
    return F.coalesce(first_match(c, U + K.NUMBER), c)


def doc_type(c: Column) -> Column:
    low = F.lower(F.trim(text(c)))
    return F.when(low.startswith("nghị định"), "Nghị định").when(low.startswith("thông tư"), "Thông tư").when(low.startswith("luật"), "Luật").otherwise("Khác")


def year(c: Column) -> Column:
    return F.regexp_extract(text(c), r"(\d{4})", 1)


def article_number(c: Column) -> Column:
    return first_match(text(c), U + r"Điều\s+(\d+)").cast("int")


def title(name: Column, body: Column) -> Column:
    """The name, or else the first line cut to 120 characters."""
    return F.coalesce(F.nullif(text(name), F.lit("")), F.substring(F.trim(F.split(text(body), "\n")[0]), 1, 120))


def snippet(body: Column, n: int) -> Column:
    """What follows the first line, on one line, cut to n characters."""
    lines = F.split(text(body), "\n")
    rest = F.filter(F.transform(F.slice(lines, F.lit(2), F.size(lines)), lambda x: F.trim(x)), lambda x: x != "")
    joined = F.array_join(rest, " ")
    return F.when(F.length(joined) > n, F.concat(F.substring(joined, 1, n), F.lit("..."))).otherwise(joined)


def breadcrumb(node_id: Column, *parts: Column) -> Column:
    joined = F.concat_ws(" > ", *[F.nullif(text(p), F.lit("")) for p in parts])
    return F.coalesce(F.nullif(joined, F.lit("")), node_id)


def doc_of_node(node_id: Column) -> Column:
    return first_match(text(node_id), r"^([^_]+(?:_\d+[^_]*)*?)_D\d+")


def word_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text(c)), U + r"\s+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Shared words over all words, by lower-case white-space words."""
    x, y = word_set(a), word_set(b)
    return F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))


def contains_any(c: Column, words: list[str] | Column) -> Column:
    """Whether any of the words is a substring."""
    if isinstance(words, Column):
        return F.exists(words, lambda w: F.contains(c, w))
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words]) if words else F.lit(False)


def contains_all(c: Column, words: Column) -> Column:
    return F.forall(words, lambda w: F.contains(c, w))


def count_contained(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.contains(c, F.lit(w)).cast("int") for w in words])


def matches_any(c: Column, patterns: list[str]) -> Column:
    return c.rlike(U + "|".join(f"(?:{p})" for p in patterns))


def boost(score: Column, c: Column, words: Column, factor: float) -> Column:
    """The score times a factor, once, if any word is contained."""
    return F.when(F.exists(words, lambda w: F.contains(F.lower(text(c)), F.lower(w))), score * factor).otherwise(score)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cache_key(c: Column) -> Column:
    return F.concat(F.lit("qcache:"), F.md5(F.lower(F.trim(text(c)))))


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(text(c)) / 4).cast("bigint")


def cut_title(c: Column, n: int = 40) -> Column:
    return F.when(F.length(text(c)) > n, F.concat(F.substring(text(c), 1, n), F.lit("..."))).otherwise(text(c))


def composed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Arrow arrays of texts in NFC, ``NFC_ROWS`` at a time: no more of them are Python strings at once."""
    for texts in batches:
        for at in range(0, len(texts), NFC_ROWS):
            yield pa.array([t and unicodedata.normalize("NFC", t) for t in texts.slice(at, NFC_ROWS).to_pylist()], pa.string())


def nfc(c: Column) -> Column:
    """Characters and their combining marks composed (NFC); Spark has no function for it, so this one runs over Arrow batches."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from composed(batches)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "string")(c)


def clean_space(c: Column) -> Column:
    """Composed characters; no-break spaces become spaces, zero-width characters go, runs of spaces shrink."""
    s = F.translate(nfc(text(c)), " ​‌‍﻿", " ")
    return F.trim(F.regexp_replace(s, r"[ \t\r\n\f\x0b]+", " "))


def safe_file_name(c: Column) -> Column:
    return F.regexp_replace(text(c), r'[/\\:*?"<>|]', "_")


def chunk_id(name: Column, number: Column, amended: bool = False) -> Column:
    head = F.regexp_replace(F.split(text(name), "/")[0], r"[^\p{L}\p{N}_]+", "")
    if amended:
        return F.concat(head, F.lit("_Mod_D"), F.regexp_replace(text(number), r"\D", ""))
    return F.concat(head, F.lit("_D"), text(number))


def clean_markdown(c: Column) -> Column:
    s = F.regexp_replace(text(c), r"\*\*|#+", "")
    s = F.regexp_replace(s, r"(?m)^[ \t]*[-*•][ \t]+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"\n+", " "), " +", " "))


def clean_json(c: Column) -> Column:
    """Model output without its thinking part and code fences."""
    s = F.regexp_replace(text(c), r"(?s)^.*</think>", "")
    s = F.regexp_replace(F.trim(F.regexp_replace(s, r"^[\s]+|[\s]+$", "")), r"^```(?:json)?[\s]*", "")
    return F.regexp_replace(s, r"[\s]*```$", "")


def status_note(status: Column) -> Column:
    return F.when(status == "da_sua_doi", " [ĐÃ SỬA ĐỔI]").when(status == "bi_bai_bo", " [BỊ BÃI BỎ]").otherwise("")


def cited_articles(c: Column, letters: bool = True) -> Column:
    """All article numbers that follow "Điều" in an answer, in order."""
    runs = F.regexp_extract_all(text(c), F.lit(U + r"[Đđ]iều\s+(" + (r"[\d\sa-zA-Z,và]+" if letters else r"[\d\s,và]+") + ")"), F.lit(1))
    return F.flatten(F.transform(runs, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("int"))))


def sha_list(c: Column) -> Column:
    """Document numbers in a citation."""
    return F.regexp_extract_all(text(c), F.lit(U + K.NUMBER), F.lit(1))
