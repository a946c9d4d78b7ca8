"""Scalar functions against short Python specifications."""

from __future__ import annotations

import re
import string
import unicodedata

import pytest
from pyspark.sql import functions as F

from quillrank.functions import text as T

TEXTS = ["", "Điều 16. Quyền của nhà giáo", "  Nghị định 71/2020/NĐ-CP  ", "A, b; c! đ", "Tiếng Việt có dấu: ắ ằ ẵ", "x_y__z", "1-2-3 43/2019", "\tTab\nand line", "中文 texts"]


def column(spark, fn, texts=TEXTS):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(fn(F.col("t"))).collect()]


def test_tokens(spark):
    spec = lambda t: "".join(c for c in t.lower() if c not in string.punctuation).split()
    assert column(spark, T.tokens) == [spec(t) for t in TEXTS]


def test_normalize(spark):
    spec = lambda t: "".join(c for c in unicodedata.normalize("NFD", t.lower().strip().replace("đ", "d")) if not unicodedata.combining(c))
    texts = [unicodedata.normalize("NFC", t).strip() for t in TEXTS]
    assert column(spark, T.normalize, texts) == [spec(t) for t in texts]


def test_bare_number(spark):
    def spec(t):
        m = re.search(r"(\d+[/-]\d{4}[/-]?[\w-]*)", t)
        return m[1] if m else t

    assert column(spark, lambda c: T.bare_number(c, False)) == [spec(t) for t in TEXTS]


@pytest.mark.parametrize("n", [3, 10, 1000])
def test_snippet(spark, n):
    def spec(t):
        rest = " ".join(x for x in (y.strip(" ") for y in t.split("\n")[1:]) if x)
        return rest[:n] + ("..." if len(rest) > n else "")

    texts = ["one", "a\nb\n\n c d ", "title\nlong line of words\nmore"]
    assert column(spark, lambda c: T.snippet(c, n), texts) == [spec(t) for t in texts]


def test_nulls(spark):
    null = F.lit(None).cast("string")
    row = spark.range(1).select(T.tokens(null), T.slug(null), T.normalize(null), T.title(null, null), T.cited_articles(null)).first()
    assert list(row) == [[], "unknown", "", "", []]
