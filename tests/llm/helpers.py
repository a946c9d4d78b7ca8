"""Small tables for the tests of this folder."""

from __future__ import annotations

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"

#: Nulls, empty and long texts, ties, repeated rows and odd characters.
ODD = [
    (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, " \n\t ", None, "s", 4), (4, "one two three four", "en", None, 18), (4, "one two three four", "en", None, 18),
    (None, "no id here", "en", "s", 10), (5, "word " * 4000, "en", "s", 20000), (6, "Ünïcödé 中文 🙂 <|endoftext|> tail", "de", "s", 30), (7, "a\nb\na\nb\n\nc", "fr", "s", 9),
]


def docs(spark, rows=None):
    return spark.createDataFrame(ODD if rows is None else rows, DOCS)


def clashing(df):
    """The same rows with columns named like those the operators make."""
    from pyspark.sql import functions as F

    names = ["words", "windows", "measured", "_words", "tokens", "score", "id", "h", "print", "rank", "copies", "hits", "units", "templates", "label", "key", "edited"]
    return df.withColumns({n: F.lit(1) for n in names})
