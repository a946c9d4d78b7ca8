"""Answer contexts: budgeted blocks, citations and their rewriting, model output parsing."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

SEPARATOR = "\n\n---\n\n"


def within_budget(rows: DataFrame, limit: int, by: str = "query_id", place: str = "place", size: str = "size") -> DataFrame:
    """Rows up to the first that overflows; sizes are never negative, so a running sum tells."""
    used = F.sum(size).over(Window.partitionBy(by).orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("used", used.cast("bigint")).where(F.col("used") <= limit)


def block(place: Column, breadcrumb: Column, effective: Column, status: Column, content: Column, cut: int = 4000) -> Column:
    body = F.when(F.length(content) > cut, F.concat(F.substring(content, 1, cut), F.lit("..."))).otherwise(content)
    date = F.when(T.text(effective) != "", F.concat(F.lit(" (Hiệu lực: "), effective, F.lit(")"))).otherwise("")
    return F.concat(F.lit("["), (place + 1).cast("string"), F.lit("] "), breadcrumb, date, T.status_note(status), F.lit("\n"), body)


def assemble(blocks: DataFrame) -> DataFrame:
    """(query_id, place, block) become one context for each query."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "block"))), lambda x: x["block"]), SEPARATOR)
    return blocks.groupBy("query_id").agg(joined.alias("context"))


def rewrite_citations(answer: Column, sources: Column) -> Column:
    """[n, rest] becomes [name, rest]; ``sources`` is an array of (name, article), the n-th for n."""

    def one(text: str | None, found) -> str | None:
        def put(m: re.Match) -> str:
            number, _, rest = m[1].partition(",")
            i = int(number.strip())
            if found is None or not 1 <= i <= len(found) or not found[i - 1]["name"]:
                return m[0]
            name, article, rest = found[i - 1]["name"], found[i - 1]["article"], rest.strip()
            return f"[{name}, {rest}]" if rest else f"[{name}, Điều {article}]" if article else f"[{name}]"

        return re.sub(r"\[(\d+(?:\s*,\s*[^\]]*)?)\]", put, text) if text else text

    @F.pandas_udf("string")
    def run(texts: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([one(t, s) for t, s in zip(texts, lists)], dtype="object")

    return run(answer, sources)


def selection(output: Column) -> Column:
    """Selected (so_hieu, dieu) pairs in a model's answer: tagged JSON, or else every such pair that can be found."""
    tagged = F.coalesce(T.first_match(output, r"(?s)<selected_clauses>(.*?)</selected_clauses>"), output)
    plain = F.trim(F.regexp_replace(T.clean_json(tagged), "'", '"'))
    parsed = F.from_json(plain, "array<struct<so_hieu:string,dieu:string>>")
    found = F.regexp_extract_all(plain, F.lit(r'"so_hieu"\s*:\s*"([^"]*)"\s*,\s*"dieu"\s*:\s*"?[^",}\]]+"?'), F.lit(0))
    fallback = F.transform(found, lambda m: F.struct(F.regexp_extract(m, r'"so_hieu"\s*:\s*"([^"]*)"', 1).alias("so_hieu"), F.trim(F.regexp_extract(m, r'"dieu"\s*:\s*"?([^",}\]]+)"?', 1)).alias("dieu")))
    return F.coalesce(parsed, fallback)


def sources(rows: DataFrame) -> DataFrame:
    """Chunks with article and status as the seven fields of an answer's source."""
    crumb = T.breadcrumb(F.col("node_id"), F.col("canonical"), F.col("chapter"), F.col("name"))
    return rows.select(
        F.col("node_id").alias("doc_id"), F.col("canonical").alias("so_hieu"), F.col("name").alias("ten_van_ban"), F.col("article").alias("so_dieu"), crumb.alias("breadcrumb"),
        F.col("status").alias("tinh_trang"), F.col("full_text").alias("content"),
    )
