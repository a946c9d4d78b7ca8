"""Query understanding by keyword rules; a model answers only what the rules leave open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from .sizing import meet


def fast_intent(query: Column) -> Column:
    q = F.lower(F.trim(query))
    greets = F.lit(False)
    for g in K.INTENT_KEYWORDS["GREETING"]:
        greets = greets | q.startswith(g)
    return F.when((F.length(q) < 30) & greets, "GREETING").when((F.length(q) < 40) & T.contains_any(q, K.INTENT_KEYWORDS["THANKS"]), "THANKS")


def intent(query: Column) -> Column:
    """The rule cascade; LOOKUP where no rule applies."""
    q = F.lower(F.trim(query))
    has = lambda name: T.contains_any(q, K.INTENT_KEYWORDS[name])
    counted = F.when(T.contains_any(q, K.LOOKUP_CONTEXT), "LOOKUP").when(has("UNANSWERABLE"), "UNANSWERABLE").otherwise("STATISTICAL")
    fast = fast_intent(query)
    return F.coalesce(fast, F.when(has("SUMMARY"), "SUMMARY").when(has("STATISTICAL"), counted).when(has("LISTING"), "LISTING").when(has("COMPARISON"), "COMPARISON").otherwise("LOOKUP"))


def instant_reply(query: Column) -> Column:
    """The reply to a question that needs no search, null for others."""
    kind = intent(query)
    out = F.lit(None).cast("string")
    for name, reply in K.REPLIES.items():
        out = F.when(kind == name, reply).otherwise(out)
    return out


def decided(query: Column) -> Column:
    """Whether a rule decides; a model is asked about the rest only."""
    q = F.lower(F.trim(query))
    rules = [T.contains_any(q, K.INTENT_KEYWORDS[n]) for n in ("SUMMARY", "STATISTICAL", "LISTING", "COMPARISON")]
    legal = (T.count_contained(q, K.LEGAL_KEYWORDS) >= 2) & (F.length(q) > 20)
    return fast_intent(query).isNotNull() | rules[0] | rules[1] | rules[2] | rules[3] | legal


def expansions(queries: DataFrame, rules: DataFrame) -> DataFrame:
    """(query_id, query) and rules (ord, keywords, expansion): one wider query for each rule that applies."""
    hit = meet(queries, rules, F.exists(F.col("keywords"), lambda k: F.contains(F.lower("query"), k)))
    return hit.select("query_id", "ord", F.concat("query", F.lit(" "), "expansion").alias("expanded"))


def title_match(query: Column, title: Column) -> Column:
    """Whether a query names a title: most of its key words, or all of it."""
    clean = F.trim(F.regexp_replace(F.lower(title), T.U + K.TITLE_LEAD, ""))
    keys = F.filter(F.split(clean, T.U + r"\s+"), lambda w: (w != "") & ~F.array_contains(F.array(*map(F.lit, K.TITLE_STOP_WORDS)), w))
    share = F.size(F.filter(keys, lambda w: F.contains(query, w))) / F.greatest(F.size(keys), F.lit(1))
    return (F.length(clean) >= 15) & (F.size(keys) >= 4) & ((share >= 0.8) | ((F.length(clean) > 20) & F.contains(query, clean)))


def targets(queries: DataFrame, titles: DataFrame, rules: DataFrame) -> DataFrame:
    """Documents that a query is about, in order: titles it names, then rule by rule; each once.

    ``rules`` holds (ord, keywords, cond, requires, match, targets): a row for each condition,
    with cond -1 for a rule's own targets.
    """
    q = F.lower("query")
    named = meet(queries, titles, title_match(q, F.col("title"))).select("query_id", F.struct(F.lit(-1).alias("a"), F.lit(-1).alias("b"), F.col("ord").alias("c")).alias("at"), F.col("so_hieu").alias("target"))
    met = F.when(F.col("match") == "any", F.exists(F.col("requires"), lambda r: F.contains(q, r))).otherwise(F.forall(F.col("requires"), lambda r: F.contains(q, r)))
    hit = meet(queries, rules, F.exists(F.col("keywords"), lambda k: F.contains(q, k)) & ((F.size("requires") == 0) | met))
    ruled = hit.select("query_id", F.col("ord").alias("a"), F.col("cond").alias("b"), F.posexplode("targets").alias("c", "target")).select("query_id", F.struct("a", "b", "c").alias("at"), "target")
    once = named.union(ruled).groupBy("query_id", "target").agg(F.min("at").alias("at"))
    order = Window.partitionBy("query_id").orderBy("at")
    return once.select("query_id", "target", (F.row_number().over(order) - 1).cast("bigint").alias("place"))


def year_and_type(query: Column) -> tuple[Column, Column]:
    q = F.lower(query)
    kind = F.when(F.contains(q, F.lit("nghị định")), "Nghị định").when(F.contains(q, F.lit("thông tư")), "Thông tư").when(F.contains(q, F.lit("luật")), "Luật")
    return T.first_match(q, r"(20\d{2})"), kind


def probe(query: Column, docs_text: Column, n_docs: Column) -> Column:
    """What went wrong with a retrieval, null if nothing did."""
    word = F.lit(r"(?U)\b(\w{3,})\b")
    stop = F.array(*map(F.lit, K.PROBE_STOP_WORDS))
    asked = F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(query), word, F.lit(1))), stop)
    had = F.array_distinct(F.regexp_extract_all(F.lower(docs_text), word, F.lit(1)))
    share = F.size(F.array_intersect(asked, had)) / F.size(asked)
    marks = T.count_contained(F.lower(query), K.CONDITION_MARKERS)
    return F.when(n_docs == 0, "NO_COVERAGE").when(F.size(asked) == 0, None).when(share < 0.15, "SURFACE_MISMATCH").when(share < 0.25, "LOW_RELEVANCE").when(marks > 1, "ENTANGLED_PREMISES")
