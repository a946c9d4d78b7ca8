"""Evaluation: set recalls, relaxed citation matches, scores and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Documents and articles that count as amendments.
AMENDED = {"strict": (["34/2018", "08/2023"], [1, 2]), "wide": (["34/2018", "08/2023", "71/2020", "116/2020"], [1, 2, 6])}


def recall(expected: Column, found: Column) -> Column:
    """Share of the expected set that was found; 1 if nothing was expected."""
    e = F.array_distinct(expected)
    return F.when(F.size(e) == 0, 1.0).otherwise(F.size(F.array_intersect(e, found)) / F.size(e))


def precision(expected: Column, found: Column) -> Column:
    f = F.array_distinct(found)
    return F.when(F.size(f) == 0, 0.0).otherwise(F.size(F.array_intersect(f, expected)) / F.size(f))


def doc_hit(expected: Column, found: Column) -> Column:
    """Whether every expected document contains, or is contained in, one that was found."""
    return F.forall(expected, lambda e: F.exists(found, lambda f: F.contains(e, f) | F.contains(f, e)))


def relaxed(expected: Column, found: Column, rule: str = "strict") -> Column:
    """Recall over (doc, article) pairs: documents may contain each other, amendments count for any article."""
    docs, articles = AMENDED[rule]

    def match(e: Column, f: Column) -> Column:
        doc = F.contains(e["doc"], f["doc"]) | F.contains(f["doc"], e["doc"])
        amended = T.contains_any(f["doc"], docs) & f["article"].isin(articles)
        return doc & ((e["article"] == f["article"]) | amended)

    hits = F.size(F.filter(expected, lambda e: F.exists(found, lambda f: match(e, f))))
    return F.when(F.size(expected) == 0, 1.0).otherwise(hits / F.size(expected))


def cited_articles(found: Column) -> Column:
    """The distinct article numbers named in the found items; items without one, or null, name none."""
    numbers = F.flatten(F.transform(F.filter(found, lambda x: x.isNotNull()), lambda x: F.transform(F.slice(F.regexp_extract_all(x, F.lit(r"Điều\s+(\d+)"), F.lit(1)), 1, 1), lambda n: n.cast("int"))))
    return F.array_distinct(numbers)


def requirement_recall(required: Column, found: Column) -> Column:
    """Share of requirements of which any one article was found; 1 if nothing was required."""
    articles = cited_articles(found)
    met = F.size(F.filter(required, lambda r: F.arrays_overlap(r, articles)))
    return F.when(F.size(required) == 0, 1.0).otherwise(met / F.size(required))


def keyword_coverage(keywords: Column, answer: Column) -> Column:
    low = F.lower(T.text(answer))
    return F.when(F.size(keywords) == 0, 1.0).otherwise(F.size(F.filter(keywords, lambda k: F.contains(low, F.lower(k)))) / F.size(keywords))


def context_score(doc_share: Column, article_share: Column) -> Column:
    return F.round(0.6 * doc_share + 0.4 * article_share, 2)


def composite(verdict: Column, citation: Column, explanation: Column, accuracy: Column, coverage: Column) -> Column:
    return 0.25 * verdict + 0.25 * citation + 0.20 * explanation + 0.20 * accuracy + 0.10 * coverage


def hallucination(label: Column, answer: Column, corpus: Column, confidence: Column) -> Column:
    """2, 1, 0.5 or 0; a document of the corpus in the answer, or little confidence, softens a 2."""
    low = F.lower(T.text(answer))
    known = F.exists(corpus, lambda d: F.contains(low, F.lower(d)))
    grade = F.when(F.contains(label, F.lit("Bia_Luat")), F.when(known | (confidence < 0.7), 1.0).otherwise(2.0))
    return grade.when(F.contains(label, F.lit("Suy_Dien")), 1.0).when(F.contains(label, F.lit("Vien_Dan_Bo_Sung")), 0.5).otherwise(0.0)


def final_score(citation: Column, similarity: Column, g: Column, car: Column, grade: Column, has_citations: Column) -> Column:
    base = 0.30 * citation + 0.30 * similarity + 0.25 * (g / 4.0) + 0.15 * car
    final = F.when(grade >= 2, base * 0.5).when(grade == 1, base * 0.95).when(grade == 0.5, base * 0.99).otherwise(base)
    return F.when((citation == 0) & has_citations, F.least(final, 0.5 * base)).otherwise(final)


def service(requests: DataFrame, intent: str, time: str, failed: Column, cached: Column) -> DataFrame:
    """(intent, n, mean_value, errors, cache_hits) of each intent, and of all requests under a null intent."""
    return requests.rollup(intent).agg(F.count("*").alias("n"), F.round(F.avg(time), 6).alias("mean_value"), F.count_if(failed).alias("errors"), F.count_if(cached).alias("cache_hits"))


def status(recall_: Column) -> Column:
    return F.when(recall_ >= 1, "perfect").when(recall_ > 0, "partial").otherwise("zero")
