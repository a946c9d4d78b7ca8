"""Document references: registries of aliases, tiered resolution, cross references and article links.

The registry is a dimension table of document aliases; containment tiers compare a batch of
references with it.  References already resolved by an earlier tier never reach a later one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from .sizing import bounded, meet


def registry(documents: DataFrame) -> DataFrame:
    """(source, so_hieu, ord) rows become (alias, canonical, ord).

    A written form claimed twice belongs to the later document, a bare number to the earlier.
    """
    canonical = F.coalesce(F.nullif(F.trim(T.text(F.col("so_hieu"))), F.lit("")), T.first_match(F.col("source"), T.U + K.NUMBER), F.col("source"))
    docs = documents.select("ord", "source", canonical.alias("canonical"))
    parts = F.split("canonical", "/")
    short = F.when(F.size(parts) >= 2, F.concat(parts[0], F.lit("/"), F.regexp_extract(parts[1], r"^([^-]*)", 1)))
    number = F.regexp_extract("canonical", r"^(\d+)", 1)
    forms = docs.select("canonical", "ord", F.explode(F.array("canonical", F.lower("canonical"), "source", F.lower("source"), short)).alias("alias")).where("alias is not null and alias <> ''")
    forms = forms.groupBy("alias").agg(F.max_by("canonical", "ord").alias("canonical"), F.max("ord").alias("ord"))
    bare = docs.select("canonical", "ord", number.alias("alias")).where(F.length("alias") >= 2)
    bare = bare.groupBy("alias").agg(F.min_by("canonical", "ord").alias("canonical"), F.min("ord").alias("ord"))
    return forms.unionByName(bare.join(forms.select("alias"), "alias", "left_anti"))


def resolve(refs: DataFrame, registry_: DataFrame) -> DataFrame:
    """(raw) rows become (raw, canonical, tier): 1 exact, 2 equal bare number, 3 containment, 4 itself."""
    reg = registry_.withColumn("bare", T.bare_number(F.col("alias")))
    raw = refs.select("raw").distinct().withColumn("norm", T.bare_number(F.col("raw")))
    first = lambda df, tier: df.groupBy("raw").agg(F.min_by("canonical", F.struct("ord", "alias")).alias("canonical")).withColumn("tier", F.lit(tier))
    one = first(raw.join(reg, raw["raw"] == reg["alias"]), 1)
    left = raw.join(one, "raw", "left_anti")
    two = first(left.join(reg, left["norm"] == reg["bare"]), 2)
    left = left.join(two, "raw", "left_anti")
    near = (F.length("bare") > 3) & (F.length("norm") > 3) & (F.contains(F.col("norm"), F.col("bare")) | F.contains(F.col("bare"), F.col("norm")))
    three = first(meet(reg, left, near), 3)
    found = one.unionByName(two).unionByName(three)
    return refs.join(found, "raw", "left").select("raw", F.coalesce("canonical", "raw").alias("canonical"), F.coalesce("tier", F.lit(4)).alias("tier"))


def route(refs: DataFrame, registry_: DataFrame) -> DataFrame:
    """The streaming flow's resolver: exact, lower case, dashes and slashes exchanged, then a short prefix."""
    raw, alias = F.col("raw"), F.col("alias")
    tier = F.when(alias == raw, 1).when(alias == F.lower(raw), 2).when(alias == F.translate(raw, "-/", "/-"), 3)
    tier = tier.when(alias.startswith(raw) & (F.length(alias) - F.length(raw) < 5), 4)
    hits = meet(registry_, refs.select("raw").distinct(), tier.isNotNull()).withColumn("tier", tier)
    best = hits.groupBy("raw").agg(F.min_by(F.struct("canonical", "tier"), F.struct("tier", "ord", "alias")).alias("b"))
    return refs.join(best, "raw", "left").select("raw", F.coalesce("b.canonical", "raw").alias("canonical"), F.coalesce("b.tier", F.lit(5)).alias("tier"))


def evaluate(refs: DataFrame, registry_: DataFrame) -> DataFrame:
    """The evaluation's resolver: (raw) becomes (raw, canonical, tier), 1 equal without accents and case, 2 equal bare number, 3 itself."""
    known = registry_.select("canonical", "ord", "alias", T.normalize(F.col("alias")).alias("plain"), T.bare_number(F.col("alias")).alias("bare"))
    asked = refs.select("raw", T.normalize(F.col("raw")).alias("plain"), T.bare_number(F.col("raw")).alias("bare"))
    pick = lambda on: F.min(F.struct("ord", "alias", "canonical"))["canonical"].alias(on)
    same = known.groupBy("plain").agg(pick("by_plain"))
    number = known.groupBy("bare").agg(pick("by_bare"))
    rows = asked.join(same, "plain", "left").join(number, "bare", "left")
    tier = F.when(F.col("by_plain").isNotNull(), 1).when(F.col("by_bare").isNotNull(), 2).otherwise(3)
    return rows.select("raw", F.coalesce("by_plain", "by_bare", "raw").alias("canonical"), tier.alias("tier"))


def inject_parents(ranked: DataFrame, cross: DataFrame) -> DataFrame:
    """(query_id, place, document): each document followed by its parents, each bare number once, first wins."""
    own = ranked.select("query_id", "document", F.struct("place", F.lit(0).alias("k"), F.lit(0).alias("n")).alias("at"))
    parents = ranked.join(bounded(cross), ranked["document"] == cross["child"]).select("query_id", F.col("parent").alias("document"), F.struct("place", F.lit(1).alias("k"), F.col("n")).alias("at"))
    rows = own.union(parents).withColumn("bare", T.bare_number(F.col("document")))
    once = rows.groupBy("query_id", "bare").agg(F.min_by("document", "at").alias("document"), F.min("at").alias("at"))
    order = Window.partitionBy("query_id").orderBy("at")
    return once.select("query_id", "document", (F.row_number().over(order) - 1).cast("bigint").alias("place"))


def canonical_number(numbers: DataFrame, rules: DataFrame) -> DataFrame:
    """(raw) becomes (raw, canonical) by the first rule whose text an upper-case number contains."""
    up = F.upper("raw")
    raw = numbers.select("raw").distinct()
    best = meet(raw, rules, F.contains(up, F.col("needle")) & F.contains(up, F.col("also"))).groupBy("raw").agg(F.min_by("target", "ord").alias("target"))
    return raw.join(best, "raw", "left").select("raw", F.coalesce("target", "raw").alias("canonical"))


def _any(text: Column, words: list[str]) -> Column:
    return T.contains_any(text, words)


def _shared(words: list[str], *texts: Column) -> Column:
    each = [reduce(lambda a, b: a & b, [F.contains(t, F.lit(w)) for t in texts]) for w in words]
    return reduce(lambda a, b: a | b, each)


def _names(text: Column, article: Column) -> Column:
    """Whether a normalised text names an article by number."""
    return F.coalesce(F.regexp_like(text, F.concat(F.lit(r"\bdieu\s+"), article.cast("string"), F.lit(r"\b"))), F.lit(False))


def link_articles(selected: DataFrame, candidates: DataFrame) -> DataFrame:
    """Pairs of a selected article and another that belongs with it, and the rule that says so.

    Both hold (query_id, doc, article, text); candidates also doc_text and top (whether the
    document leads the ranking), selected also doc_text, label and query.  A query selects a
    handful of articles, and its candidates are those of its own documents.
    """
    s = selected.select("query_id", F.col("query").alias("q"), F.col("label").alias("s_label"), F.col("doc").alias("s_doc"), F.col("article").alias("s_article"), F.col("text").alias("s_text"), F.col("doc_text").alias("s_doc_text"))
    c = candidates.select("query_id", F.col("doc").alias("c_doc"), F.col("article").alias("c_article"), F.col("text").alias("c_text"), F.col("doc_text").alias("c_doc_text"), F.col("top").alias("c_top"))
    pairs = s.join(c, "query_id")
    sb, cb, st, ct, q = (T.bare_number(F.col("s_doc")), T.bare_number(F.col("c_doc")), T.normalize(F.col("s_text")), T.normalize(F.col("c_text")), T.normalize(F.col("q")))
    sd, cd = T.normalize(F.col("s_doc_text")), T.normalize(F.col("c_doc_text"))
    pairs = pairs.select("*", *[x.alias(n) for x, n in ((sb, "sb"), (cb, "cb"), (st, "st"), (ct, "ct"), (q, "qn"), (sd, "sd"), (cd, "cd"))])
    sb, cb, st, ct, q, sd, cd = (F.col(n) for n in ("sb", "cb", "st", "ct", "qn", "sd", "cd"))
    sa, ca = F.col("s_article"), F.col("c_article")
    same = sb == cb
    rights = _any(st, K.RIGHTS) | F.contains(F.lower("s_label"), F.lit("quyen"))
    gate = F.contains(sd, cb) | F.contains(cd, sb)
    head = F.lower(F.split("c_text", "\n")[0])
    b3 = F.contains(ct, sb) & _any(ct, K.AMENDING)
    rule = (
        F.when(same & (_names(ct, sa) | _names(st, ca)), "A1")
        .when(same & rights & _any(ct, K.PROHIBITIONS) & _shared(K.ACTORS, q, ct, st), "A2")
        .when(same | ~gate, None)
        .when(F.contains(ct, sb) & _names(ct, sa), "B1")
        .when(F.contains(st, cb) & _names(st, ca), "B2")
        .when(b3, F.when(~_any(head, K.IMPLEMENTING), "B3"))
        .when(F.col("c_top") & _shared(K.CONCEPTS, q, ct, st), "B4")
    )
    linked = pairs.where(~(same & (sa == ca))).withColumn("rule", rule).where("rule is not null")
    return linked.select("query_id", "s_doc", "s_article", "c_doc", "c_article", "rule")


def footnotes(refs: DataFrame, titles: DataFrame) -> DataFrame:
    """Titles for footnotes: by exact number, by number and year, by the number of a law, by a part of the title."""
    raw, so_hieu = F.col("raw"), F.col("so_hieu")
    number, law = T.first_match(raw, r"(\d+/\d{4})"), T.first_match(raw, r"^Luật (\d+)")
    tier = F.when(so_hieu == raw, 1).when(number.isNotNull() & F.contains(so_hieu, number), 2).when(law.isNotNull() & F.startswith(so_hieu, F.concat(law, F.lit("/"))), 3)
    tier = tier.when((F.length(raw) > 5) & F.contains(F.lower("title"), F.lower(raw)), 4)
    hits = meet(refs.select("raw").distinct(), titles, tier.isNotNull()).withColumn("tier", tier)
    best = hits.groupBy("raw").agg(F.min_by(F.struct("title", "tier"), F.struct("tier", "ord")).alias("b"))
    return refs.join(best, "raw", "left").select("raw", F.col("b.title").alias("title"), F.coalesce("b.tier", F.lit(5)).alias("tier"))


def selected_nodes(picked: DataFrame, articles: DataFrame) -> DataFrame:
    """(so_hieu, dieu, node_id): the articles of a document that a selection names; (so_hieu, dieu) and (canonical, name, node_id).

    A whole number is an equality, so it meets only the articles of that number; only one with letters is looked for in all names of its document.
    """
    whole = F.coalesce(F.col("dieu").rlike(r"^\d+$"), F.lit(False))
    exact = picked.where(whole).select("so_hieu", "dieu", F.expr("try_cast(dieu as int)").alias("number"))
    numbered = articles.select(F.col("canonical").alias("so_hieu"), T.article_number(F.col("name")).alias("number"), "node_id")
    met = numbered.join(bounded(exact), ["so_hieu", "number"]).select("so_hieu", "dieu", "node_id")
    suffix = F.regexp_like(F.lower("name"), F.concat(F.lit(r"điều\s+"), F.lower("dieu")))
    rest = articles.join(bounded(picked.where(~whole)), F.col("canonical") == F.col("so_hieu")).where(suffix)
    return met.union(rest.select("so_hieu", "dieu", "node_id"))
