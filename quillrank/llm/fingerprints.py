"""I-Match document fingerprints.

The lexicon holds the terms of a chosen band of inverse document frequency, counted over all
texts.  A text's distinct terms of the lexicon, sorted, are hashed once whole and once for each
of several randomised subsets of the lexicon.  The whole hash is equal for texts of the same
lexicon terms; the share of equal subset hashes tells how alike two texts are.  Subsets keep
from a quarter to one in 2048 of the lexicon, so short and long texts both have subsets in
which they hold a term or two.  DataFrame functions only.

A band of idf from ``a`` to ``b`` means document frequencies from ``e**-b`` to ``e**-a`` of
the rows, so the lexicon has at most ``e**b`` times as many terms as a text has on average,
however many texts there are.  Its size is counted; beyond ``LEXICON_ROWS`` it is joined by a
shuffle and not broadcast.

Defined results: a null text is empty; a text without a lexicon term is known by a hash of the
text itself; rows that repeat id and text give one row; rows that repeat an id alone follow each
other by text hash; null ids come last; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table, text_of

#: Shares of rows between which a term's document frequency lies: idf from ln 20 to ln 1000.
BAND = (0.001, 0.05)
#: Bits by which a subset thins the lexicon: a subset of r bits keeps 1 in 2 ** r terms.
THINNED = [r for r in range(2, 12) for _ in range(6 if r < 8 else 4)]
LEXICON_ROWS = 1_000_000
TERM_BREAK = r"[^\p{L}\p{N}]+"
#: Where null ids stand in the order.
LAST = -(2**63)
#: A subset without terms.
NONE = "0000"


def subset_tests() -> list[tuple[int, int]]:
    """(mask, value) for each subset: it keeps the terms whose hash has ``value`` under ``mask``.

    Positions and values come from a multiplicative generator, so they are the same anywhere.
    """
    state, out = 0x9E3779B97F4A7C15, []

    def draw(n: int) -> int:
        nonlocal state
        state = (state * 6364136223846793005 + 1442695040888963407) % 2**64
        return (state >> 33) % n

    for r in THINNED:
        free = list(range(63))
        bits = [free.pop(draw(len(free))) for _ in range(r)]
        out.append((sum(1 << b for b in bits), sum(draw(2) << b for b in bits)))
    return out


def terms(text: Column) -> Column:
    """Hashes of the distinct lower-case terms of a text."""
    words = F.filter(F.array_distinct(F.split(F.lower(text), TERM_BREAK)), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND, text_col: str = "text") -> DataFrame:
    """(term) hashes whose document frequency lies in the band; one in two texts at least."""
    n = docs.count()
    counted = docs.select(F.explode(terms(text_of(text_col))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    low, high = max(2, math.ceil(band[0] * n)), max(2, math.floor(band[1] * n))
    found = materialize(counted.where(F.col("df").between(low, high)).select("term"), "lexicon")
    return F.broadcast(found) if found.count() <= LEXICON_ROWS else found


def _hex4(c: Column) -> Column:
    """Four digits of a hash, never those of NONE."""
    return F.lpad(F.lower(F.hex(F.pmod(c, F.lit(65_535)) + 1)), 4, "0")


def signature(sorted_terms: Column) -> Column:
    """The fingerprint of a sorted array of distinct term hashes."""

    def subset(mask: int, value: int) -> Column:
        return F.xxhash64(F.filter(sorted_terms, lambda t: t.bitwiseAND(F.lit(mask)) == F.lit(value)))

    # The hash of an empty array is its seed, so one number tells empty subsets too.
    parts = F.array(*[subset(m, v) for m, v in subset_tests()])
    digits = F.transform(parts, lambda h: F.when(h == 42, F.lit(NONE)).otherwise(_hex4(h)))
    return F.concat(F.lpad(F.lower(F.hex(F.xxhash64(sorted_terms))), 16, "0"), F.array_join(digits, ""))


def of_text(text: Column) -> Column:
    """The fingerprint of a text without lexicon terms."""
    return F.concat(F.lpad(F.lower(F.hex(F.xxhash64(text))), 16, "0"), F.lit(NONE * len(THINNED)))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints, else the share of equal subsets among those with a term in either."""
    at = F.sequence(F.lit(0), F.lit(len(THINNED) - 1))
    part = lambda c, i: F.substring(c, F.lit(17) + 4 * i, F.lit(4))
    some = F.filter(at, lambda i: (part(a, i) != NONE) | (part(b, i) != NONE))
    same = F.filter(some, lambda i: part(a, i) == part(b, i))
    return F.when(a == b, 1.0).when(F.size(some) == 0, 0.0).otherwise(F.size(same) / F.size(some))


def fingerprint_terms(texts: DataFrame, keys: list[str], lexicon_: DataFrame, term_cols: dict[str, Column]) -> DataFrame:
    """(keys, one fingerprint for each of ``term_cols``), null where a text has no lexicon term.

    Each text's terms go to rows and meet the lexicon there; the rows of a key stay in the
    partition they are in if ``texts`` is dealt by the keys.
    """
    names = list(term_cols)
    both = texts.select(*keys, F.posexplode(F.array(*term_cols.values())).alias("which", "terms"))
    rows = both.select(*keys, "which", F.explode("terms").alias("term")).join(lexicon_, "term")
    sets = rows.groupBy(*keys).agg(*[F.sort_array(F.collect_set(F.when(F.col("which") == i, F.col("term")))).alias(c) for i, c in enumerate(names)])
    return sets.select(*keys, *[F.when(F.size(c) > 0, signature(F.col(c))).alias(c) for c in names])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", band: tuple[float, float] = BAND) -> DataFrame:
    """(id, fingerprint) of each row."""
    lex = lexicon(docs, band, text_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = rows.dropDuplicates(["id", "h"]).withColumn("key", F.struct("id", "h"))
    found = fingerprint_terms(rows, ["key"], lex, {"fingerprint": terms(F.col("text"))})
    return rows.join(found, "key", "left").select("id", F.coalesce("fingerprint", of_text(F.col("text"))).alias("fingerprint"))


def following(keys: DataFrame, by: list[str]) -> DataFrame:
    """Each row of distinct keys with the key after it in descending order; after the last, the first.

    Keys are dealt by range, so each task orders its own part; only the first key of each part
    is handled in one place.
    """
    n = max(1, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = materialize(keys.repartitionByRange(n, *[F.desc(c) for c in by]).withColumn("part", F.spark_partition_id()), "order")
    down = [F.desc(c) for c in by]
    ahead = F.lead(F.struct(*by)).over(Window.partitionBy("part").orderBy(*down))
    heads = dealt.groupBy("part").agg(F.max(F.struct(*by)).alias("head"))
    whole = Window.orderBy("part")
    first = F.first("head").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("part", F.coalesce(F.lead("head").over(whole), first).alias("after"))
    linked = dealt.withColumn("ahead", ahead).join(F.broadcast(heads), "part")
    return linked.select(*by, F.coalesce("ahead", "after").alias("next"))


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are."""
    docs = table(spark, sf_dir, "documents")
    lex = lexicon(docs)
    text = F.col("text")
    rows = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("id"), text_of("text").alias("text")).withColumn("h", F.xxhash64("text"))
    sizes = rows.select("id", "h", F.length("text").alias("n")).groupBy("id", "h").agg(F.max("n").alias("n"))
    order = materialize(following(sizes.select("id", "h"), ["id", "h"]).join(sizes, ["id", "h"]), "pairs")
    # What each row lends to the row before it, which says how much it takes.  Every use of
    # ``rows`` below reads the same columns dealt by the same keys, so texts are shuffled once.
    wanted = order.select(F.col("next.id").alias("id"), F.col("next.h").alias("h"), F.col("id").alias("to_id"), F.col("h").alias("to_h"), F.expr("cast(n div 2 as int)").alias("m"))
    lent = rows.join(wanted, ["id", "h"]).select(F.col("to_id").alias("id"), F.col("to_h").alias("h"), F.substring(text, F.lit(1), F.col("m")).alias("lent"))
    n = F.length(text)
    own = rows.join(lent, ["id", "h"]).select("id", "h", "text", F.concat(F.substring(text, F.lit(1), n - F.floor(n / 2).cast("int")), "lent").alias("edited"))
    found = fingerprint_terms(own, ["id", "h"], lex, {"fingerprint": terms(text), "edited_fingerprint": terms(F.col("edited"))})
    plain = own.select("id", "h", n.cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), of_text(text).alias("plain"), of_text(F.col("edited")).alias("plain_edited"))
    plain = plain.dropDuplicates(["id", "h"])
    whole = plain.join(found, ["id", "h"], "left").select(
        "id", "h", F.nullif("id", F.lit(LAST)).alias("doc_id"), "n_chars", "edited_sha256", F.coalesce("fingerprint", "plain").alias("fingerprint"), F.coalesce("edited_fingerprint", "plain_edited").alias("edited_fingerprint")
    )
    whole = materialize(whole, "prints")
    after = order.select("id", "h", "next").join(whole.select(F.struct("id", "h").alias("next"), F.col("fingerprint").alias("after")), "next").select("id", "h", "after")
    return whole.join(after, ["id", "h"]).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("after")).alias("near_next"),
    )
