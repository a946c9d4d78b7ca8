"""Quality rules as a bitmask ledger.

``ledger`` evaluates every rule once for each document and stores the measurements and one
failure bit for each rule.  Policies are versioned masks over these bits, so a policy, or what
a policy would do without one of its rules, is a bitwise operation over the stored ledger and
reads no text again.  DataFrame functions only.

Defined results: a null text counts as empty; an empty text has no words and fails
``few_words``; repeated rows are judged each on their own; an empty table gives an empty
ledger; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, materialize, table, text_of, words_of

SYMBOLS = "#*$%&|<>"

#: Bit numbers never change; a new rule takes the next one.
RULES = {
    "few_words": 0,
    "repeated_windows": 1,
    "many_symbols": 2,
    "duplicate_lines": 3,
    "word_length": 4,
    "upper_case": 5,
}

#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "many_symbols", "duplicate_lines", "word_length", "upper_case"),
    "v2": ("few_words", "repeated_windows", "many_symbols", "duplicate_lines"),
}


def mask(policy: str) -> int:
    """The bits of a policy."""
    return sum(1 << RULES[r] for r in POLICIES[policy])


def _measure(df: DataFrame, text_col: str) -> tuple[DataFrame, str]:
    """``df`` with one struct column of measurements, and that column's name.

    Work columns are added one at a time because each is read several times by the next: a
    document's words are split once, and its windows are sorted once.
    """
    out, words, windows = (fresh(df, f"_{x}") for x in ("measured", "words", "windows"))
    text, w, s = text_of(text_col), F.col(words), F.col(windows)
    df = df.withColumn(words, words_of(text))
    n = F.size(w)
    # Sorted (hash, position) pairs bring equal windows together in O(n log n).
    three = lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("p"))
    df = df.withColumn(windows, F.when(n >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), three))).otherwise(F.array().cast("array<struct<h:bigint,p:int>>")))
    again = F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
    starts = F.sort_array(F.transform(again, lambda x: x["p"]))
    # A window that starts d words after the last one adds min(3, d) covered words.
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).alias("last")),
        lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last")),
        lambda a: a["n"],
    )
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    long = lambda c: c.cast("bigint")
    fields = {
        "n_words": long(n),
        "word_chars": long(F.length(F.translate(text, " \t\n\x0b\x0c\r", ""))),
        "n_symbols": long(F.length(text) - F.length(F.translate(text, SYMBOLS, ""))),
        "n_lines": long(F.size(lines)),
        "n_dup_lines": long(F.size(lines) - F.size(F.array_distinct(lines))),
        "n_repeat_words": covered,
        "n_upper": long(F.length(F.regexp_replace(text, r"[^\p{Lu}]+", ""))),
    }
    # A later filter on measurements would be pushed down with all of them written out in it,
    # again and again; it can't pass the explosion of a one-element array.
    df = df.withColumn(out, F.explode(F.array(F.struct(*[c.alias(k) for k, c in fields.items()]))))
    return df.drop(words, windows), out


def _bits(m: Column) -> Column:
    """Failure bits from measurements; integer arithmetic only."""
    n = m["n_words"]
    failed = {
        "few_words": n < 50,
        "repeated_windows": 100 * m["n_repeat_words"] > 50 * n,
        "many_symbols": 100 * m["n_symbols"] > 10 * n,
        "duplicate_lines": (m["n_dup_lines"] > 2) & (100 * m["n_dup_lines"] > 30 * m["n_lines"]),
        "word_length": (m["word_chars"] < 2 * n) | (m["word_chars"] > 15 * n),
        "upper_case": 100 * m["n_upper"] > 30 * m["word_chars"],
    }
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(failed[r], F.lit(1 << b)).otherwise(F.lit(0)) for r, b in RULES.items()]).cast("bigint")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: its id, every measurement, and ``failed_bits``."""
    df, m = _measure(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), "text")
    return df.select("doc_id", f"{m}.*", _bits(F.col(m)).alias("failed_bits"))


def verdict(ledgered: DataFrame, policy: str = "v1") -> DataFrame:
    """Apply a policy to a stored ledger: adds ``base_failed`` and ``kept``."""
    bits = F.col("failed_bits")
    return ledgered.withColumns({
        "base_failed": bits.bitwiseAND(mask("base")) != 0,
        "kept": bits.bitwiseAND(mask("base") | mask(policy)) == 0,
    })


def ablation(ledgered: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of a policy: documents that fail it, that only it rejects, and that would be kept without it.

    One aggregation to at most 2 ** rules groups, whatever the number of documents; the rest is
    bitwise work on these groups.
    """
    spark, full = ledgered.sparkSession, mask(policy)
    groups = ledgered.groupBy("failed_bits").agg(F.count("*").alias("n"))
    rules = spark.createDataFrame([(r, 1 << RULES[r]) for r in POLICIES[policy]], "rule string, bit bigint")
    hit = F.col("failed_bits").bitwiseAND(F.col("bit")) != 0
    rest = F.col("failed_bits").bitwiseAND(F.lit(full).bitwiseXOR(F.col("bit"))) == 0
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias
    return (
        rules.join(F.broadcast(groups), F.lit(True), "left")
        .groupBy("rule", "bit")
        .agg(count(hit)("n_failed"), count(hit & rest)("n_only_rule"), count(rest)("n_kept_without"))
    )


def policies(ledgered: DataFrame) -> DataFrame:
    """Documents that each policy keeps and rejects, by bitwise work on the groups of a stored ledger."""
    spark = ledgered.sparkSession
    groups = ledgered.groupBy("failed_bits").agg(F.count("*").alias("n"))
    masks = spark.createDataFrame([(p, mask(p)) for p in POLICIES], "policy string, mask bigint")
    kept = F.col("failed_bits").bitwiseAND(F.col("mask")) == 0
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    # At most 2 ** rules groups meet a row for each policy.
    return masks.join(F.broadcast(groups), F.lit(True), "left").groupBy("policy", "mask").agg(count(kept).alias("n_kept"), count(~kept).alias("n_rejected"))


def filter_stage(docs: DataFrame, policy: str = "v1", text_col: str = "text") -> DataFrame:
    """The documents that a policy keeps, with their own columns."""
    df, m = _measure(docs, text_col)
    return df.where(_bits(F.col(m)).bitwiseAND(mask("base") | mask(policy)) == 0).select(*[f"`{c}`" for c in docs.columns])


def stored_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents, written down once; policies read it and no text again."""
    return materialize(ledger(table(spark, sf_dir, "documents")), "ledger")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents under policy v1."""
    return verdict(stored_ledger(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_upper", "failed_bits"
    )


def quality_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each version of the policy does to all documents."""
    return policies(stored_ledger(spark, sf_dir))


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What policy v1 would do without each of its rules."""
    return ablation(stored_ledger(spark, sf_dir))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM w),
win AS (SELECT doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g FROM pos),
dup AS (SELECT doc_id, p FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(DISTINCT p + d) AS n_repeat_words FROM dup, (VALUES (0), (1), (2)) v(d) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(w.w)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    length(regexp_replace(text, '[^\p{Lu}]+', '', 'g'))::BIGINT AS n_upper
  FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
b AS (SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT
    + 4 * (100 * n_symbols > 10 * n_words)::BIGINT + 8 * (n_dup_lines > 2 AND 100 * n_dup_lines > 30 * n_lines)::BIGINT
    + 16 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::BIGINT
    + 32 * (100 * n_upper > 30 * word_chars)::BIGINT)::BIGINT AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept, n_lines, n_upper, failed_bits
FROM b
"""

_BITS = ORACLE[: ORACLE.rindex("SELECT doc_id, n_words")]
POLICIES_ORACLE = _BITS + f"""
SELECT policy, mask::BIGINT AS mask, count(*) FILTER (WHERE failed_bits & mask = 0) AS n_kept, count(*) FILTER (WHERE failed_bits & mask <> 0) AS n_rejected
FROM (VALUES {", ".join(f"('{p}', {mask(p)})" for p in POLICIES)}) v(policy, mask), b GROUP BY policy, mask
"""
ABLATION_ORACLE = _BITS + f"""
SELECT rule, bit::BIGINT AS bit, count(*) FILTER (WHERE failed_bits & bit <> 0) AS n_failed,
  count(*) FILTER (WHERE failed_bits & bit <> 0 AND failed_bits & ({mask("v1")} - bit) = 0) AS n_only_rule,
  count(*) FILTER (WHERE failed_bits & ({mask("v1")} - bit) = 0) AS n_kept_without
FROM (VALUES {", ".join(f"('{r}', {1 << RULES[r]})" for r in POLICIES["v1"])}) v(rule, bit), b GROUP BY rule, bit
"""
