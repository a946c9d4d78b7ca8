"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes what the one before kept.  The first four return the columns of ``documents``;
the last returns the pieces of the packed sequences.  Every stage is written to the shared
folder and read again before the next, so a lost executor costs the running stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.llm import mixing, packing, quality, shingles, toxicity
from quillrank.llm.common import materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy v1 keeps."""
    return quality.filter_stage(docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; labels of the held-out fold are not read."""
    return toxicity.filter_stage(docs, toxicity.training_labels(table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: five-word shingles, likeness 0.8 or more, candidates by the SimHash trie and by bands."""
    return shingles.keep_one_copy(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated until their languages have the target shares, four times at most."""
    labelled = docs.select("doc_id", F.col("lang").alias("domain")).join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    return mixing.mix_stage(docs, labelled)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 ids."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("SimHash near-dedup", near_dedup),
    ("mixing to target weights", mix_sources),
    ("best-fit packing", pack),
]

#: A learned classifier, fingerprints and a tokenizer are in between, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage{i}")
    return docs
