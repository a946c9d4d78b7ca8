"""File formats of the corpus: chunk files, graph files, title maps, ontologies, benchmark cases.

Every reader takes a path that Spark can open and gives typed rows; a file that can't be parsed
is skipped by the permissive mode and kept out of the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINT = "struct<label:string,text:string>"
CHUNK = (
    "id string, metadata struct<source:string,so_hieu:string,chapter:string,section:string,article_number:string,article_title:string,"
    "target_article:string,is_sub_split:boolean,is_base:boolean,tags:array<string>>,"
    f"content struct<full_text:string,clause:array<struct<clause_id:string,text:string,point:array<{POINT}>>>>"
)
GRAPH = (
    "struct<metadata:map<string,string>,entities:array<struct<id:string,name:string,type:string,description:string>>,"
    "relations:array<struct<source:string,target:string,relation:string>>,mappings:array<struct<tree_node:string,entity:string,relation:string>>>"
)
ONTOLOGY = (
    "intent_classifier struct<keywords:map<string,array<string>>,lookup_context:array<string>,legal_keywords:array<string>>,"
    "query_expander struct<expansion_rules:array<struct<keywords:array<string>,expansion:string>>,target_routing_rules:array<struct<keywords:array<string>,"
    "match_type:string,targets:array<string>,conditions:array<struct<requires:array<string>,match_type:string,targets:array<string>>>>>>"
)
CASE = "question string, type string, answer string, citations array<string>"
NESTED_CASE = (
    "questions array<struct<id:string,question:string,difficulty:string,legal_basis:string,ground_truth:struct<relevant_docs:array<string>,"
    "relevant_articles:array<string>,reference_answer:string,expected_answer_keywords:array<string>>>>"
)


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def chunk_files(spark: SparkSession, path: str) -> DataFrame:
    """A row for each chunk of all ``*.json`` files but ``doc_titles.json``; the file stem is the fallback source."""
    df = _json(spark, f"{path}/*.json", CHUNK).withColumn("file", F.col("_metadata.file_name"))
    df = df.where((F.col("file") != "doc_titles.json") & F.col("_corrupt_record").isNull())
    source = F.coalesce(F.nullif(F.col("metadata.source"), F.lit("")), F.regexp_replace("file", r"\.json$", ""))
    return df.select("file", "id", source.alias("source"), "metadata", "content")


def graph_file(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, relations, mappings) of a graph file: one object under a single key of any name."""
    whole = spark.read.option("wholetext", True).text(path)
    root = whole.select(F.explode(F.from_json("value", f"map<string,{GRAPH}>")).alias("key", "graph")).select("graph.*")
    return tuple(root.select(F.inline(c)) for c in ("entities", "relations", "mappings"))


def title_map(spark: SparkSession, path: str) -> DataFrame:
    """(so_hieu, title) rows of a JSON object."""
    whole = spark.read.option("wholetext", True).text(path)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("so_hieu", "title"))


def ontology(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, ONTOLOGY).drop("_corrupt_record")


def cases(spark: SparkSession, path: str, nested: bool = False) -> DataFrame:
    """Benchmark cases of the flat or the nested layout."""
    if nested:
        return _json(spark, path, NESTED_CASE).select(F.inline("questions"))
    return _json(spark, path, CASE).drop("_corrupt_record")


def append_new(results: DataFrame, path: str, key: str) -> DataFrame:
    """Append the rows whose key isn't in the table at ``path`` yet; gives what was added."""
    spark = results.sparkSession
    try:
        done = spark.read.parquet(path).select(key).distinct()
        new = results.join(done, key, "left_anti")
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        new = results
    new.write.mode("append").parquet(path)
    return new


def write_index(tables: dict[str, DataFrame], path: str) -> None:
    """Index tables as Parquet, each with a manifest row: row count and content hash."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        manifest(df).withColumn("name", F.lit(name)).write.mode("overwrite").json(f"{path}/_manifest_{name}")


def manifest(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(F.to_json(F.struct(*df.columns))).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("content"))


def index_is_current(spark: SparkSession, df: DataFrame, path: str, name: str) -> bool:
    """Whether the written index table was built from these rows."""
    try:
        kept = spark.read.schema("n bigint, content string, name string").json(f"{path}/_manifest_{name}").first()
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return False
    now = manifest(df).first()
    return kept is not None and (kept["n"], kept["content"]) == (now["n"], now["content"])


def write_report(rows: DataFrame, path: str, form: str = "json") -> None:
    """Replace the report at ``path``: JSON lines, one text column as it is, or a Markdown table in the order of the rows.

    A table goes to one file: reports are aggregates, and the head must come before the rows.
    """
    if form == "json":
        rows.write.mode("overwrite").json(path)
    elif form == "text":
        rows.select(F.col(f"`{rows.columns[0]}`").cast("string").alias("value")).write.mode("overwrite").text(path)
    elif form == "markdown":
        cell = lambda c: F.regexp_replace(F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), r"\s*\n\s*", " ")
        line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in rows.columns]), F.lit(" |"))
        head = rows.sparkSession.createDataFrame([(-2, "| " + " | ".join(rows.columns) + " |"), (-1, "|" + " --- |" * len(rows.columns))], "place bigint, value string")
        body = rows.select(F.monotonically_increasing_id().alias("place"), line.alias("value"))
        head.union(body).coalesce(1).sortWithinPartitions("place").select("value").write.mode("overwrite").text(path)
    else:
        raise ValueError(f"no report form {form!r}")


def append_trace(lines: DataFrame, path: str) -> None:
    """Append one text column to a log of text files."""
    lines.select(F.col(lines.columns[0]).cast("string").alias("value")).write.mode("append").text(path)


def rewrite_with_backup(df: DataFrame, path: str) -> None:
    """Replace the table at ``path`` by rows that may come from it: write aside, keep the old one as ``.bak``, swap."""
    context = df.sparkSession.sparkContext
    place = lambda p: context._jvm.org.apache.hadoop.fs.Path(p)
    store = place(path).getFileSystem(context._jsc.hadoopConfiguration())
    df.write.mode("overwrite").parquet(f"{path}.new")
    if store.exists(place(path)):
        store.delete(place(f"{path}.bak"), True)
        store.rename(place(path), place(f"{path}.bak"))
    store.rename(place(f"{path}.new"), place(path))
