"""Helpers that every operator of this folder shares."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word definition: space, tab, line feed, vertical tab, form feed, return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A folder of our own is made only where the setting is missing and all tasks run in the driver,
    as in local tests; on a cluster a missing setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir isn't set: it has to name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillrank-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, stem: str) -> str:
    """An unused path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{stem}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of ours; a stopped session leaves nothing to do."""
    context = spark.sparkContext
    if context._jsc is None or context._jsc.sc().isStopped():
        return
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, stem: str) -> DataFrame:
    """Cut lineage with a written table in the shared folder and read it back."""
    path = new_path(df.sparkSession, stem)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have in any letter case."""
    have, name = {c.lower() for c in df.columns}, stem
    while name.lower() in have:
        name = "_" + name
    return name


def text_of(name: str) -> Column:
    """The text column, null read as empty."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Words as runs of anything but white space."""
    return F.filter(F.split(text, SPACE), lambda w: w != F.lit(""))
