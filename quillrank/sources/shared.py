"""The folder that driver and executors share, and the state of stored tables."""

from __future__ import annotations

import atexit
import hashlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of our own only where it is unset and all tasks run in the driver."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir isn't set: it has to name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillrank-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    store, target = _hadoop(spark, path)
    return store.exists(target)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of ours; a stopped session leaves nothing to do."""
    context = spark.sparkContext
    if context._jsc is not None and not context._jsc.sc().isStopped():
        store, target = _hadoop(spark, path)
        store.delete(target, True)


def version(df: DataFrame) -> str:
    """A digest of the names, sizes and times of a table's files; it changes when the table is written."""
    spark, parts = df.sparkSession, []
    for name in sorted(df.inputFiles()):
        store, target = _hadoop(spark, name)
        at = store.getFileStatus(target)
        parts.append(f"{name} {at.getLen()} {at.getModificationTime()}")
    return hashlib.md5("\n".join(parts).encode()).hexdigest()


def home(spark: SparkSession, stem: str) -> str:
    """A path in the shared folder that this application comes back to, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{stem}-{spark.sparkContext.applicationId}"
    if path not in _homes:
        _homes.add(path)
        atexit.register(remove, spark, path)
    return path


_homes: set[str] = set()


def written(df: DataFrame, stem: str) -> DataFrame:
    """Rows that are written to the shared folder and read again, so what follows doesn't compute them anew; removed when the driver ends."""
    path = f"{shared_dir(df.sparkSession)}/{stem}-{uuid.uuid4().hex}"
    atexit.register(remove, df.sparkSession, path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
