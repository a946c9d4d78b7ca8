"""Structured Streaming counterparts: event-time windows, running metrics, token buckets and a cache with a time to live."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.shared import exists, remove, shared_dir

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, with event time in UTC."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*").parquet(_folder(spark, sf_dir))
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations table as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/conversations.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/conversations.parquet*")


def _folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder to stream from: a table that is one file is matched by its name."""
    return f"{sf_dir}/events.parquet*"


def tumbling(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    counted = stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(stream: DataFrame, width: str = "2 hours", step: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    counted = stream.withWatermark("ts", late).groupBy(F.window("ts", width, step)).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "n")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    once = stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    counted = once.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return counted.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def metrics(stream: DataFrame) -> DataFrame:
    """Running request metrics by intent."""
    return stream.groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))


def drain(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over what there is and give the result table, which the executors write and nothing collects.

    New rows go to a file sink; a complete result replaces the one of the micro-batch before.
    """
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/drained-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    out, options = f"{path}/out", {"checkpointLocation": f"{path}/checkpoint"}
    if mode == "append":
        stream.writeStream.format("parquet").options(path=out, **options).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(out) if exists(spark, out) else spark.createDataFrame([], stream.schema)
    last: list[int] = []

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/{batch}")
        last.append(batch)

    stream.writeStream.foreachBatch(write).options(**options).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/{last[-1]}") if last else spark.createDataFrame([], stream.schema)


class Bucket(StatefulProcessor):
    """A client's token bucket."""

    def __init__(self, per_minute: int = 30):
        self.per_minute = per_minute

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bucket", "tokens int, last timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        tokens, last = self.state.get() if self.state.exists() else (self.per_minute, None)
        frame = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        out = []
        for ts in frame["ts"]:
            last = ts if last is None else last
            refill = int((ts - last).total_seconds() * self.per_minute / 60)
            if refill > 0:
                tokens, last = min(self.per_minute, tokens + refill), ts
            out.append(tokens > 0)
            tokens -= tokens > 0
        self.state.update((int(tokens), pd.Timestamp(last).to_pydatetime()))
        yield pd.DataFrame({"event_id": frame["event_id"], "client": key[0], "allowed": out})

    def close(self) -> None:
        pass


class Cached(StatefulProcessor):
    """A key that is known for some seconds of event time after it was written; reading it doesn't renew it."""

    def __init__(self, ttl_seconds: int = 1800):
        self.ttl = ttl_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.written = handle.getValueState("written", "at timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        at = pd.Timestamp(self.written.get()[0]) if self.written.exists() else None
        frame = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        hits = []
        for ts in frame["ts"]:
            hit = at is not None and (ts - at).total_seconds() < self.ttl
            hits.append(hit)
            at = at if hit else ts
        self.written.update((at.to_pydatetime(),))
        yield pd.DataFrame({"event_id": frame["event_id"], "key": key[0], "hit": hits})

    def close(self) -> None:
        pass


def rate_limit(stream: DataFrame, per_minute: int = 30) -> DataFrame:
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    asked = stream.select("event_id", F.col("user_id").alias("client"), "ts")
    return asked.groupBy("client").transformWithStateInPandas(Bucket(per_minute), "event_id bigint, client bigint, allowed boolean", "append", "none")


def cached(stream: DataFrame, ttl_seconds: int = 1800) -> DataFrame:
    """(event_id, key, ts) requests become hits and misses."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return stream.select("event_id", "key", "ts").groupBy("key").transformWithStateInPandas(Cached(ttl_seconds), "event_id bigint, key string, hit boolean", "append", "none")
