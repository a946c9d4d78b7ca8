"""Keyed state in streams: a store with expiry, the last turns of conversations, and a session table.

State lives in the state store by key; timers on event time take out what has expired, so state is
bounded by what is alive.  Within a micro-batch rows are taken in (ts, event_id) or turn order; between
micro-batches in the order of arrival.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as T
from ..sources.shared import exists
from .stream import ROCKS

OUT = "event_id bigint, key string, op string, found boolean, value double"


class Store(StatefulProcessor):
    """One key's value: set, get, exists and delete; a value is gone when its time to live is over."""

    def __init__(self, ttl_seconds: int):
        self.ttl = pd.Timedelta(seconds=ttl_seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("value", "value double, written timestamp")

    def _expiry(self, at: pd.Timestamp) -> int:
        return int((pd.Timestamp(at) + self.ttl).timestamp() * 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        value, written = self.state.get() if self.state.exists() else (None, None)
        kept, out = written, []
        frame = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        for event, ts, op, put in zip(frame["event_id"], frame["ts"], frame["op"], frame["value"]):
            alive = written is not None and ts - pd.Timestamp(written) < self.ttl
            out.append((event, key[0], op, alive, value if alive and op == "get" else None))
            if op == "set":
                value, written = put, ts
            elif op == "delete":
                value = written = None
        if kept is not None and (written is None or pd.Timestamp(kept) != pd.Timestamp(written)):
            self.handle.deleteTimer(self._expiry(kept))
        if written is None:
            self.state.clear()
        else:
            self.state.update((None if value is None else float(value), pd.Timestamp(written).to_pydatetime()))
            self.handle.registerTimer(self._expiry(written))
        yield pd.DataFrame(out, columns=["event_id", "key", "op", "found", "value"]).astype({"value": "float64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def store(requests: DataFrame, ttl_seconds: int = 1800, late: str = "10 minutes") -> DataFrame:
    """(event_id, key, ts, op, value) of a stream become (event_id, key, op, found, value): what each request met."""
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = requests.select("event_id", "key", "ts", "op", "value").withWatermark("ts", late)
    return rows.groupBy("key").transformWithStateInPandas(Store(ttl_seconds), OUT, "append", "eventTime")


def replay(requests: DataFrame, ttl_seconds: int = 1800) -> DataFrame:
    """The same over a whole table, without Python: the last write before each request, by a window."""
    order = Window.partitionBy("key").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    write = F.when(F.col("op").isin("set", "delete"), F.struct("op", "value", "ts"))
    last = F.last(write, ignorenulls=True).over(order)
    # Microseconds, as times differ by parts of seconds.
    age = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("last.ts").cast("timestamp"))
    alive = F.coalesce((F.col("last.op") == "set") & (age < ttl_seconds * 1_000_000), F.lit(False))
    return requests.withColumn("last", last).select("event_id", "key", "op", alive.alias("found"), F.when(alive & (F.col("op") == "get"), F.col("last.value")).alias("value"))


class Turns(StatefulProcessor):
    """One conversation's last question-answer pairs, and the question that waits for its answer."""

    def __init__(self, n: int, cut: int):
        self.n, self.cut = n, cut

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pairs = handle.getListState("pairs", "question string, answer string")
        self.said = handle.getValueState("said", "n bigint, question string, asked boolean")

    def _take(self, frame: pd.DataFrame) -> list[tuple]:
        n, question, asked = self.said.get() if self.said.exists() else (0, None, False)
        kept, out = list(self.pairs.get()) if self.pairs.exists() else [], []
        for role, text in zip(frame["role"], frame["text"]):
            if n % 2 == 0:
                question, asked = text, role == "user"
            elif asked and role == "assistant":
                lines = [f"User: {q}\nAssistant: {a}" for q, a in kept if q is not None and a is not None]
                out.append((n // 2, question, "\n".join(lines)))
                kept = [*kept, (question, None if text is None else text[: self.cut])][-self.n :]
            n += 1
        self.said.update((int(n), question, bool(asked)))
        if kept:
            self.pairs.put(kept)
        return out

    def handleInitialState(self, key, rows: pd.DataFrame, timers) -> None:
        self._take(rows.sort_values("turn"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("turn")
        out = self._take(frame)
        yield pd.DataFrame([(key[0], *r) for r in out], columns=["conv_id", "pair", "question", "history"])

    def close(self) -> None:
        pass


def turns(messages: DataFrame, before: DataFrame | None = None, n: int = 3, cut: int = 200) -> DataFrame:
    """(conv_id, turn, role, text) of a stream become (conv_id, pair, question, history) as answers arrive.

    ``before`` are the messages of the time before the stream: the initial state.
    """
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    said = lambda df: df.where("role <> 'system'").select("conv_id", "turn", "role", "text").groupBy("conv_id")
    first = None if before is None else said(before)
    return said(messages).transformWithStateInPandas(Turns(n, cut), "conv_id bigint, pair bigint, question string, history string", "append", "none", first)


# --- Session table ------------------------------------------------------------------------------

VERSIONS = "session_id bigint, version bigint, deleted boolean, messages array<struct<turn:bigint,role:string,text:string>>"


class SessionTable:
    """An append-only table of session versions below ``path``; a deletion is a version, too.

    Each micro-batch writes the folder of its own number, so a batch that is run again replaces what
    it wrote.  ``version`` orders the versions of a session.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, versions: DataFrame, batch: int) -> None:
        versions.select("session_id", "version", "deleted", "messages").write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def sink(self, versions: DataFrame, checkpoint: str, **options):
        """Start a stream of versions into the table."""
        return versions.writeStream.foreachBatch(lambda df, batch: self.append(df, batch)).option("checkpointLocation", checkpoint).trigger(**(options or {"availableNow": True})).start()

    def versions(self) -> DataFrame:
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], VERSIONS)
        return self.spark.read.schema(f"{VERSIONS}, batch int").parquet(self.path).drop("batch")

    def delete(self, sessions: DataFrame, version: int, batch: int) -> None:
        """A tombstone for each (session_id) row."""
        self.append(sessions.select("session_id", F.lit(version).cast("bigint").alias("version"), F.lit(True).alias("deleted"), F.lit(None).cast("array<struct<turn:bigint,role:string,text:string>>").alias("messages")), batch)

    def current(self) -> DataFrame:
        """(session_id, version, messages): the last version of every session that isn't deleted; messages of all versions up to it since its last deletion."""
        rows = self.versions()
        gone = rows.where("deleted").groupBy("session_id").agg(F.max("version").alias("gone"))
        alive = rows.where("not deleted").join(gone, "session_id", "left").where("gone is null or version > gone")
        merged = F.array_sort(F.array_distinct(F.flatten(F.collect_list("messages"))))
        return alive.groupBy("session_id").agg(F.max("version").alias("version"), merged.alias("messages"))

    def listing(self, limit: int | None = None) -> DataFrame:
        """(session_id, title, n, version), latest first: the title is the start of the first user message."""
        rows = self.current()
        first = F.get(F.filter("messages", lambda m: m["role"] == "user"), F.lit(0))["text"]
        listed = rows.select("session_id", F.when(first.isNotNull(), T.cut_title(first)).alias("title"), F.size("messages").cast("bigint").alias("n"), "version").orderBy(F.desc("version"), "session_id")
        return listed if limit is None else listed.limit(limit)

    def fetch(self, sessions: DataFrame) -> DataFrame:
        """(session_id, turn, role, text): the messages of the (session_id) rows asked for."""
        return self.current().join(sessions.select("session_id").distinct(), "session_id", "left_semi").select("session_id", F.inline("messages"))
