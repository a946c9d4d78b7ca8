"""Streams with keyed state: over several micro-batches, after a restart, with expiry, and replayed batches."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillrank.operators import sessions
from quillrank.sources import tables as S
from quillrank.streaming import keyed

START = dt.datetime(2024, 1, 1)
REQUESTS = "event_id bigint, key string, ts timestamp, op string, value double"


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


FIRST = [(1, "a", at(0), "get", None), (2, "a", at(1), "set", 5.0), (3, "a", at(2), "get", None), (4, "b", at(3), "set", None), (5, "b", at(4), "get", None), (6, "c", at(5), "exists", None)]
SECOND = [(7, "a", at(20), "get", None), (8, "a", at(21), "delete", None), (9, "a", at(22), "get", None), (10, "b", at(25), "exists", None), (11, "c", at(26), "set", 1.0), (12, "c", at(26), "set", 2.0)]
THIRD = [(13, "b", at(33), "get", None), (14, "c", at(40), "get", None), (15, "c", at(56), "get", None), (16, "d", at(300), "get", None), (17, "c", at(301), "exists", None)]


def run_over(spark, tmp_path, batches, make, schema, out_schema):
    """Each batch of rows is a file; the stream stops after each and starts again from its checkpoint."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source))
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "checkpoint")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    return sorted(map(tuple, spark.read.schema(out_schema).parquet(out).collect()), key=repr)


def test_store_over_restarts(spark, tmp_path):
    got = run_over(spark, tmp_path, [FIRST, SECOND, THIRD], lambda s: keyed.store(s, late="1 minute"), REQUESTS, keyed.OUT)
    want = keyed.replay(spark.createDataFrame(FIRST + SECOND + THIRD, REQUESTS))
    assert got == sorted(map(tuple, want.collect()), key=repr)
    found = {r[0]: (r[3], r[4]) for r in got}
    assert found[3] == (True, 5.0) and found[7] == (True, 5.0) and found[9] == (False, None)
    assert found[5] == (True, None) and found[13] == (False, None)  # a null value is there until it expires
    assert found[14] == (True, 2.0) and found[15] == (False, None) and found[17] == (False, None)


MESSAGES = "conv_id bigint, turn bigint, role string, text string"


def talk(conv, turns):
    return [(conv, t, ("user", "assistant")[t % 2], f"c{conv} t{t}") for t in turns]


def test_turns_over_restarts(spark, tmp_path):
    """What was said before is the initial state; a restarted stream goes on with what it knew."""
    rows = talk(1, range(12)) + talk(2, range(5)) + [(3, 0, "system", "s"), *[(3, t + 1, r, x) for _, t, r, x in talk(3, range(8))], (4, 0, "user", None), (4, 1, "assistant", "x" * 500), (4, 2, "user", "q"), (4, 3, "assistant", None), (4, 4, "user", "z"), (4, 5, "assistant", "y")]
    before = spark.createDataFrame([r for r in rows if r[1] < 3], MESSAGES)
    parts = [[r for r in rows if low <= r[1] < high] for low, high in ((3, 5), (5, 9), (9, 99))]
    got = run_over(spark, tmp_path, parts, lambda s: keyed.turns(s, before), MESSAGES, "conv_id bigint, pair bigint, question string, history string")
    want = sessions.history(sessions.pairs(spark.createDataFrame(rows, MESSAGES))).select("conv_id", "pair", "question", "history")
    late = {(r[0], p) for r in rows for p in [0]}
    answered = {(c, sum(1 for r in rows if r[0] == c and r[2] != "system" and r[1] < t) // 2) for c, t, role, _ in rows if role == "assistant" and t >= 3}
    assert late and got == sorted((tuple(r) for r in want.collect() if (r.conv_id, r.pair) in answered), key=repr)


def version(session, number, *messages):
    return (session, number, False, [{"turn": t, "role": r, "text": x} for t, r, x in messages])


def test_session_table(spark, tmp_path):
    table = keyed.SessionTable(spark, str(tmp_path / "table"))
    assert table.listing().collect() == [] and table.fetch(spark.createDataFrame([(1,)], "session_id bigint")).collect() == []
    make = lambda rows: spark.createDataFrame(rows, keyed.VERSIONS)
    one = make([version(1, 1, (0, "user", "first question " * 5)), version(2, 2, (0, "system", "s"), (1, "user", "hello")), version(3, 3, (0, "assistant", "no user"))])
    table.append(one, 0)
    two = make([version(1, 4, (1, "assistant", "an answer")), version(2, 5, (2, "assistant", None))])
    table.append(two, 1)
    before = [tuple(r) for r in table.listing().collect()]
    assert [r[0] for r in before] == [2, 1, 3] and before[0] == (2, "hello", 3, 5) and before[1][1] == ("first question " * 5)[:40] + "..." and before[2][1] is None
    table.append(two, 1)  # a batch that is run again
    table.append(one, 0)
    assert [tuple(r) for r in table.listing().collect()] == before
    table.delete(spark.createDataFrame([(2,), (9,)], "session_id bigint"), 6, 2)
    assert [r.session_id for r in table.listing().collect()] == [1, 3]
    table.append(make([version(2, 7, (3, "user", "back again"))]), 3)
    assert [tuple(r) for r in table.fetch(spark.createDataFrame([(2,), (2,), (8,)], "session_id bigint")).collect()] == [(2, 3, "user", "back again")]
    assert [r.session_id for r in table.listing(1).collect()] == [2]


@pytest.mark.parametrize("trigger", [{"availableNow": True}])
def test_session_sink_is_idempotent(spark, tmp_path, sf_dir, trigger):
    """A sink that lost its last commit writes the batch again and the table stays the same."""
    said = F.array(F.struct("turn", "role", "text")).alias("messages")
    source = str(tmp_path / "in")
    S.load(spark, sf_dir, "conversations").repartition(3).write.parquet(source)
    rows = lambda: spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", 1).parquet(source).select(F.col("conv_id").alias("session_id"), F.col("turn").alias("version"), F.lit(False).alias("deleted"), said)
    table = keyed.SessionTable(spark, str(tmp_path / "table"))
    table.sink(rows(), str(tmp_path / "ck"), **trigger).awaitTermination()
    once = sorted(map(tuple, table.current().select("session_id", "version").collect()))
    last = max((tmp_path / "ck" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for lost in (last, last.with_name(f".{last.name}.crc")):
        lost.unlink(missing_ok=True)
    table.sink(rows(), str(tmp_path / "ck"), **trigger).awaitTermination()
    assert sorted(map(tuple, table.current().select("session_id", "version").collect())) == once
    assert len(once) == S.load(spark, sf_dir, "conversations").select("conv_id").distinct().count()
