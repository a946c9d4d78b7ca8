"""Chat sessions, answer frames, caches and limits as batch analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(versions: DataFrame, key: str, at: str) -> DataFrame:
    """The last version of each row of an append-only table."""
    order = Window.partitionBy(key).orderBy(F.desc(at))
    return versions.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def by_recency(rows: DataFrame, key: str, at: str) -> DataFrame:
    """Each session once with its last update, latest first; equal times by key, sessions without a time last."""
    return rows.groupBy(key).agg(F.max(at).alias("updated_at"), F.count("*").alias("n")).orderBy(F.desc_nulls_last("updated_at"), key)


def pairs(messages: DataFrame) -> DataFrame:
    """Messages 0 and 1, 2 and 3, .. of a conversation without its system turns, if user then assistant."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    said = messages.where("role <> 'system'").withColumns({"pos": F.row_number().over(order) - 1, "answer": F.lead("text").over(order), "next": F.lead("role").over(order)})
    return said.where("pos % 2 = 0 and role = 'user' and next = 'assistant'").select("conv_id", (F.col("pos") / 2).cast("bigint").alias("pair"), F.col("text").alias("question"), "answer")


def history(pairs_: DataFrame, n: int = 3, cut: int = 200) -> DataFrame:
    """What a model is told before each question: the n pairs before it, answers cut."""
    order = Window.partitionBy("conv_id").orderBy("pair").rowsBetween(-n, -1)
    line = F.concat(F.lit("User: "), "question", F.lit("\nAssistant: "), F.substring("answer", 1, cut))
    return pairs_.select("conv_id", "pair", "question", F.array_join(F.collect_list(line).over(order), "\n").alias("history"))


def frames(answers: DataFrame) -> DataFrame:
    """(id, answer) become token frames: words, each with its space but the last."""
    words = F.split("answer", " ")
    rows = answers.select("id", F.size(words).alias("n"), F.posexplode(words).alias("pos", "word"))
    token = F.when(F.col("pos") < F.col("n") - 1, F.concat("word", F.lit(" "))).otherwise(F.col("word"))
    return rows.select("id", F.col("pos").cast("bigint").alias("pos"), token.alias("token"))


def sse(kind: Column, content: Column) -> Column:
    return F.concat(F.lit("data: "), F.to_json(F.struct(kind.alias("type"), content.alias("content"))), F.lit("\n\n"))


def _runs(requests: DataFrame, key: str, seconds: int, *columns: str) -> DataFrame:
    """(key, run, rows): a key's requests in order, cut wherever nothing of ``seconds`` ago can matter any more.

    Behind such a gap the state is known, so a key's history is as many groups as it has gaps.
    """
    order = Window.partitionBy(key).orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = F.coalesce(F.col("at") - F.lag("at").over(order) >= seconds * 1_000_000, F.lit(True))
    cut = requests.select("event_id", key, "ts", *columns).withColumn("at", at).withColumn("gap", gap.cast("int"))
    runs = cut.withColumn("run", F.sum("gap").over(order))
    return runs.groupBy(key, "run").agg(F.sort_array(F.collect_list(F.struct("at", "event_id"))).alias("rows"))


def cache_hits(requests: DataFrame, ttl_seconds: int = 1800) -> DataFrame:
    """(key, ts): a request hits if the key was written within the time to live; a miss writes.

    Whether a request writes depends on the one before it.  A request that comes a time to live after the one before
    is sure to write, so histories are cut there; each run is folded in the JVM, and only its
    writes, of which there is one for each time to live at most, are gathered.
    """
    none = F.struct(F.lit(None).cast("bigint").alias("last"), F.array().cast("array<bigint>").alias("writes"))
    fold = F.aggregate("rows", none, lambda a, x: F.when(a["last"].isNull() | (x["at"] - a["last"] >= ttl_seconds * 1_000_000), F.struct(x["at"].alias("last"), F.concat(a["writes"], F.array(x["event_id"])).alias("writes"))).otherwise(a))
    runs = _runs(requests, "key", ttl_seconds).select("key", "rows", fold["writes"].alias("writes"))
    return runs.select("key", "writes", F.explode("rows").alias("r")).select("r.event_id", "key", (~F.array_contains("writes", F.col("r.event_id"))).alias("hit"))


def token_budget(requests: DataFrame, seconds: int = 60) -> DataFrame:
    """(client, ts, tokens): tokens of the client's last minute up to each request."""
    order = Window.partitionBy("client").orderBy(F.col("ts").cast("timestamp").cast("long")).rangeBetween(-seconds, 0)
    return requests.withColumn("used", F.sum("tokens").over(order))


def rate_limit(requests: DataFrame, per_minute: int = 30) -> DataFrame:
    """Token buckets by client: a request passes if a token is left; the clock moves only when tokens come in.

    A minute without a request fills the bucket, so histories are cut there and each run is folded in the
    JVM, which gathers the requests that are refused.
    """
    bigint = lambda n: F.lit(n).cast("bigint")
    start = F.struct(bigint(per_minute).alias("tokens"), F.lit(None).cast("bigint").alias("last"), F.array().cast("array<bigint>").alias("refused"))

    def step(a, x):
        last = F.coalesce(a["last"], x["at"])
        refill = F.floor((x["at"] - last) * per_minute / 60_000_000)
        tokens = F.when(refill > 0, F.least(bigint(per_minute), a["tokens"] + refill)).otherwise(a["tokens"])
        passes = tokens > 0
        return F.struct(
            F.when(passes, tokens - 1).otherwise(tokens).alias("tokens"), F.when(refill > 0, x["at"]).otherwise(last).alias("last"),
            F.when(passes, a["refused"]).otherwise(F.concat(a["refused"], F.array(x["event_id"]))).alias("refused"),
        )

    runs = _runs(requests, "client", 60).select("client", "rows", F.aggregate("rows", start, step)["refused"].alias("refused"))
    return runs.select("client", "refused", F.explode("rows").alias("r")).select("r.event_id", "client", (~F.array_contains("refused", F.col("r.event_id"))).alias("allowed"))
