"""Queries of evaluation, sessions, service metrics and streams."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import metrics, sessions
from ..sources import tables as S
from ..sources.shared import remove, shared_dir
from ..streaming import keyed, stream
from . import inputs
from .registry import query

LONG = "::BIGINT"
RESULTS = inputs.results([
    (0, "lookup", ["43/2019", "71/2020"], ["43/2019", "08/2023"], ["Học phí", "miễn"], "Học sinh được miễn học phí.", 4.0, 1.0, 0.9, "Khong", 0.9),
    (1, "lookup", ["34/2018"], ["34/2018/QH14"], [], "Theo 34/2018", 3.0, 0.5, 0.8, "Bia_Luat", 0.95), (2, "multi", [], ["x"], ["a"], None, 2.0, 0.0, 0.2, "Bia_Luat", 0.5),
    (3, "multi", ["a", "b", "c"], [], ["xyz"], "không có", 1.0, 0.25, 0.0, "Suy_Dien", 0.8), (4, "temporal", ["a", "b"], ["b", "a"], ["b"], "ab", 4.0, 1.0, 1.0, "Vien_Dan_Bo_Sung", 1.0), (5, "temporal", ["q"], ["z"], ["q"], "q 99/2099", 4.0, 1.0, 1.0, "Bia_Luat", 0.9),
])
_REC = "CASE WHEN len(expected) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(expected, found))::DOUBLE / len(expected) END"
_REL = "CASE WHEN len(expected) = 0 THEN 1.0::DOUBLE ELSE len(list_filter(expected, lambda e: len(list_filter(found, lambda f: contains(e, f) OR contains(f, e))) > 0))::DOUBLE / len(expected) END"
_GRADE = """CASE WHEN contains(label, 'Bia_Luat') THEN CASE WHEN contains(lower(coalesce(answer, '')), '99/2099') OR confidence < 0.7 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END WHEN contains(label, 'Suy_Dien') THEN 1.0::DOUBLE WHEN contains(label, 'Vien_Dan_Bo_Sung') THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END"""


def recall():
    return metrics.recall(F.col("expected"), F.col("found"))


@query("stage_recall", f"SELECT qid, round({_REC}, 6) AS recall, CASE WHEN {_REC} >= 1 THEN 'perfect' WHEN {_REC} > 0 THEN 'partial' ELSE 'zero' END AS status FROM {RESULTS.sql}")
def stage_recall(spark, sf):
    return RESULTS.df(spark, sf).select("qid", F.round(recall(), 6).alias("recall"), metrics.status(recall()).alias("status"))


@query("document_hit", f"SELECT qid, {_REL} >= 1 AS hit FROM {RESULTS.sql}")
def document_hit(spark, sf):
    return RESULTS.df(spark, sf).select("qid", metrics.doc_hit(F.col("expected"), F.col("found")).alias("hit"))


PAIRS = inputs.cited_pairs([
    (0, "e", "43/2019/QH14", 5), (0, "e", "34/2018/QH14", 9), (0, "f", "43/2019", 5), (0, "f", "34/2018/QH14", 1), (1, "e", "71/2020/NĐ-CP", 3), (1, "f", "71/2020/NĐ-CP", 6), (2, "f", "x", 1), (3, "e", "a", 1), (3, "e", "a", 2), (3, "f", "a", 2),
])


@query("relaxed_recall", f"""WITH p AS (SELECT * FROM {PAIRS.sql}), e AS (SELECT * FROM p WHERE side = 'e'), f AS (SELECT * FROM p WHERE side = 'f'), q AS (SELECT DISTINCT qid FROM p),
m AS (SELECT e.qid, e.doc, e.article, count(f.qid) FILTER (WHERE (contains(e.doc, f.doc) OR contains(f.doc, e.doc)) AND (e.article = f.article OR ((contains(f.doc, '34/2018') OR contains(f.doc, '08/2023')) AND f.article IN (1, 2)))) AS s,
  count(f.qid) FILTER (WHERE (contains(e.doc, f.doc) OR contains(f.doc, e.doc)) AND (e.article = f.article OR ((contains(f.doc, '34/2018') OR contains(f.doc, '08/2023') OR contains(f.doc, '71/2020') OR contains(f.doc, '116/2020')) AND f.article IN (1, 2, 6)))) AS w
  FROM e LEFT JOIN f USING (qid) GROUP BY ALL)
SELECT qid, coalesce(round(avg((s > 0)::INT), 6), 1.0)::DOUBLE AS strict, coalesce(round(avg((w > 0)::INT), 6), 1.0)::DOUBLE AS wide FROM q LEFT JOIN m USING (qid) GROUP BY qid""")
def relaxed_recall(spark, sf):
    side = lambda s: F.filter(F.collect_list(F.when(F.col("side") == s, F.struct("doc", "article"))), lambda x: x.isNotNull())
    rows = PAIRS.df(spark, sf).groupBy("qid").agg(side("e").alias("e"), side("f").alias("f"))
    return rows.select("qid", *[F.round(metrics.relaxed(F.col("e"), F.col("f"), r), 6).alias(r) for r in ("strict", "wide")])


REQUIRED = inputs.required([(0, 0, [5, 6]), (0, 1, [9]), (1, 0, [3]), (1, 1, [4, 12]), (3, 0, [7])])
ITEMS = inputs.found_items([(0, "43/2019 Điều 6. Nhiệm vụ"), (0, "Khoản 9"), (1, "Điều  12"), (1, "Điều 3, Điều 4"), (2, "Điều 1"), (3, None)])


@query("requirement_recall", f"""WITH r AS (SELECT * FROM {REQUIRED.sql}), i AS (SELECT qid, try_cast(regexp_extract(item, 'Điều\\s+(\\d+)', 1) AS INTEGER) AS article FROM {ITEMS.sql}),
m AS (SELECT qid, ord, EXISTS (SELECT 1 FROM i WHERE i.qid = r.qid AND list_contains(r.articles, i.article)) AS met FROM r)
SELECT q.qid, coalesce(round(avg(met::INT), 6), 1.0)::DOUBLE AS recall FROM (SELECT DISTINCT qid FROM i) q LEFT JOIN m USING (qid) GROUP BY q.qid""")
def requirement_recall(spark, sf):
    found = ITEMS.df(spark, sf).groupBy("qid").agg(F.collect_list("item").alias("found"))
    needed = REQUIRED.df(spark, sf).groupBy("qid").agg(F.collect_list("articles").alias("required"))
    required = F.coalesce("required", F.array().cast("array<array<int>>"))
    return found.join(needed, "qid", "left").select("qid", F.round(metrics.requirement_recall(required, F.col("found")), 6).alias("recall"))


@query("precision_recall", f"""SELECT qid, round({_REC}, 6) AS recall, CASE WHEN len(found) = 0 THEN 0.0::DOUBLE ELSE round(len(list_intersect(expected, found))::DOUBLE / len(found), 6) END AS precision,
list_sort(list_filter(expected, lambda x: NOT list_contains(found, x))) AS missing, list_sort(list_filter(found, lambda x: NOT list_contains(expected, x))) AS extra FROM {RESULTS.sql}""")
def precision_recall(spark, sf):
    e, f = F.col("expected"), F.col("found")
    return RESULTS.df(spark, sf).select("qid", F.round(recall(), 6).alias("recall"), F.round(metrics.precision(e, f), 6).alias("precision"), F.array_sort(F.array_except(e, f)).alias("missing"), F.array_sort(F.array_except(f, e)).alias("extra"))


@query("keyword_coverage", f"SELECT qid, round(CASE WHEN len(keywords) = 0 THEN 1.0::DOUBLE ELSE len(list_filter(keywords, lambda k: contains(lower(coalesce(answer, '')), lower(k))))::DOUBLE / len(keywords) END, 6) AS coverage FROM {RESULTS.sql}")
def keyword_coverage(spark, sf):
    return RESULTS.df(spark, sf).select("qid", F.round(metrics.keyword_coverage(F.col("keywords"), F.col("answer")), 6).alias("coverage"))


@query("context_score", f"SELECT qid, round(0.6::DOUBLE * {_REC} + 0.4::DOUBLE * sim, 2) AS score FROM {RESULTS.sql}")
def context_score(spark, sf):
    return RESULTS.df(spark, sf).select("qid", metrics.context_score(recall(), F.col("sim")).alias("score"))


@query("composite_score", f"SELECT qid, round(0.25::DOUBLE * g + 0.25::DOUBLE * car + 0.2::DOUBLE * sim + 0.2::DOUBLE * confidence + 0.1::DOUBLE * g, 6) AS score FROM {RESULTS.sql}")
def composite_score(spark, sf):
    return RESULTS.df(spark, sf).select("qid", F.round(metrics.composite(*map(F.col, ("g", "car", "sim", "confidence", "g"))), 6).alias("score"))


@query("hallucination_grade", f"SELECT qid, {_GRADE} AS grade FROM {RESULTS.sql}")
def hallucination_grade(spark, sf):
    return RESULTS.df(spark, sf).select("qid", grade().alias("grade"))


def grade():
    return metrics.hallucination(F.col("label"), F.col("answer"), F.array(F.lit("99/2099")), F.col("confidence"))


_SCORED = f"""b AS (SELECT *, {_REC} AS rec, {_GRADE} AS grade, 0.3::DOUBLE * {_REC} + 0.3::DOUBLE * sim + 0.25::DOUBLE * (g / 4) + 0.15::DOUBLE * car AS base FROM {RESULTS.sql}),
p AS (SELECT *, CASE WHEN grade >= 2 THEN base * 0.5::DOUBLE WHEN grade = 1 THEN base * 0.95::DOUBLE WHEN grade = 0.5 THEN base * 0.99::DOUBLE ELSE base END AS f FROM b),
scored AS (SELECT *, CASE WHEN rec = 0 AND len(expected) > 0 THEN least(f, 0.5::DOUBLE * base) ELSE f END AS final FROM p)"""


def scored(spark, sf):
    final = metrics.final_score(recall(), F.col("sim"), F.col("g"), F.col("car"), grade(), F.size("expected") > 0)
    return RESULTS.df(spark, sf).withColumns({"rec": recall(), "grade": grade(), "final": final})


@query("final_score", f"WITH {_SCORED} SELECT qid, round(final, 6) AS final FROM scored")
def final_score(spark, sf):
    return scored(spark, sf).select("qid", F.round("final", 6).alias("final"))


@query("eval_rollup", f"""WITH {_SCORED} SELECT kind, count(*){LONG} AS n, count(*) FILTER (WHERE rec >= 1){LONG} AS perfect, count(*) FILTER (WHERE rec > 0 AND rec < 1){LONG} AS partial, count(*) FILTER (WHERE rec = 0){LONG} AS zero, round(avg(rec), 6) AS recall FROM scored GROUP BY ROLLUP (kind)""")
def eval_rollup(spark, sf):
    r = F.col("rec")
    return scored(spark, sf).rollup("kind").agg(F.count("*").alias("n"), F.count_if(r >= 1).alias("perfect"), F.count_if((r > 0) & (r < 1)).alias("partial"), F.count_if(r == 0).alias("zero"), F.round(F.avg(r), 6).alias("recall"))


@query("score_summary", f"WITH {_SCORED} SELECT kind, round(avg(final), 6) AS mean_score, round(avg((final >= 0.95)::INT)::DOUBLE, 6) AS high, round(avg((grade >= 2)::INT)::DOUBLE, 6) AS severe FROM scored GROUP BY ROLLUP (kind)")
def score_summary(spark, sf):
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    return scored(spark, sf).rollup("kind").agg(F.round(F.avg("final"), 6).alias("mean_score"), share(F.col("final") >= 0.95).alias("high"), share(F.col("grade") >= 2).alias("severe"))


TIMES = inputs.stage_times([(0, 8.0, 12.5, 20.0, 30.0), (1, 8.0, 10.0, 62.5, 25.0), (2, 8.0, 9.0, 41.0, 50.0), (3, 8.0, 40.0, 5.0, 1.0)])


@query("latency_breakdown", f"""WITH t AS (SELECT *, greatest(retrieve, choose, pick, write) AS top FROM {TIMES.sql}),
b AS (SELECT *, CASE WHEN retrieve = top THEN 'retrieve' WHEN choose = top THEN 'choose' WHEN pick = top THEN 'pick' ELSE 'write' END AS bottleneck FROM t)
SELECT pick > 40 AS retried, bottleneck, count(*){LONG} AS n, round(avg(retrieve + choose + pick + write), 6) AS mean_total, round(sum(pick) / sum(retrieve + choose + pick + write), 6) AS pick_share FROM b GROUP BY ALL""")
def latency_breakdown(spark, sf):
    names = ["retrieve", "choose", "pick", "write"]
    top, total = F.greatest(*names), F.col("retrieve") + F.col("choose") + F.col("pick") + F.col("write")
    which = F.when(F.col("retrieve") == top, "retrieve").when(F.col("choose") == top, "choose").when(F.col("pick") == top, "pick").otherwise("write")
    return TIMES.df(spark, sf).groupBy((F.col("pick") > 40).alias("retried"), which.alias("bottleneck")).agg(F.count("*").alias("n"), F.round(F.avg(total), 6).alias("mean_total"), F.round(F.sum("pick") / F.sum(total), 6).alias("pick_share"))


# --- Sessions -----------------------------------------------------------------------------------


@query("session_listing", f"""SELECT conv_id, CASE WHEN length(first) > 40 THEN substr(first, 1, 40) || '...' ELSE first END AS title, n FROM (SELECT conv_id, arg_min(coalesce(text, ''), turn) FILTER (WHERE role = 'user') AS first, count(*){LONG} AS n FROM conversations GROUP BY conv_id)""")
def session_listing(spark, sf):
    first = F.min_by(T.text(F.col("text")), F.when(F.col("role") == "user", F.col("turn")))
    return S.load(spark, sf, "conversations").groupBy("conv_id").agg(first.alias("first"), F.count("*").alias("n")).select("conv_id", F.when(F.col("first").isNotNull(), T.cut_title(F.col("first"))).alias("title"), "n")


@query("history_order", f"SELECT user_id, max(ts) AS updated_at, count(*){LONG} AS n FROM events GROUP BY user_id ORDER BY updated_at DESC NULLS LAST, user_id")
def history_order(spark, sf):
    return sessions.by_recency(S.load(spark, sf, "events").select("user_id", "ts"), "user_id", "ts")


@query("session_latest", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def session_latest(spark, sf):
    return sessions.latest(S.load(spark, sf, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn")


@query("history_search", "SELECT conv_id, turn FROM conversations WHERE contains(lower(text), lower('The'))")
def history_search(spark, sf):
    return S.load(spark, sf, "conversations").where(F.contains(F.lower("text"), F.lower(F.lit("The")))).select("conv_id", "turn")


_PAIRS = f"""m AS (SELECT conv_id, turn, role, text, row_number() OVER w - 1 AS pos, lead(text) OVER w AS answer, lead(role) OVER w AS nxt FROM conversations WHERE role <> 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
pairs AS (SELECT conv_id, (pos // 2){LONG} AS pair, text AS question, answer FROM m WHERE pos % 2 = 0 AND role = 'user' AND nxt = 'assistant')"""


@query("turn_pairs", f"WITH {_PAIRS} SELECT conv_id, pair, question, answer FROM pairs")
def turn_pairs(spark, sf):
    return sessions.pairs(S.load(spark, sf, "conversations"))


@query("history_window", f"""WITH {_PAIRS} SELECT conv_id, pair, coalesce(string_agg('User: ' || question || chr(10) || 'Assistant: ' || substr(answer, 1, 200), chr(10)) OVER (PARTITION BY conv_id ORDER BY pair ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS history FROM pairs""")
def history_window(spark, sf):
    return sessions.history(sessions.pairs(S.load(spark, sf, "conversations"))).select("conv_id", "pair", "history")


@query("token_frames", f"""WITH f AS (SELECT item_id AS id, string_split(text, ' ') AS w FROM benchmark), x AS (SELECT id, len(w) AS n, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS word FROM f)
SELECT id, pos{LONG} AS pos, CASE WHEN pos < n - 1 THEN word || ' ' ELSE word END AS token FROM x""")
def token_frames(spark, sf):
    return sessions.frames(S.load(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("answer")))


@query("sse_frames", """SELECT event_id, 'data: {"type":"' || event_type || '","content":"' || user_id || '"}' || chr(10) || chr(10) AS frame FROM events""")
def sse_frames(spark, sf):
    return S.load(spark, sf, "events").select("event_id", sessions.sse(F.col("event_type"), F.col("user_id").cast("string")).alias("frame"))


@query("session_frames", f"""WITH f AS (SELECT item_id AS id, 0 AS stage, 0::BIGINT AS pos, 'meta' AS type FROM benchmark UNION ALL SELECT item_id, 1, s, 'status' FROM benchmark, range(3) r(s) UNION ALL SELECT item_id, 2, 0, 'sources' FROM benchmark
 UNION ALL SELECT item_id, 3, generate_subscripts(string_split(text, ' '), 1) - 1, 'token' FROM benchmark UNION ALL SELECT item_id, 4, 0, 'done' FROM benchmark)
SELECT id, type, (row_number() OVER (PARTITION BY id ORDER BY stage, pos) - 1){LONG} AS seq FROM f""")
def session_frames(spark, sf):
    from pyspark.sql import Window

    items = S.load(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("answer"))
    plain = items.select("id", F.inline(F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(0).cast("bigint").alias("pos"), F.lit(t).alias("type")) for s, t in ((0, "meta"), (2, "sources"), (4, "done"))])))
    # A status frame for each step: understanding, searching, writing.
    status = items.select("id", F.lit(1).alias("stage"), F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(3)])).alias("pos"), F.lit("status").alias("type"))
    rows = plain.unionByName(status).unionByName(sessions.frames(items).select("id", F.lit(3).alias("stage"), "pos", F.lit("token").alias("type")))
    return rows.select("id", "type", (F.row_number().over(Window.partitionBy("id").orderBy("stage", "pos")) - 1).cast("bigint").alias("seq"))


# --- Service ------------------------------------------------------------------------------------


@query("intent_metrics", f"SELECT event_type, count(*){LONG} AS n, round(avg(value), 6) AS mean_value, count(*) FILTER (WHERE event_type = 'error'){LONG} AS errors, count(*) FILTER (WHERE event_type = 'view'){LONG} AS cache_hits FROM events GROUP BY ROLLUP (event_type)")
def intent_metrics(spark, sf):
    """Requests, mean time, errors and cache hits by intent, and in total (a null intent)."""
    return metrics.service(S.load(spark, sf, "events"), "event_type", "value", F.col("event_type") == "error", F.col("event_type") == "view")


def requests(spark, sf):
    return S.load(spark, sf, "events").select("event_id", F.concat("event_type", F.lit(":"), F.col("user_id").cast("string")).alias("key"), F.col("user_id").alias("client"), "ts", F.col("value").alias("tokens"))


_HITS = """RECURSIVE r AS (SELECT event_id, event_type || ':' || user_id AS key, ts, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS n FROM events),
c AS (SELECT event_id, key, n, false AS hit, ts AS written FROM r WHERE n = 1 UNION ALL SELECT r.event_id, r.key, r.n, r.ts - c.written < INTERVAL 1800 SECOND, CASE WHEN r.ts - c.written < INTERVAL 1800 SECOND THEN c.written ELSE r.ts END FROM c JOIN r ON r.key = c.key AND r.n = c.n + 1)"""


@query("cache_hits_ttl", f"WITH {_HITS} SELECT event_id, key, hit FROM c")
def cache_hits_ttl(spark, sf):
    return sessions.cache_hits(requests(spark, sf))


@query("cache_statistics", f"WITH {_HITS} SELECT count(*) FILTER (WHERE hit){LONG} AS hits, count(*) FILTER (WHERE NOT hit){LONG} AS misses, round(avg(hit::INT) * 100)::BIGINT || '%' AS hit_rate FROM c")
def cache_statistics(spark, sf):
    hits = sessions.cache_hits(requests(spark, sf))
    return hits.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.format_string("%d%%", F.round(F.avg(F.col("hit").cast("int")) * 100).cast("bigint")).alias("hit_rate"))


@query("cache_admission", "SELECT conv_id, turn FROM conversations WHERE turn <= 1 OR conv_id = 0")
def cache_admission(spark, sf):
    return S.load(spark, sf, "conversations").where("turn <= 1 or conv_id = 0").select("conv_id", "turn")


@query("token_budget_60s", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 60 PRECEDING AND CURRENT ROW), 4) AS used, used > 100 AS blocked FROM (SELECT *, date_trunc('second', ts) AS s FROM events)".replace("epoch(ts)", "epoch(s)"))
def token_budget_60s(spark, sf):
    """Tokens of a client's last minute, and whether the limit of 100 makes the request wait."""
    return sessions.token_budget(requests(spark, sf)).select("event_id", F.round("used", 4).alias("used")).withColumn("blocked", F.col("used") > 100)


#: Two requests a minute: tokens before and after each request, one after the other.
_LIMIT = """WITH RECURSIVE r AS (SELECT event_id, user_id AS client, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
c AS (SELECT event_id, client, n, 1::BIGINT AS tokens, us AS last, true AS allowed FROM r WHERE n = 1
  UNION ALL SELECT event_id, client, n, held - (held > 0)::INT, last, held > 0 FROM (SELECT r.event_id, r.client, r.n, CASE WHEN (r.us - c.last) * 2 // 60000000 > 0 THEN least(2, c.tokens + (r.us - c.last) * 2 // 60000000) ELSE c.tokens END AS held,
    CASE WHEN (r.us - c.last) * 2 // 60000000 > 0 THEN r.us ELSE c.last END AS last FROM c JOIN r ON r.client = c.client AND r.n = c.n + 1))
SELECT event_id, client, allowed FROM c"""


@query("rate_limiter", _LIMIT)
def rate_limiter(spark, sf):
    return sessions.rate_limit(requests(spark, sf), 2)


@query("resume_unprocessed", "SELECT item_id FROM benchmark ANTI JOIN labels ON labels.doc_id = benchmark.item_id")
def resume_unprocessed(spark, sf):
    done = S.load(spark, sf, "labels").select(F.col("doc_id").alias("item_id"))
    return S.load(spark, sf, "benchmark").join(done, "item_id", "left_anti").select("item_id")


@query("index_sizes", f"SELECT (SELECT count(*) FROM documents){LONG} AS nodes, (SELECT count(*) FROM embeddings){LONG} AS vectors, (SELECT count(DISTINCT conv_id) FROM conversations){LONG} AS sessions")
def index_sizes(spark, sf):
    one = lambda t, c, n: S.load(spark, sf, t).agg(c.alias(n))
    return one("documents", F.count("*"), "nodes").join(one("embeddings", F.count("*"), "vectors"), F.lit(True)).join(one("conversations", F.count_distinct("conv_id"), "sessions"), F.lit(True))


# --- Streams ------------------------------------------------------------------------------------


@query("stream_tumbling", f"SELECT date_trunc('hour', ts) AS start, event_type, count(*){LONG} AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, sf):
    return stream.drain(stream.tumbling(stream.events(spark, sf))).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("stream_sliding", f"SELECT start, count(*){LONG} AS n FROM (SELECT date_trunc('hour', ts) - to_hours(h) AS start FROM events, (VALUES (0), (1)) v(h)) GROUP BY start")
def stream_sliding(spark, sf):
    return stream.drain(stream.sliding(stream.events(spark, sf))).select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("stream_session", f"""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*){LONG} AS n FROM s GROUP BY user_id, k""")
def stream_session(spark, sf):
    done = stream.drain(stream.sessions(stream.events(spark, sf)))
    return done.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("stream_metrics", f"SELECT event_type, count(*){LONG} AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY event_type")
def stream_metrics(spark, sf):
    return stream.drain(stream.metrics(stream.events(spark, sf))).select("event_type", "n", F.round("mean_value", 6).alias("mean_value"))


@query("stream_rate_limit", _LIMIT)
def stream_rate_limit(spark, sf):
    return stream.drain(stream.rate_limit(stream.events(spark, sf), 2), "append")


# --- Keyed state --------------------------------------------------------------------------------


def operations(df):
    """Events as requests to a store: clicks and views read, purchases write, errors delete, the rest ask for existence."""
    op = F.when(F.col("event_type").isin("click", "view"), "get").when(F.col("event_type") == "purchase", "set").when(F.col("event_type") == "error", "delete").otherwise("exists")
    return df.select("event_id", F.col("user_id").cast("string").alias("key"), "ts", op.alias("op"), "value")


_STORE = """o AS (SELECT event_id, user_id::VARCHAR AS key, ts, CASE event_type WHEN 'click' THEN 'get' WHEN 'view' THEN 'get' WHEN 'purchase' THEN 'set' WHEN 'error' THEN 'delete' ELSE 'exists' END AS op, value FROM events),
l AS (SELECT *, last_value(CASE WHEN op IN ('set', 'delete') THEN {'op': op, 'value': value, 'ts': ts} END IGNORE NULLS) OVER (PARTITION BY key ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM o),
f AS (SELECT *, coalesce(last.op = 'set' AND ts - last.ts < INTERVAL 1800 SECOND, false) AS found FROM l)"""


@query("store_replay", f"WITH {_STORE} SELECT event_id, key, op, found, CASE WHEN found AND op = 'get' THEN last.value END AS value FROM f")
def store_replay(spark, sf):
    return keyed.replay(operations(S.load(spark, sf, "events")))


@query("stream_store", f"WITH {_STORE} SELECT event_id, key, op, found, CASE WHEN found AND op = 'get' THEN last.value END AS value FROM f")
def stream_store(spark, sf):
    """The store as a stream with timers, into a file sink."""
    return stream.drain(keyed.store(operations(stream.events(spark, sf))), "append")


@query("stream_turns", f"""WITH {_PAIRS}, h AS (SELECT conv_id, pair, question, coalesce(string_agg('User: ' || question || chr(10) || 'Assistant: ' || substr(answer, 1, 200), chr(10)) OVER (PARTITION BY conv_id ORDER BY pair ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS history FROM pairs),
late AS (SELECT conv_id, (pos // 2)::BIGINT AS pair FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations WHERE role <> 'system') WHERE pos % 2 = 1 AND turn >= 3)
SELECT conv_id, pair, question, history FROM h SEMI JOIN late USING (conv_id, pair)""")
def stream_turns(spark, sf):
    """History for every answer of turn 3 or later, as it arrives; what was said before is the initial state."""
    before = S.load(spark, sf, "conversations").where("turn < 3")
    return stream.drain(keyed.turns(stream.messages(spark, sf).where("turn >= 3"), before), "append")


def session_table(spark, sf):
    """All conversations streamed into a session table, one version for each micro-batch's messages; those of users with errors are deleted, then some return."""
    path = f"{shared_dir(spark)}/sessions-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    table = keyed.SessionTable(spark, f"{path}/table")
    said = F.array(F.struct("turn", "role", "text")).alias("messages")
    rows = stream.messages(spark, sf).select(F.col("conv_id").alias("session_id"), F.col("turn").alias("version"), F.lit(False).alias("deleted"), said)
    table.sink(rows, f"{path}/checkpoint").awaitTermination()
    gone = S.load(spark, sf, "events").where("event_type = 'error' and value > 40").select(F.col("user_id").alias("session_id")).distinct()
    table.delete(gone.where("session_id % 3 <> 0"), 1_000_000, 1_000_000)
    # A session may be deleted between its messages: what comes later starts it anew.
    table.delete(gone.where("session_id % 3 = 0"), 1, 1_000_001)
    return table


_SESSIONS = """gone AS (SELECT DISTINCT user_id AS conv_id, CASE WHEN user_id % 3 <> 0 THEN 1000000 ELSE 1 END AS since FROM events WHERE event_type = 'error' AND value > 40),
alive AS (SELECT c.* FROM conversations c LEFT JOIN gone USING (conv_id) WHERE since IS NULL OR turn > since)"""


@query("session_store", f"""WITH {_SESSIONS}, s AS (SELECT conv_id AS session_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS first, count(*) FILTER (WHERE role = 'user') AS asked, count(*){LONG} AS n, max(turn) AS version FROM alive GROUP BY conv_id)
SELECT session_id, CASE WHEN length(first) > 40 THEN substr(first, 1, 40) || '...' ELSE first END AS title, n, version FROM s""")
def session_store(spark, sf):
    return session_table(spark, sf).listing()


@query("session_fetch", f"WITH {_SESSIONS} SELECT conv_id AS session_id, turn, role, text FROM alive WHERE conv_id IN (SELECT item_id FROM benchmark)")
def session_fetch(spark, sf):
    return session_table(spark, sf).fetch(S.load(spark, sf, "benchmark").select(F.col("item_id").alias("session_id")))
