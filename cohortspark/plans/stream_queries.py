"""Streams over the driver's events, drained once."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.plans.corpus_queries import release
from cohortspark.plans.register import query
from cohortspark.sources.store import read_corpus
from cohortspark.streaming import jobs


def events(t):
    """The events as a stream with a UTC timestamp and milliseconds."""
    rows = t.spark.readStream.schema(t.events.schema).parquet(f"{t.sf_dir}/events.parque[t]")
    millis = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts AS timestamp_ntz)) div 1000")
    return rows.withColumn("at_ms", millis).withColumn("ts", F.timestamp_millis("at_ms"))


@query("SELECT 'u-' || cast(user_id AS string) AS user_id, cast(floor(at_ms / 86400000.0) AS bigint) AS day, count(*) AS requests FROM (SELECT user_id, at_ms FROM (SELECT user_id, MILLIS AS at_ms FROM {events})) GROUP BY ALL")
def stream_daily_usage(t):
    rows = events(t).withColumn("user_id", F.concat(F.lit("u-"), F.col("user_id").cast("string")))
    return jobs.run_available(jobs.daily_usage(rows), t.folder("stream"), "update", ("user_id", "day"))


#: A request id counts for 20 days from its first content on; each next first one is sought from the last.
_VERDICTS = """WITH RECURSIVE e AS (SELECT cast(user_id % 30 AS bigint) AS user_id, event_type AS request_id, at_ms, sha256(cast(event_id % 3 AS string)) AS digest FROM (SELECT *, MILLIS AS at_ms FROM {events})),
f AS (SELECT user_id, request_id, min(at_ms) AS at_ms FROM e GROUP BY ALL UNION ALL SELECT f.user_id, f.request_id, min(e.at_ms) FROM f JOIN e ON e.user_id = f.user_id AND e.request_id = f.request_id AND e.at_ms >= f.at_ms + 1728000000 GROUP BY f.user_id, f.request_id, f.at_ms),
h AS (SELECT f.user_id, f.request_id, f.at_ms, min(digest) AS first FROM f JOIN e USING (user_id, request_id, at_ms) GROUP BY ALL),
r AS (SELECT e.*, h.at_ms AS since, h.first, row_number() OVER (PARTITION BY e.user_id, e.request_id, h.at_ms ORDER BY e.at_ms, digest) AS k FROM e ASOF JOIN h ON h.user_id = e.user_id AND h.request_id = e.request_id AND e.at_ms >= h.at_ms)
SELECT user_id, request_id, at_ms, digest, CASE WHEN k = 1 THEN 'new' WHEN digest = first THEN 'repeat' ELSE 'conflict' END AS verdict FROM r"""


@query(_VERDICTS)
def stream_idempotent_requests(t):
    """Event types as request ids of thirty users, with one of three contents."""
    rows = events(t).select((F.col("user_id") % 30).cast("long").alias("user_id"), F.col("event_type").alias("request_id"), "ts", (F.col("event_id") % 3).cast("string").alias("content"))
    got = jobs.run_available(jobs.request_verdicts(rows, ["user_id", "request_id"], 20 * 86_400_000), t.folder("stream"))
    return got.select("user_id", "request_id", F.unix_millis("ts").alias("at_ms"), "digest", "verdict")


@query()
def stream_generations(t):
    op = F.expr("CASE event_type WHEN 'signup' THEN 'begin' WHEN 'view' THEN 'renew' WHEN 'click' THEN 'write' WHEN 'purchase' THEN 'finish' ELSE 'cancel' END")
    rows = events(t).select(F.concat(F.lit("c-"), (F.col("user_id") % 50).cast("string")).alias("chat_id"), "ts", "at_ms", F.col("event_id").cast("long").alias("event_id"), op.alias("op"), F.expr("concat('g-', event_id % 3)").alias("generation_id"), F.col("event_type").alias("content"))
    return jobs.run_available(jobs.generations(rows, 6 * 3600 * 1000), t.folder("stream"))


@query()
def stream_stale_uploads(t):
    rows = events(t).where("event_type IN ('signup', 'purchase')").select(F.col("user_id").cast("string").alias("file_id"), "ts", "at_ms", F.when(F.col("event_type") == "signup", "start").otherwise("finish").alias("op"))
    return jobs.run_available(jobs.stale_uploads(rows, 24 * 3600 * 1000), t.folder("stream"))


@query("SELECT 'm-' || cast(conv_id AS string) || '-' || cast(turn AS string) AS message_id, text AS content, CASE WHEN trim(text) = '' THEN 'failed' ELSE 'complete' END AS status FROM {conversations} WHERE role = 'assistant'")
def stream_answers(t):
    rows = t.spark.readStream.schema(t.conversations.schema).parquet(f"{t.sf_dir}/conversations.parque[t]").where("role = 'assistant'")
    frames = rows.select(F.concat_ws("-", F.lit("m"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("message_id"), F.posexplode(F.split("text", "(?<= )")).alias("seq", "text"), F.lit(False).alias("bad"), F.size(F.split("text", "(?<= )")).alias("n"))
    frames = frames.select("message_id", F.timestamp_millis(F.lit(1704067200000)).alias("ts"), "seq", "text", F.when(F.col("seq") == F.col("n") - 1, "stop").alias("finish"), "bad")
    return jobs.run_available(jobs.answers(frames), t.folder("stream"))


RELEASES = """WITH p AS (SELECT *, CASE WHEN orderkey % 4 = 1 THEN 2 ELSE 1 END AS seq FROM {profiles} WHERE orderkey % 8 <> 5 OR orderkey % 4 = 1),
h AS (SELECT account_id, arg_max(id, seq * 10000000000 + orderkey) AS handle FROM p GROUP BY account_id), o AS (SELECT profile_id, count(*) AS outcomes FROM {outcomes} GROUP BY profile_id)
SELECT p.id, p.account_id, p.cycle, CASE WHEN seq = 2 THEN 3.25 ELSE gpa END AS gpa, CASE WHEN row_number() OVER (PARTITION BY p.account_id, cycle ORDER BY seq DESC, orderkey DESC) = 1 THEN 1 ELSE 0 END AS is_current, handle, coalesce(outcomes, 0) AS outcomes,
 (SELECT string_agg(release || ':' || n || ':' || a, ',' ORDER BY release) FROM (SELECT CASE WHEN k = 1 THEN 'r-2' ELSE 'r-1' END AS release, count(*) AS n, count(DISTINCT account_id) AS a FROM (SELECT account_id, CASE WHEN orderkey % 4 = 1 THEN 1 ELSE 0 END AS k FROM {profiles} UNION ALL SELECT account_id, 0 FROM {profiles} WHERE orderkey % 8 = 1) GROUP BY k)) AS ledger
FROM p JOIN h ON h.account_id = p.account_id LEFT JOIN o ON o.profile_id = p.id"""


@query(RELEASES)
def stream_publish(t):
    """Two releases of nested profiles arrive as packed files in parts that mix them; the second one holds a quarter of all, half of them new, and comes twice."""
    rows = t.written(release(t).withColumn("public_handle", F.col("id")), "release")
    first = rows.where("orderkey % 4 <> 1 OR orderkey % 8 <> 5").withColumn("release", F.lit("r-1"))
    second = rows.where("orderkey % 4 = 1").withColumn("gpa", F.lit(3.25)).withColumn("release", F.lit("r-2"))
    first, second = (df.crossJoin(df.agg(F.countDistinct("ordinal").alias("release_size"))) for df in (first, second))
    files, store, seen = t.folder("files"), t.folder("store"), t.folder("checkpoint")
    half = lambda df, k: df.where(F.floor(F.col("orderkey") / 8) % 2 == k)
    for k, part in enumerate((half(first, 0), half(first, 1).unionByName(half(second, 1)), half(second, 0), second)):
        part.write.json(f"{files}/{k}", compression="gzip")
        if k == 3:
            t.removed(rows)
        jobs.publish_files(t.spark, f"{files}/*", first.schema, store, seen, "2026-01-01", buckets=16).awaitTermination()
    corpus = read_corpus(t.spark, store)
    handles = corpus["accounts"].select(F.col("id").alias("account_id"), F.col("public_handle").alias("handle"))
    counts = corpus["outcomes"].groupBy(F.col("profile_id").alias("id")).agg(F.count("*").alias("outcomes"))
    found = corpus["profiles"].join(handles, "account_id").join(counts, "id", "left")
    ledger = corpus["imports"].agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "release", F.col("profile_count").cast("string"), F.col("account_count").cast("string")))), ",").alias("ledger"))
    return found.crossJoin(ledger).select("id", "account_id", "cycle", "gpa", "is_current", "handle", F.coalesce("outcomes", F.lit(0).cast("long")).alias("outcomes"), "ledger")
