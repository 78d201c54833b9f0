"""Conversations, evidence and quotas over the derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.operators import citations, conversations, quotas
from cohortspark.plans.register import query

SIX_HOURS = 6 * 3600 * 1000
CITED = r"""cited AS (SELECT id AS message_id, list_distinct(flatten(list_transform(regexp_extract_all(content, '\[([^\]\n]{1,100})\]', 1), lambda g: regexp_extract_all(g, '\b([PWAC][0-9]+)\b', 1)))) AS ids FROM {messages})"""


@query(r"WITH " + CITED + " SELECT message_id, list_sort(ids) AS ids FROM cited")
def cited_ids(t):
    return t.messages.select(F.col("id").alias("message_id"), F.array_sort(citations.cited_ids(F.col("content"))).alias("ids"))


@query("WITH " + CITED + " SELECT s.message_id, s.id, s.kind FROM {sources} s JOIN cited c ON c.message_id = s.message_id AND list_contains(c.ids, s.id)")
def cited_sources(t):
    return citations.cited_sources(t.messages, t.sources).select("message_id", "id", "kind")


@query("WITH " + CITED + " SELECT s.message_id, count(DISTINCT s.applicant_id) AS supporting FROM {sources} s JOIN cited c ON c.message_id = s.message_id AND list_contains(c.ids, s.id) WHERE s.kind = 'profile' GROUP BY s.message_id")
def supporting_accounts(t):
    return citations.supporting_accounts(t.messages, t.sources)


_SETS = "WITH " + CITED + ", own AS (SELECT message_id, list(id) AS known FROM {sources} GROUP BY message_id), b AS (SELECT c.message_id, ids, coalesce(known, []) AS known FROM cited c LEFT JOIN own USING (message_id))"


@query(_SETS + " SELECT message_id, list_sort(list_filter(ids, lambda x: NOT list_contains(known, x))) AS dangling FROM b")
def dangling_citations(t):
    return citations.citation_sets(t.messages, t.sources).select("message_id", F.array_sort("dangling").alias("dangling"))


@query(_SETS + " SELECT message_id, list_sort(list_filter(known, lambda x: NOT list_contains(ids, x))) AS uncited FROM b")
def uncited_sources(t):
    return citations.citation_sets(t.messages, t.sources).select("message_id", F.array_sort("uncited").alias("uncited"))


@query(_SETS + " SELECT message_id, list_sort(list_filter(ids, lambda x: list_contains(known, x))) AS supported FROM b")
def current_support(t):
    return citations.citation_sets(t.messages, t.sources).select("message_id", F.array_sort("supported").alias("supported"))


_ANSWERS = "SELECT id AS message_id, cast((conv_id + turn) % 4 AS bigint) AS supporting, cast(turn + conv_id % 3 AS bigint) AS matched, cast(turn AS bigint) AS examined FROM {messages} WHERE role = 'assistant'"


@query("WITH " + CITED + f""", a AS ({_ANSWERS}), r AS (SELECT s.message_id, count(DISTINCT s.applicant_id) AS n FROM {{sources}} s JOIN cited c ON c.message_id = s.message_id AND list_contains(c.ids, s.id) WHERE s.kind = 'profile' GROUP BY s.message_id)
SELECT message_id, 'no_support' AS violation FROM a WHERE supporting <= 0 UNION ALL SELECT a.message_id, 'count_differs' FROM a LEFT JOIN r USING (message_id) WHERE supporting <> coalesce(n, 0) UNION ALL SELECT message_id, 'counts_out_of_order' FROM a WHERE NOT (matched >= examined AND examined > 0)""")
def support_audit(t):
    answers = t.messages.where("role = 'assistant'").selectExpr("id AS message_id", "(conv_id + turn) % 4 AS supporting", "turn + conv_id % 3 AS matched", "turn AS examined")
    return citations.support_audit(answers, citations.supporting_accounts(t.messages, t.sources), t.sources)


@query("""WITH h AS (SELECT chat_id, 'A' AS prefix, max(doc_id % 13) AS top FROM {attachments} WHERE status <> 'ready' GROUP BY chat_id), n AS (SELECT chat_id, doc_id, id AS key FROM {attachments} WHERE status = 'ready')
SELECT n.chat_id, key, 'A' || cast(coalesce(top, 0) + row_number() OVER (PARTITION BY n.chat_id ORDER BY doc_id, key) AS string) AS id FROM n LEFT JOIN h ON h.chat_id = n.chat_id""")
def citation_ledger(t):
    history = t.attachments.where("status <> 'ready'").selectExpr("chat_id", "concat('A', doc_id % 13) AS id", "id AS key")
    new = t.attachments.where("status = 'ready'").selectExpr("chat_id", "doc_id AS seq", "'A' AS prefix", "id AS key")
    return citations.citation_ledger(history, new).select("chat_id", "key", "id")


@query("SELECT u.id, u.chat_id, a.id AS reply_id, a.status AS reply_status FROM {messages} u JOIN {messages} a ON a.reply_to_id = u.id WHERE u.role = 'user' AND a.role = 'assistant'")
def reply_pairs(t):
    return conversations.reply_pairs(t.messages)


@query("SELECT id FROM {messages} u WHERE role = 'user' AND NOT EXISTS (SELECT 1 FROM {messages} a WHERE a.role = 'assistant' AND a.reply_to_id = u.id)")
def incomplete_turns(t):
    return conversations.incomplete_turns(t.messages).select("id")


_CHATS = "SELECT chat_id AS id, user_id, max(created_at) AS updated_at, min(created_at) AS deleting_at FROM {messages} GROUP BY chat_id, user_id"


def chats(t):
    return t.messages.groupBy(F.col("chat_id").alias("id"), "user_id").agg(F.max("created_at").alias("updated_at"), F.min("created_at").alias("deleting_at"))


@query(f"WITH c AS ({_CHATS}) SELECT id, user_id, cast(rn AS integer) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, id) AS rn FROM c) WHERE rn <= 2")
def recent_chats(t):
    return conversations.newest(chats(t), "user_id", "updated_at", 2).select("id", "user_id", "place")


@query("SELECT id, user_id, cast(rn AS integer) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS rn FROM {attachments}) WHERE rn <= 40")
def recent_files(t):
    return conversations.newest(t.attachments, "user_id", "created_at", 40).select("id", "user_id", "place")


@query(f"WITH c AS ({_CHATS}) SELECT id, user_id, cast(rn AS integer) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY deleting_at, id) AS rn FROM c) WHERE rn <= 2")
def pending_deletions(t):
    return conversations.pending_deletions(chats(t), 2).select("id", "user_id", "place")


@query("SELECT id, chat_id, cast(row_number() OVER (PARTITION BY chat_id ORDER BY created_at, id) AS integer) AS place FROM {messages}")
def ordered_messages(t):
    return conversations.ranked(t.messages, ["chat_id"], F.asc("created_at"), F.asc("id")).select("id", "chat_id", "place")


@query("SELECT chat_id, left(arg_min(content, created_at), 100) AS title FROM {messages} WHERE role = 'user' GROUP BY chat_id")
def chat_title(t):
    return conversations.chat_titles(t.messages)


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY created_at DESC, id DESC) AS place FROM {messages} WHERE role = 'user' OR status = 'complete'),
s AS (SELECT *, coalesce(sum(least(length(content), 400)) OVER (PARTITION BY chat_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM r WHERE place <= 20)
SELECT id, cast(place AS integer) AS place, left(content, cast(least(400, 1000 - spent) AS integer)) AS content FROM s WHERE spent < 1000""")
def context_messages(t):
    return conversations.context_messages(t.messages, each=400, total=1000).select("id", "place", "content")


@query("""WITH r AS (SELECT *, coalesce(extracted_text, '') AS text, row_number() OVER (PARTITION BY chat_id ORDER BY created_at DESC, id DESC) AS place FROM {attachments} WHERE status = 'ready'),
s AS (SELECT *, coalesce(sum(least(length(text), 3000)) OVER (PARTITION BY chat_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM r WHERE place <= 4),
u AS (SELECT *, cast(greatest(0, least(length(text), 3000, 6000 - spent)) AS integer) AS used FROM s)
SELECT chat_id, id, cast(place AS integer) AS place, used, used < length(text) AS truncated, left(text, least(used, 100)) AS excerpt FROM u""")
def context_documents(t):
    return conversations.context_documents(t.attachments, 4, 3000, 6000, 100)


@query(f"""WITH b AS (SELECT *, CASE WHEN at_ms - lag(at_ms) OVER (PARTITION BY chat_id ORDER BY at_ms, event_id) >= {SIX_HOURS} OR lag(at_ms) OVER (PARTITION BY chat_id ORDER BY at_ms, event_id) IS NULL THEN 1 ELSE 0 END AS br FROM {{attempts}}),
c AS (SELECT *, cast(sum(br) OVER (PARTITION BY chat_id ORDER BY at_ms, event_id ROWS UNBOUNDED PRECEDING) AS bigint) AS chain FROM b)
SELECT chat_id, chain, min(at_ms) AS first_ms, max(at_ms) AS last_ms, count(*) AS renewals FROM c GROUP BY chat_id, chain""")
def lease_chains(t):
    return conversations.lease_chains(t.attempts, SIX_HOURS)


@query(f"""WITH g AS (SELECT chat_id, at_ms, user_id AS gen, event_id FROM {{attempts}} WHERE op = 'begin'), w AS (SELECT chat_id, at_ms, user_id AS gen, event_id FROM {{attempts}} WHERE op = 'write'),
u AS (SELECT *, 0 AS kind FROM g UNION ALL SELECT *, 1 FROM w),
l AS (SELECT *, last_value(CASE WHEN kind = 0 THEN gen END IGNORE NULLS) OVER x AS now_gen, last_value(CASE WHEN kind = 0 THEN at_ms END IGNORE NULLS) OVER x AS now_at FROM u WINDOW x AS (PARTITION BY chat_id ORDER BY at_ms, kind, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT chat_id, event_id, gen AS generation_id, at_ms FROM l WHERE kind = 1 AND gen = now_gen AND now_at + {40 * SIX_HOURS} > at_ms""")
def fence_writes(t):
    begins = t.attempts.where("op = 'begin'").selectExpr("chat_id", "user_id AS generation_id", "at_ms", f"at_ms + {40 * SIX_HOURS} AS lease_expires_at", "event_id")
    writes = t.attempts.where("op = 'write'").selectExpr("chat_id", "user_id AS generation_id", "at_ms", "event_type AS content", "event_id")
    return conversations.fence_writes(writes, begins).select("chat_id", "event_id", "generation_id", "at_ms")


@query("SELECT id, CASE WHEN status = 'cancelled' AND created_at <= 1704067200000 + 40 * 3600000 THEN 'failed' WHEN status = 'cancelled' THEN 'running' ELSE status END AS status FROM {messages} WHERE role = 'assistant'")
def expire_generations(t):
    m = t.messages.where("role = 'assistant'").withColumn("status", F.when(F.col("status") == "cancelled", "running").otherwise(F.col("status")))
    c = m.selectExpr("concat('x', id) AS id", "id AS generation_id", "created_at AS lease_expires_at")
    return conversations.expire_generations(c, m, 1704067200000 + 40 * 3600000)[1].select("id", "status")


@query("SELECT id, chat_id, status FROM (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY created_at DESC, id) AS rn FROM {messages}) WHERE rn = 1 AND status IN ('failed', 'cancelled')")
def retry_eligible(t):
    return conversations.retry_eligible(t.messages).select("id", "chat_id", "status")


_CALLS = "SELECT cast(l_orderkey AS bigint) AS answer_id, l_linenumber % 5 AS round, ord AS seq, CASE l_partkey % 5 WHEN 0 THEN 'cohort_search' WHEN 1 THEN 'profile_inspect' WHEN 2 THEN 'calculate' WHEN 3 THEN 'weekly_time_budget' ELSE 'other' END AS tool, l_suppkey % 10 = 0 AS large FROM {li}"


@query(f"""WITH c AS ({_CALLS}), a AS (SELECT *, row_number() OVER (PARTITION BY answer_id, round ORDER BY seq) AS k FROM c), b AS (SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY round, seq) AS n FROM a WHERE k <= 6 AND round < 4),
d AS (SELECT *, sum(CASE WHEN large THEN 0 ELSE 1 END) OVER (PARTITION BY answer_id, tool ORDER BY round, seq ROWS UNBOUNDED PRECEDING) AS used FROM b WHERE n <= 7)
SELECT answer_id, seq, tool, CASE WHEN large THEN 'too_large' WHEN tool = 'other' THEN 'unknown_tool' WHEN used > CASE tool WHEN 'cohort_search' THEN 2 ELSE 3 END THEN 'tool_limit' ELSE 'admitted' END AS verdict FROM d""")
def tool_call_budget(t):
    calls = t.spark.sql(_CALLS, li=t.li).withColumn("args", F.when(F.col("large"), F.repeat(F.lit("x"), 5001)).otherwise("{}"))
    return conversations.tool_call_budget(calls).select("answer_id", "seq", "tool", "verdict")


@query("""SELECT id AS message_id, text AS content, CASE WHEN (conv_id + turn) % 11 = 0 OR (conv_id + turn) % 7 = 0 OR trim(text) = '' THEN 'failed' ELSE 'complete' END AS status
FROM (SELECT 'm-' || cast(conv_id AS string) || '-' || cast(turn AS string) AS id, conv_id, turn, text FROM {conversations} WHERE role = 'assistant')""")
def assemble_answers(t):
    m = t.conversations.where("role = 'assistant'").selectExpr("concat('m-', conv_id, '-', turn) AS message_id", "conv_id", "turn", "text")
    pieces = m.select("message_id", "conv_id", "turn", F.posexplode(F.split("text", "(?<= )")).alias("seq", "text"))
    last = m.selectExpr("message_id", "conv_id", "turn", "1000000 AS seq", "'' AS text").withColumn("finish", F.when((F.col("conv_id") + F.col("turn")) % 11 == 0, "length").when((F.col("conv_id") + F.col("turn")) % 7 != 0, "stop"))
    return conversations.assemble_answers(pieces.withColumn("finish", F.lit(None).cast("string")).unionByName(last).withColumn("bad", F.lit(False)))


@query("SELECT user_id, cast(floor(at_ms / 86400000.0) AS bigint) AS day, count(*) AS requests FROM {attempts} GROUP BY ALL")
def daily_usage(t):
    return quotas.daily_usage(t.attempts)


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, floor(at_ms / 86400000.0) ORDER BY at_ms, event_id) AS rn FROM {attempts}) WHERE rn <= 3")
def admit_daily(t):
    return quotas.admit_daily(t.attempts, 3).select("event_id", "user_id")


@query("SELECT user_id, count(*) AS files, cast(sum(size) AS bigint) AS bytes, count(*) > 40 OR sum(size) > 67108864 AS over FROM {attachments} GROUP BY user_id")
def storage_usage(t):
    return quotas.storage_usage(t.attachments)


@query("WITH p AS (SELECT user_id, chat_id, count(*) AS n FROM {messages} GROUP BY ALL) SELECT user_id, count(*) AS chats, max(n) AS most_messages, count(*) < 100 AND max(n) + 2 <= 200 AS open FROM p GROUP BY user_id")
def chat_usage(t):
    return quotas.chat_usage(t.messages)


@query()
def admit_storage(t):
    return quotas.admit_storage(t.attachments.withColumnRenamed("created_at", "at_ms"))


@query("""WITH s AS (SELECT *, status = 'processing' AND created_at <= 1708026700000 - 180000 AS stale FROM {attachments}), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, stale ORDER BY created_at, id) AS rn FROM s)
SELECT id, CASE WHEN stale AND rn <= 5 THEN 'failed' ELSE status END AS status, NOT (stale AND rn <= 5) AND extracted_text IS NOT NULL AS has_text FROM r""")
def stale_processing(t):
    rows = quotas.stale_processing(t.attachments, 1708026700000, 5)
    return rows.select("id", "status", F.col("extracted_text").isNotNull().alias("has_text"))


@query("""WITH r AS (SELECT cast(event_id AS bigint) AS request_id, 'u-' || cast(event_id % 7 AS string) AS r_user, 'c-' || cast(event_id % 90 AS string) AS r_chat, 'f-' || cast(event_id % 700 AS string) AS f FROM {attempts})
SELECT request_id, CASE WHEN a.id IS NOT NULL AND a.user_id = r_user AND a.status = 'ready' AND a.chat_id = r_chat THEN 'claimable' ELSE 'unavailable' END AS verdict FROM r LEFT JOIN {attachments} a ON a.id = r.f""")
def attachment_claimable(t):
    r = t.attempts.selectExpr("cast(event_id AS bigint) AS request_id", "concat('u-', event_id % 7) AS user_id", "concat('c-', event_id % 90) AS chat_id", "array(concat('f-', event_id % 700), concat('f-', event_id % 700)) AS files")
    return quotas.attachment_claims(r, t.attachments.withColumn("message_id", F.lit(None).cast("string")))


@query(f"WITH c AS ({_CHATS}) SELECT m.id FROM {{messages}} m WHERE m.user_id NOT IN ('u-1', 'u-2') AND m.chat_id NOT IN (SELECT id FROM c WHERE updated_at % 7 = 0)")
def cascade_delete(t):
    users = t.spark.createDataFrame([("u-1",), ("u-2",)], "id string")
    gone = chats(t).where("updated_at % 7 = 0").select("id")
    files = t.attachments.withColumn("message_id", F.lit(None).cast("string"))
    return conversations.cascade_delete(chats(t), t.messages, files, users, gone)[1].select("id")


@query("SELECT id, chat_id FROM {messages} WHERE user_id = 'u-7' AND conv_id % 3 <> 0")
def owned_rows(t):
    chats = t.messages.selectExpr("chat_id AS id", "user_id", "CASE WHEN conv_id % 3 = 0 THEN 1 END AS deleting_at").distinct()
    return conversations.owned_rows(t.messages, chats, "u-7").select("id", "chat_id")


@query("""WITH c AS (SELECT chat_id, id FROM {messages} WHERE turn = 1) SELECT a.chat_id, cast(row_number() OVER (PARTITION BY a.chat_id ORDER BY created_at, a.id) AS integer) AS place, a.id, coalesce(extracted_text, '') AS text FROM {attachments} a JOIN c ON c.chat_id = a.chat_id WHERE status = 'ready' AND doc_id % 4 <> 0""")
def chat_documents(t):
    files = t.attachments.join(t.messages.where("turn = 1").select("chat_id", F.col("id").alias("message_id")), "chat_id").withColumn("message_id", F.when(F.col("doc_id") % 4 != 0, F.col("message_id")))
    return conversations.chat_documents(files, t.messages).select("chat_id", "place", "id", "text")
