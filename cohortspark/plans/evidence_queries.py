"""Evidence records and tool replays over the derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.operators import batch, citations, cohort, conversations, tools
from cohortspark.plans.register import query
from cohortspark.plans.search_queries import _MANY, BASE, EVENT, found, saved, searched
from cohortspark.sources import files


def evidence(t):
    """messages with their sources as JSON; the attachment sources name a file of the conversation's number, or none."""
    s = F.struct(F.col("id").alias("id"), F.when(F.col("id") == "P1", "attachment").otherwise(F.col("kind")).alias("kind"), F.when((F.col("id") == "P1") & (F.length("message_id") % 2 == 0), "f-1").alias("attachmentId"))
    per = t.sources.groupBy("message_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(s)).alias("sources"))).alias("evidence_json"))
    m = t.messages.where("role = 'assistant'")
    return m.join(per, m["id"] == per["message_id"]).select("id", "chat_id", "conv_id", "evidence_json")


def whole_evidence(t):
    """Messages with records of every kind of source, cohort figures, notes and a key that the library does not know."""
    return t.evidence.withColumn("evidence_json", F.concat("head", "other_file", F.lit(","), "legacy", F.lit(","), "web", F.lit("],"), "rest", F.lit("}")))


#: A record as it is and as it is written after its chat lost its first file (the second one too where a third of the chats lose it).
_RECORD = "head || other_file || ',' || legacy || ',' || web || '],' || rest || chr(125)"
_EDITED = """translate('<' || rest || ',"sources":[<"applicantId":"a-' || cast(turn % 3 AS string) || '","excerpt":null,"id":"P1","kind":"profile">,' || CASE WHEN conv_id % 3 = 0 THEN '' ELSE '<"attachmentId":"f-' || cast(conv_id + 1 AS string) || '","id":"A2","kind":"attachment","title":"y">,' END || web || ']>', '<>', chr(123) || chr(125))"""


@query(f"SELECT id, CASE WHEN conv_id % 2 = 0 THEN {_EDITED} ELSE {_RECORD} END AS evidence_json FROM {{evidence}}")
def scrub_evidence(t):
    """Whole records: every second chat loses its file, every sixth another one as well."""
    even = t.evidence.where("conv_id % 2 = 0")
    removed = even.selectExpr("chat_id", "concat('f-', conv_id) AS attachment_id").unionAll(even.where("conv_id % 3 = 0").selectExpr("chat_id", "concat('f-', conv_id + 1)")).distinct()
    return citations.scrub_evidence(whole_evidence(t), removed).select("id", "evidence_json")


@query(f"""WITH l AS (SELECT conv_id, arg_max(id, turn) AS last FROM {{evidence}} GROUP BY conv_id), e AS (SELECT *, conv_id % 2 = 0 AS gone, coalesce(id = last, false) AS runs FROM {{evidence}} LEFT JOIN l USING (conv_id))
SELECT id, CASE WHEN gone THEN {_EDITED.replace("conv_id % 3 = 0", "false")} ELSE {_RECORD} END AS evidence_json, CASE WHEN NOT runs THEN status WHEN gone THEN 'cancelled' ELSE 'running' END AS status, CASE WHEN gone THEN 9 ELSE updated_at END AS updated_at,
 CASE WHEN NOT gone THEN last END AS generation_id, CASE WHEN gone THEN 'failed' ELSE 'ready' END AS file, CASE WHEN gone THEN NULL ELSE 'text' END AS extracted_text FROM e""")
def remove_attachments(t):
    """The owner removes the file of every second chat while an answer runs; removals by others and of unknown files do nothing."""
    e = whole_evidence(t)
    last = e.groupBy("chat_id", "conv_id", "user_id").agg(F.max_by("id", "turn").alias("generation_id"))
    chats = last.select(F.col("chat_id").alias("id"), "user_id", "generation_id", F.lit(99).alias("lease_expires_at"))
    files = last.select(F.concat(F.lit("f-"), F.col("conv_id").cast("string")).alias("id"), "user_id", "chat_id", F.lit("ready").alias("status"), F.lit("text").alias("extracted_text"), F.lit(None).cast("string").alias("error"), "conv_id")
    asked = files.select(F.when(F.col("conv_id") % 2 == 0, F.col("user_id")).otherwise("u-other").alias("user_id"), F.col("id").alias("attachment_id"), F.lit(9).cast("long").alias("at_ms"))
    running = e.join(last.select(F.col("generation_id").alias("id"), F.lit(True).alias("runs")), "id", "left").withColumn("status", F.when(F.col("runs"), "running").otherwise(F.col("status")))
    m, c, f = citations.remove_attachments(running.select("id", "chat_id", "status", "evidence_json", "updated_at"), chats, files.drop("conv_id"), asked.unionAll(asked))
    c, f = c.select(F.col("id").alias("chat_id"), "generation_id"), f.select("chat_id", F.col("status").alias("file"), "extracted_text")
    return m.join(c, "chat_id").join(f, "chat_id").select("id", "evidence_json", "status", "updated_at", "generation_id", "file", "extracted_text")


@query("SELECT m.id, 'C1,P2,P3,P4,new' AS ids FROM {messages} m WHERE role = 'assistant'")
def carry_sources(t):
    e = evidence(t).withColumn("s", F.from_json("evidence_json", citations.SOURCE)["sources"])
    new = F.transform(F.slice("s", 1, 1), lambda x: x.withField("id", F.lit("new")))
    return e.select("id", F.array_join(citations.carry_sources(F.col("s"), new)["id"], ",").alias("ids"))


_TOLD = "concat_ws('; ', " + ", ".join(f"'{c}: ' || cast({c} AS string)" for c in ("gpa_min", "gpa_max", "mcat_min", "mcat_max")) + ", " + ", ".join(f"'{c}: ' || r.{one} || coalesce(', ' || r.{one}2, '')" for c, one in (("cycles", "cycle"), ("sources", "source"), ("outcomes", "outcome"))) + ", 'school: ' || school, 'activity: ' || activity)"
#: One statistic of a record, without what is null, and a record's braces as < and >.
_STAT = """'<"statistic":"{c}","n":' || count({c}) || ',"excluded":' || (count(*) - count({c})) || coalesce(',"min":' || cast(min({c}) AS double) || ',"max":' || cast(max({c}) AS double) || ',"median":' || cast(median({c}) AS double), '') || '>'"""


@query(_MANY + f""", one AS MATERIALIZED (SELECT * FROM pairs WHERE rn = 1), s AS (SELECT request_id, string_agg('"' || source || ': ' || n || '"', ',' ORDER BY source) AS sources FROM (SELECT request_id, source, count(*) AS n FROM one GROUP BY ALL) GROUP BY request_id),
y AS (SELECT request_id, string_agg('"' || cycle || ': ' || n || '"', ',' ORDER BY cycle DESC) AS cycles FROM (SELECT request_id, cycle, count(*) AS n FROM one GROUP BY ALL) GROUP BY request_id),
g AS (SELECT request_id, {_STAT.format(c="gpa")} || ',' || {_STAT.format(c="mcat")} AS stats FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY cycle DESC, id) AS place FROM one) WHERE place <= 1000 GROUP BY request_id),
ar AS (SELECT p.id FROM {{profiles}} p WHERE {EVENT} AND o.status IN ('accepted', 'rejected'))),
c AS (SELECT request_id, count(*) AS matched, count(*) FILTER (WHERE id IN (SELECT id FROM ar)) AS reported FROM one GROUP BY request_id)
SELECT request_id, left(translate('<"counts":<"total":' || (SELECT count(DISTINCT account_id) FROM ({BASE})) || ',"matched":' || matched || ',"examined":' || least(matched, 12) || ',"with_reported_outcomes":' || reported || ',"summarized":' || least(matched, 1000) || '>,"filters":"' || {_TOLD} || '","statistics":[' || stats || '],"coverage":<"sources":[' || sources || '],"cycles":[' || cycles || ']>>', '<>', chr(123) || chr(125)), 6000) AS excerpt
FROM c JOIN s USING (request_id) JOIN y USING (request_id) JOIN g USING (request_id) JOIN {{requests}} r USING (request_id)""")
def cohort_evidence(t):
    """Whole records of all requests, as their text."""
    def records(asked):
        asked, counted, first = found(t, asked, cohort.SUMMARY_ROWS)
        return citations.cohort_evidence(asked, batch.match_records(counted, t.profiles), batch.match_summaries(first), batch.match_coverage(counted)).select("request_id", "excerpt")

    return batch.once(saved(t), records)


@query("SELECT id, cast(5 AS bigint) AS sources, CASE WHEN length(id) % 2 = 0 THEN 'f-1' END AS attachment FROM {messages} WHERE role = 'assistant'")
def parse_documents(t):
    rows = files.parse_documents(evidence(t), "evidence_json", citations.SOURCE)
    attached = F.get(F.filter("parsed.sources", lambda s: s["kind"] == "attachment"), F.lit(0))
    return rows.select("id", F.size("parsed.sources").cast("long").alias("sources"), attached["attachmentId"].alias("attachment"))


@query("""SELECT id, CASE WHEN saved THEN 'told: ' || content ELSE content END AS content, CASE WHEN saved THEN 'complete' WHEN status = 'cancelled' THEN 'running' ELSE status END AS status,
 CASE WHEN saved AND conv_id % 2 = 0 THEN '{"id":"C1","note":null}' ELSE '{"id":"C0"}' END AS evidence_json, CASE WHEN NOT saved THEN id END AS generation_id
FROM (SELECT *, status = 'cancelled' AND created_at > 1704067200000 + 40 * 3600000 AS saved FROM {messages} WHERE role = 'assistant')""")
def write_evidence(t):
    m = t.messages.where("role = 'assistant'").selectExpr("id", "concat('x', id) AS chat_id", "conv_id", "created_at", "content", "if(status = 'cancelled', 'running', status) AS status", """'{"id":"C0"}' AS evidence_json""")
    chats = m.selectExpr("chat_id AS id", "id AS generation_id", "created_at AS lease_expires_at")
    answers = m.selectExpr("chat_id", "id AS message_id", "concat('told: ', content) AS content", "'complete' AS status", "if(conv_id % 2 = 0, named_struct('id', 'C1', 'note', cast(NULL AS string)), NULL) AS evidence")
    written, left = conversations.write_evidence(m, chats, answers, 1704067200000 + 40 * 3600000)
    return written.join(left.select(F.col("id").alias("chat_id"), "generation_id"), "chat_id").select("id", "content", "status", "evidence_json", "generation_id")


@query("SELECT id, cast(9 + conv_id AS string) || ' available; ' || cast(turn AS string) || ' matching; 3 retrieved; 2 supporting this answer' AS receipt FROM {messages} WHERE role = 'assistant'")
def receipt_counts(t):
    rows = t.messages.where("role = 'assistant'").selectExpr("id", "9 + conv_id AS total", "turn AS matched", "3 AS examined", "2 AS supporting")
    return citations.receipts(rows).select("id", "receipt")


@query("SELECT l_orderkey AS answer_id, max(ord) AS seq FROM {li} WHERE l_partkey % 5 = 0 GROUP BY l_orderkey")
def latest_cohort(t):
    calls = t.li.where("l_partkey % 5 = 0").selectExpr("l_orderkey AS answer_id", "0 AS round", "ord AS seq", "named_struct('matched', l_suppkey) AS counts")
    return tools.latest_cohort(calls).select("answer_id", "seq")


_REPLAY = f"""WITH c AS (SELECT l_orderkey AS answer_id, ord AS seq, l_partkey % 4 AS k, cast(l_quantity AS double) AS q, l_suppkey, 'p-' || lpad(cast(l_orderkey AS string), 10, '0') AS own, l_suppkey % 20 AS v, l_partkey % 3 AS w,
  row_number() OVER (PARTITION BY l_orderkey, l_partkey % 4 ORDER BY ord) AS u FROM {{li}}),
r AS (SELECT DISTINCT v, w, 2.0 + v / 10.0 AS gpa_min, CASE w WHEN 0 THEN 'sdn' WHEN 1 THEN 'reddit' END AS source FROM c WHERE v < 18),
m AS (SELECT v, w, p.id, p.account_id, p.cycle, row_number() OVER (PARTITION BY v, w, account_id ORDER BY p.cycle DESC, observed_at DESC, p.id) AS rn FROM r JOIN ({BASE}) p ON p.gpa >= r.gpa_min AND (r.source IS NULL OR p.source = r.source)
  WHERE r.source IS NOT NULL OR {EVENT} AND o.status IN ('accepted', 'waitlisted'))),
one AS (SELECT *, row_number() OVER (PARTITION BY v, w ORDER BY cycle DESC, id) AS place FROM m WHERE rn = 1),
n AS (SELECT v, w, count(*) AS matched, count(*) FILTER (WHERE {EVENT} AND o.status IN ('accepted', 'rejected'))) AS ar FROM one p GROUP BY ALL),
asked AS (SELECT *, CASE WHEN k = 3 AND l_suppkey % 3 > 0 THEN (SELECT min(id) FROM one WHERE place = 1 AND v = 5 AND w = 0) WHEN k = 3 THEN own END AS wants FROM c WHERE seq < 6),
seen AS (SELECT a.answer_id, one.id, min(a.seq) AS since FROM asked a JOIN one ON a.k = 2 AND a.u <= 2 AND one.v = a.v AND one.w = a.w AND place <= CASE WHEN a.v % 2 = 0 THEN 12 ELSE 10 END GROUP BY ALL)
SELECT a.answer_id, a.seq, CASE WHEN u > 3 THEN NULL WHEN k = 0 THEN q + l_suppkey WHEN k = 1 THEN q * 4 END AS number, CASE WHEN u <= 3 AND k = 3 AND (s.since < a.seq OR (wants = own AND a.answer_id % 2 = 0)) THEN p.cycle END AS cycle,
 CASE WHEN g THEN (SELECT count(DISTINCT account_id) FROM ({BASE})) END AS total, CASE WHEN g THEN coalesce(matched, 0) END AS matched, CASE WHEN g THEN least(coalesce(matched, 0), CASE WHEN a.v % 2 = 0 THEN 12 ELSE 10 END) END AS examined, CASE WHEN g THEN coalesce(ar, 0) END AS with_reported_outcomes,
 CASE WHEN k = 2 AND u > 2 OR u > 3 THEN 'tool_limit' WHEN k = 3 AND NOT coalesce(s.since < a.seq OR (wants = own AND a.answer_id % 2 = 0), false) THEN 'not_returned' WHEN k = 3 AND p.cycle IS NULL THEN 'unknown_profile' WHEN k = 2 AND a.v >= 18 THEN 'invalid_sources' END AS error
FROM (SELECT *, k = 2 AND u <= 2 AND v < 18 AS g FROM asked) a LEFT JOIN n ON n.v = a.v AND n.w = a.w LEFT JOIN seen s ON s.answer_id = a.answer_id AND s.id = wants
LEFT JOIN ({BASE}) p ON p.id = wants"""


@query(_REPLAY)
def replay_tool_calls(t):
    """Four tools in turn; half of the searches name a limit above the most, some a source that does not exist."""
    profiles = t.written(searched(t), "profiles")
    base = t.written(batch.searchable(profiles, t.outcomes), "searchable")
    c = t.li.withColumn("v", F.expr("l_suppkey % 20")).withColumn("w", F.expr("l_partkey % 3"))
    more = F.expr("CASE WHEN v >= 18 THEN ', \"sources\": [\"none\"]' WHEN w = 0 THEN ', \"sources\": [\"sdn\"]' WHEN w = 1 THEN ', \"sources\": [\"reddit\"]' ELSE ', \"outcomes\": [\"accepted\", \"waitlisted\"]' END")
    search = F.concat(F.lit('{"gpaMin": '), F.expr("2.0D + v / 10.0D").cast("string"), more, F.expr("CASE WHEN v % 2 = 0 THEN ', \"limit\": 20}' ELSE '}' END"))
    top = t.written(batch.match_samples(batch.matches(t.spark.sql("SELECT 'x' AS request_id, 2.5D AS gpa_min, cast(NULL AS double) AS gpa_max, cast(NULL AS double) AS mcat_min, cast(NULL AS double) AS mcat_max, cast(NULL AS array<string>) AS cycles, array('sdn') AS sources, cast(NULL AS array<string>) AS outcomes, cast(NULL AS string) AS school"), base), 1).select("id"), "top")
    c = c.crossJoin(top.select(F.col("id").alias("top")).unionAll(t.spark.sql("SELECT 'p-none'")).agg(F.min("top").alias("top")))
    own = F.concat(F.lit("p-"), F.lpad(F.col("l_orderkey").cast("string"), 10, "0"))
    args = F.expr("""CASE l_partkey % 4 WHEN 0 THEN concat('{"operation": "sum", "values": [', cast(l_quantity AS double), ', ', l_suppkey, ']}') WHEN 1 THEN concat('{"hoursPerWeek": ', cast(l_quantity AS double), ', "weeks": 4}') END""")
    inspect = F.concat(F.lit('{"id": "'), F.when(F.expr("l_suppkey % 3 > 0"), F.col("top")).otherwise(own), F.lit('"}'))
    args = F.when(F.expr("l_partkey % 4 = 2"), search).when(F.expr("l_partkey % 4 = 3"), inspect).otherwise(args)
    tool = F.expr("CASE l_partkey % 4 WHEN 0 THEN 'calculate' WHEN 1 THEN 'weekly_time_budget' WHEN 2 THEN 'cohort_search' ELSE 'profile_inspect' END")
    calls = c.select(F.col("l_orderkey").alias("answer_id"), F.lit(0).alias("round"), F.col("ord").alias("seq"), tool.alias("tool"), args.alias("args"))
    previous = t.orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("answer_id"), F.concat(F.lit("p-"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0")).alias("id"))
    got = tools.replay_tool_calls(calls, profiles, t.outcomes, previous, t.written, base)
    return got.select("answer_id", "seq", "number", "cycle", "cohort.total", "cohort.matched", "cohort.examined", "cohort.with_reported_outcomes", "error")
