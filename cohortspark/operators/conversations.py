"""Turns, context windows, leases, fenced writes, assembled answers and deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Fixed limits: lease, saved characters, context messages, characters a message and in all.
LEASE_MS, SAVED_CHARS, ANSWER_CHARS = 180_000, 120_000, 35_000
HISTORY, CONTEXT, MESSAGE_CHARS, CONTEXT_CHARS = 24, 20, 16_000, 100_000
MOST_ARGS = 5000
TOOL_LIMITS = {"cohort_search": 2, "profile_inspect": 3, "calculate": 3, "weekly_time_budget": 3}


def ranked(df: DataFrame, keys: list[str], *order: Column, name: str = "place") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def reply_pairs(messages: DataFrame) -> DataFrame:
    """Each user message with its reply."""
    replies = messages.where("role = 'assistant'").select(F.col("reply_to_id").alias("id"), F.col("id").alias("reply_id"), F.col("status").alias("reply_status"))
    return messages.where("role = 'user'").select("id", "chat_id").join(replies, "id").select("id", "chat_id", "reply_id", "reply_status")


def incomplete_turns(messages: DataFrame) -> DataFrame:
    replies = messages.where("role = 'assistant'").select(F.col("reply_to_id").alias("id"))
    return messages.where("role = 'user'").join(replies, "id", "left_anti")


def newest(df: DataFrame, key: str, at: str, n: int) -> DataFrame:
    """The n newest rows of each key; ties by id."""
    return ranked(df, [key], F.desc(at), F.asc("id")).where(F.col("place") <= n)


def owned_rows(df: DataFrame, chats: DataFrame, user_id: str) -> DataFrame:
    """A user's own rows of a table with chat_id, those of chats being deleted left out."""
    own = chats.where((F.col("user_id") == user_id) & F.col("deleting_at").isNull()).select(F.col("id").alias("chat_id"))
    return df.join(own, "chat_id", "left_semi")


def chat_documents(attachments: DataFrame, messages: DataFrame) -> DataFrame:
    """Ready files tied to a message of their chat, in order of time; a missing text is empty."""
    rows = attachments.where("status = 'ready'").join(messages.select(F.col("id").alias("message_id"), "chat_id"), ["message_id", "chat_id"], "left_semi")
    return ranked(rows, ["chat_id"], F.asc("created_at"), F.asc("id")).select("chat_id", "place", "id", F.coalesce("extracted_text", F.lit("")).alias("text"))


def pending_deletions(chats: DataFrame, n: int = 10) -> DataFrame:
    """The n oldest deletions of each user."""
    return ranked(chats.where("deleting_at IS NOT NULL"), ["user_id"], F.asc("deleting_at"), F.asc("id")).where(F.col("place") <= n)


def chat_titles(messages: DataFrame) -> DataFrame:
    first = messages.where("role = 'user'").groupBy("chat_id").agg(F.min_by("content", F.struct("created_at", "id")).alias("c"))
    return first.select("chat_id", F.left("c", F.lit(100)).alias("title"))


def context_messages(messages: DataFrame, outside: DataFrame | None = None, history: int = HISTORY, context: int = CONTEXT, each: int = MESSAGE_CHARS, total: int = CONTEXT_CHARS) -> DataFrame:
    """What a model would see of each chat: the last messages within the character budgets, newest spending first.

    `outside` holds message_id of answers backed by outside sources; they go after the second cut.
    """
    rows = messages.where("role = 'user' OR status = 'complete'")
    rows = ranked(rows, ["chat_id"], F.desc("created_at"), F.desc("id")).where(F.col("place") <= min(history, context))
    if outside is not None:
        rows = rows.join(outside.select(F.col("message_id").alias("id")).distinct(), "id", "left_anti")
    before = W.partitionBy("chat_id").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(F.least(F.length("content"), F.lit(each))).over(before), F.lit(0))
    rows = rows.withColumn("spent", spent).where(F.col("spent") < total)
    return rows.withColumn("content", F.left("content", F.least(F.lit(each), F.lit(total) - F.col("spent")).cast("int"))).drop("spent")


def context_documents(attachments: DataFrame, newest_n: int = 4, each: int = 20_000, total: int = 50_000, excerpt: int = 1_200) -> DataFrame:
    """The newest ready files of each chat, cut to the budgets; a spent budget leaves empty texts."""
    rows = ranked(attachments.where("status = 'ready'").withColumn("text", F.coalesce("extracted_text", F.lit(""))), ["chat_id"], F.desc("created_at"), F.desc("id")).where(F.col("place") <= newest_n)
    before = W.partitionBy("chat_id").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(F.least(F.length("text"), F.lit(each))).over(before), F.lit(0))
    used = F.greatest(F.lit(0), F.least(F.length("text"), F.lit(each), F.lit(total) - F.col("spent"))).cast("int")
    return rows.withColumn("spent", spent).withColumn("used", used).select("chat_id", "id", "place", "used", (F.col("used") < F.length("text")).alias("truncated"), F.left("text", F.least("used", F.lit(excerpt))).alias("excerpt"))


def lease_chains(renewals: DataFrame, lease_ms: int = LEASE_MS, keys: tuple[str, ...] = ("chat_id",)) -> DataFrame:
    """Runs of renewals that each came strictly before the lease ended: key, chain, first, last, renewals."""
    order = W.partitionBy(*keys).orderBy("at_ms", "event_id")
    broken = F.coalesce((F.col("at_ms") - F.lag("at_ms").over(order) >= lease_ms).cast("long"), F.lit(1))
    chained = renewals.withColumn("b", broken).withColumn("chain", F.sum("b").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return chained.groupBy(*keys, "chain").agg(F.min("at_ms").alias("first_ms"), F.max("at_ms").alias("last_ms"), F.count("*").alias("renewals"))


def fence_writes(writes: DataFrame, generations: DataFrame) -> DataFrame:
    """Writes (chat_id, generation_id, at_ms, content) that come while their generation is the chat's latest and its lease runs.

    generations: (chat_id, generation_id, at_ms, lease_expires_at). A generation of the same time counts as earlier.
    """
    cols = ["chat_id", "at_ms", "kind", "generation_id", "lease_expires_at", "content", "event_id"]
    a = generations.select("chat_id", "at_ms", F.lit(0).alias("kind"), "generation_id", "lease_expires_at", F.lit(None).cast("string").alias("content"), "event_id")
    b = writes.select("chat_id", "at_ms", F.lit(1).alias("kind"), "generation_id", F.lit(None).cast("long").alias("lease_expires_at"), "content", "event_id")
    order = W.partitionBy("chat_id").orderBy("at_ms", "kind", "event_id").rowsBetween(W.unboundedPreceding, 0)
    at = F.last(F.when(F.col("kind") == 0, F.struct("generation_id", "lease_expires_at")), ignorenulls=True).over(order)
    rows = a.select(*cols).unionAll(b.select(*cols)).withColumn("now", at).where("kind = 1")
    return rows.where((F.col("now.generation_id") == F.col("generation_id")) & (F.col("now.lease_expires_at") > F.col("at_ms"))).select("chat_id", "event_id", "generation_id", "at_ms", F.left("content", F.lit(SAVED_CHARS)).alias("content"))


def expire_generations(chats: DataFrame, messages: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """Chats whose lease has run out lose it; their running or pending message fails and keeps its text."""
    out = (F.col("lease_expires_at") <= now_ms) & F.col("generation_id").isNotNull()
    ended = chats.where(out).select(F.col("generation_id").alias("id")).withColumn("ended", F.lit(True))
    failed = messages.join(ended, "id", "left").withColumn("status", F.when(F.col("ended") & F.col("status").isin("pending", "running"), "failed").otherwise(F.col("status"))).drop("ended")
    kept = lambda c: F.when(~F.coalesce(out, F.lit(False)), F.col(c))
    return chats.withColumn("was", kept("generation_id")).withColumn("lease_expires_at", kept("lease_expires_at")).drop("generation_id").withColumnRenamed("was", "generation_id"), failed


def write_evidence(messages: DataFrame, chats: DataFrame, answers: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """Messages and chats after finished answers (chat_id, message_id, content, status, evidence struct) are saved.

    An answer counts only while its message runs and is what its chat generates, under a lease that has not ended. Its
    text is cut, its evidence is stored with null fields, and without evidence the earlier record stays. The chat is
    free afterwards. There is at most one answer per message.
    """
    leased = chats.where(F.col("lease_expires_at") > now_ms).select(F.col("id").alias("chat_id"), F.col("generation_id").alias("message_id"))
    running = messages.where("status = 'running'").select(F.col("id").alias("message_id"), "chat_id")
    took = answers.join(leased, ["chat_id", "message_id"], "left_semi").join(running, ["chat_id", "message_id"], "left_semi")
    record = F.to_json("evidence", {"ignoreNullFields": "false"})
    new = took.select("chat_id", F.col("message_id").alias("id"), F.left("content", F.lit(SAVED_CHARS)).alias("n_content"), F.col("status").alias("n_status"), record.alias("n_evidence"))
    saved = F.col("n_status").isNotNull()
    columns = {"content": F.when(saved, F.col("n_content")).otherwise(F.col("content")), "status": F.coalesce("n_status", "status"), "evidence_json": F.coalesce("n_evidence", "evidence_json")}
    written = messages.join(new, ["chat_id", "id"], "left").withColumns(columns).select(*messages.columns)
    free = new.select(F.col("chat_id").alias("id"), F.lit(True).alias("free"))
    kept = {c: F.when(F.col("free").isNull(), F.col(c)) for c in ("generation_id", "lease_expires_at")}
    return written, chats.join(free, "id", "left").withColumns(kept).select(*chats.columns)


def retry_eligible(messages: DataFrame) -> DataFrame:
    """Chats' newest messages that failed or were cancelled."""
    return newest(messages, "chat_id", "created_at", 1).where("status IN ('failed', 'cancelled')")


def tool_call_budget(calls: DataFrame) -> DataFrame:
    """Calls (answer_id, round, seq, tool, args) with their verdict: admitted, or the first limit that they meet.

    Per reply only the first six stand; an answer has four rounds and seven calls; each tool has its own limit, which
    oversized calls do not use up.
    """
    large = F.length("args") > MOST_ARGS
    return admission(calls.select("answer_id", "round", "seq", "tool", large.alias("large"))).drop("large")


def admission(calls: DataFrame) -> DataFrame:
    """The verdicts of calls (answer_id, round, seq, tool, large: whether the arguments are oversized); other columns stay.

    The arguments themselves are neither sorted nor dealt out.
    """
    rows = ranked(calls, ["answer_id", "round"], F.asc("seq"), name="in_reply")
    standing = rows.where((F.col("in_reply") <= 6) & (F.col("round") < 4))
    standing = ranked(standing, ["answer_id"], F.asc("round"), F.asc("seq"), name="in_answer").where(F.col("in_answer") <= 7)
    limit = F.create_map(*[x for k, v in TOOL_LIMITS.items() for x in (F.lit(k), F.lit(v))])
    # A count for each tool in the order of the answer's calls, so that they are not sorted by tool once more.
    so_far = W.partitionBy("answer_id").orderBy("round", "seq").rowsBetween(W.unboundedPreceding, 0)
    counts = [F.when(F.col("tool") == k, F.sum(F.when((F.col("tool") == k) & ~F.col("large"), 1).otherwise(0)).over(so_far)) for k in TOOL_LIMITS]
    counted = F.coalesce(*counts)
    verdict = F.when(F.col("large"), "too_large").when(F.try_element_at(limit, F.col("tool")).isNull(), "unknown_tool").when(counted > F.try_element_at(limit, F.col("tool")), "tool_limit").otherwise("admitted")
    return standing.select(*calls.columns, verdict.alias("verdict"))


def assemble_answers(frames: DataFrame, limit: int = ANSWER_CHARS) -> DataFrame:
    """Answers from frames (message_id, seq, text, finish, bad): text in order and how it ended."""
    rows = frames.groupBy("message_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), "").alias("content"),
        F.max(F.coalesce(F.col("finish") == "stop", F.lit(False))).alias("done"),
        F.max(F.coalesce(F.col("finish") == "length", F.lit(False))).alias("truncated"),
        F.max(F.col("bad") | F.coalesce(~F.col("finish").isin("stop", "length"), F.lit(False))).alias("broken"),
    )
    ok = ~F.col("broken") & F.col("done") & ~F.col("truncated") & (F.regexp_replace("content", r"\s+", "") != "") & (F.length("content") <= limit)
    return rows.select("message_id", "content", F.when(ok, "complete").otherwise("failed").alias("status"))


def cascade_delete(chats: DataFrame, messages: DataFrame, attachments: DataFrame, users: DataFrame | None = None, gone_chats: DataFrame | None = None, gone_messages: DataFrame | None = None):
    """Delete users, chats or messages (tables of ids) with all that hangs on them; files only lose a deleted message."""
    if users is not None:
        chats = chats.join(users.select(F.col("id").alias("user_id")), "user_id", "left_anti")
        attachments = attachments.join(users.select(F.col("id").alias("user_id")), "user_id", "left_anti")
    if gone_chats is not None:
        chats = chats.join(gone_chats.select("id"), "id", "left_anti")
    kept = chats.select(F.col("id").alias("chat_id"))
    messages = messages.join(kept, "chat_id", "left_semi")
    attachments = attachments.where("chat_id IS NULL").unionByName(attachments.join(kept, "chat_id", "left_semi").select(*attachments.columns))
    if gone_messages is not None:
        messages = messages.join(gone_messages.select("id"), "id", "left_anti")
    ids = messages.select(F.col("id").alias("message_id"), F.lit(True).alias("there"))
    attachments = attachments.join(ids, "message_id", "left").withColumn("message_id", F.when(F.col("there"), F.col("message_id"))).drop("there")
    return chats, messages, attachments
