"""Citations in answers, the sources behind them, and what they support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def cited_ids(text: Column) -> Column:
    """Distinct P, W, A and C ids in brackets of 1 to 100 characters without line feed; null text cites nothing."""
    groups = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\[([^\]\n]{1,100})\]"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit(r"\b([PWAC][0-9]+)\b"), F.lit(1)))))


def cited_sources(messages: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows of sources that their message cites."""
    cited = messages.select(F.col("id").alias("message_id"), F.explode(cited_ids(F.col("content"))).alias("id"))
    return sources.join(cited, ["message_id", "id"], "left_semi")


def supporting_accounts(messages: DataFrame, sources: DataFrame, latest: DataFrame | None = None) -> DataFrame:
    """Distinct applicants of cited profile sources by message; `latest` (message_id, id) cuts to the last retrieval."""
    rows = cited_sources(messages, sources).where("kind = 'profile'")
    if latest is not None:
        rows = rows.join(latest, ["message_id", "id"], "left_semi")
    return rows.groupBy("message_id").agg(F.countDistinct(F.nullif("applicant_id", F.lit(""))).alias("supporting"))


def citation_sets(messages: DataFrame, sources: DataFrame) -> DataFrame:
    """Per message: cited ids, ids of its sources, and cited ids without source, sources without citation, both."""
    own = sources.groupBy("message_id").agg(F.array_sort(F.collect_set("id")).alias("known"))
    base = messages.select(F.col("id").alias("message_id"), cited_ids(F.col("content")).alias("cited")).join(own, "message_id", "left")
    known = F.coalesce("known", F.array().cast("array<string>"))
    return base.select("message_id", "cited", F.array_except("cited", known).alias("dangling"), F.array_except(known, "cited").alias("uncited"), F.array_intersect("cited", known).alias("supported"))


def support_audit(answers: DataFrame, recount: DataFrame, sources: DataFrame) -> DataFrame:
    """(message_id, violation): a stored count not above 0 or unlike the recount, matched >= examined > 0 broken, outside sources."""
    outside = sources.where("kind IN ('web', 'official')").select("message_id").distinct().withColumn("outside", F.lit(True))
    rows = answers.join(recount.withColumnRenamed("supporting", "recounted"), "message_id", "left").join(outside, "message_id", "left")
    bad = F.array_compact(F.array(
        F.when(F.coalesce("supporting", F.lit(0)) <= 0, "no_support"),
        F.when(~F.col("supporting").eqNullSafe(F.coalesce("recounted", F.lit(0))), "count_differs"),
        F.when(~F.coalesce((F.col("matched") >= F.col("examined")) & (F.col("examined") > 0), F.lit(False)), "counts_out_of_order"),
        F.when(F.col("outside"), "outside_source"),
    ))
    return rows.select("message_id", F.explode(bad).alias("violation"))


def citation_ledger(history: DataFrame, new: DataFrame) -> DataFrame:
    """Ids for new sources (chat_id, seq, prefix, key): a key known in the chat keeps its id, others count on from the greatest.

    history: (chat_id, id, key) with key null for ids that were only cited. Ids count only with 1 to 8 digits.
    """
    numbered = history.withColumn("prefix", F.substr("id", F.lit(1), F.lit(1))).withColumn("number", F.when(F.col("id").rlike(r"\A[A-Z][0-9]{1,8}\z"), F.substr("id", F.lit(2)).cast("long")))
    top = numbered.groupBy("chat_id", "prefix").agg(F.max("number").alias("top"))
    known = numbered.where("key IS NOT NULL").groupBy("chat_id", "prefix", "key").agg(F.max_by("id", "number").alias("kept"))
    rows = new.join(known, ["chat_id", "prefix", "key"], "left").join(top, ["chat_id", "prefix"], "left")
    fresh = W.partitionBy("chat_id", "prefix", F.col("kept").isNull()).orderBy("seq", "key")
    number = F.coalesce("top", F.lit(0)) + F.row_number().over(fresh)
    return rows.select("chat_id", "seq", "prefix", "key", F.coalesce("kept", F.concat("prefix", number.cast("string"))).alias("id"))


def carry_sources(previous: Column, new: Column) -> Column:
    """The last 24 of the previous sources that are profiles or calculations, then the new ones."""
    last = F.slice(previous, F.greatest(F.size(previous) - 23, F.lit(1)), F.lit(24))
    return F.concat(F.filter(last, lambda s: s["kind"].isin("profile", "calculation")), new)


def scrub_evidence(messages: DataFrame, removed: DataFrame) -> DataFrame:
    """messages with their evidence_json freed of attachment sources that carry a removed id (chat_id, attachment_id) or none.

    Only messages of a chat with a removal change. A record is edited as VARIANT, so everything else in it stays,
    unknown keys, nulls and numbers of up to 38 digits included; keys come out in order of their names. A record
    without a list of sources gets an empty one; a null or one that is no JSON object stays as it is.
    """
    gone = removed.groupBy("chat_id").agg(F.collect_set("attachment_id").alias("_gone"))
    rows = messages.join(gone, "chat_id", "left").withColumn("_v", F.when(F.col("_gone").isNotNull(), F.try_parse_json("evidence_json")))
    file = lambda s: F.try_variant_get(s, "$.attachmentId", "string")
    stays = lambda s: ~F.try_variant_get(s, "$.kind", "string").eqNullSafe("attachment") | F.coalesce(~F.array_contains("_gone", file(s)), F.lit(False))
    kept = F.filter(F.coalesce(F.try_variant_get("_v", "$.sources", "array<variant>"), F.array().cast("array<variant>")), stays)
    others = F.map_filter(F.try_variant_get("_v", "$", "map<string,variant>"), lambda k, _: k != "sources")
    edited = F.to_json(F.to_variant_object(F.map_concat(others, F.create_map(F.lit("sources"), F.to_variant_object(kept)))))
    return rows.select(*[F.coalesce(edited, "evidence_json").alias(c) if c == "evidence_json" else F.col(c) for c in messages.columns])


def remove_attachments(messages: DataFrame, chats: DataFrame, attachments: DataFrame, removals: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables after removals (user_id, attachment_id, at_ms) of files by their owners.

    A file's text goes and its removal is noted; the evidence of its chat is scrubbed; a message that still runs in
    that chat is cancelled and the chat's lease ends. A removal by someone else, or of a file in another's chat, does nothing
    beyond what that user owns. Removing twice changes no more than times.
    """
    asked = removals.groupBy("user_id", "attachment_id").agg(F.max("at_ms").alias("at_ms"))
    files = attachments.select(F.col("id").alias("attachment_id"), "user_id", "chat_id")
    own = asked.join(files, ["user_id", "attachment_id"])
    touched = own.join(chats.select(F.col("id").alias("chat_id"), "user_id", "generation_id"), ["chat_id", "user_id"])
    at = touched.groupBy("chat_id").agg(F.max("at_ms").alias("_at"), F.max("generation_id").alias("_generation"))
    rows = scrub_evidence(messages, touched.select("chat_id", "attachment_id")).join(at, "chat_id", "left")
    cancelled = F.coalesce((F.col("id") == F.col("_generation")) & F.col("status").isin("pending", "running"), F.lit(False))
    changed = F.col("_at").isNotNull() & (cancelled | F.col("evidence_json").isNotNull())
    new = {"status": F.when(cancelled, "cancelled").otherwise(F.col("status")), "updated_at": F.when(changed, F.col("_at")).otherwise(F.col("updated_at"))}
    messages = rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in messages.columns])
    ended = chats.join(at.select(F.col("chat_id").alias("id"), "_at"), "id", "left")
    chats = ended.select(*[F.when(F.col("_at").isNull(), F.col(c)).alias(c) if c in ("generation_id", "lease_expires_at") else F.col(c) for c in chats.columns])
    marks = {"status": "failed", "extracted_text": None, "error": "Removal in progress."}
    marked = attachments.join(own.select(F.col("attachment_id").alias("id"), F.lit(True).alias("_own")), "id", "left")
    attachments = marked.select(*[F.when(F.col("_own"), F.lit(marks[c])).otherwise(F.col(c)).alias(c) if c in marks else F.col(c) for c in attachments.columns])
    return messages, chats, attachments


SOURCE = "struct<sources:array<struct<id:string,kind:string,title:string,excerpt:string,applicantId:string,profileId:string,attachmentId:string>>,notes:array<string>>"


def cohort_evidence(filters: DataFrame, counts: DataFrame, summaries: DataFrame, coverage: DataFrame) -> DataFrame:
    """One evidence record per request: flattened filters, counts, statistics and coverage, and its text of at most 6,000 characters.

    counts, summaries and coverage are those of the batch search. Coverage reads `value: count`, sources by name and
    cycles from the latest.
    """
    told = F.array_sort(F.collect_list(F.struct("statistic", "n", F.col("missing").alias("excluded"), "min", "max", "median")))
    stats = summaries.groupBy("request_id").agg(told.alias("statistics"))
    entry = F.when(F.col("value").isNotNull(), F.struct("value", F.concat("value", F.lit(": "), F.col("count").cast("string")).alias("told")))
    listed = lambda part, up: F.transform(F.sort_array(F.collect_list(F.when(F.col("part") == part, entry)), up), lambda x: x["told"]).alias(part)
    covered = coverage.groupBy("request_id").agg(listed("sources", True), listed("cycles", False))
    parts = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.array_join(c, ", ") if kind.startswith("array") else F.col(c).cast("string"))) for c, kind in filters.dtypes if c != "request_id"]
    rows = filters.select("request_id", F.concat_ws("; ", *parts).alias("filters")).join(counts, "request_id").join(stats, "request_id", "left").join(covered, "request_id", "left")
    numbers = F.struct("total", "matched", "examined", "with_reported_outcomes", "summarized").alias("counts")
    record = F.struct(numbers, "filters", "statistics", F.struct("sources", "cycles").alias("coverage"))
    return rows.select("*", F.left(F.to_json(record), F.lit(6000)).alias("excerpt"))


def receipts(counts: DataFrame) -> DataFrame:
    """The sentence that states an answer's counts."""
    return counts.select("*", F.format_string("%d available; %d matching; %d retrieved; %d supporting this answer", "total", "matched", "examined", "supporting").alias("receipt"))
