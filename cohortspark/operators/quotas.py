"""Usage and admission by user and day."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

#: Fixed limits.
DAY_MS, QUESTIONS, UPLOADS, FILES, BYTES, STALE_MS = 86_400_000, 50, 20, 40, 64 * 1024 * 1024, 180_000


def day(column: str = "at_ms"):
    return F.floor(F.col(column) / DAY_MS)


def daily_usage(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("user_id", day().alias("day")).agg(F.count("*").alias("requests"))


def admit_daily(attempts: DataFrame, limit: int = QUESTIONS) -> DataFrame:
    """The first `limit` attempts of each user and UTC day; exact because a rejection takes nothing."""
    order = W.partitionBy("user_id", day()).orderBy("at_ms", "event_id")
    return attempts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def storage_usage(attachments: DataFrame) -> DataFrame:
    return attachments.groupBy("user_id").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), ((F.count("*") > FILES) | (F.sum("size") > BYTES)).alias("over"))


def chat_usage(messages: DataFrame, chats_most: int = 100, messages_most: int = 200) -> DataFrame:
    """Chats per user and the most messages of one, with whether another turn fits."""
    per = messages.groupBy("user_id", "chat_id").agg(F.count("*").alias("n"))
    return per.groupBy("user_id").agg(F.count("*").alias("chats"), F.max("n").alias("most_messages"), ((F.count("*") < chats_most) & (F.max("n") + 2 <= messages_most)).alias("open"))


VERDICTS = np.array(["accepted", "daily_limit", "storage_limit"])


class Storage:
    """What one user holds on the way through their uploads: files, bytes, and the uploads of the last day."""

    def __init__(self, files: int, most: int, per_day: int):
        self.files, self.most, self.per_day = files, most, per_day
        self.count, self.used, self.day, self.today = 0, 0, None, 0

    def accepted(self, days: np.ndarray, sizes: np.ndarray) -> int:
        """How many of the next uploads are accepted before one is not; they are taken in."""
        n = min(len(days), self.files - self.count)
        if n <= 0:
            return 0
        days, sizes = days[:n], sizes[:n]
        begins = np.r_[True, days[1:] != days[:-1]]
        place = np.arange(n) - np.maximum.accumulate(np.where(begins, np.arange(n), 0))
        today = place + np.where(days == self.day, self.today, 0) if self.day is not None else place
        used = self.used + np.cumsum(sizes)
        bad = (today >= self.per_day) | (used > self.most)
        n = int(bad.argmax()) if bad.any() else n
        if n:
            self.count, self.used, self.day, self.today = self.count + n, int(used[n - 1]), days[n - 1], int(today[n - 1]) + 1
        return n

    def rejected(self, days: np.ndarray, sizes: np.ndarray) -> tuple[int, int]:
        """How many of the next uploads, the first of which is not accepted, are refused for the same reason, and the reason."""
        if self.day is not None and days[0] == self.day and self.today >= self.per_day:
            return int(np.searchsorted(days, self.day, side="right")), 1
        if self.count >= self.files:
            return len(days), 2
        fits = sizes <= self.most - self.used
        return (int(fits.argmax()) if fits.any() else len(days)), 2


def admit_storage(uploads: DataFrame, files: int = FILES, most: int = BYTES, per_day: int = UPLOADS) -> DataFrame:
    """Uploads (user_id, id, at_ms, size) in order with their verdict; what is rejected takes nothing.

    Acceptance depends on all earlier acceptances, so a user's uploads pass in order by a small state. Runs of them are decided
    at once from sums over arrays, and as a user holds `files` files at most, there are few runs. Rows stream through
    sorted partitions; no user's history is held. A null time or size counts as 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = pc.fill_null(batch.column(0).dictionary_encode().indices, -1).to_numpy()
            days, sizes = batch.column(2).to_numpy() // DAY_MS, batch.column(3).to_numpy()
            out = np.zeros(len(codes), np.int8)
            starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            ends = np.r_[starts[1:], len(codes)]
            # Users new in this batch whose uploads all fit are accepted without a look at each.
            at = np.arange(len(codes))
            fresh = np.repeat(starts, ends - starts)
            begins = np.r_[True, (codes[1:] != codes[:-1]) | (days[1:] != days[:-1])]
            total = np.cumsum(sizes)
            bad = (at - fresh >= files) | (total - (total - sizes)[fresh] > most) | (at - np.maximum.accumulate(np.where(begins, at, 0)) >= per_day)
            plain = np.add.reduceat(bad, starts) == 0
            for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
                last = b == len(codes)
                who = batch.column(0)[a].as_py() if k == 0 or last else None
                known = k == 0 and state is not None and who == user
                if plain[k] and not known and not last:
                    continue
                if not known:
                    state = Storage(files, most, per_day)
                while a < b:
                    a += state.accepted(days[a:b], sizes[a:b])
                    if a < b:
                        n, reason = state.rejected(days[a:b], sizes[a:b])
                        out[a : a + n] = reason
                        a += n
                if last:
                    user = who
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(VERDICTS[out])], names=["user_id", "id", "verdict"])

    whole = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c)
    rows = uploads.select("user_id", "id", whole("at_ms"), whole("size"))
    return rows.repartition("user_id").sortWithinPartitions("user_id", "at_ms", "id").mapInArrow(run, "user_id string, id string, verdict string")


def stale_processing(attachments: DataFrame, now_ms: int, each: int = 40) -> DataFrame:
    """Files still processing after the limit fail, the oldest `each` of a user, without text. Only ids of stale files are ranked."""
    stale = attachments.where((F.col("status") == "processing") & (F.col("created_at") <= now_ms - STALE_MS)).select("user_id", "created_at", "id")
    order = W.partitionBy("user_id").orderBy("created_at", "id")
    failed = stale.withColumn("place", F.row_number().over(order)).where(F.col("place") <= each).select("id", F.lit(True).alias("fails"))
    rows = attachments.join(failed, "id", "left")
    return rows.withColumn("status", F.when(F.col("fails"), "failed").otherwise(F.col("status"))).withColumn("extracted_text", F.when(F.col("fails").isNull(), F.col("extracted_text"))).select(*attachments.columns)


def attachment_claims(requests: DataFrame, attachments: DataFrame) -> DataFrame:
    """requests (request_id, user_id, chat_id, files array): verdict of each. At most 4 distinct files, each ready, unused, own, and of no or this chat."""
    asked = requests.select("request_id", "user_id", "chat_id", F.array_distinct("files").alias("files"))
    one = asked.select("request_id", F.col("user_id").alias("r_user"), F.col("chat_id").alias("r_chat"), F.explode("files").alias("id"))
    fits = (F.col("user_id") == F.col("r_user")) & (F.col("status") == "ready") & F.col("message_id").isNull() & (F.col("chat_id").isNull() | (F.col("chat_id") == F.col("r_chat")))
    good = one.join(attachments, "id", "left").groupBy("request_id").agg(F.count_if(fits).alias("good"))
    return asked.join(good, "request_id", "left").select("request_id", F.when(F.size("files") > 4, "too_many").when(F.coalesce("good", F.lit(0)) == F.size("files"), "claimable").otherwise("unavailable").alias("verdict"))
