"""Structured Streaming jobs over attempts, answers, uploads and releases."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from cohortspark.operators.conversations import ANSWER_CHARS, LEASE_MS, SAVED_CHARS
from cohortspark.sources.store import BUCKETS, CODEC, gone, publish


def daily_usage(attempts: DataFrame, delay: str = "1 day") -> DataFrame:
    """Attempts per user and UTC day from a stream with a timestamp `ts`."""
    return attempts.withWatermark("ts", delay).groupBy("user_id", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("requests")).select("user_id", F.floor(F.unix_seconds("w.start") / 86_400).cast("long").alias("day"), "requests")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed(rows: DataFrame, keys: list[str], processor: StatefulProcessor, out: str) -> DataFrame:
    """A processor over the keys of a stream with a watermark; its state lies in RocksDB, entry by entry."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return rows.groupBy(*keys).transformWithStateInPandas(processor, out, "append", "eventTime")


class Verdicts(StatefulProcessor):
    """Of each request the digest of its first content and when it came; it is forgotten `keep_ms` after that."""

    def __init__(self, keys: list[str], keep_ms: int):
        self.keys, self.keep_ms = keys, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "digest string, at_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = self.first.get() if self.first.exists() else None
        known = first
        said = []
        came = pd.concat(list(rows))
        came["at_ms"] = [int(x.timestamp() * 1000) for x in came["ts"]]
        for e in came.sort_values(["at_ms", "digest"], kind="stable").itertuples():
            if first is None or e.at_ms >= first[1] + self.keep_ms:
                first = (e.digest, e.at_ms)
                verdict = "new"
            else:
                verdict = "repeat" if e.digest == first[0] else "conflict"
            said.append((*key, e.ts, e.digest, verdict))
        if first != known:
            if known is not None:
                self.handle.deleteTimer(int(known[1]) + self.keep_ms)
            self.first.update(first)
            self.handle.registerTimer(int(first[1]) + self.keep_ms)
        yield pd.DataFrame(said, columns=[*self.keys, "ts", "digest", "verdict"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.first.clear()
        return iter(())


def request_verdicts(requests: DataFrame, keys: list[str], keep_ms: int, delay: str = "1 hour") -> DataFrame:
    """Each request of a stream (keys, ts, content) as new, repeat or conflict, with the digest of its content.

    The first content of a request id counts for `keep_ms`; the same content again is a repeat, another one a conflict. After that
    the id is new again, and its state has gone with the watermark. Requests of one batch are taken by time, then digest.
    """
    rows = requests.select(*keys, "ts", F.sha2(F.coalesce(F.col("content"), F.lit("")), 256).alias("digest")).withWatermark("ts", delay)
    kinds = ", ".join(f"{k} {dict(rows.dtypes)[k]}" for k in keys)
    return keyed(rows, keys, Verdicts(keys, keep_ms), f"{kinds}, ts timestamp, digest string, verdict string")


def idempotent_requests(requests: DataFrame, keys: list[str], keep_ms: int, delay: str = "1 hour") -> DataFrame:
    """The requests that request_verdicts calls new."""
    return request_verdicts(requests, keys, keep_ms, delay).where("verdict = 'new'")


GENERATION = "chat_id string, generation_id string, status string, ended_ms long, writes long, content string"


class Generations(StatefulProcessor):
    """The running generation of a chat and, apart from it, the text that it has saved, so that a renewal writes no text."""

    def __init__(self, lease_ms: int):
        self.lease_ms = lease_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.running = handle.getValueState("running", "generation_id string, lease long, writes long")
        self.text = handle.getValueState("text", "content string")

    def ended(self, key, running: list, content: str | None, status: str, at: int) -> tuple:
        if content is None:
            content = self.text.get()[0] if self.text.exists() else ""
        return key[0], running[0], status, int(at), int(running[2]), content

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = list(self.running.get()) if self.running.exists() else None
        lease, content, out = now and int(now[1]), None, []
        for e in pd.concat(list(rows)).sort_values(["at_ms", "event_id"]).itertuples():
            if now and now[1] <= e.at_ms:
                out.append(self.ended(key, now, content, "failed", now[1]))
                now = None
            if e.op == "begin" and now is None:
                now, content = [e.generation_id, int(e.at_ms) + self.lease_ms, 0], ""
            elif now and now[0] == e.generation_id:
                if e.op == "renew":
                    now[1] = int(e.at_ms) + self.lease_ms
                elif e.op == "write":
                    now[2], content = now[2] + 1, (e.content or "")[:SAVED_CHARS]
                elif e.op in ("finish", "cancel"):
                    out.append(self.ended(key, now, content, "complete" if e.op == "finish" else "cancelled", e.at_ms))
                    now = None
        if lease is not None:
            self.handle.deleteTimer(lease)
        if now is None:
            self.running.clear()
            self.text.clear()
        else:
            self.running.update((now[0], int(now[1]), int(now[2])))
            if content is not None:
                self.text.update((content,))
            self.handle.registerTimer(int(now[1]))
        if out:
            yield pd.DataFrame(out, columns=["chat_id", "generation_id", "status", "ended_ms", "writes", "content"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = list(self.running.get())
        yield pd.DataFrame([self.ended(key, now, None, "failed", now[1])], columns=["chat_id", "generation_id", "status", "ended_ms", "writes", "content"])
        self.running.clear()
        self.text.clear()


def generations(events: DataFrame, lease_ms: int = LEASE_MS, delay: str = "1 minute") -> DataFrame:
    """Ended generations of a stream (chat_id, ts, at_ms, event_id, op, generation_id, content).

    One generation runs in a chat at a time. begin starts one unless another's lease still runs; renew and write
    count only for the running one before its lease ends; renew moves the lease; finish and cancel end it. A lease that
    ends fails the generation and keeps its text. State is one row per running chat and its text, and leaves with it.
    """
    rows = events.select("chat_id", "ts", "at_ms", "event_id", "op", "generation_id", "content").withWatermark("ts", delay)
    return keyed(rows, ["chat_id"], Generations(lease_ms), GENERATION)


class Uploads(StatefulProcessor):
    """When a file's upload began."""

    def __init__(self, limit_ms: int):
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.start = handle.getValueState("start", "at_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        start = int(self.start.get()[0]) if self.start.exists() else None
        known, out = start, []
        for e in pd.concat(list(rows)).sort_values(["at_ms", "op"], ascending=[True, False]).itertuples():
            if e.op == "start" and start is None:
                start = int(e.at_ms)
            elif e.op == "finish" and start is not None:
                out.append((key[0], "ready", int(e.at_ms)) if e.at_ms < start + self.limit_ms else (key[0], "failed", start + self.limit_ms))
                start = None
        if start != known:
            if known is not None:
                self.handle.deleteTimer(known + self.limit_ms)
            if start is None:
                self.start.clear()
            else:
                self.start.update((start,))
                self.handle.registerTimer(start + self.limit_ms)
        if out:
            yield pd.DataFrame(out, columns=["file_id", "status", "at_ms"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame([(key[0], "failed", int(self.start.get()[0]) + self.limit_ms)], columns=["file_id", "status", "at_ms"])
        self.start.clear()


def stale_uploads(events: DataFrame, limit_ms: int = 180_000, delay: str = "1 minute") -> DataFrame:
    """Uploads (file_id, ts, at_ms, op start or finish) with their end: ready within the limit, else failed for good."""
    rows = events.select("file_id", "ts", "at_ms", "op").withWatermark("ts", delay)
    return keyed(rows, ["file_id"], Uploads(limit_ms), "file_id string, status string, at_ms long")


class Assembly(StatefulProcessor):
    """The frames of an answer as a list, to which each batch appends its own, and where the answer stands."""

    def __init__(self, silence_ms: int):
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.frames = handle.getListState("frames", "seq long, text string, finish string, bad boolean")
        self.stand = handle.getValueState("stand", "frames long, top long, last long")

    @staticmethod
    def whole(key, frames, top: int | None, late: bool) -> pd.DataFrame | None:
        """The answer from all frames (of one number the first counts), or None while some before `top` are missing."""
        held = {}
        for seq, text, finish, bad in frames:
            held.setdefault(int(seq), (text, finish, bad))
        whole = top is not None and all(k in held for k in range(top + 1))
        if not whole and not late:
            return None
        text = "".join(held[k][0] for k in sorted(held))
        ok = whole and held[top][1] == "stop" and not any(f[2] for f in held.values()) and text.strip() and len(text) <= ANSWER_CHARS
        return pd.DataFrame([(key[0], text, "complete" if ok else "failed")], columns=["message_id", "content", "status"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.stand.exists()
        count, top, last = self.stand.get() if known else (0, -1, 0)
        before, new = int(last), []
        for batch in rows:
            new += [(int(seq), text or "", finish or "", bool(bad)) for seq, text, finish, bad in zip(batch["seq"], batch["text"], batch["finish"], batch["bad"])]
            last = max(int(last), int(batch["ts"].max().timestamp() * 1000))
        count += len(new)
        top = max([int(top), *(f[0] for f in new if f[2])])
        # Fewer frames than numbers up to the last one: nothing has to be read. An answer that comes whole in one batch never enters the state.
        full = top >= 0 and count > top
        done = self.whole(key, new, int(top), False) if full and not known else None
        if done is None:
            self.frames.appendList(new)
            done = self.whole(key, self.frames.get(), int(top), False) if full and known else None
            if done is not None:
                self.frames.clear()
                self.stand.clear()
        if before:
            self.handle.deleteTimer(before + self.silence_ms)
        if done is not None:
            yield done
            return
        self.stand.update((int(count), int(top), int(last)))
        self.handle.registerTimer(int(last) + self.silence_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        top = int(self.stand.get()[1])
        yield self.whole(key, self.frames.get(), top if top >= 0 else None, True)
        self.frames.clear()
        self.stand.clear()


def answers(frames: DataFrame, delay: str = "10 minutes", silence_ms: int = 150_000) -> DataFrame:
    """Finished answers of a stream (message_id, ts, seq, text, finish, bad), each with its status, whatever batches its frames came in.

    An answer ends when a frame with a finish and all before it (seq counts from 0) have come, or fails once the
    watermark is `silence_ms` past its last frame. A frame is written into state once and leaves with its answer; the watermark
    drops frames that come later still. Statuses are those of assemble_answers, texts are whole.
    """
    rows = frames.select("message_id", "ts", "seq", "text", "finish", "bad").withWatermark("ts", delay)
    return keyed(rows, ["message_id"], Assembly(silence_ms), "message_id string, content string, status string")


def run_available(stream: DataFrame, path: str, mode: str = "append", keys: tuple[str, ...] = ()) -> DataFrame:
    """Drain a stream into Parquet below path and read the result.

    In update mode each batch writes only what it changed, below its own number (a batch that runs again overwrites
    itself), and the last row of each key counts.
    """
    spark = stream.sparkSession
    writer = stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        q = writer.format("parquet").option("path", f"{path}/rows").outputMode("append").start()
        q.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{path}/rows")
    q = writer.outputMode(mode).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/rows/batch={n}")).start()
    q.awaitTermination()
    rows = spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last")).select(*keys, *[f"last.{c}" for c in rest])


def publish_files(spark: SparkSession, files: str, schema: str, store: str, checkpoint: str, imported_at: str, staging: str | None = None, buckets: int = BUCKETS):
    """Publish release files (JSON lines of nested profiles with release, release_size and ordinal) as they arrive, in parts of any size.

    Each batch is staged under its number. A release is published once as many ordinals as its release_size says have come, in
    whatever batches; of an ordinal that comes again the latest row counts (only then rows are dealt out by ordinal). What is staged of it then goes. Staging and
    publishing are idempotent, so a batch that runs again after a failure leaves the same tables. A batch gathers only
    the names of its releases.
    """
    staging = staging or f"{checkpoint.rstrip('/')}-staged"
    source = spark.readStream.schema(schema).json(files)

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("release").parquet(f"{staging}/batch={number}", compression=CODEC)
        names = [r[0] for r in spark.read.schema(batch.schema).parquet(f"{staging}/batch={number}").select("release").distinct().orderBy("release").collect()]
        kinds = T.StructType([*batch.schema.fields, T.StructField("batch", T.LongType())])
        staged = spark.read.schema(kinds).option("basePath", staging).parquet(f"{staging}/batch=*").where(F.col("release").isin(names))
        have = staged.groupBy("release").agg(F.countDistinct("ordinal").alias("n"), F.count("*").alias("rows"), F.max_by("release_size", "batch").alias("size")).where("n >= size")
        for name, given, ordinals in sorted(map(tuple, have.select("release", "rows", "n").collect())):
            rows = staged.where(F.col("release") == name).withColumn("_place", F.lit(1))
            if given > ordinals:
                latest = W.partitionBy("ordinal").orderBy(F.desc("batch"))
                rows = rows.withColumn("_place", F.row_number().over(latest)).where("_place = 1")
            publish(store, rows.drop("release", "release_size", "batch", "_place"), name, imported_at, buckets)
            for held in staged.where(F.col("release") == name).select("batch").distinct().collect():
                gone(spark, f"{staging}/batch={held.batch}/release={name}")

    return source.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(step).start()
