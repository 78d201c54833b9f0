"""Streams over several micro-batches, against the batch jobs or plain Python."""

import datetime

from cohortspark.streaming import jobs


def drained(spark, tmp_path, schema, batches, job):
    """Run a stream over files that arrive one batch after the other."""
    source, out = tmp_path / "in", str(tmp_path / "out")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        result = jobs.run_available(job(stream), out)
    return result.collect()


def at(second):
    return datetime.datetime(2024, 1, 1, 0, 0) + datetime.timedelta(seconds=second)


def ms(second):
    return 1_704_067_200_000 + second * 1000


def test_answers_over_batches(spark, tmp_path):
    schema = "message_id string, ts timestamp, seq long, text string, finish string, bad boolean"
    batches = [
        [("a", at(1), 1, "you ", None, False), ("b", at(1), 0, "cut", None, False), ("c", at(1), 0, "x", None, True)],
        [("a", at(2), 2, "there", "stop", False), ("c", at(2), 1, "y", "stop", False), ("d", at(3), 0, "long", "length", False)],
        [("a", at(3), 0, "Hi ", None, False), ("z", at(5000), 0, "late", None, False)],
        [("z", at(9000), 1, ".", None, False)],
        [("z", at(9100), 2, "!", "stop", False)],
    ]
    got = {r.message_id: (r.content, r.status) for r in drained(spark, tmp_path, schema, batches, jobs.answers)}
    assert got["a"] == ("Hi you there", "complete") and got["c"] == ("xy", "failed") and got["d"] == ("long", "failed")
    assert got["b"] == ("cut", "failed")


def test_generations_over_batches(spark, tmp_path):
    schema = "chat_id string, ts timestamp, at_ms long, event_id long, op string, generation_id string, content string"
    event = lambda s, k, op, g, text=None: ("c", at(s), ms(s), k, op, g, text)
    batches = [
        [event(0, 1, "begin", "g1"), event(10, 2, "write", "g1", "half")],
        # g2 begins while g1 runs and is refused; its writes are a stale writer's. g1's lease ends before its renewal.
        [event(20, 3, "begin", "g2"), event(30, 4, "write", "g2", "stale"), event(180, 5, "renew", "g1"), event(190, 6, "begin", "g3")],
        [event(200, 7, "write", "g1", "late"), event(210, 8, "write", "g3", "done"), event(220, 9, "cancel", "g1"), event(230, 10, "finish", "g3")],
    ]
    got = {r.generation_id: (r.status, r.ended_ms, r.writes, r.content) for r in drained(spark, tmp_path, schema, batches, jobs.generations)}
    assert got == {"g1": ("failed", ms(180), 1, "half"), "g3": ("complete", ms(230), 1, "done")}


def test_stale_uploads_over_batches(spark, tmp_path):
    schema = "file_id string, ts timestamp, at_ms long, op string"
    event = lambda f, s, op: (f, at(s), ms(s), op)
    batches = [
        [event("a", 0, "start"), event("b", 0, "start"), event("c", 0, "start")],
        [event("a", 100, "finish"), event("b", 180, "finish")],
        [event("d", 5000, "start")],
        [event("d", 5001, "finish")],
    ]
    got = sorted((r.file_id, r.status) for r in drained(spark, tmp_path, schema, batches, jobs.stale_uploads))
    assert got == [("a", "ready"), ("b", "failed"), ("c", "failed"), ("d", "ready")]


def test_verdicts_over_batches(spark, tmp_path):
    """Repeats and conflicts in later batches; after the time to live an id is new again and its state has gone."""
    schema = "chat_id string, request_id string, ts timestamp, content string"
    batches = [
        [("c", "r1", at(0), "hello"), ("c", "r2", at(1), None)],
        [("c", "r1", at(10), "hello"), ("d", "r1", at(11), "other"), ("c", "r1", at(12), "changed"), ("c", "r2", at(12), "")],
        [("c", "r9", at(50_000), "x")],
        [("c", "r1", at(50_001), "changed"), ("c", "r9", at(50_002), "y")],
    ]
    job = lambda s: jobs.request_verdicts(s, ["chat_id", "request_id"], 3_600_000, "1 second")
    rows = drained(spark, tmp_path, schema, batches, job)
    got = sorted((r.chat_id, r.request_id, int((r.ts - at(0)).total_seconds()), r.verdict) for r in rows)
    assert got == [("c", "r1", 0, "new"), ("c", "r1", 10, "repeat"), ("c", "r1", 12, "conflict"), ("c", "r1", 50_001, "new"), ("c", "r2", 1, "new"), ("c", "r2", 12, "repeat"), ("c", "r9", 50_000, "new"), ("c", "r9", 50_002, "conflict"), ("d", "r1", 11, "new")]
    state = spark.read.format("statestore").option("stateVarName", "first").load(f"{tmp_path}/out/checkpoint")
    assert sorted((r.key.chat_id, r.key.request_id) for r in state.select("key").collect()) == [("c", "r1"), ("c", "r9")]


def test_frames_are_written_once(spark, tmp_path):
    """Over twelve batches of one answer the entries written into state grow with the frames, not with their square."""
    schema = "message_id string, ts timestamp, seq long, text string, finish string, bad boolean"
    source, out, written = tmp_path / "in", tmp_path / "out", []
    for k in range(12):
        rows = [("a", at(k), 40 * k + i, "x" * 50, "stop" if (k, i) == (11, 39) else None, False) for i in range(40)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = jobs.answers(spark.readStream.schema(schema).parquet(str(source)))
        q = stream.writeStream.option("checkpointLocation", str(out / "c")).trigger(availableNow=True).format("parquet").option("path", str(out / "rows")).outputMode("append").start()
        q.awaitTermination()
        written.append(sum(p.stateOperators[0].customMetrics.get("rocksdbTotalBytesWritten", 0) for p in q.recentProgress if p.stateOperators))
    got = spark.read.parquet(str(out / "rows")).collect()
    assert [(len(r.content), r.status) for r in got] == [(480 * 50, "complete")]
    assert 0 < max(written[1:]) <= 2 * min(written[1:-1]), written


def test_releases_in_parts(spark, tmp_path):
    """However a release is split over batches, it is published once as a whole, with one ledger row."""
    from test_publishing import PROFILE, profile

    from cohortspark.sources import store

    rows = [profile(f"p{k}", f"a{k % 4}", "h", k) for k in range(10)]
    schema = PROFILE + ", release string, release_size long"
    for name, cuts in (("one", [10]), ("many", [1, 2, 7, 10])):
        files, path, start = str(tmp_path / name / "in"), str(tmp_path / name / "store"), 0
        for k, stop in enumerate(cuts):
            # The row before comes again with each part.
            part = [(*r, "r", 10) for r in rows[max(0, start - 1) : stop]]
            spark.createDataFrame(part, schema).write.json(f"{files}/{k}")
            jobs.publish_files(spark, f"{files}/*", schema, path, str(tmp_path / name / "c"), "t", buckets=4).awaitTermination()
            assert (store.read_corpus(spark, path) is None) == (stop < 10)
            start = stop
        corpus = store.read_corpus(spark, path)
        assert [(r.release, r.profile_count, r.account_count) for r in corpus["imports"].collect()] == [("r", 10, 4)]
        assert sorted(r.id for r in corpus["profiles"].collect()) == sorted(r[0] for r in rows)
        assert [n for n, _ in store.versions(spark, path)] == [1]
        left = [p for p in (tmp_path / name / "c-staged").rglob("*.parquet")]
        assert left == []


def test_whole_answers_do_not_enter_the_state():
    """An answer whose frames come in one batch is told from them; nothing is appended, updated or timed."""
    import pandas as pd

    class Untouched:
        def exists(self):
            return False

    frames = pd.DataFrame([(1, "there", "stop", False), (0, "Hi ", None, False)], columns=["seq", "text", "finish", "bad"]).assign(ts=at(1))
    job = jobs.Assembly(1000)
    job.handle, job.frames, job.stand = object(), Untouched(), Untouched()
    got = [tuple(r) for out in job.handleInputRows(("a",), iter([frames.iloc[:1], frames.iloc[1:]]), None) for r in out.itertuples(index=False)]
    assert got == [("a", "Hi there", "complete")]


def test_publishing_queries_drop_what_they_wrote(spark, tmp_path, monkeypatch):
    """Of stream_publish only the arrived files, the store and the checkpoint are left: no staged rows, not the release that the files were written from."""
    from cohortspark.plans.register import Tables
    from cohortspark.registry import QUERIES

    monkeypatch.setattr(Tables, "folder", lambda self, name: str(tmp_path / name))
    assert QUERIES["stream_publish"](spark, "/root/testdata/sf0.001").count() == 1500
    assert {f.relative_to(tmp_path).parts[0] for f in tmp_path.rglob("*.parquet")} == {"store"}
