"""Publishing into a store: identity, repeated releases, unfinished versions; saved answers and numbered lines."""

import hashlib
import json
import pathlib
import random

from pyspark.sql import functions as F

from cohortspark.operators import cohort, conversations, publish
from cohortspark.sources import files, store

PROFILE = """id string, account_id string, source string, source_account_id string, public_handle string, cycle string, version int, review_status string, gpa double,
activities array<struct<category:string>>, outcomes array<struct<cycle:string,status:string,school:string,conditional:int>>, content_sha256 string, ordinal long"""


def profile(id, account, handle, ordinal, outcomes=(), cycle="2023-24", version=1):
    return (id, f"sdn:{account}", "sdn", account, handle, cycle, version, "reviewed", 3.0, [("research",)], list(outcomes), id * 3, ordinal)


def stored(spark, path):
    return {name: sorted(map(tuple, df.collect()), key=str) for name, df in store.read_corpus(spark, path).items()}


def test_store(spark, tmp_path):
    path = str(tmp_path / "store")
    assert store.read_corpus(spark, path) is None
    first = spark.createDataFrame([profile("a", "x", "old", 0, [("2023-24", "accepted", "S", None), ("2023-24", "rejected", None, 1)]), profile("b", "y", "bee", 1)], PROFILE)
    second = spark.createDataFrame([profile("a", "moved", "new", 0, [("2023-24", "pending", None, None)], version=7), profile("c", "x", None, 1, version=2)], PROFILE)
    store.publish(path, first, "r1", "t1")
    store.publish(path, second, "r2", "t2")
    once = stored(spark, path)
    assert [r[:4] for r in once["accounts"]] == [("sdn:moved", "sdn", "moved", "new"), ("sdn:x", "sdn", "x", None), ("sdn:y", "sdn", "y", "bee")]
    rows = {r.id: r for r in store.read_corpus(spark, path)["profiles"].collect()}
    assert (rows["a"].account_id, rows["a"].version, rows["c"].is_current, rows["b"].is_current) == ("sdn:x", 1, 1, 1)
    assert rows["a"].activities_json == '[{"category":"research"}]'
    assert [(r[0], r[4]) for r in once["outcomes"]] == [("a:0", "pending")]
    assert [(r[0], r[2], r[3], r[4]) for r in once["imports"]] == [("r1", "t1", 2, 2), ("r2", "t2", 2, 2)]
    # The same release again changes nothing but adds a version; an unfinished one is never read.
    store.publish(path, second, "r2", "t2")
    assert stored(spark, path) == once
    first.write.parquet(f"{path}/v-00000009/profiles")
    assert stored(spark, path) == once and store.versions(spark, path)[-1] == (9, False)
    store.publish(path, second, "r2", "t2")
    # The first version still holds the buckets that no later release touched; the second one is needed no more.
    assert stored(spark, path) == once and [n for n, _ in store.versions(spark, path)] == [1, 3, 10]


def test_a_release_writes_what_it_touches(spark, tmp_path):
    """Rows written follow the release: a later one of a single account leaves all other buckets where they lie."""
    path = str(tmp_path / "store")
    big = [profile(f"p{k}", f"a{k}", "h", k, [("2023-24", "accepted", "S", None)] * 3) for k in range(400)]
    store.publish(path, spark.createDataFrame(big, PROFILE), "r1", "t1", 32)
    store.publish(path, spark.createDataFrame([profile("p7", "elsewhere", "new", 0)], PROFILE), "r2", "t2")
    rows = lambda v, name: spark.read.parquet(f"{path}/v-{v:08d}/{name}").count()
    # Two of 32 buckets at most: the account that is named and the one that the profile has had.
    assert rows(1, "profiles") == 400 and rows(2, "profiles") < 60 and rows(2, "outcomes") < 120
    got = store.read_corpus(spark, path)
    assert got["profiles"].count() == 400 and got["outcomes"].count() == 399 * 3 and got["accounts"].count() == 401
    kept = got["profiles"].where("id = 'p7'").first()
    assert (kept.account_id, json.loads(kept.profile_json)["public_handle"]) == ("sdn:a7", "new")


def test_documents_come_back(spark, tmp_path):
    """A release file, read, validated, published and inspected: the profile's document is its own text."""
    raw = {"id": "p1", "accountId": "sdn:x", "source": "sdn", "sourceAccountId": "X", "publicHandle": "X", "cycle": "2023-24", "gpa": 3.5, "scienceGpa": None, "mcat": 510, "residence": None, "summary": "s", "timingStatus": "cycle_report", "reviewStatus": "reviewed", "extractionConfidence": "high", "observedAt": "d", "notes": ["n"], "extra": {"kept": [1, None]},
           "activities": [{"category": c, "description": "d", "hours": {"min": None, "max": None, "precision": "unreported"}} for c in ("clinical", "research")], "sourceUrls": ["https://forums.studentdoctor.net/x"],
           "outcomes": [{"status": "accepted", "program": "MD", "school": None, "cycle": "2023-24", "reportedCount": 2, "countKind": "exact", "evidence": "e", "sourceUrl": "https://forums.studentdoctor.net/x", "conditional": True}], "provenance": {"sourceContentSha256": "a" * 64, "sourceArtifactKey": "corpus/x"}}
    (tmp_path / "r.json").write_text(json.dumps({"version": 1, "release": "r", "profiles": [raw]}))
    (tmp_path / "e.json").write_text(json.dumps({"version": 2, "release": "e", "profiles": []}))
    headers = files.release_headers(spark, str(tmp_path / "*.json"))
    assert sorted(map(tuple, publish.validate_release(headers).collect())) == [("e", "empty_corpus"), ("e", "format_version")]
    nested = publish.release_profiles(files.read_release(spark, str(tmp_path / "r.json")))
    assert publish.validate_corpus(nested).count() == 0
    store.publish(str(tmp_path / "store"), nested, "r", "t", 4)
    corpus = store.read_corpus(spark, str(tmp_path / "store"))
    found = cohort.inspect_profiles(corpus["profiles"], spark.createDataFrame([("p1",)], "id string")).first()
    assert json.loads(found.profile_json) == raw
    o = corpus["outcomes"].first()
    assert (o.program, o.reported_count, o.count_kind, o.conditional, o.source_url, o.evidence) == ("MD", 2, "exact", 1, raw["sourceUrls"][0], "e")


def test_empty_release(spark, tmp_path):
    store.publish(str(tmp_path), spark.createDataFrame([], PROFILE), "none", "t")
    got = stored(spark, str(tmp_path))
    assert got["profiles"] == [] and got["imports"][0][0] == "none" and got["imports"][0][3:] == (0, 0)


def test_digest_depends_on_order(spark):
    digest = lambda rows: publish.release_digest(spark.createDataFrame(rows, "ordinal long, content_sha256 string")).first()[0]
    assert digest([(0, "a"), (25_000, "b")]) == digest([(25_000, "b"), (0, "a")]) != digest([(0, "b"), (25_000, "a")])


def test_lines_are_numbered_over_files(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"part-{k}").write_text("".join(f'{{"id": "p{k}-{i}"}}\n' for i in range(40 * (5 - k))) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        rows = files.read_release(spark, str(tmp_path), lines=True)
        got = [(r.ordinal, r.id) for r in rows.select("ordinal", "p.id").orderBy("ordinal").collect()]
        assert rows.rdd.getNumPartitions() > 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    lines = [f"p{k}-{i}" if i < 40 * (5 - k) else None for k in range(5) for i in range(40 * (5 - k) + 1)]
    assert got == [(n, x) for n, x in enumerate(lines) if x]


def test_answers_are_saved_under_their_lease(spark):
    m = spark.createDataFrame([(i, f"c{i}", "", "cancelled" if i == "d" else "running", '{"old":1}') for i in "abcd"], "id string, chat_id string, content string, status string, evidence_json string")
    chats = spark.createDataFrame([("ca", "a", 11), ("cb", "b", 10), ("cc", "other", 99), ("cd", "d", 99), ("ce", None, None)], "id string, generation_id string, lease_expires_at long")
    answers = spark.createDataFrame([(f"c{i}", i, "x" * 120_001, "complete", (None, "n")) for i in "abcd"], "chat_id string, message_id string, content string, status string, evidence struct<sources:array<string>,note:string>")
    got, left = conversations.write_evidence(m, chats, answers, 10)
    rows = {r.id: (len(r.content), r.status, r.evidence_json) for r in got.collect()}
    assert rows == {"a": (120_000, "complete", '{"sources":null,"note":"n"}'), "b": (0, "running", '{"old":1}'), "c": (0, "running", '{"old":1}'), "d": (0, "cancelled", '{"old":1}')}
    assert {r.id: r.generation_id for r in left.collect()} == {"ca": None, "cb": "b", "cc": "other", "cd": "d", "ce": None}
    none = answers.withColumn("evidence", F.lit(None).cast("struct<sources:array<string>,note:string>"))
    assert conversations.write_evidence(m, chats, none, 10)[0].where("id = 'a'").first().evidence_json == '{"old":1}'


def test_artifact_digests(spark):
    from cohortspark.registry import QUERIES

    sf = "/root/testdata/sf0.001"
    want = {(f.name, hashlib.sha256(f.read_bytes()).hexdigest(), f.stat().st_size) for f in pathlib.Path(sf).glob("*.parquet")}
    assert {tuple(r) for r in QUERIES["artifact_digests"](spark, sf).collect()} == want


def test_artifacts_of_any_size(spark, tmp_path):
    """Files about a piece's size and of several pieces, and one that is too large for a row."""
    whole = random.Random(3).randbytes(12_345)
    for n in (0, 1, 999, 1000, 1001, 2000, 2001, 12_345):
        (tmp_path / f"a b%20#{n}.gz").write_bytes(whole[:n])
    got = {tuple(r) for r in files.artifact_digests(spark, str(tmp_path), piece=1000).collect()}
    assert got == {(f.name, hashlib.sha256(f.read_bytes()).hexdigest(), f.stat().st_size) for f in tmp_path.iterdir()} and len(got) == 8
    (tmp_path / "large").mkdir()
    with open(tmp_path / "large" / "x", "wb") as f:
        f.write(b"x")
        f.truncate((2 << 30) + 5)
    with open(tmp_path / "large" / "x", "rb") as f:
        want = hashlib.file_digest(f, "sha256").hexdigest()
    assert [tuple(r) for r in files.artifact_digests(spark, str(tmp_path / "large")).collect()] == [("x", want, (2 << 30) + 5)]


def test_broken_documents_are_null(spark):
    df = spark.createDataFrame([('{"a": 1}',), ("[",), ("",), (None,)], "t string")
    assert [r.parsed and r.parsed.a for r in files.parse_documents(df, "t", "a int").collect()] == [1, None, None, None]


def test_whole_rows_are_dealt_out_once(spark, tmp_path):
    """Profiles go to their buckets in one shuffle; an id that names another account or comes twice still ends where it belongs."""
    path = str(tmp_path / "store")
    rows = [profile(f"p{k}", f"a{k % 5}", "h", k) for k in range(20)]
    store.publish(path, spark.createDataFrame(rows, PROFILE), "r1", "t1", 4)
    corpus = store.read_corpus(spark, path)
    before = corpus["profiles"]
    again = before.withColumn("ordinal", F.lit(100).cast("long")).drop("is_current").where("id = 'p1'")
    dealt = publish.publish_profiles(before, again, store.bucket_of(F.col("account_id"), 4))
    assert dealt._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1
    assert "Join" not in dealt._jdf.queryExecution().optimizedPlan().toString()
    elsewhere = again.withColumn("account_id", F.lit("sdn:a2")).unionAll(again.withColumns({"account_id": F.lit("sdn:a3"), "ordinal": F.lit(99).cast("long")}))
    got = {r.id: r for r in publish.publish_profiles(before, elsewhere, store.bucket_of(F.col("account_id"), 4)).collect()}
    # p1 stays with a1, of whose profiles p16 was current; a2's are demoted, as the last row names it; a3's are not.
    assert len(got) == 20 and got["p1"].account_id == "sdn:a1" and got["p1"].is_current == 1 and got["p16"].is_current == 1
    assert (got["p17"].is_current, got["p18"].is_current) == (0, 1)


def test_publishing_leaves_no_shuffle_files(spark, tmp_path):
    """What a publication has shuffled goes with it; large tables are written in rounds, compressed well, each bucket in one of them."""
    import time

    places = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    shuffled = lambda: {f for d in places for f in pathlib.Path(d).rglob("shuffle_*.data")}
    rows = spark.createDataFrame([profile(f"p{k}", f"a{k % 40}", "h", k, [("2023-24", "accepted", "S", None)]) for k in range(200)], PROFILE)
    before = shuffled()
    for release in ("r1", "r2"):
        store.publish(str(tmp_path), rows, release, "t1", 8)
    waited = time.time() + 20
    while shuffled() - before and time.time() < waited:
        time.sleep(0.2)
    assert shuffled() <= before
    written = list(tmp_path.rglob("profiles/bucket=*/*.parquet"))
    assert all(".zstd." in f.name for f in written)
    # Each round has a job's id of its own in the names of its files.
    jobs = {f.name.split("-", 2)[2].rsplit("-", 1)[0] for f in written if "v-00000001" in str(f)}
    assert len(jobs) == store.ROUNDS["profiles"] and len({f.parent.name for f in written}) == 8
    got = store.read_corpus(spark, str(tmp_path))
    assert (got["profiles"].count(), got["outcomes"].count(), got["accounts"].count(), got["profiles"].where("is_current = 1").count()) == (200, 200, 40, 40)
