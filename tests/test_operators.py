"""Known answers and hostile rows for single operators."""

import datetime
import random

from pyspark.sql import functions as F

from cohortspark.functions import budgets, files, texts
from cohortspark.operators import batch, citations, cohort, conversations, publish, quotas
from cohortspark.sources import files as sources


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_numeric_summary(spark):
    rows = [("a", 100.0), ("a", None), ("a", 0.0), ("a", 300.0), ("b", 10.0), ("b", 30.0), ("c", float("nan")), ("c", float("inf")), ("c", None)]
    got = {r.g: r for r in cohort.numeric_summary(spark.createDataFrame(rows, "g string, v double"), ["v"], ["g"]).collect()}
    assert (got["a"].n, got["a"].missing, got["a"].min, got["a"].max, got["a"].median) == (3, 1, 0, 300, 100)
    assert got["b"].median == 20 and (got["c"].n, got["c"].missing, got["c"].median) == (0, 3, None)


def test_literal_search(spark):
    rows = [("100%_a\\b",), ("ÄB",), (None,), ("äb",), ("x' or 1=1",)]
    df = spark.createDataFrame(rows, "t string")
    hits = lambda term: [r.t for r in df.where(cohort.contains_literal(F.col("t"), term)).collect()]
    assert hits("%_A\\B") == ["100%_a\\b"] and hits("äb") == ["äb"] and hits("' OR 1") == ["x' or 1=1"] and hits("_") == ["100%_a\\b"]


def test_filters_come_before_latest(spark):
    p = spark.createDataFrame([("p1", "a", "2023-24", 1, "reviewed", "d", 3.9, 500), ("p2", "a", "2024-25", 1, "reviewed", "d", 3.0, 500)], "id string, account_id string, cycle string, is_current int, review_status string, observed_at string, gpa double, mcat int")
    a = spark.createDataFrame([("a", "sdn", "h")], "id string, source string, public_handle string")
    o = spark.createDataFrame([("p1", "2023-24", "accepted", "X", 1), ("p1", "2024-25", "accepted", "X", 0), ("p1", "2023-24", "rejected", "Y", 0)], "profile_id string, cycle string, status string, school string, conditional int")
    assert [r.id for r in cohort.search(p, a, o, gpa_min=3.5).collect()] == ["p1"]
    assert cohort.search(p, a, o, statuses=["accepted"]).count() == 0
    assert cohort.search(p, a, o, statuses=["rejected"], school="x").count() == 0
    assert [r.id for r in cohort.search(p, a, o, statuses=["rejected"], school="y").collect()] == ["p1"]


def test_batch_of_one_is_the_search(spark):
    from cohortspark.plans.fixtures import derived

    t = lambda n: derived(spark, "/root/testdata/sf0.001", n)
    request = spark.createDataFrame([(1, 3.0, None, None, 520, None, None, ["accepted"], None)], "request_id long, gpa_min double, gpa_max double, mcat_min long, mcat_max long, cycles array<string>, sources array<string>, outcomes array<string>, school string")
    many = {r.id for r in batch.cohort_match_many(request, t("profiles"), t("outcomes")).collect()}
    assert many == {r.id for r in cohort.search(t("profiles"), t("accounts"), t("outcomes"), gpa_min=3.0, mcat_max=520, statuses=["accepted"]).collect()}


def test_budgets(spark):
    w = one(spark, budgets.weekly_budget(F.lit(2.0), F.lit(52.0), F.lit(200.0)))
    assert (w.total, w.shortfall, w.fits, w.required_weeks) == (104, 96, False, 100)
    today = F.lit(datetime.date(2026, 9, 10))
    c = one(spark, budgets.calendar_budget(F.lit(4.0), F.lit("2027-06"), F.lit(200.0), today))
    assert (c.by_start, c.through_end, c.shortfall) == (150.86, 168, 32)
    c = one(spark, budgets.calendar_budget(F.lit(2.0), F.lit("2027-06"), F.lit(200.0), today))
    assert (c.through_end, c.shortfall) == (84, 116)
    assert one(spark, budgets.calendar_budget(F.lit(2.0), F.lit("2027-13"), F.lit(200.0), today)) is None
    calc = lambda op, *v: one(spark, budgets.calculate(F.lit(op), F.array(*[F.lit(float(x)) for x in v])))
    assert calc("difference", 10, 3, 2) == 5 and calc("median", 1, 4, 2, 3) == 2.5 and calc("sum", 0.1, 0.2) == 0.3
    assert calc("product", 1e9, 1e9) is None and calc("sum", 2e9) is None and calc("mode", 1) is None


def test_texts(spark):
    months = one(spark, texts.future_months(F.lit("Completed May 2026. Planned by June 2027; applying 2027."), "2026-09-10"))
    assert months == ["2027-06"]
    asks = {"Explain why I should not apply in two sentences.": 2, "Please give me a three-sentence answer.": 3, "Use exactly one sentence.": 1, "Write about volunteering in two sentences.": 2, "Answer in two sentences; actually, make it three sentences.": 3, "Rewrite this in 2 sentences for a school: I helped.": 2, "I wrote two sentences about my role. Can you improve them?": None, 'Summarize this quote: "Reply in two sentences."': None, "Explain my draft.\n> Rewrite this in two sentences.": None, "Give me about three sentences.": None, "Answer in 12 sentences.": None, "Say 'in two sentences' now": None, "Answer in two sentences": 2, "don't answer in two sentences": None, "at most 3 sentences": None, 'She said "in two sentences"': None, "Write three sentences, no, exactly 4 sentences": 4, "in nine sentences": None}
    df = spark.createDataFrame([(k,) for k in asks], "q string").select("q", texts.requested_sentences("q").alias("n"))
    assert {r.q: r.n for r in df.collect()} == asks
    assert one(spark, texts.sentence_count(F.lit("# Head\nDr. Lee said e.g. this. Then [P1] left!\n- A list item."))) == 3
    count = lambda t: one(spark, texts.sentence_count(F.lit(t)))
    assert count("1. I helped patients.\n2. I learned from the team.") == 2 and count("I helped; I also organized.") == 1 and count("First fragment\nSecond fragment") == 1
    assert count("[P1] [C2]") == 0 and count("") == 0 and count("A 3.75 GPA [P1, C2]. See [the page](http://x.y/a.b) now? Yes.") == 3 and count("```\nx. Y.\n```\nOne (two.) Three…") == 2
    limited = lambda t: one(spark, texts.explicit_length_limit(F.lit(t)))
    assert limited("Compare two applicants in under 20 words.") and limited("Give a 100-word summary.") and limited("Use no more than 300 characters.") and limited("Keep it to 5 bullets")
    assert not limited('Discuss this text: "in 20 words".') and not limited("Compare two applicants.") and not limited("I read 20 words")
    check = lambda q, t: one(spark, texts.sentence_check(F.lit(q), F.lit(t)))
    assert tuple(check("Rewrite this in 2 sentences: x", "One only.")) == (2, 1, False) and check("Rewrite", "One.") is None
    assert one(spark, texts.safe_name(F.lit("a/b\\c\x01"))) == "a_b_c_" and one(spark, texts.safe_name(F.lit(""))) == "attachment"
    df = spark.createDataFrame([("see [P1, P2] and [P3] and [P1](x)", ["P1", "P2"])], "t string, ids array<string>")
    assert df.select(texts.link_citations("t", "ids").alias("x")).first()["x"] == "see [P1](#source-P1) [P2](#source-P2) and [P3] and [P1](x)"


def test_files(spark):
    verdict = lambda name, body, size=None: one(spark, files.file_verdict(F.lit(name), F.lit(len(body) if size is None else size), F.lit(body)))
    assert verdict("a.pdf", b"x%PDF-1") == "application/pdf" and verdict("a.pdf", b"no") == "invalid_file" and verdict("a.txt", b"") == "empty_file"
    assert verdict("a.exe", b"MZ") == "unsupported_file" and verdict("a.txt", b"x", 9 << 20) == "file_too_large" and verdict("b.JPG", b"\xff\xd8\xff0") == "image/jpeg"
    text = lambda t: one(spark, files.extraction_verdict(F.lit(t), F.lit(True)))
    assert text("# scan.pdf\n## Contents\n### Page 1\n ") == "empty_extraction" and text("a\0" + "b" * 20) == "extraction_failed" and text("b" * 80_001) == "extraction_too_large" and text("GPA 3.75. MCAT 515. Clinical.") == "ready"


def test_leases_are_strict(spark):
    df = spark.createDataFrame([(1, "c", 0), (2, "c", 179_999), (3, "c", 359_999), (4, "c", 360_000)], "event_id long, chat_id string, at_ms long")
    assert sorted(r.renewals for r in conversations.lease_chains(df).collect()) == [2, 2]


def test_citations(spark):
    assert one(spark, citations.cited_ids(F.lit("a [P1] [P2, C3] [P99] [x W4y] [P1\n]"))) == ["P1", "P2", "C3", "P99"]
    assert one(spark, citations.cited_ids(F.lit(None).cast("string"))) == []
    history = spark.createDataFrame([("c", "A12", None), ("c", "A8", "3"), ("c", "C8", None), ("c", "A123456789", None)], "chat_id string, id string, key string")
    new = spark.createDataFrame([("c", 1, "A", "3"), ("c", 2, "A", "4"), ("d", 1, "P", "x")], "chat_id string, seq int, prefix string, key string")
    assert {(r.chat_id, r.key): r.id for r in citations.citation_ledger(history, new).collect()} == {("c", "3"): "A8", ("c", "4"): "A13", ("d", "x"): "P1"}


def test_sentences(spark):
    """The source's own cases, then abbreviations, decimals, quotes, ellipses, other scripts and edges."""
    cases = {
        "Dr. Lee supervised my clinic role. I earned a 3.8 GPA. [P1, P2]": 2, "1. I helped patients.\n2. I learned from the team.": 2, "I helped patients; I also organized appointments.": 1, "First fragment\nSecond fragment": 1, "[P1] [C2]": 0,
        "I assisted patients with scheduling (e.g. finding the right appointment). I volunteered weekly.": 2,
        "": 0, "...": 0, "?!": 0, "Wait... what?": 1, "Wait... What?": 2, "Really?! Yes.": 2, "He said \"Go.\" She went.": 2, "He said (go.) then left.": 1, "U.S. policy is A.B.C. now.": 1, "Version 1.2.3 came. It works.": 2, "Score 3.5! Good": 2, "One.Two": 1, "one.two three": 1, "End.) Next": 2,
        "Prof. Ada and Mrs. Bo agreed. i.e. all": 1, "I.E. All of it.": 1, "Yes.  5 days left.": 1, "Yes. 5 Days left.": 2, "Это раз. Это два.": 2, "你好。再见。": 2, "a. b. c.": 1, "No stop": 1, "Stop!, then go.": 1, "x. — y": 1, "```code. Code.``` Text.": 1, "# Head. Line\nBody.": 1, "See [this. That](http://x.y/a.B) now.": 2, "½. ½.": 2, "Fin.\u200b Next.": 2,
    }
    rows = spark.createDataFrame([(t, n) for t, n in cases.items()] + [(None, None)], "t string, n int").withColumn("got", texts.sentence_count(F.col("t"))).collect()
    assert [(r.t, r.got) for r in rows] == [(r.t, r.n) for r in rows]


def test_citation_links(spark):
    known = ["P1", "W-2", "calc_3", "a" * 31, "Z"]
    cases = {"[P1]": "[P1](#source-P1)", "[P1 ,W-2] [P1](x)": "[P1](#source-P1) [W-2](#source-W-2) [P1](x)", "[P1, Q]": "[P1, Q]", "[calc_3][Z]": "[calc_3](#source-calc_3)[Z](#source-Z)", f"[{'a' * 31}]": f"[{'a' * 31}](#source-{'a' * 31})", f"[{'a' * 32}] [1P] [P1,]": f"[{'a' * 32}] [1P] [P1,]", "[P١]": "[P١]"}
    df = spark.createDataFrame([(t, known) for t in cases] + [("[P1]", None), (None, known)], "t string, k array<string>")
    assert [r.x for r in df.select(texts.link_citations(F.col("t"), F.col("k")).alias("x")).collect()] == [*cases.values(), "[P1]", None]


def test_admission(spark):
    rows = [("u", f"f{k:02d}", k, 30 << 20) for k in range(4)] + [("u", "f9", 9, 1), ("v", "g", 0, 1)]
    got = {r.id: r.verdict for r in quotas.admit_storage(spark.createDataFrame(rows, "user_id string, id string, at_ms long, size long")).collect()}
    assert [got[k] for k in ("f00", "f01", "f02", "f03", "f9", "g")] == ["accepted", "accepted", "storage_limit", "storage_limit", "accepted", "accepted"]
    many = [("u", f"{k:03d}", k, 1) for k in range(25)] + [("u", "x", quotas.DAY_MS, 1)]
    verdicts = [r.verdict for r in quotas.admit_storage(spark.createDataFrame(many, "user_id string, id string, at_ms long, size long")).orderBy("id").collect()]
    assert verdicts.count("accepted") == 21 and verdicts.count("daily_limit") == 5


def test_admission_of_hot_users(spark):
    """Ten users with thousands of uploads, many small ones and the null user, against a plain fold, over batches of a few rows."""
    r = random.Random(8)
    rows = [(f"hot{u}" if u else None, f"{u}-{k:05d}", r.randrange(40) * quotas.DAY_MS // 4, r.choice([0, 1 << 20, 5 << 20, 70 << 20, None])) for u in range(11) for k in range(400)]
    rows += [(f"u{k}", f"s{k}-{i}", i, 1) for k in range(300) for i in range(3)]
    want, held = {}, {}
    for user, key, at, size in sorted(rows, key=lambda x: (x[0] or "", x[2], x[1])):
        count, used, days = held.setdefault(user, [0, 0, {}])
        today = days.get(at // quotas.DAY_MS, 0)
        want[key] = "daily_limit" if today >= 4 else "storage_limit" if count >= 30 or used + (size or 0) > quotas.BYTES else "accepted"
        if want[key] == "accepted":
            held[user] = [count + 1, used + (size or 0), {**days, at // quotas.DAY_MS: today + 1}]
    df = spark.createDataFrame(rows, "user_id string, id string, at_ms long, size long")
    for size in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = {x.id: x.verdict for x in quotas.admit_storage(df, files=30, per_day=4).collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == want and len(set(want.values())) == 3


def test_frames(spark):
    block = 'event: x\r\ndata: {"choices": [{"delta": {"content": "Hi "}}]}\r\n'
    rows = [("m", 1, block), ("m", 2, ": nothing"), ("m", 3, 'data: {"choices": [{"delta": {"content": "you"}, "finish_reason": "stop"}]}'), ("m", 4, "data: [DONE]"), ("n", 1, "data: {broken")]
    frames = sources.read_event_frames(spark.createDataFrame(rows, "message_id string, seq int, block string"))
    got = {r.message_id: r for r in conversations.assemble_answers(frames).collect()}
    assert (got["m"].content, got["m"].status, got["n"].status) == ("Hi you", "complete", "failed")


def test_publish_keeps_identity(spark):
    cols = "id string, account_id string, cycle string, version int, gpa double, is_current int"
    old = spark.createDataFrame([("a", "x", "2023-24", 1, 3.0, 1), ("b", "x", "2024-25", 1, 3.0, 1)], cols)
    new = spark.createDataFrame([("a", "moved", "2024-25", 9, 3.5, 5), ("c", "x", "2023-24", 2, 3.6, 6)], "id string, account_id string, cycle string, version int, gpa double, ordinal int")
    got = {r.id: (r.account_id, r.version, r.gpa, r.is_current) for r in publish.publish_profiles(old, new).collect()}
    assert got["a"][:3] == ("x", 1, 3.5) and got["c"] == ("x", 2, 3.6, 1) and got["b"] == ("x", 1, 3.0, 1)


def test_read_release(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text('{"version": 1, "release": "r", "profiles": [{"id": "a", "gpa": 3.5, "outcomes": [{"status": "accepted"}]}, {"id": "b"}]}')
    got = sources.read_release(spark, str(path)).orderBy("ordinal").collect()
    assert [r.p.id for r in got] == ["a", "b"] and got[0].p.outcomes[0].status == "accepted" and len(got[0].content_sha256) == 64
    assert sources.artifact_digests(spark, str(tmp_path)).first()["name"] == "r.json"


def test_batch_activity(spark):
    p = spark.createDataFrame([("p1", "a", "2023-24", 1, "reviewed", "d", 3.9, 500, '{"category":"Lab_Work"}'), ("p2", "b", "2023-24", 1, "reviewed", "d", None, None, None)], "id string, account_id string, cycle string, is_current int, review_status string, observed_at string, gpa double, mcat long, activities_json string").withColumn("source", F.lit("sdn"))
    o = spark.createDataFrame([], "profile_id string, cycle string, status string, school string, conditional int")
    cols = "request_id long, gpa_min double, gpa_max double, mcat_min long, mcat_max long, cycles array<string>, sources array<string>, outcomes array<string>, school string, activity string"
    asked = spark.createDataFrame([(1, None, None, None, None, None, None, None, None, "lab_w"), (2, None, None, None, None, None, None, None, None, None), (3, None, 4.0, None, None, None, None, None, None, None), (4, 3.9, 3.9, 500, 500, None, ["sdn"], None, None, "work"), (5, 3.0, 2.0, None, None, None, None, None, None, None)], cols)
    got = sorted((r.request_id, r.id) for r in batch.cohort_match_many(asked, p, o).collect())
    assert got == [(1, "p1"), (2, "p1"), (2, "p2"), (3, "p1"), (4, "p1")]


def test_admission_over_the_tables(spark):
    """The registered admission against a plain fold of the same rows."""
    from cohortspark.plans.fixtures import derived
    from cohortspark.registry import QUERIES

    sf = "/root/testdata/sf0.001"
    files, used, days, want = {}, {}, {}, {}
    for r in derived(spark, sf, "attachments").orderBy("created_at", "id").collect():
        d = (r.user_id, r.created_at // quotas.DAY_MS)
        if days.get(d, 0) >= quotas.UPLOADS:
            want[r.id] = "daily_limit"
        elif files.get(r.user_id, 0) >= quotas.FILES or used.get(r.user_id, 0) + r.size > quotas.BYTES:
            want[r.id] = "storage_limit"
        else:
            want[r.id] = "accepted"
            files[r.user_id], used[r.user_id], days[d] = files.get(r.user_id, 0) + 1, used.get(r.user_id, 0) + r.size, days.get(d, 0) + 1
    got = {r.id: r.verdict for r in QUERIES["admit_storage"](spark, sf).collect()}
    assert got == want and len(set(got.values())) > 1


def test_a_number_with_full_stops_is_no_mark_before_it(spark):
    """As in the SQL: the full stops of an address end nothing, so the next letter decides on the one before."""
    text = "He said die. 75.201.227.208 ppp and so on. So."
    assert one(spark, texts.sentence_count(F.lit(text))) == 2


def test_check_of_an_answer_with_an_address(spark):
    got = one(spark, texts.sentence_check(F.lit("Answer in two sentences."), F.lit("It is die. 80.134.228.59 chlla now. So.")))
    assert tuple(got) == (2, 2, True)


def test_budget_sorts_no_arguments(spark):
    """Arguments are measured before calls are dealt out and sorted; null ones are not oversized."""
    calls = spark.createDataFrame([(1, 0, 0, "calculate", "x" * 5001), (1, 0, 1, "calculate", None), (1, 0, 2, "other", "{}")], "answer_id long, round int, seq int, tool string, args string")
    got = conversations.tool_call_budget(calls)
    assert [r.verdict for r in got.orderBy("seq").collect()] == ["too_large", "admitted", "unknown_tool"]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and not any("args" in line for line in plan.split("\n") if "Window" in line or "Sort" in line)
    assert "args" not in plan[: plan.rindex("Window")]
