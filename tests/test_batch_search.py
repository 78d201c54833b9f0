"""Batch search against the single one on random requests, exact medians, evidence edits and the replay of mixed calls."""

import json
import random
import statistics

import pytest

from cohortspark.operators import batch, citations, cohort, tools

PROFILES = "id string, account_id string, source string, cycle string, observed_at string, gpa double, mcat long, review_status string, is_current int, timing_status string, activities_json string"
OUTCOMES = "profile_id string, cycle string, status string, school string, conditional int"
REQUESTS = "request_id long, gpa_min double, gpa_max double, mcat_min double, mcat_max double, cycles array<string>, sources array<string>, outcomes array<string>, school string, activity string"


def corpus(spark, r, n=160):
    cycles = ["2021-22", "2022-23", "2023-24"]
    gpas = [None, float("nan"), float("inf"), float("-inf"), -1.0, 0.0, 1.95, 2.0, 3.1, 3.999, 4.0, 4.3, 99.0]
    mcats = [None, 0, 471, 472, 500, 528, 529, 530, 532, 10_000]
    p = [(f"p{k}", f"a{r.randrange(n // 3)}", r.choice(cohort.SOURCES), r.choice(cycles), f"2024-01-{1 + r.randrange(9):02d}", r.choice(gpas), r.choice(mcats), r.choice(["reviewed", "reviewed", "excluded"]), r.choice([1, 1, 0]), "cycle_report", r.choice([None, "Lab Work", "clinic"])) for k in range(n)]
    o = [(x[0], r.choice([x[3], "2021-22"]), r.choice(["accepted", "rejected", "pending"]), r.choice([None, "Alpha U", "beta"]), r.choice([0, 0, 1])) for x in p for _ in range(r.randrange(3))]
    return spark.createDataFrame(p, PROFILES), spark.createDataFrame(o, OUTCOMES)


def test_batch_equals_search(spark):
    """Bounds within, at and beyond the usual range; metrics below, above, null and not finite."""
    r = random.Random(11)
    p, o = corpus(spark, r)
    p, o = p.cache(), o.cache()
    some = lambda xs: None if r.random() < 0.6 else r.sample(xs, r.randrange(1, len(xs)))
    asked = [(k, r.choice([None, None, -2.0, 0.0, 2.0, 3.1, 4.1, 98.0]), r.choice([None, None, -0.5, 2.0, 3.5, 4.0, 50.0, 1e300]), r.choice([None, None, 0.0, 472.0, 500.0, 529.0]), r.choice([None, None, 471.0, 528.0, 531.0, 1e5]), some(["2021-22", "2022-23", "2023-24"]), some(list(cohort.SOURCES)), some(["accepted", "rejected", "pending"]), r.choice([None, None, "ALPHA"]), r.choice([None, None, "lab w"])) for k in range(24)]
    got = {}
    for row in batch.cohort_match_many(spark.createDataFrame(asked, REQUESTS), p, o).collect():
        got.setdefault(row.request_id, set()).add(row.id)
    for k, a, b, c, d, cycles, sources, statuses, school, activity in asked:
        rows = cohort.metric_range(cohort.in_cycles(cohort.reviewed_current(p), cycles), a, b, c, d)
        rows = cohort.activity_contains(rows, activity) if activity else rows
        rows = cohort.in_sources(rows, sources)
        rows = cohort.outcome_semi_join(rows, o, statuses, school) if statuses or school else rows
        assert got.get(k, set()) == {x.id for x in cohort.latest_matching_profile(rows).select("id").collect()}, k
    assert sum(map(len, got.values())) > 50


@pytest.mark.parametrize("seed", range(2))
def test_exact_medians(spark, seed):
    """Distinct doubles, ties, one value, even and odd numbers, null groups; no window over a whole group."""
    r = random.Random(seed)
    groups = {"many": [r.gauss(0, 1) for _ in range(30_001 + seed)], "ties": [float(r.randrange(3)) for _ in range(101 + seed)], "one": [2.5], "none": [None, float("nan")], None: [1.0, 4.0, float("inf")]}
    rows = [(g, x) for g, xs in groups.items() for x in xs]
    got = {x.g: x for x in cohort.numeric_summary(spark.createDataFrame(rows, "g string, v double"), ["v"], ["g"]).collect()}
    for g, xs in groups.items():
        known = [x for x in xs if x is not None and x == x and abs(x) != float("inf")]
        assert (got[g].n, got[g].missing) == (len(known), len(xs) - len(known))
        assert got[g].median == (statistics.median(known) if known else None)
    whole = cohort.numeric_summary(spark.createDataFrame(rows, "g string, v double"), ["v"]).first()
    known = [x for _, x in rows if x is not None and x == x and abs(x) != float("inf")]
    assert whole.median == statistics.median(known) and whole.n == len(known)


def test_median_with_a_wrong_sketch(spark, monkeypatch):
    monkeypatch.setattr(cohort, "MIDDLE", (0.9, 0.95))
    xs = [float(x) for x in range(1000)]
    assert cohort.numeric_summary(spark.createDataFrame([(x,) for x in xs], "v double"), ["v"]).first().median == 499.5
    monkeypatch.setattr(cohort, "MIDDLE", (0.1, 0.2))
    assert cohort.numeric_summary(spark.createDataFrame([(x,) for x in xs], "v double"), ["v"]).first().median == 499.5


def test_scrubbing_keeps_the_rest(spark):
    record = {"sources": [{"id": "A1", "kind": "attachment", "attachmentId": "f1"}, {"id": "A2", "kind": "attachment", "attachmentId": "f2", "x": None}, {"id": "A3", "kind": "attachment"}, {"id": "A4", "kind": "attachment", "attachmentId": None}, {"id": "W1", "kind": "web", "url": "u", "observedAt": "d"}, {"id": "Q", "kind": None}, {"id": "R"}], "cohort": {"a": 1.25, "b": [None, 123456789012345678], "c": {"d": "ü\"\n"}}, "notes": [], "more": True}
    texts = [json.dumps(record), json.dumps(record, indent=2), '{"z": 1}', "[1]", "broken", None, '{"sources": {}}']
    rows = [(str(k), "c", t, "kept") for k, t in enumerate(texts)] + [("other", "d", texts[0], "kept"), ("null chat", None, texts[0], None)]
    m = spark.createDataFrame(rows, "id string, chat_id string, evidence_json string, content string")
    removed = spark.createDataFrame([("c", "f1"), ("c", "f9"), ("c", "f1"), ("e", "f2")], "chat_id string, attachment_id string")
    got = {x.id: x for x in citations.scrub_evidence(m, removed).collect()}
    want = {**record, "sources": [s for s in record["sources"] if s["id"] not in ("A1", "A3", "A4")]}
    assert json.loads(got["0"].evidence_json) == json.loads(got["1"].evidence_json) == want
    assert json.loads(got["2"].evidence_json) == {"z": 1, "sources": []} and json.loads(got["6"].evidence_json) == {"sources": []}
    assert [got[k].evidence_json for k in ("3", "4", "5", "other", "null chat")] == ["[1]", "broken", None, texts[0], texts[0]]
    assert got["0"].content == "kept" and len(got) == len(rows)


def test_replay_of_searches(spark):
    p = spark.createDataFrame([("p1", "a1", "reddit", "2023-24", "d", 3.5, 510, "reviewed", 1, "cycle_report", None), ("p2", "a2", "sdn", "2023-24", "d", 3.0, None, "reviewed", 1, "cycle_report", "Lab")], PROFILES)
    o = spark.createDataFrame([("p2", "2023-24", "accepted", "S", 0)], OUTCOMES)
    call = lambda a, s, tool, args: (a, 0, s, tool, args if isinstance(args, str) else json.dumps(args))
    calls = [
        call("x", 0, "profile_inspect", {"id": "p1"}), call("x", 1, "cohort_search", {"sources": ["reddit"], "limit": 1}), call("x", 2, "profile_inspect", {"id": "p1"}), call("x", 3, "cohort_search", {"sources": ["sdn"], "limit": "many"}),
        call("x", 4, "profile_inspect", {"id": "p2"}), call("x", 5, "cohort_search", {}),
        call("y", 0, "cohort_search", {"gpaMin": 9}), call("y", 1, "cohort_search", {"gpaMin": 3.9}), call("y", 2, "profile_inspect", {"id": "p2"}), call("y", 3, "profile_inspect", {"id": "gone"}), call("y", 4, "calculate", {"operation": "sum", "values": [1, 2]}),
        call("z", 0, "cohort_search", "no json"), call("z", 1, "cohort_search", {"activity": "lab", "limit": 0}),
    ]
    before = spark.createDataFrame([("y", "p2"), ("y", "gone")], "answer_id string, id string")
    got = {(r.answer_id, r.seq): r for r in tools.replay_tool_calls(spark.createDataFrame(calls, "answer_id string, round int, seq int, tool string, args string"), p, o, before).collect()}
    cohort_of = lambda k: tuple(got[k].cohort) if got[k].cohort else got[k].error
    assert [cohort_of(("x", k)) for k in (1, 3, 5)] == [(2, 1, 1, 0, 1), (2, 1, 1, 1, 1), "tool_limit"]
    assert [(got["x", k].cycle, got["x", k].error) for k in (0, 2, 4)] == [(None, "not_returned"), ("2023-24", None), ("2023-24", None)]
    assert "invalid_gpaMin" in got["y", 0].error and cohort_of(("y", 1)) == (2, 0, 0, 0, 0)
    assert (got["y", 2].cycle, got["y", 3].error, got["y", 4].number) == ("2023-24", "unknown_profile", 3.0)
    assert got["z", 0].error and "invalid_limit" in got["z", 1].error and len(got) == len(calls)


NO_FILTER = (None,) * 9


def test_crowded_accounts_and_first_matches(spark):
    """One row of an account whatever the number of its profiles; the first matches are those of the whole order, found in few of its parts."""
    p = spark.createDataFrame([(f"p{k:04d}", "crowd" if k < 100 else f"a{k}", "sdn", "2022-23" if k % 3 else "2023-24", "d", 3.0 + k % 7 / 10, 500, "reviewed", 1, "cycle_report", None) for k in range(1000)], PROFILES)
    o = spark.createDataFrame([("p0098", "2022-23", "odd", "S", 0), ("p0500", "2022-23", "other", "S", 0)], OUTCOMES)
    asked = spark.createDataFrame([(1, *NO_FILTER), (2, 3.6, *NO_FILTER[1:]), (3, *NO_FILTER[:6], ["odd"], None, None)], REQUESTS)
    base = batch.searchable(p, o).cache()
    rows = batch.matches(asked, base).select("request_id", "account_id", "id", "cycle").collect()
    assert len({(r.request_id, r.account_id) for r in rows}) == len(rows)
    assert [r.id for r in rows if r.account_id == "crowd"] and {r.id for r in rows if r.request_id == 3} == {"p0098"}
    assert len([r for r in rows if r.request_id == 1]) == 901
    counted = batch.tallies(batch.matches(asked, base)).cache()
    first = batch.first_matches(asked, base, counted, 40).collect()
    for k in (1, 2, 3):
        order = sorted((r for r in rows if r.request_id == k), key=lambda r: (-int(r.cycle[:4]), r.id))[:40]
        assert [r.id for r in sorted((r for r in first if r.request_id == k), key=lambda r: r.place)] == [r.id for r in order]
    slots = [r.slot for r in counted.select("slot").distinct().collect()]
    assert len(slots) > 20 and max(r._slot for r in first if r.request_id == 1) < max(slots) / 2


def test_equal_filters_are_searched_once(spark):
    asked = spark.createDataFrame([(k, None, 3.0 if k % 2 else None, *NO_FILTER[2:4], ["2022-23"], *NO_FILTER[5:]) for k in range(10)], REQUESTS)
    seen = []

    def search(requests):
        seen.append(sorted(r.request_id for r in requests.collect()))
        return requests.select("request_id", "gpa_max")

    got = {r.request_id: r.gpa_max for r in batch.once(asked, search).collect()}
    assert seen == [[0, 1]] and got == {k: 3.0 if k % 2 else None for k in range(10)}
