"""Registered queries hand their operators whole tables."""

from cohortspark.operators import tools
from cohortspark.plans.fixtures import derived
from cohortspark.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_replay_sees_every_call(spark, monkeypatch):
    seen, replay = [], tools.replay_tool_calls

    def watched(calls, *rest):
        seen.append(calls.where("seq >= 6").count())
        return replay(calls, *rest)

    monkeypatch.setattr(tools, "replay_tool_calls", watched)
    got = QUERIES["replay_tool_calls"](spark, SF)
    assert seen == [derived(spark, SF, "li").where("ord >= 6").count()] and seen[0] > 0
    # Of a reply's calls only the first six stand.
    assert got.where("seq >= 6").count() == 0 and got.count() == derived(spark, SF, "li").where("ord < 6").count()


def test_release_deals_lines_out_once(spark, tmp_path):
    """Activities and outcomes of all profiles come from one shuffle of the lines; an unknown supplier's line is an activity alone."""
    import shutil

    from cohortspark.plans.register import Tables
    from cohortspark.plans.search_queries import nested

    sf = str(tmp_path / "sf")
    shutil.copytree(SF, sf)
    few = spark.read.parquet(f"{SF}/supplier.parquet").where("s_suppkey % 3 > 0")
    shutil.rmtree(f"{sf}/supplier.parquet", ignore_errors=True) if (tmp_path / "sf/supplier.parquet").is_dir() else (tmp_path / "sf/supplier.parquet").unlink()
    few.write.parquet(f"{sf}/supplier.parquet")
    t = Tables(spark, sf)
    rows = nested(t)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_linenumber") > 0 and plan.count("lineitem.parquet") + plan.count("Relation [l_orderkey") == 1
    arrays = rows.selectExpr("id", "transform(activities, a -> a.ord) AS a", "transform(outcomes, o -> o.id) AS o").collect()
    acts = {(r.profile_id, r.ord) for r in t.activities.select("profile_id", "ord").collect()}
    outs = {r.id for r in t.outcomes.select("id").collect()}
    assert {(r.id, k) for r in arrays for k in r.a} == acts and {x for r in arrays for x in r.o} == outs and 0 < len(outs) < len(acts)


def test_lines_of_a_release_are_packed(spark, tmp_path, monkeypatch):
    """What read_release writes is a small part of the text that it reads back."""
    from cohortspark.plans.register import Tables

    monkeypatch.setattr(Tables, "folder", lambda self, name: str(tmp_path / name))
    QUERIES["read_release"](spark, SF)
    text = spark.read.text(str(tmp_path / "lines")).selectExpr("sum(length(value)) AS n").first().n
    assert 0 < sum(f.stat().st_size for f in (tmp_path / "lines").glob("part-*")) < text / 5


def test_snapshots_look_at_no_whole_description(spark):
    """Whether an activity is described is told at its first character that is no blank, and the lines lie in parts by their work."""
    from cohortspark.operators import batch, cohort

    plan = QUERIES["profile_snapshot"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "regexp_replace" not in plan and f"], {batch.working_parts(spark)}" in plan.split("repartitionbyexpression")[1].split("\n")[0]
    texts = [None, "", " \t\n", "\u00a0", " x ", "x"]
    row = [("p", "a", "2024-25", None, None, "s", "cycle_report", [("clinical", t, "reported", None) for t in texts], [])]
    schema = "id string, account_id string, cycle string, gpa double, mcat long, summary string, timing_status string, activities array<struct<category:string,description:string,timing:string,hours:struct<min:double,max:double,precision:string>>>, outcomes array<struct<status:string,cycle:string,conditional:int,evidence:string>>"
    got = cohort.profile_snapshot(spark.createDataFrame(row, schema)).first().activities
    assert [a.reporting_status == "reported_text" for a in got] == [False, False, False, True, True, True]


def test_rules_are_evaluated_once(spark):
    """The rules of a release are in one projection, not in a generator and in a filter before it; items are passed over once."""
    from cohortspark.operators import publish

    df = QUERIES["validate_corpus"](spark, SF)
    nodes = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert not any("Generate" in n and "hours_precision" in n for n in nodes) and not any("Filter" in n and "profile_id THEN" in n for n in nodes)
    assert sum(n.count("THEN hours_precision") for n in nodes) == 1
    assert set(publish.item_rules()["activities"]) < {r.rule for r in df.select("rule").distinct().collect()}


def test_replay_admits_and_prepares_once(spark, monkeypatch):
    """Calls are admitted once and stored, and profiles are made ready for searches once; what searches return is not dealt out by answer."""
    from cohortspark.operators import batch

    made, searchable = [], batch.searchable
    for module in (batch, tools):
        monkeypatch.setattr(module, "searchable", lambda *tables: made.append(1) or searchable(*tables))
    got = QUERIES["replay_tool_calls"](spark, SF)
    assert len(made) == 1 and not any("lineitem" in f for f in got.inputFiles())


def test_replay_looks_back_within_an_answer(spark):
    """A profile may be inspected after a search of the same answer that came earlier and returned it, or where the answer before had it."""
    p = spark.createDataFrame([("p-1", "a1", "reddit", "2024-25", 1, 1, "reviewed", "2024-01-01", 3.5, 510)], "id string, account_id string, source string, cycle string, version long, is_current int, review_status string, observed_at string, gpa double, mcat long")
    o = spark.createDataFrame([], "profile_id string, cycle string, conditional int, status string, school string")
    look, find, none = '{"id": "p-1"}', '{"gpaMin": 3.0}', '{"gpaMin": 3.9}'
    inspect, search = "profile_inspect", "cohort_search"
    calls = [("x", 0, 0, inspect, look), ("x", 0, 1, search, find), ("x", 0, 2, inspect, look), ("x", 1, 0, inspect, look), ("y", 0, 0, search, none), ("y", 0, 1, inspect, look), ("z", 0, 0, inspect, look), ("z", 0, 1, search, find), ("w", 0, 0, search, find), ("v", 0, 1, inspect, look), ("v", 0, 2, "odd", "{}"), ("v", 0, 3, None, "{}")]
    before = spark.createDataFrame([("z", "p-1"), ("z", "p-1"), ("y", None)], "answer_id string, id string")
    got = tools.replay_tool_calls(spark.createDataFrame(calls, "answer_id string, round int, seq int, tool string, args string"), p, o, before)
    assert {(r.answer_id, r.round, r.seq): r.cycle or r.error for r in got.where("tool = 'profile_inspect' OR tool IS NULL OR tool = 'odd'").collect()} == {
        ("x", 0, 0): "not_returned", ("x", 0, 2): "2024-25", ("x", 1, 0): "2024-25", ("y", 0, 1): "not_returned", ("z", 0, 0): "2024-25", ("v", 0, 1): "not_returned", ("v", 0, 2): "unknown_tool", ("v", 0, 3): "unknown_tool",
    }
