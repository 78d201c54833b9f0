"""Replay of recorded tool calls, and the search that counts for an answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortspark.functions.budgets import calculate, weekly_budget
from cohortspark.operators.batch import first_matches, match_records, matches, searchable, tallies, validate_filters
from cohortspark.operators.cohort import SUMMARY_ROWS, inspect_profiles, total_accounts
from cohortspark.operators.conversations import MOST_ARGS, admission


def latest_cohort(calls: DataFrame) -> DataFrame:
    """Of several searches of an answer the last one gives its counts."""
    return calls.groupBy("answer_id").agg(F.max_by(F.struct("seq", "counts"), F.struct("round", "seq")).alias("l")).select("answer_id", "l.seq", "l.counts")


#: Profiles that a search gives back at most, and where a call names no limit.
MOST_RETURNED, RETURNED = 12, 10


def search_requests(calls: DataFrame) -> DataFrame:
    """The different searches of calls (args JSON) as validated requests: request_id is the text of its arguments.

    A limit that is no number counts as 10, one above 12 as 12.
    """
    parsed = F.try_parse_json("args")
    given = F.try_variant_get(parsed, "$.limit", "variant")
    number = F.schema_of_variant(given).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    limit = F.least(F.when(number, F.try_variant_get(parsed, "$.limit", "double")).otherwise(F.lit(float(RETURNED))), F.lit(float(MOST_RETURNED)))
    others = F.map_filter(F.try_variant_get(parsed, "$", "map<string,variant>"), lambda k, _: k != "limit")
    raw = F.to_json(F.to_variant_object(F.map_concat(others, F.create_map(F.lit("limit"), limit.cast("variant")))))
    return validate_filters(calls.select("args").distinct().select(F.col("args").alias("request_id"), raw.alias("raw")))


def replay_tool_calls(calls: DataFrame, profiles: DataFrame, outcomes: DataFrame, previous: DataFrame, written=lambda df, name: df, base: DataFrame | None = None) -> DataFrame:
    """Calls (answer_id, round, seq, tool, args JSON) with a result or an error.

    Admission follows tool_call_budget, with the arguments beside it. calculate and weekly_time_budget are column arithmetic. The different searches of
    all answers become one table of requests, searched together, and their counts go back to every call that asked.
    profile_inspect gives the cycle of a profile that an earlier search of the answer returned or that the answer before
    had (previous: answer_id, id). `written` stores what is read several times; base is what `searchable` gives, where it is stored already.
    """
    key = ["answer_id", "round", "seq"]
    # Oversized arguments are known by their size alone; no call that is let through has them.
    large = F.length("args") > MOST_ARGS
    admitted = admission(calls.select(*key, "tool", F.when(~large, F.col("args")).alias("args"), large.alias("large"))).drop("large")
    admitted = written(admitted, "admitted")
    a = F.from_json("args", "operation string, values array<double>, hoursPerWeek double, weeks double, plannedHours double, id string")
    rows = admitted.withColumn("a", a).withColumn("asked", F.when((F.col("verdict") == "admitted") & (F.col("tool") == "profile_inspect"), F.col("a.id")))

    searches = rows.where("verdict = 'admitted' AND tool = 'cohort_search'").select(*key, "args")
    requests = written(search_requests(searches), "requests")
    asked = requests.where(F.size("errors") == 0)
    base = written(searchable(profiles, outcomes), "searchable") if base is None else base
    filters = asked.drop("errors", "limit")
    counted = written(tallies(matches(filters, base)), "tallies")
    # A search without any match has counts as well.
    counts = match_records(counted, profiles).drop("total", "examined", "summarized")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    matched = zero(F.col("matched"))
    counts = requests.join(counts, "request_id", "left").crossJoin(total_accounts(profiles)).select(
        F.col("request_id").alias("args"), F.concat_ws(",", "errors").alias("invalid"), F.when(F.size("errors") == 0, F.struct(F.col("total_accounts").alias("total"), matched.alias("matched"), F.least(matched, F.col("limit").cast("long")).alias("examined"), zero(F.col("with_reported_outcomes")).alias("with_reported_outcomes"), F.least(matched, F.lit(SUMMARY_ROWS).cast("long")).alias("summarized"))).alias("cohort")
    )
    returned = first_matches(filters, base, counted, MOST_RETURNED).join(asked.select("request_id", "limit"), "request_id").where("place <= limit").select(F.col("request_id").alias("args"), "id")
    # Only what a call inspects is looked up in what the answer's searches returned: an answer has few calls, a search many profiles.
    inspects = rows.where("asked IS NOT NULL").select(*key, F.col("asked").alias("id"))
    earlier = searches.select("answer_id", F.struct("round", "seq").alias("at"), "args")
    after = inspects.join(earlier, "answer_id").where(F.col("at") < F.struct("round", "seq")).join(returned, ["args", "id"], "left_semi").select(*key, "id")
    wanted = after.unionByName(inspects.join(previous.select("answer_id", "id"), ["answer_id", "id"], "left_semi")).distinct()
    read = inspect_profiles(profiles, wanted.select("id").distinct()).select(F.col("asked").alias("id"), F.col("cycle").alias("found_cycle"), F.lit(True).alias("allowed"))
    rows = rows.join(wanted.join(read, "id").select(*key, "found_cycle", "allowed"), key, "left").join(counts, "args", "left")
    tool = F.col("tool")
    number = F.when(tool == "calculate", calculate(F.col("a.operation"), F.col("a.values"))).when(tool == "weekly_time_budget", weekly_budget(F.col("a.hoursPerWeek"), F.col("a.weeks"), F.col("a.plannedHours"))["total"])
    search = tool == "cohort_search"
    error = F.when(F.col("verdict") != "admitted", F.col("verdict")).when((tool == "profile_inspect") & F.col("allowed").isNull(), "not_returned").when((tool == "profile_inspect") & F.col("found_cycle").isNull(), "unknown_profile")
    error = error.when(tool.isin("calculate", "weekly_time_budget") & number.isNull(), "invalid_input").when(search & (F.col("invalid") != ""), F.col("invalid"))
    fine = lambda c: F.when(error.isNull(), c)
    return rows.select(*key, "tool", fine(number).alias("number"), fine(F.col("found_cycle")).alias("cycle"), fine(F.when(search, F.col("cohort"))).alias("cohort"), error.alias("error"))
