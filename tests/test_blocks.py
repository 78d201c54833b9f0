"""Batch search by blocks of accounts against the search that makes a row of every pair."""

import random

import pytest
from pyspark.sql import functions as F
from test_batch_search import NO_FILTER, OUTCOMES, PROFILES, REQUESTS, corpus

from cohortspark.operators import batch, blocks, cohort
from cohortspark.registry import QUERIES


def key(r):
    return tuple((x is None, str(x)) for x in r)


@pytest.mark.parametrize("sizes", [(200_000, 50_000, 600), (30, 7, 2)])
def test_blocks_equal_pairs(spark, monkeypatch, sizes):
    """Counts and first matches in one block and in many, whatever the bounds, sets and texts; metrics and texts null, not finite or unknown."""
    for name, n in zip(("BLOCK", "ASKED", "MASKS"), sizes):
        monkeypatch.setattr(blocks, name, n)
    r = random.Random(5)
    p, o = corpus(spark, r)
    p = p.withColumns({"cycle": F.when(F.col("id") != "p3", F.col("cycle")), "source": F.when(F.col("id") != "p4", F.col("source"))}).cache()
    o = o.unionAll(spark.createDataFrame([("p1", "2021-22", None, "Alpha U", 0), ("p2", "2022-23", "odd", None, 0)], OUTCOMES)).cache()
    some = lambda xs: None if r.random() < 0.6 else r.sample(xs, r.randrange(0, len(xs)))
    nan = float("nan")
    asked = [(k, r.choice([None, None, -2.0, 2.0, 3.1, 98.0, nan]), r.choice([None, None, -0.5, 3.5, 4.0, 1e300, nan]), r.choice([None, None, 0.0, 500.0, 529.0]), r.choice([None, None, 471.0, 528.0, 1e5, nan]), some(["2021-22", "2022-23", "2023-24"]), some([*cohort.SOURCES]), some(["accepted", "rejected", "odd", None]), r.choice([None, None, "ALPHA", ""]), r.choice([None, None, "lab w", ""])) for k in range(60)]
    asked = spark.createDataFrame([*asked, (60, *NO_FILTER)], REQUESTS).cache()
    base, rows = batch.searchable(p, o).cache(), blocks.account_rows(p, o).cache()
    tallies = batch.tallies(batch.matches(asked, base)).cache()
    want = tallies.groupBy("request_id", "source", "cycle", "reported").agg(F.sum("n")).collect()
    cuts = blocks.cuts(rows)
    for limit in (3, 25):
        found = blocks.counted(asked, rows, limit, cuts).cache()
        got = found.where("n IS NOT NULL").groupBy("request_id", "source", "cycle", "reported").agg(F.sum("n")).collect()
        assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key) and len(want) > 100
        order = batch.match_samples(batch.matches(asked, base), limit).selectExpr("request_id", "cycle", "id", "cast(_gpa AS double)", "cast(_mcat AS double)", "place")
        first = blocks.first_matches(asked, rows, found, limit, cuts)
        assert sorted(map(tuple, first.collect()), key=key) == sorted(map(tuple, order.collect()), key=key)


def test_nothing_to_search(spark):
    none = blocks.account_rows(spark.createDataFrame([], PROFILES), spark.createDataFrame([], OUTCOMES))
    asked = spark.createDataFrame([(1, *NO_FILTER)], REQUESTS)
    found = blocks.counted(asked, none, 5, blocks.cuts(none))
    assert found.count() == 0 and blocks.first_matches(asked, none, found, 5, []).count() == 0


@pytest.mark.parametrize("name", ["cohort_match_many", "cohort_match_samples", "cohort_match_summaries", "cohort_evidence"])
def test_queries_search_blocks(spark, monkeypatch, name):
    """The registered searches make no rows of pairs of requests and profiles."""
    monkeypatch.delattr(batch, "matches")
    QUERIES[name](spark, "/root/testdata/sf0.001")
