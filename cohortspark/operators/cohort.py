"""Cohort search: filters, the same-event outcome rule, one row per account, counts, coverage and statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Fixed values.
SOURCES = ("reddit", "sdn", "mdapplicants")
OUTCOMES = ("accepted", "rejected", "interview", "waitlisted", "withdrawn", "pending", "unknown")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows that statistics look at, in sample order; None for all.
SUMMARY_ROWS = 1000


def reviewed_current(profiles: DataFrame) -> DataFrame:
    return profiles.where("is_current = 1 AND review_status = 'reviewed'")


def reported(metric: str) -> Column:
    """A metric as reported: null, NaN and the infinities are not."""
    number = F.col(metric).cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), F.col(metric))


def metric_range(df: DataFrame, gpa_min=None, gpa_max=None, mcat_min=None, mcat_max=None) -> DataFrame:
    """Inclusive bounds; a metric that is not reported drops out only where its bound is given."""
    for column, low, high in (("gpa", gpa_min, gpa_max), ("mcat", mcat_min, mcat_max)):
        if low is not None:
            df = df.where((F.col(column) >= low) & reported(column).isNotNull())
        if high is not None:
            df = df.where((F.col(column) <= high) & reported(column).isNotNull())
    return df


def in_cycles(df: DataFrame, cycles: Sequence[str] | None) -> DataFrame:
    return df if cycles is None else df.where(F.col("cycle").isin(list(cycles)))


def in_sources(df: DataFrame, sources: Sequence[str] | None) -> DataFrame:
    return df if sources is None else df.where(F.col("source").isin(list(sources)))


def contains_literal(column: Column, term: Column | str) -> Column:
    """Literal substring; only ASCII letters fold. A null never matches."""
    term = F.lit(term) if isinstance(term, str) else term
    return F.coalesce(F.contains(F.translate(column, UPPER, LOWER), F.translate(term, UPPER, LOWER)), F.lit(False))


def activity_contains(df: DataFrame, term: str) -> DataFrame:
    """Over the raw activities text, key names included."""
    return df.where(contains_literal(F.col("activities_json"), term))


def unconditional(outcomes: DataFrame, statuses: Sequence[str] | None = None, school: str | None = None) -> DataFrame:
    """(profile_id, cycle) of events that are unconditional and meet both conditions at once."""
    out = outcomes.where("conditional = 0")
    if statuses is not None:
        out = out.where(F.col("status").isin(list(statuses)))
    if school is not None:
        out = out.where(contains_literal(F.col("school"), school))
    return out.select(F.col("profile_id").alias("o_profile"), F.col("cycle").alias("o_cycle"))


def outcome_semi_join(profiles: DataFrame, outcomes: DataFrame, statuses=None, school=None) -> DataFrame:
    """Profiles with one event of their own cycle that meets all conditions."""
    events = unconditional(outcomes, statuses, school)
    return profiles.join(events, (profiles["id"] == events["o_profile"]) & (profiles["cycle"] == events["o_cycle"]), "left_semi")


def profiles_with_accounts(profiles: DataFrame, accounts: DataFrame) -> DataFrame:
    named = accounts.select(F.col("id").alias("account_id"), "source", "public_handle")
    return profiles.drop("source").join(named, "account_id")


def latest_matching_profile(matching: DataFrame) -> DataFrame:
    """Per account the latest of the rows that matched: filters come first."""
    latest = W.partitionBy("account_id").orderBy(F.desc("cycle"), F.desc("observed_at"), F.asc("id"))
    return matching.withColumn("_rn", F.row_number().over(latest)).where("_rn = 1").drop("_rn")


def with_reported_outcome(matched: DataFrame, outcomes: DataFrame) -> DataFrame:
    events = unconditional(outcomes, ("accepted", "rejected")).distinct().withColumn("_seen", F.lit(True))
    joined = matched.join(events, (matched["id"] == events["o_profile"]) & (matched["cycle"] == events["o_cycle"]), "left")
    return joined.withColumn("has_reported_outcome", F.coalesce("_seen", F.lit(False))).drop("o_profile", "o_cycle", "_seen")


def search(profiles: DataFrame, accounts: DataFrame, outcomes: DataFrame, *, gpa_min=None, gpa_max=None, mcat_min=None, mcat_max=None, cycles=None, sources=None, statuses=None, school=None, activity=None) -> DataFrame:
    """One row per matching account."""
    rows = metric_range(in_cycles(reviewed_current(profiles), cycles), gpa_min, gpa_max, mcat_min, mcat_max)
    if activity is not None:
        rows = activity_contains(rows, activity)
    rows = in_sources(profiles_with_accounts(rows, accounts), sources)
    if statuses is not None or school is not None:
        rows = outcome_semi_join(rows, outcomes, statuses, school)
    return latest_matching_profile(rows)


def total_accounts(profiles: DataFrame) -> DataFrame:
    return reviewed_current(profiles).agg(F.countDistinct("account_id").alias("total_accounts"))


def cohort_counts(profiles: DataFrame, matched: DataFrame, outcomes: DataFrame, limit: int = 12) -> DataFrame:
    counted = with_reported_outcome(matched, outcomes).agg(F.count("*").alias("matched"), F.coalesce(F.count_if("has_reported_outcome"), F.lit(0)).alias("with_reported_outcomes"))
    return counted.crossJoin(total_accounts(profiles)).select(
        F.col("total_accounts").alias("total"), "matched", F.least("matched", F.lit(limit).cast("long")).alias("examined"), "with_reported_outcomes", F.least("matched", F.lit(SUMMARY_ROWS).cast("long")).alias("summarized")
    )


def coverage(matched: DataFrame, column: str) -> DataFrame:
    return matched.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("count"))


def cohort_sample(matched: DataFrame, limit: int) -> DataFrame:
    return matched.orderBy(F.desc("cycle"), "id").limit(limit)


def summary_population(matched: DataFrame, cap: int | None = SUMMARY_ROWS) -> DataFrame:
    return matched if cap is None else cohort_sample(matched, cap)


#: The middle is looked for between these shares of a group's rows, as a sketch of that accuracy sees them.
MIDDLE, ACCURACY = (0.4999, 0.5001), 20_000


def numeric_summary(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows (by..., statistic, n, missing, min, max, median) for each column; NaN and infinities are missing.

    The median is exact and found by selection: a sketch gives two values around the middle, equal values are counted
    once, the counts below, between and above the two say where the middle lies, and only that part is sorted.
    However wrong the sketch, the part is the right one; as a rule it has a few ten-thousandths of a group's values.
    """
    keys = [*by, "statistic"]
    one = F.explode(F.array(*[F.struct(F.lit(c).alias("statistic"), F.col(c).cast("double").alias("value")) for c in columns])).alias("s")
    rows = df.select(*by, one).select(*by, "s.*")
    rows = rows.withColumn("value", F.when(~F.isnan("value") & (F.abs("value") != float("inf")), F.col("value")))
    about = F.percentile_approx("value", list(MIDDLE), ACCURACY)
    stats = rows.groupBy(*keys).agg(F.count("value").alias("n"), F.count_if(F.col("value").isNull()).alias("missing"), F.min("value").alias("min"), F.max("value").alias("max"), about.alias("about"))
    counted = rows.where("value IS NOT NULL").groupBy(*keys, "value").agg(F.count("*").alias("c"))

    def matched(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
        """Joined by the keys, a null being equal to a null."""
        named = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys])
        on = [left[k].eqNullSafe(named[f"_{k}"]) for k in keys]
        for c in on[1:]:
            on[0] = on[0] & c
        return left.join(named, on[0], how).drop(*[f"_{k}" for k in keys])

    part = F.when(F.col("value") < F.col("about")[0], 0).when(F.col("value") <= F.col("about")[1], 1).otherwise(2)
    placed = matched(counted, stats.select(*keys, "n", "about")).withColumn("part", part)
    sizes = placed.groupBy(*keys).agg(F.max("n").alias("n"), F.sum(F.when(F.col("part") == 0, F.col("c")).otherwise(0)).alias("below"), F.sum(F.when(F.col("part") <= 1, F.col("c")).otherwise(0)).alias("upto"))
    low, high = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    lies = lambda p: F.when(p <= F.col("below"), 0).when(p <= F.col("upto"), 1).otherwise(2)
    sought = matched(placed.drop("n", "about"), sizes.withColumn("low", lies(low)).withColumn("high", lies(high))).where("part IN (low, high)")
    upto = W.partitionBy(*keys, "part").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    before = F.when(F.col("part") == 0, F.lit(0)).when(F.col("part") == 1, F.col("below")).otherwise(F.col("upto"))
    ranked = sought.withColumn("last", before + F.sum("c").over(upto)).withColumn("first", F.col("last") - F.col("c") + 1)
    has = lambda p: F.max(F.when((F.col("first") <= p) & (p <= F.col("last")), F.col("value")))
    middle = ranked.groupBy(*keys).agg(((has(low) + has(high)) / 2).alias("median"))
    return matched(stats.drop("about"), middle, "left").select(*keys, "n", "missing", "min", "max", "median")


def first_hours(activities: Column, timing_status: Column, category: str) -> Column:
    """Hours of the first activity of a category, only if exactly reported for this cycle."""
    a = F.get(F.filter(activities, lambda x: x["category"] == category), F.lit(0))
    usable = (timing_status != "retrospective_mixed") & a["hours"]["precision"].isin("reported", "explicit_absence") & ~F.coalesce(a["timing"], F.lit("")).isin("after_submission", "projected") & (a["hours"]["min"] == a["hours"]["max"])
    return F.when(usable, a["hours"]["min"])


def activity_hours_summary(matched: DataFrame, categories: Sequence[str] = ("clinical", "research", "nonclinical")) -> DataFrame:
    columns = [first_hours(F.col("activities"), F.col("timing_status"), c).alias(f"{c}_hours") for c in categories]
    return numeric_summary(matched.select(*columns), [f"{c}_hours" for c in categories])


def corpus_stats(profiles: DataFrame, accounts: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """(part, value, accounts): distinct accounts in all, by source and by cycle, in one pass over distinct (account, source, cycle).

    With a ledger of imports (release, imported_at) also the parts reviewed_at, the latest review of a profile
    (profiles have reviewed_at), and release, the latest imported; they count no accounts.
    """
    base = reviewed_current(profiles)
    distinct = profiles_with_accounts(base, accounts).select("account_id", "source", "cycle").distinct()
    sets = distinct.groupingSets([[], ["source"], ["cycle"]], "source", "cycle").agg(F.countDistinct("account_id").alias("accounts"), F.grouping_id().alias("g"))
    stats = sets.select(F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "source").otherwise("cycle").alias("part"), F.coalesce("source", "cycle", F.lit("")).alias("value"), "accounts")
    if imports is None:
        return stats
    none = F.lit(None).cast("long").alias("accounts")
    reviewed = base.agg(F.max("reviewed_at").alias("value")).select(F.lit("reviewed_at").alias("part"), "value", none)
    latest = imports.agg(F.max_by("release", F.struct("imported_at", "release")).alias("value")).select(F.lit("release").alias("part"), "value", none)
    return stats.unionAll(reviewed).unionAll(latest)


def inspect_profiles(profiles: DataFrame, ids: DataFrame) -> DataFrame:
    """Each asked id: whether it is well formed, and its reviewed current profile or null."""
    valid = ids.select(F.col("id").alias("asked"), F.coalesce(F.col("id").rlike(r"\A[a-z0-9_-]+\z") & (F.length("id") <= 160), F.lit(False)).alias("valid"))
    rows = reviewed_current(profiles)
    return valid.join(rows, (valid["asked"] == rows["id"]) & valid["valid"], "left")


def profile_snapshot(profiles: DataFrame) -> DataFrame:
    """The cycle snapshot of nested profiles: own-cycle unconditional outcomes, cut texts, no mixed hours."""
    mixed = F.col("timing_status") == "retrospective_mixed"
    own = F.filter("outcomes", lambda o: (o["cycle"] == F.col("cycle")) & (F.coalesce(o["conditional"], F.lit(0)) == 0))
    narrative = lambda a: a["category"].isin("publications", "other")

    def activity(a: Column) -> Column:
        described = F.coalesce(F.rlike(a["description"], F.lit(r"\S")), F.lit(False))
        return F.struct(
            a["category"].alias("category"),
            a["timing"].alias("timing"),
            F.when(~mixed, F.left(a["description"], F.lit(500))).alias("reported_text"),
            F.when(mixed, "mixed_timing_not_attributed_to_cycle").when(described, "reported_text").otherwise("no_description_reported").alias("reporting_status"),
            F.when(~mixed, F.when(narrative(a), "narrative_not_hours").otherwise("hours")).alias("measurement_type"),
            F.when(~mixed & ~narrative(a), a["hours"]).alias("hours"),
        )

    told = F.concat("cycle", F.lit(" applicant with retrospectively reported activities; amounts are omitted because what was done before this application is not known."))
    return profiles.withColumn("_own", own).select(
        "id", "account_id", "cycle", "gpa", "mcat",
        F.when(mixed, told).otherwise(F.left("summary", F.lit(2000))).alias("summary"),
        F.transform("activities", activity).alias("activities"),
        F.transform("_own", lambda o: o.withField("evidence", F.left(o["evidence"], F.lit(400)))).alias("outcomes"),
        F.exists("_own", lambda o: o["status"] == "accepted").alias("has_acceptance"),
        (F.size("outcomes") - F.size("_own")).alias("excluded_outcome_events"),
        "timing_status",
    )
