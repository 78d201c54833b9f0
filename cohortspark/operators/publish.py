"""Validation of releases, versions in import order, publishing and integrity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .batch import valid_cycle
from .cohort import OUTCOMES, SOURCES

#: Parts into which rows of one place are dealt out by account and cycle.
PIECES = 16
#: Fixed values.
HOSTS = {"reddit": "www.reddit.com", "sdn": "forums.studentdoctor.net", "mdapplicants": "www.mdapplicants.com"}
IMPORTS = "release string, content_sha256 string, imported_at string, profile_count long, account_count long"
PRECISIONS = ("reported", "approximate", "explicit_absence", "unreported", "range", "lower_bound", "upper_bound")


def account_identity(source: Column, source_account_id: Column) -> Column:
    return F.concat_ws(":", source, F.lower(source_account_id))


def source_url_ok(url: Column, source: Column) -> Column:
    hosts = F.create_map(*[F.lit(x) for pair in HOSTS.items() for x in pair])
    return F.coalesce((F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & (F.try_parse_url(url, F.lit("HOST")) == F.try_element_at(hosts, source)), F.lit(False))


def _no(condition: Column, rule: str) -> Column:
    """The rule's name where its condition does not hold; unknown counts as not."""
    return F.when(~F.coalesce(condition, F.lit(False)), rule)


def _all(array: str, test) -> Column:
    return F.col(array).isNotNull() & (F.size(F.filter(array, lambda x: ~F.coalesce(test(x), F.lit(False)))) == 0)


def _finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) != float("inf"))


def item_rules() -> dict[str, dict]:
    """The rules of every activity and of every outcome."""
    bound = lambda c: c.isNull() | (_finite(c) & (c >= 0))
    h = lambda a: a["hours"]
    return {
        "activities": {
            "activity_description": lambda a: F.length(a["description"]) > 0,
            "hours_bound": lambda a: bound(h(a)["min"]) & bound(h(a)["max"]),
            "hours_order": lambda a: h(a)["min"].isNull() | h(a)["max"].isNull() | (h(a)["min"] <= h(a)["max"]),
            "hours_absence": lambda a: (h(a)["precision"] != "explicit_absence") | ((h(a)["min"] == 0) & (h(a)["max"] == 0)),
            "hours_unreported": lambda a: (h(a)["precision"] != "unreported") | (h(a)["min"].isNull() & h(a)["max"].isNull()),
            "hours_precision": lambda a: h(a)["precision"].isin(*PRECISIONS),
        },
        "outcomes": {
            "outcome_status": lambda o: o["status"].isin(*OUTCOMES),
            "outcome_count": lambda o: o["reported_count"].isNull() | ((o["reported_count"] > 0) & (o["reported_count"] == F.floor(o["reported_count"]))),
            "outcome_evidence": lambda o: F.length(o["evidence"]) > 0,
            "outcome_url": lambda o: F.array_contains("source_urls", o["source_url"]),
            "outcome_cycle": lambda o: o["cycle"].rlike(r"\A20[0-9]{2}-[0-9]{2}\z"),
        },
    }


def _items(array: str, rules: dict) -> Column:
    """A bit for every rule that an item of the array breaks, in one pass over it; unknown counts as broken."""
    bit = lambda x: [F.when(F.coalesce(test(x), F.lit(False)), 0).otherwise(1 << k) for k, test in enumerate(rules.values())]
    return F.aggregate(array, F.lit(0), lambda seen, x: seen.bitwiseOR(reduce(lambda a, b: a.bitwiseOR(b), bit(x))))


def row_rules() -> list[Column]:
    """A column for every rule with its name where a row breaks it; what the items tell is in _activities, _outcomes (bits), _count and _explicit."""
    grade = lambda c: F.col(c).isNull() | (_finite(F.col(c)) & F.col(c).between(0, 4))
    items = [_no(F.col(f"_{array}").bitwiseAND(F.lit(1 << k)) == 0, rule) for array, rules in item_rules().items() for k, rule in enumerate(rules)]
    return [
        _no(F.col("id").rlike(r"\A[a-z0-9_-]+\z"), "profile_id"),
        _no(F.col("source").isin(*SOURCES), "source"),
        _no(F.col("account_id") == account_identity(F.col("source"), F.col("source_account_id")), "account_identity"),
        _no(valid_cycle(F.col("cycle")), "cycle"),
        _no(F.col("review_status") == "reviewed", "review_status"),
        _no(F.col("extraction_confidence").isin("high", "mixed"), "confidence"),
        _no(F.col("timing_status").isin("cycle_report", "retrospective_mixed"), "timing_status"),
        _no(grade("gpa"), "gpa"),
        _no(grade("science_gpa"), "science_gpa"),
        _no(F.col("mcat").isNull() | ((F.col("mcat") == F.floor("mcat")) & F.col("mcat").between(472, 528)), "mcat"),
        _no((F.size("source_urls") > 0) & _all("source_urls", lambda u: source_url_ok(u, F.col("source"))), "source_urls"),
        _no(F.col("content_sha256").rlike(r"\A[a-f0-9]{64}\z"), "sha256"),
        _no(F.col("artifact_key").startswith("corpus/"), "artifact_key"),
        _no(_all("notes", lambda n: n.isNotNull()), "notes"),
        _no(F.col("_count") >= 2, "activity_count"),
        _no(F.col("_explicit"), "explicit_outcome"),
        *items,
    ]


def duplicate_keys(profiles: DataFrame) -> DataFrame:
    """(rule, key, rows) of profile ids and account:cycle:version keys that occur more than once."""
    version = F.coalesce("version", F.lit(1)).cast("string")
    keys = profiles.select(F.explode(F.array(F.struct(F.lit("duplicate_id").alias("rule"), F.col("id").alias("key")), F.struct(F.lit("duplicate_version").alias("rule"), F.concat_ws(":", "account_id", "cycle", version).alias("key")))).alias("k")).select("k.*")
    return keys.groupBy("rule", "key").agg(F.count("*").alias("rows")).where("rows > 1")


def validate_corpus(profiles: DataFrame) -> DataFrame:
    """Every (profile_id, rule) that a release breaks; publish only when this is empty.

    The rules are columns of one projection, evaluated once; generators alone would interpret them, and filter by them first.
    """
    # The items are not carried on to the rules.
    told = {f"_{array}": _items(array, rules) for array, rules in item_rules().items()}
    explicit = F.exists("outcomes", lambda o: F.coalesce(o["status"].isin("accepted", "rejected") & (F.length(o["evidence"]) > 0), F.lit(False)))
    items = profiles.withColumns(told | {"_count": F.size("activities"), "_explicit": explicit})
    broken = items.select(F.col("id").alias("profile_id"), F.array(*row_rules()).alias("rules"))
    rows = broken.select("profile_id", F.explode_outer("rules").alias("rule")).where("rule IS NOT NULL")
    return rows.unionByName(duplicate_keys(profiles).select(F.col("key").alias("profile_id"), "rule"))


def validate_release(headers: DataFrame) -> DataFrame:
    """(release, rule) of release documents (release, version, profiles: their number) of another format or without profiles."""
    rules = [_no(F.col("version") == 1, "format_version"), _no(F.col("profiles") > 0, "empty_corpus")]
    return headers.select("release", F.explode(F.array_compact(F.array(*rules))).alias("rule"))


#: An outcome's columns in the published corpus and their types.
OUTCOME = {"cycle": "string", "status": "string", "program": "string", "school": "string", "reported_count": "long", "count_kind": "string", "conditional": "int", "source_url": "string", "evidence": "string"}


def release_profiles(rows: DataFrame) -> DataFrame:
    """What read_release gives (ordinal, raw, p) as nested profiles in the library's names; raw stays, as the profile's document."""
    p = lambda name, to=None: F.col(f"p.{name}").alias(to or name)
    named = {"reported_count": "reportedCount", "count_kind": "countKind", "source_url": "sourceUrl"}
    outcome = lambda o: F.struct(*[o[named.get(c, c)].alias(c) for c in OUTCOME])
    return rows.select(
        "ordinal", "raw", p("id"), p("accountId", "account_id"), p("source"), p("sourceAccountId", "source_account_id"), p("publicHandle", "public_handle"), p("cycle"), F.coalesce("p.version", F.lit(1)).alias("version"),
        p("reviewStatus", "review_status"), p("observedAt", "observed_at"), p("reviewedAt", "reviewed_at"), p("gpa"), p("scienceGpa", "science_gpa"), p("mcat"), p("residence"), p("summary"), p("timingStatus", "timing_status"), p("extractionConfidence", "extraction_confidence"),
        p("activities"), F.transform("p.outcomes", outcome).alias("outcomes"), p("sourceUrls", "source_urls"), p("notes"), p("provenance.sourceContentSha256", "content_sha256"), p("provenance.sourceArtifactKey", "artifact_key"),
    )


def flatten_release(profiles: DataFrame):
    """Accounts, profiles and outcomes of nested profiles; outcome ids are the profile's and the place.

    A profile's document profile_json is its raw text where there is one, else all its columns as JSON. A field that
    the outcomes do not have is null; conditional counts as 0 unless it is true or 1.
    """
    accounts = profiles.select(F.col("account_id").alias("id"), "source", "source_account_id", "public_handle", "ordinal")
    document = F.col("raw") if "raw" in profiles.columns else F.to_json(F.struct(*[c for c in profiles.columns if c != "ordinal"]))
    rows = profiles if "profile_json" in profiles.columns else profiles.withColumn("profile_json", document)
    rows = rows.withColumn("activities_json", F.to_json("activities")).drop("outcomes", "activities", "raw")
    one = profiles.select("id", "account_id", F.posexplode("outcomes").alias("place", "o"))
    given = profiles.schema["outcomes"].dataType.elementType.names
    fields = {c: F.col(f"o.{c}").cast(kind) if c in given else F.lit(None).cast(kind) for c, kind in OUTCOME.items()}
    fields["conditional"] = F.coalesce(fields["conditional"], F.lit(0))
    outcomes = one.select(F.concat_ws(":", "id", F.col("place").cast("string")).alias("id"), F.col("id").alias("profile_id"), "account_id", *[x.alias(c) for c, x in fields.items()])
    return accounts, rows, outcomes


def latest_handle(accounts: DataFrame) -> DataFrame:
    """Accounts once: the last handle written, all else as first written."""
    return accounts.groupBy("id").agg(F.min_by("source", "ordinal").alias("source"), F.min_by("source_account_id", "ordinal").alias("source_account_id"), F.max_by("public_handle", "ordinal").alias("public_handle"))


def current_versions(imports: DataFrame) -> DataFrame:
    """is_current by import order: the last written row of an account and cycle, whatever its version."""
    last = W.partitionBy("account_id", "cycle").orderBy(F.desc("release_seq"), F.desc("ordinal"))
    return imports.withColumn("is_current", (F.row_number().over(last) == 1).cast("int"))


def publish_profiles(existing: DataFrame, release: DataFrame, place=None) -> DataFrame:
    """Existing profiles with a release's written over them; account, cycle and version of a known id never change.

    Of several rows of one id the last ordinal is written. A release row demotes the others of its account and cycle as it
    names them; among the release's own rows the last written stays current. Running it twice changes nothing.

    Whole rows are dealt out once, to their account and cycle, where all is decided. Only ids are compared before: those
    whose rows name different accounts or cycles get the place where they belong, and a row without content demotes where
    they are named. By `place` (a column of the account), which stays as `bucket`, and PIECES parts of it rows are dealt out by hash, since
    ranges take a pass over whole rows to be found; then it is asked first whether any id is out of place, so that whole rows are joined with none.
    """
    key = ["account_id", "cycle"]
    rest = [c for c in existing.columns if c != "is_current"]
    old = existing.select(*rest, F.coalesce("is_current", F.lit(0)).alias("was"), F.lit(False).alias("_new"), F.lit(None).cast("long").alias("n_ordinal"))
    new = release.select(*rest, F.lit(0).alias("was"), F.lit(True).alias("_new"), F.col("ordinal").cast("long").alias("n_ordinal"))
    both = old.unionByName(new)
    named, known = F.struct(*key), F.col("_known")
    ids = both.select("id", *key, "_new", "n_ordinal").groupBy("id").agg(
        F.min(named).alias("a"), F.max(named).alias("b"), F.max_by(named, "n_ordinal").alias("last"), F.max("n_ordinal").alias("last_ordinal"), F.max(F.when(~F.col("_new"), named)).alias("_known"), F.max("_new").alias("_named")
    )
    moved = ids.where(F.col("_named") & ~F.col("a").eqNullSafe(F.col("b"))).select("id", *[F.coalesce(known[c], F.col("last")[c]).alias(f"to_{c}") for c in key], "last", "last_ordinal")
    if place is not None and moved.isEmpty():
        both = both.withColumns({"_moved": F.lit(False), "_told": F.lit(False)})
    else:
        both = both.join(moved.select("id", *[f"to_{c}" for c in key], F.lit(True).alias("_moved")), "id", "left").withColumn("_moved", F.coalesce("_moved", F.lit(False)))
        both = both.withColumns({c: F.when(F.col("_moved"), F.col(f"to_{c}")).otherwise(F.col(c)) for c in key}).select(*rest, "was", "_new", "n_ordinal", "_moved", F.lit(False).alias("_told"))
        told = moved.select(*[F.col("last")[c].alias(c) for c in key], F.col("last_ordinal").alias("n_ordinal"), F.lit(True).alias("_told"))
        both = both.unionByName(told, allowMissingColumns=True)
    spot = [*(["bucket", "_piece"] if place is not None else []), *key]
    if place is not None:
        both = both.withColumns({"bucket": place, "_piece": F.pmod(F.xxhash64(*key, F.lit(PIECES)), F.lit(PIECES))}).repartition("bucket", "_piece")
    # Rows of one id lie together, the last written first; a known id's version stays.
    same = W.partitionBy(*spot, "id")
    version = F.coalesce(F.max(F.when(~F.col("_new"), F.col("version"))).over(same), "version")
    nth = F.row_number().over(same.orderBy(F.desc("_new"), F.desc_nulls_last("n_ordinal")))
    chosen = both.withColumns({"version": version, "_nth": nth}).where("_nth = 1 OR _told")
    # A row demotes where it lies, one of a moved id where it is told.
    said = F.max(F.when(F.col("_told") | (F.col("_new") & ~F.col("_moved")), F.col("n_ordinal"))).over(W.partitionBy(*spot))
    last = F.when(F.col("account_id").isNotNull() & F.col("cycle").isNotNull(), said)
    current = F.when(F.col("_new"), (F.coalesce("last", F.lit(-1)) <= F.coalesce("n_ordinal", F.lit(-1))).cast("int")).when(F.col("last").isNotNull(), F.lit(0)).otherwise(F.col("was"))
    return chosen.withColumn("last", last).where("NOT _told").withColumn("is_current", current).select(*existing.columns, *spot[:-3])


def publish_outcomes(existing: DataFrame, release_profiles: DataFrame, release_outcomes: DataFrame) -> DataFrame:
    """A published profile's outcomes are replaced as a whole."""
    named = release_profiles.select(F.col("id").alias("profile_id")).distinct()
    return existing.join(named, "profile_id", "left_anti").select(*existing.columns).unionByName(release_outcomes.select(*existing.columns))


def publish_accounts(existing: DataFrame, release_accounts: DataFrame) -> DataFrame:
    """Existing accounts with a release's added: a known account keeps what was first written, the last handle counts."""
    before = existing.select("id", "source", "source_account_id", "public_handle", F.lit(-1).cast("long").alias("ordinal"))
    return latest_handle(before.unionByName(release_accounts.select(*before.columns)))


def release_digest(profiles: DataFrame) -> DataFrame:
    """One row `content_sha256`: the profiles' digests in order, hashed by tens of thousands until one is left.

    No task sees more than 10,000 digests at once; three rounds reach 10^12 places. An empty release has the digest of
    the empty text.
    """
    rows = profiles.select(F.col("ordinal").cast("long").alias("at"), F.col("content_sha256").alias("digest"))
    for last in (False, False, True):
        up = F.lit(0).cast("long") if last else F.floor(F.col("at") / 10_000).cast("long")
        told = F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda x: x["digest"])
        rows = rows.groupBy(up.alias("up")).agg(F.sha2(F.array_join(told, ""), 256).alias("digest")).select(F.col("up").alias("at"), "digest")
    return rows.agg(F.coalesce(F.max("digest"), F.sha2(F.lit(""), 256)).alias("content_sha256"))


def publish_ledger(existing: DataFrame, profiles: DataFrame, release: str, imported_at: str) -> DataFrame:
    """The ledger of imports with this release's row in place of an earlier one of the same name."""
    counts = profiles.agg(F.count("*").alias("profile_count"), F.countDistinct("account_id").alias("account_count"))
    row = release_digest(profiles).crossJoin(counts).select(F.lit(release).alias("release"), "content_sha256", F.lit(imported_at).alias("imported_at"), "profile_count", "account_count")
    return existing.where(F.col("release") != release).unionByName(row)


def publish_release(corpus: dict[str, DataFrame] | None, profiles: DataFrame, release: str, imported_at: str, place=None) -> dict[str, DataFrame]:
    """accounts, profiles, outcomes and imports of a corpus (None: empty) after a release of valid nested profiles.

    Publishing the same release again gives the same tables. `place` is that of publish_profiles.
    """
    accounts, rows, outcomes = flatten_release(profiles)
    if corpus is None:
        corpus = {
            "accounts": accounts.drop("ordinal").where("false"),
            "profiles": rows.drop("ordinal").withColumn("is_current", F.lit(0)).where("false"),
            "outcomes": outcomes.where("false"),
            "imports": profiles.sparkSession.createDataFrame([], IMPORTS),
        }
    written = rows.select("ordinal", *[c for c in corpus["profiles"].columns if c != "is_current"])
    return {
        "accounts": publish_accounts(corpus["accounts"], accounts),
        "profiles": publish_profiles(corpus["profiles"], written, place),
        "outcomes": publish_outcomes(corpus["outcomes"], rows, outcomes),
        "imports": publish_ledger(corpus["imports"], rows, release, imported_at),
    }


def integrity_check(accounts: DataFrame, profiles: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(rule, key) of every broken key, reference, enumeration and range."""
    many = lambda df, rule, *keys: df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(rule).alias("rule"), F.concat_ws(":", *keys).alias("key"))
    found = many(accounts, "account_key", "id").unionAll(many(profiles, "profile_key", "id")).unionAll(many(outcomes, "outcome_key", "id")).unionAll(many(profiles, "version_key", "account_id", "cycle", "version")).unionAll(many(profiles.where("is_current = 1"), "one_current", "account_id", "cycle"))
    lost = profiles.join(accounts.select(F.col("id").alias("account_id")), "account_id", "left_anti").select(F.lit("profile_account").alias("rule"), F.col("id").alias("key"))
    stray = outcomes.join(profiles.select(F.col("id").alias("profile_id")), "profile_id", "left_anti").select(F.lit("outcome_profile").alias("rule"), F.col("id").alias("key"))
    bad = profiles.where("gpa NOT BETWEEN 0 AND 4 OR mcat NOT BETWEEN 472 AND 528 OR review_status NOT IN ('reviewed', 'needs_review', 'excluded')").select(F.lit("profile_range").alias("rule"), F.col("id").alias("key"))
    odd = outcomes.where(~F.col("status").isin(*OUTCOMES)).select(F.lit("outcome_status").alias("rule"), F.col("id").alias("key"))
    return found.unionAll(lost).unionAll(stray).unionAll(bad).unionAll(odd)


def release_counts(profiles: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(part, value, n): profiles, accounts in all, by source and by cycle, outcome observations, mixed timing.

    Profiles are counted once by (account, source, cycle); sets of these give all parts.
    """
    mixed = F.count_if(F.col("timing_status") == "retrospective_mixed")
    few = profiles.groupBy("account_id", "source", "cycle").agg(F.count("*").alias("n"), mixed.alias("mixed"))
    sets = few.groupingSets([[], ["source"], ["cycle"]], "source", "cycle").agg(F.countDistinct("account_id").alias("accounts"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("mixed"), F.lit(0)).alias("mixed"), F.grouping_id().alias("g"))
    part = lambda name, n, value=None: F.struct(F.lit(name).alias("part"), (F.lit("") if value is None else F.col(value)).alias("value"), F.col(n).cast("long").alias("n"))
    whole = F.array(part("profiles", "n"), part("accounts", "accounts"), part("mixed_timing", "mixed"))
    parts = F.when(F.col("g") == 3, whole).when(F.col("g") == 1, F.array(part("accounts_by_source", "accounts", "source"))).otherwise(F.array(part("accounts_by_cycle", "accounts", "cycle")))
    counted = sets.select(F.explode(parts).alias("p")).select("p.*")
    return counted.unionAll(outcomes.agg(F.count("*").alias("n")).select(F.lit("outcomes"), F.lit(""), "n"))


def coverage_check(published: DataFrame, counted: DataFrame) -> DataFrame:
    """(part, value) whose published and counted numbers differ or are missing on one side."""
    a, b = published.select("part", "value", F.col("n").alias("published")), counted.select("part", "value", F.col("n").alias("counted"))
    return a.join(b, ["part", "value"], "full_outer").where(~F.col("published").eqNullSafe(F.col("counted")))


def artifact_mismatch(profiles: DataFrame, digests: DataFrame) -> DataFrame:
    """Profiles whose artifact is missing or whose digest differs; digests: (name, sha256)."""
    name = F.substring_index("artifact_key", "/", -1)
    rows = profiles.select("id", "content_sha256", name.alias("name")).join(digests, "name", "left")
    return rows.where(F.col("sha256").isNull() | (F.col("sha256") != F.col("content_sha256"))).select("id", "name", F.when(F.col("sha256").isNull(), "missing").otherwise("differs").alias("reason"))
