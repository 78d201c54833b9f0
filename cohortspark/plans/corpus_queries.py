"""Validation, publishing and integrity over the derived corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.operators import batch, publish
from cohortspark.plans.register import query
from cohortspark.plans.search_queries import nested
from cohortspark.sources import files, store


def release(t):
    """Nested profiles in the shape that validation reads; some break rules, by their order's number."""
    p = nested(t).join(t.accounts.select(F.col("id").alias("account_id"), "source_account_id", "public_handle"), "account_id")
    url = F.concat(F.when(F.col("orderkey") % 19 == 0, "http://").otherwise("https://"), F.expr("CASE source WHEN 'reddit' THEN 'www.reddit.com' WHEN 'sdn' THEN 'forums.studentdoctor.net' ELSE 'www.mdapplicants.com' END"), F.lit("/x"))
    return (
        p.withColumn("url", url)
        .withColumn("source_urls", F.array("url"))
        .withColumn("outcomes", F.transform("outcomes", lambda o: o.withField("program", F.concat(F.lit("MD "), o["status"])).withField("count_kind", F.lit("explicit")).withField("reported_count", F.when(o["ord"] % 2 == 0, (o["ord"] + 1).cast("double"))).withField("source_url", F.col("url"))))
        .withColumn("science_gpa", F.when(F.col("orderkey") % 23 == 0, F.col("gpa") + 3))
        .withColumn("extraction_confidence", F.lit("high"))
        .withColumn("content_sha256", F.sha2("id", 256))
        .withColumn("artifact_key", F.concat(F.lit("corpus/"), "id"))
        .withColumn("notes", F.array(F.lit("n")))
        .withColumn("ordinal", F.col("orderkey"))
    )


def broken(t):
    """The release with every rule of a row broken somewhere, by the order's number."""
    p = release(t)
    k = F.col("orderkey") % 97
    on = lambda n, column, value: F.when(k == n, value).otherwise(F.col(column))
    hours = lambda a, **f: a.withField("hours", F.struct(*[(f.get(c, a["hours"][c])).alias(c) for c in ("min", "max", "precision")]))
    acts = F.when(k == 14, F.transform("activities", lambda a: a.withField("description", F.lit("")))).when(k == 15, F.transform("activities", lambda a: hours(a, min=F.lit(-1.0)))).when(k == 16, F.transform("activities", lambda a: hours(a, min=a["hours"]["max"] + 1)))
    for n, word in ((17, "explicit_absence"), (18, "unreported"), (19, "odd")):
        acts = acts.when(k == n, F.transform("activities", lambda a: hours(a, precision=F.lit(word))))  # noqa: B023
    acts = acts.when(k == 26, F.transform("activities", lambda a: hours(a, min=F.lit(float("inf"))))).otherwise(F.col("activities"))
    outs = F.when(k == 20, F.transform("outcomes", lambda o: o.withField("status", F.lit("odd"))))
    for n, field, value in ((21, "reported_count", F.lit(0.0)), (22, "reported_count", F.lit(1.5)), (23, "evidence", F.lit("")), (24, "source_url", F.lit("https://other")), (25, "cycle", F.lit("1999-00"))):
        outs = outs.when(k == n, F.transform("outcomes", lambda o: o.withField(field, value)))  # noqa: B023
    none = F.array().cast("array<string>")
    changed = {
        "id": on(0, "id", F.upper("id")), "source": on(1, "source", F.lit("other")), "account_id": on(2, "account_id", F.concat(F.lit("x-"), "id")), "version": on(3, "version", F.col("orderkey")), "cycle": on(3, "cycle", F.lit("2024-26")), "extraction_confidence": on(4, "extraction_confidence", F.lit("low")), "timing_status": on(5, "timing_status", F.lit("other")),
        "gpa": F.when(k == 6, F.lit(4.5)).when(k == 7, F.lit(float("nan"))).otherwise(F.col("gpa")), "mcat": F.when(k == 8, F.lit(471.0)).when(k == 9, F.lit(500.5)).otherwise(F.col("mcat").cast("double")), "source_urls": on(10, "source_urls", none), "content_sha256": on(11, "content_sha256", F.lit("zz")), "artifact_key": on(12, "artifact_key", F.lit("x")),
        "notes": on(13, "notes", F.array(F.lit(None).cast("string"))), "activities": acts, "outcomes": outs.otherwise(F.col("outcomes")),
    }
    return p.withColumns(changed)


#: Rules and where `broken` and the tables themselves break them; k is the order's number mod 97, a and o count activities and outcomes.
_BROKEN = {
    "profile_id": "k = 0", "source": "k = 1", "account_identity": "k IN (1, 2)", "cycle": "k = 3", "review_status": "review_status <> 'reviewed'", "confidence": "k = 4", "timing_status": "k = 5", "gpa": "k IN (6, 7)", "science_gpa": "orderkey % 23 = 0 AND gpa + 3 > 4", "mcat": "k IN (8, 9)",
    "source_urls": "orderkey % 19 = 0 OR k IN (1, 10)", "sha256": "k = 11", "artifact_key": "k = 12", "notes": "k = 13", "activity_count": "a < 2", "activity_description": "k = 14 AND a > 0", "hours_bound": "k IN (15, 26) AND a > 0", "hours_order": "k IN (16, 26) AND a > 0", "hours_absence": "k = 17 AND a > 0", "hours_unreported": "k = 18 AND a > 0", "hours_precision": "k = 19 AND a > 0",
    "explicit_outcome": "ar = 0 OR k IN (20, 23)", "outcome_status": "k = 20 AND o > 0", "outcome_count": "k IN (21, 22) AND o > 0", "outcome_evidence": "k = 23 AND o > 0", "outcome_url": "k IN (10, 24) AND o > 0", "outcome_cycle": "k = 25 AND o > 0",
}


@query(f"""WITH x AS (SELECT profile_id, count(*) AS n FROM {{activities}} GROUP BY profile_id), y AS (SELECT profile_id, count(*) AS n, count(*) FILTER (WHERE status IN ('accepted', 'rejected')) AS ar FROM {{outcomes}} GROUP BY profile_id),
p AS (SELECT p.*, orderkey % 97 AS k, coalesce(x.n, 0) AS a, coalesce(y.n, 0) AS o, coalesce(y.ar, 0) AS ar FROM {{profiles}} p LEFT JOIN x ON x.profile_id = p.id LEFT JOIN y ON y.profile_id = p.id)
{" UNION ALL ".join(f"SELECT CASE WHEN k = 0 THEN upper(id) ELSE id END AS profile_id, '{rule}' AS rule FROM p WHERE {where}" for rule, where in _BROKEN.items())}""")
def validate_corpus(t):
    return publish.validate_corpus(broken(t))


@query("SELECT 'duplicate_version' AS rule, account_id || ':' || cycle || ':1' AS key, count(*) AS rows FROM {profiles} GROUP BY account_id, cycle HAVING count(*) > 1")
def duplicate_keys(t):
    return publish.duplicate_keys(t.profiles.withColumn("version", F.lit(None).cast("long")))


_URL = "CASE WHEN p.orderkey % 19 = 0 THEN 'http://' ELSE 'https://' END || CASE p.source WHEN 'reddit' THEN 'www.reddit.com' WHEN 'sdn' THEN 'forums.studentdoctor.net' ELSE 'www.mdapplicants.com' END || '/x'"
#: The three tables as one: each row's table, id and its columns as text.
_OUTCOMES = f"SELECT 'outcomes' AS part, o.id, concat_ws('|', o.profile_id, o.account_id, o.cycle, o.status, 'MD ' || o.status, coalesce(o.school, '-'), CASE WHEN ord % 2 = 0 THEN cast(ord + 1 AS string) ELSE '-' END, 'explicit', cast(o.conditional AS string), {_URL}, 'told: ' || o.status) AS told FROM {{outcomes}} o JOIN {{profiles}} p ON p.id = o.profile_id"


def told_outcomes(outcomes):
    """Outcomes as (part, id, told)."""
    text = F.concat_ws("|", "profile_id", "account_id", "cycle", "status", "program", F.coalesce("school", F.lit("-")), F.coalesce(F.col("reported_count").cast("string"), F.lit("-")), "count_kind", F.col("conditional").cast("string"), "source_url", "evidence")
    return outcomes.select(F.lit("outcomes").alias("part"), "id", text.alias("told"))


@query(f"""{_OUTCOMES} UNION ALL SELECT 'accounts', account_id, concat_ws('|', p.source, a.source_account_id, a.public_handle, cast(p.orderkey AS string)) FROM {{profiles}} p JOIN {{accounts}} a ON a.id = p.account_id
UNION ALL SELECT 'profiles', p.id, concat_ws('|', p.account_id, p.cycle, coalesce(cast(gpa AS string), '-'), p.id || ' in ' || p.cycle, cast(coalesce(n, 0) AS string), coalesce(k, '')) FROM {{profiles}} p
LEFT JOIN (SELECT profile_id, count(*) AS n, string_agg(category, ',' ORDER BY ord) AS k FROM {{activities}} GROUP BY profile_id) x ON x.profile_id = p.id""")
def flatten_release(t):
    """All three tables; of a profile the activities are read back from its document."""
    accounts, rows, outcomes = publish.flatten_release(t.written(release(t), "release"))
    handles = accounts.select(F.lit("accounts").alias("part"), "id", F.concat_ws("|", "source", "source_account_id", "public_handle", F.col("ordinal").cast("string")).alias("told"))
    document = F.from_json("profile_json", "account_id string, cycle string, gpa double, summary string, activities array<struct<category:string>>")
    told = F.concat_ws("|", "d.account_id", "d.cycle", F.coalesce(F.col("d.gpa").cast("string"), F.lit("-")), "d.summary", F.size("d.activities").cast("string"), F.array_join("d.activities.category", ","))
    profiles = rows.select("id", document.alias("d")).select(F.lit("profiles").alias("part"), "id", told.alias("told"))
    return told_outcomes(outcomes).unionAll(handles).unionAll(profiles)


@query("SELECT account_id AS id, source, arg_max(id, orderkey) AS public_handle FROM {profiles} GROUP BY account_id, source")
def latest_handle(t):
    a = t.profiles.selectExpr("account_id AS id", "source", "account_id AS source_account_id", "id AS public_handle", "orderkey AS ordinal")
    return publish.latest_handle(a).select("id", "source", "public_handle")


@query("SELECT id, CASE WHEN row_number() OVER (PARTITION BY account_id, cycle ORDER BY orderkey % 3 DESC, orderkey DESC) = 1 THEN 1 ELSE 0 END AS is_current FROM {profiles}")
def current_versions(t):
    imports = t.profiles.drop("is_current").withColumn("release_seq", F.col("orderkey") % 3).withColumn("ordinal", F.col("orderkey"))
    return publish.current_versions(imports).select("id", "is_current")


@query("""WITH r AS (SELECT * FROM {profiles} WHERE orderkey % 4 = 1), l AS (SELECT account_id, cycle, max(orderkey) AS last FROM r GROUP BY ALL)
SELECT p.id, p.account_id, p.cycle, CASE WHEN p.orderkey % 4 = 1 THEN 9.5 ELSE p.gpa END AS gpa, CASE WHEN p.orderkey % 4 = 1 THEN CASE WHEN l.last = p.orderkey THEN 1 ELSE 0 END WHEN l.last IS NOT NULL THEN 0 ELSE p.is_current END AS is_current
FROM {profiles} p LEFT JOIN l ON l.account_id = p.account_id AND l.cycle = p.cycle""")
def publish_release(t):
    p = t.profiles.drop("orderkey", "source")
    # A release of a quarter of the profiles over all others; half of the release is new.
    existing = t.profiles.where("orderkey % 8 <> 5").select(*p.columns)
    new = t.profiles.where("orderkey % 4 = 1").withColumn("gpa", F.lit(9.5)).withColumn("ordinal", F.col("orderkey")).drop("orderkey", "source", "is_current")
    once = publish.publish_profiles(existing, new)
    return publish.publish_profiles(once, new).select("id", "account_id", "cycle", "gpa", "is_current")


@query("""SELECT id, profile_id, status FROM {outcomes} WHERE profile_id NOT IN (SELECT id FROM {profiles} WHERE orderkey % 3 = 0) UNION ALL SELECT o.id, profile_id, 'pending' FROM {outcomes} o JOIN {profiles} p ON p.id = o.profile_id WHERE p.orderkey % 3 = 0 AND ord < 2""")
def publish_outcomes(t):
    named = t.profiles.where("orderkey % 3 = 0").select("id")
    new = t.outcomes.join(named.withColumnRenamed("id", "profile_id"), "profile_id").where("ord < 2").withColumn("status", F.lit("pending"))
    return publish.publish_outcomes(t.outcomes, named, new).select("id", "profile_id", "status")


@query("""WITH p AS (SELECT *, substr(id, 12, 1) = '7' AS lost FROM {profiles}), c AS (SELECT account_id, cycle FROM p WHERE NOT lost GROUP BY ALL HAVING count(*) > 1)
SELECT 'profile_account' AS rule, p.id AS key FROM p JOIN {accounts} a ON a.id = p.account_id WHERE a.custkey % 10 = 0 AND NOT lost UNION ALL SELECT 'outcome_profile', o.id FROM {outcomes} o JOIN p ON p.id = o.profile_id WHERE lost UNION ALL SELECT 'outcome_profile', o.id FROM {outcomes} o JOIN p ON p.id = o.profile_id WHERE lost AND ord = 4 AND status = 'accepted'
UNION ALL SELECT 'one_current', account_id || ':' || cycle FROM c UNION ALL SELECT 'version_key', account_id || ':' || cycle || ':1' FROM c UNION ALL SELECT 'account_key', id FROM {accounts} WHERE custkey % 10 <> 0 AND custkey % 17 = 0
UNION ALL SELECT 'profile_range', id FROM p WHERE NOT lost AND orderkey % 41 = 0 UNION ALL SELECT 'outcome_status', id FROM {outcomes} WHERE ord = 3 AND status = 'pending' UNION ALL SELECT 'outcome_key', id FROM {outcomes} WHERE ord = 4 AND status = 'accepted'""")
def integrity_check(t):
    """Every rule broken somewhere: accounts and profiles missing and doubled, all profiles current and of version 1, a metric and a status out of range."""
    a, o = t.accounts.where("custkey % 10 <> 0"), t.outcomes
    profiles = t.profiles.where("substr(id, 12, 1) <> '7'").withColumns({"is_current": F.lit(1), "version": F.lit(1), "gpa": F.when(F.col("orderkey") % 41 == 0, F.lit(4.5)).otherwise(F.col("gpa"))})
    outcomes = o.withColumn("status", F.when((F.col("ord") == 3) & (F.col("status") == "pending"), "odd").otherwise(F.col("status")))
    twice = outcomes.where("ord = 4 AND status = 'accepted'")
    return publish.integrity_check(a.unionAll(a.where("custkey % 17 = 0")), profiles, outcomes.unionAll(twice))


_COUNTS = """SELECT 'profiles' AS part, '' AS value, count(*) AS n FROM {profiles} UNION ALL SELECT 'accounts', '', count(DISTINCT account_id) FROM {profiles} UNION ALL SELECT 'outcomes', '', count(*) FROM {outcomes}
UNION ALL SELECT 'mixed_timing', '', count(*) FROM {profiles} WHERE timing_status = 'retrospective_mixed' UNION ALL SELECT 'accounts_by_source', source, count(DISTINCT account_id) FROM {profiles} GROUP BY source UNION ALL SELECT 'accounts_by_cycle', cycle, count(DISTINCT account_id) FROM {profiles} GROUP BY cycle"""


@query(_COUNTS)
def release_counts(t):
    return publish.release_counts(t.profiles, t.outcomes)


@query(f"""WITH a AS ({_COUNTS}), b AS ({_COUNTS.replace("{profiles}", "r").replace("FROM a", "FROM r")}) SELECT part, value, a.n AS published, b.n AS counted FROM a FULL JOIN b USING (part, value) WHERE a.n IS DISTINCT FROM b.n""".replace("WITH a AS", "WITH r AS (SELECT * FROM {profiles} WHERE review_status = 'reviewed' AND cycle <> '2019-20'), a AS"))
def coverage_check(t):
    """All parts: a count of the reviewed profiles without one cycle against what all profiles give."""
    reviewed = t.profiles.where("review_status = 'reviewed' AND cycle <> '2019-20'")
    return publish.coverage_check(publish.release_counts(t.profiles, t.outcomes), publish.release_counts(reviewed, t.outcomes))


@query("SELECT id, id AS name, CASE WHEN orderkey % 3 = 0 THEN 'missing' ELSE 'differs' END AS reason FROM {profiles} WHERE orderkey % 3 = 0 OR orderkey % 5 = 0")
def artifact_mismatch(t):
    digests = t.profiles.where("orderkey % 3 <> 0").select(F.col("id").alias("name"), F.when(F.col("orderkey") % 5 == 0, "other").otherwise(F.sha2("id", 256)).alias("sha256"))
    return publish.artifact_mismatch(release(t).select("id", "content_sha256", "artifact_key"), digests)


@query("SELECT id AS message_id, text, CASE WHEN length(text) % 2 = 0 THEN 'stop' END AS finish, false AS bad FROM (SELECT 'm-' || cast(conv_id AS string) || '-' || cast(turn AS string) AS id, text FROM {conversations} WHERE role = 'assistant')")
def read_event_frames(t):
    m = t.conversations.where("role = 'assistant'").selectExpr("concat('m-', conv_id, '-', turn) AS message_id", "1 AS seq", "text")
    choice = F.struct(F.struct(F.col("text").alias("content"), F.lit("hidden").alias("reasoning")).alias("delta"), F.when(F.length("text") % 2 == 0, "stop").alias("finish_reason"))
    block = F.concat(F.lit(": note\r\nevent: x\r\ndata:   "), F.to_json(F.struct(F.array(choice).alias("choices"))), F.lit("\r\n"))
    return files.read_event_frames(m.withColumn("block", block)).drop("seq")


@query("""WITH p AS (SELECT *, sha256(id) AS sha, CASE WHEN orderkey % 4 = 1 THEN 'r-2' ELSE 'r-1' END AS release FROM {profiles}),
a AS (SELECT release, orderkey // 10000 AS up, sha256(string_agg(sha, '' ORDER BY orderkey)) AS sha FROM p GROUP BY ALL), b AS (SELECT release, up // 10000 AS up, sha256(string_agg(sha, '' ORDER BY up)) AS sha FROM a GROUP BY ALL),
c AS (SELECT release, sha256(string_agg(sha, '' ORDER BY up)) AS content_sha256 FROM b GROUP BY ALL)
SELECT release, content_sha256, '2026-01-01' AS imported_at, count(*) AS profile_count, count(DISTINCT account_id) AS account_count, (SELECT count(*) FROM p) AS stored FROM p JOIN c USING (release) GROUP BY ALL""")
def write_corpus(t):
    """Two releases published into a store one after the other; its ledger, with the number of stored profiles."""
    rows, path = t.written(release(t), "release"), t.folder("store")
    for name, part in (("r-1", rows.where("orderkey % 4 <> 1")), ("r-2", rows.where("orderkey % 4 = 1"))):
        store.publish(path, part, name, "2026-01-01", 16)
    corpus = store.read_corpus(t.spark, path)
    return corpus["imports"].crossJoin(corpus["profiles"].agg(F.count("*").alias("stored")))


@query("SELECT id, row_number() OVER (ORDER BY id) - 1 AS ordinal, account_id, cycle, gpa, coalesce(n, 0) AS activities FROM {profiles} p LEFT JOIN (SELECT profile_id, count(*) AS n FROM {activities} GROUP BY profile_id) a ON a.profile_id = p.id")
def read_release(t):
    """The profiles as JSON lines over many packed files, read back with their numbers."""
    line = F.to_json(F.struct("id", F.col("account_id").alias("accountId"), "source", "cycle", "gpa", "activities", "outcomes"))
    path = t.folder("lines")
    nested(t).select("id", line.alias("value")).orderBy("id").select("value").write.text(path, compression="gzip")
    got = files.read_release(t.spark, path, lines=True)
    return got.select("p.id", "ordinal", F.col("p.accountId").alias("account_id"), "p.cycle", "p.gpa", F.size("p.activities").cast("long").alias("activities"))


@query()
def artifact_digests(t):
    return files.artifact_digests(t.spark, f"{t.sf_dir}/*.parquet")


@query("SELECT id, source || ':' || lower(source_account_id) = id AS same, source || ':' || lower(source_account_id || 'X') AS other FROM {accounts}")
def account_identity(t):
    return t.accounts.select("id", (publish.account_identity(F.col("source"), F.col("source_account_id")) == F.col("id")).alias("same"), publish.account_identity(F.col("source"), F.concat("source_account_id", F.lit("X"))).alias("other"))


@query(r"""WITH u AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'reddit' WHEN 1 THEN 'sdn' WHEN 2 THEN 'mdapplicants' ELSE 'other' END AS source, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN replace(url, regexp_extract(url, '//([^/]*)', 1), 'www.reddit.com') ELSE replace(regexp_replace(url, '^https?:', 'http:'), regexp_extract(url, '//([^/]*)', 1), 'forums.studentdoctor.net') END AS url FROM {pages})
SELECT page_id, regexp_extract(url, '^(\w+):', 1) = 'https' AND regexp_extract(url, '//([^/:?#]*)', 1) = CASE source WHEN 'reddit' THEN 'www.reddit.com' WHEN 'sdn' THEN 'forums.studentdoctor.net' WHEN 'mdapplicants' THEN 'www.mdapplicants.com' ELSE '-' END AS ok FROM u""")
def source_url_ok(t):
    """Page addresses as they are, on the host of a source, and without encryption."""
    host = F.regexp_extract("url", "//([^/]*)", 1)
    url = F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, F.replace("url", host, F.lit("www.reddit.com"))).otherwise(F.replace(F.regexp_replace("url", "^https?:", "http:"), host, F.lit("forums.studentdoctor.net")))
    source = F.element_at(F.array(*map(F.lit, ("reddit", "sdn", "mdapplicants", "other"))), (F.col("page_id") % 4 + 1).cast("int"))
    return t.pages.select("page_id", publish.source_url_ok(url, source).alias("ok"))


@query("SELECT o_orderkey, a = 20 AND (b + 1) % 100 = c AS valid FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 19 ELSE 20 END AS a, o_orderkey % 100 AS b, (o_orderkey + o_orderkey % 3) % 100 AS c FROM {orders})")
def valid_cycle(t):
    """Cycles whose second year follows the first in every third order, in every seventh of another century."""
    text = F.format_string("%d%02d-%02d", F.when(F.col("o_orderkey") % 7 == 0, 19).otherwise(20), F.col("o_orderkey") % 100, (F.col("o_orderkey") + F.col("o_orderkey") % 3) % 100)
    return t.orders.select("o_orderkey", batch.valid_cycle(text).alias("valid"))
