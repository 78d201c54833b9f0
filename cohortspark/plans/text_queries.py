"""Rules on texts, files and budgets over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.functions import budgets, files, texts
from cohortspark.plans.register import query

_ASK = "CASE doc_id % 6 WHEN 0 THEN 'Answer in two sentences.' WHEN 1 THEN 'Do not answer in 3 sentences.' WHEN 2 THEN 'Use at most 4 sentences' WHEN 3 THEN 'Give a 5-sentence reply in July 2027 or 2026-11' WHEN 4 THEN 'Say \"in two sentences\" under 50 words' ELSE text END"


@query("SELECT doc_id, cast(CASE doc_id % 6 WHEN 0 THEN 2 WHEN 3 THEN 5 END AS integer) AS required FROM {documents}")
def requested_sentences(t):
    return t.documents.select("doc_id", texts.requested_sentences(F.expr(_ASK)).alias("required"))


@query("SELECT doc_id, doc_id % 6 = 4 AS limited FROM {documents}")
def explicit_length_limit(t):
    return t.documents.select("doc_id", texts.explicit_length_limit(F.expr(_ASK)).alias("limited"))


@query("SELECT doc_id, CASE WHEN doc_id % 6 = 3 THEN ['2026-11', '2027-07'] ELSE []::VARCHAR[] END AS months FROM {documents}")
def future_months(t):
    return t.documents.select("doc_id", texts.future_months(F.expr(_ASK), "2026-09-10").alias("months"))


_SENTENCES = r"""WITH f AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 2 ELSE 5 END AS required, string_split(coalesce(text, ''), '```') AS p FROM {documents}),
 l AS (SELECT doc_id, required, string_split(array_to_string(list_filter(p, lambda x, i: i % 2 = 1 OR i = len(p)), ' '), chr(10)) AS lines FROM f),
 j AS (SELECT doc_id, required, string_split(array_to_string(list_transform(list_filter(lines, lambda x: NOT regexp_matches(ltrim(x), '^#{1,6}\s')), lambda x: regexp_replace(ltrim(x), '^(?:[-*+]|[0-9]+[.)])\s+', '')), ' '), '](') AS k FROM l),
 t AS (SELECT doc_id, required, array_to_string(list_transform(k, lambda x, i: CASE WHEN i = 1 THEN x ELSE substr(x, strpos(x, ')') + 1) END), '] ') AS plain FROM j),
 a AS (SELECT doc_id, required, list_filter(list_transform(regexp_split_to_array(plain, '\s+'), lambda x: regexp_replace(x, '^\[?[A-Z][0-9]+(?:,$|\])', '')), lambda x: x <> '') AS w FROM t),
 b AS (SELECT doc_id, required, regexp_replace(regexp_replace(array_to_string(w, ' '), '\b(Mr|Mrs|Ms|Dr|Prof|Sr|Jr|St)\.', '\1_', 'g'), '(?i)\b(e|i)\.(g|e)\.', '\1_\2_', 'g') AS t FROM a),
 r AS (SELECT doc_id, required, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[\p{M}\p{Cf}]', '', 'g'), '\p{Ll}', 'a', 'g'), '[\p{Lu}\p{Lt}]', 'B', 'g'), '[\p{Lm}\p{Lo}]', '字', 'g'), '\p{Nd}', '1', 'g') AS t FROM b),
 q AS (SELECT doc_id, required, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[\p{Nl}\p{No}]', '½', 'g'), '[\p{Ps}\p{Pe}\p{Pi}\p{Pf}''¡¿"]', '"', 'g'), '\s', ' ', 'g'), '[-:;–—]', ',', 'g'), '\?', '!', 'g') AS t FROM r),
 n AS (SELECT doc_id, required, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\.1', '_1', 'g'), '([aB])\.B', '\1_B', 'g'), '([aB])\.B', '\1_B', 'g'), '\.(\x22* *[^字Ba.!]*a)', '_\1', 'g') AS t FROM q),
 m AS (SELECT doc_id, required, regexp_replace(regexp_replace(regexp_replace(t, '(?:[.!]\x22* *)+([.!])', '\1', 'g'), '[.!](\x22* *,)', '_\1', 'g'), '[.!]\x22* *', chr(10), 'g') AS t FROM n)"""


@query(_SENTENCES + r"""
 SELECT doc_id, cast(required AS integer) AS required, cast(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[aB字1½]'))) AS integer) AS actual, len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[aB字1½]'))) = required AS valid FROM m WHERE doc_id % 6 IN (0, 3)""")
def sentence_check(t):
    checked = t.documents.select("doc_id", texts.sentence_check(F.expr(_ASK), F.coalesce("text", F.lit(""))).alias("c"))
    return checked.where("c IS NOT NULL").select("doc_id", "c.required", "c.actual", "c.valid")


@query(_SENTENCES + " SELECT doc_id, cast(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[aB字1½]'))) AS integer) AS sentences FROM m")
def sentence_count(t):
    return t.documents.select("doc_id", texts.sentence_count(F.coalesce("text", F.lit(""))).alias("sentences"))


@query(r"""WITH m AS (SELECT *, cast(1 + (conv_id + turn) % 4 AS string) AS x, cast(1 + (conv_id * 3 + turn) % 6 AS string) AS y FROM {messages})
SELECT id AS message_id, CASE WHEN role <> 'assistant' THEN content ELSE regexp_replace(regexp_replace(content, '\[P\d, P[1-4]\] ', '[P' || x || '](#source-P' || x || ') [P' || y || '](#source-P' || y || ') '), '\[C1\]', '[C1](#source-C1)') END AS linked FROM m""")
def link_citations(t):
    """Groups of two against the sources of their own message: P1 to P4 and C1 are known, P5 and P6 are not."""
    m, known = t.messages, t.sources.groupBy("message_id").agg(F.collect_set("id").alias("known"))
    rows = m.join(known, m["id"] == known["message_id"], "left").drop("message_id")
    return rows.select(F.col("id").alias("message_id"), texts.link_citations(F.col("content"), F.col("known")).alias("linked"))


@query("SELECT page_id, left(replace(url, '/', '_'), 160) AS name FROM {pages}")
def safe_name(t):
    return t.pages.select("page_id", texts.safe_name(F.col("url")).alias("name"))


@query("SELECT doc_id, sha256(text) AS digest FROM {documents}")
def content_sha256(t):
    return t.documents.select("doc_id", texts.content_sha256(F.col("text")).alias("digest"))


@query(r"SELECT page_id, regexp_full_match(substr(url, 9), '[A-Za-z0-9_-]{8,100}') AS id_ok, length(trim(html)) BETWEEN 1 AND 20000 AS question_ok FROM {pages}")
def valid_requests(t):
    return t.pages.select("page_id", texts.valid_request_id(F.substr("url", F.lit(9))).alias("id_ok"), texts.valid_question(F.col("html")).alias("question_ok"))


@query(r"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '# head' || chr(10) || '<b>x</b>' ELSE text END AS t FROM {documents}) SELECT doc_id, CASE WHEN length(trim(regexp_replace(regexp_replace(t, '(?m)^#{1,6}\s+.*$', '', 'g'), '<[^>]*>', '', 'g'), chr(10) || ' ')) < 15 THEN 'empty_extraction' WHEN length(t) > 80000 THEN 'extraction_too_large' ELSE 'ready' END AS verdict FROM d""")
def extraction_verdict(t):
    text = F.when(F.col("doc_id") % 11 == 0, "# head\n<b>x</b>").otherwise(F.col("text"))
    return t.documents.select("doc_id", files.extraction_verdict(text, F.lit(True)).alias("verdict"))


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'invalid_file' WHEN 2 THEN 'unsupported_file' WHEN 3 THEN 'text/plain' ELSE 'empty_file' END AS verdict FROM {documents}""")
def file_signature_check(t):
    name = F.expr("concat('f.', CASE doc_id % 5 WHEN 0 THEN 'PDF' WHEN 1 THEN 'png' WHEN 2 THEN 'exe' ELSE 'txt' END)")
    body = F.when(F.col("doc_id") % 5 == 4, "").when(F.col("doc_id") % 5 == 0, F.concat(F.lit("x "), F.lit("%PDF-1.7"), F.col("text"))).otherwise(F.col("text")).cast("binary")
    return t.documents.select("doc_id", files.file_verdict(name, F.octet_length(body), body).alias("verdict"))


@query("SELECT l_orderkey, ord, cast(l_quantity AS double) + l_partkey % 7 + l_suppkey AS total, cast(l_quantity AS double) - l_partkey % 7 - l_suppkey AS difference, cast(l_quantity AS double) * (l_partkey % 7) * l_suppkey AS product, cast(list_median AS double) AS middle FROM (SELECT *, list_aggregate([cast(l_quantity AS double), cast(l_partkey % 7 AS double), cast(l_suppkey AS double)], 'median') AS list_median FROM {li})")
def calculate(t):
    v = F.array(F.col("l_quantity").cast("double"), (F.col("l_partkey") % 7).cast("double"), F.col("l_suppkey").cast("double"))
    one = lambda op: budgets.calculate(F.lit(op), v)
    return t.li.select("l_orderkey", "ord", one("sum").alias("total"), one("difference").alias("difference"), one("product").alias("product"), one("median").alias("middle"))


@query("""SELECT l_orderkey, ord, q * w AS total, greatest(0, 500 - q * w) AS shortfall, 500 - q * w <= 0 AS fits FROM (SELECT l_orderkey, ord, cast(l_quantity AS double) AS q, cast(l_linenumber * 3 AS double) AS w FROM {li})""")
def weekly_budget(t):
    b = budgets.weekly_budget(F.col("l_quantity").cast("double"), (F.col("l_linenumber") * 3).cast("double"), F.lit(500.0))
    return t.li.select("l_orderkey", "ord", b.alias("b")).select("l_orderkey", "ord", "b.total", "b.shortfall", "b.fits")


@query("""SELECT l_orderkey, ord, greatest(0, DATE '1998-06-01' - d) / 7.0 * 7 AS by_start, greatest(0, DATE '1998-07-01' - d) / 7.0 * 7 AS through_end FROM (SELECT l_orderkey, ord, cast(l_shipdate AS date) AS d FROM {li})""")
def calendar_budget(t):
    # The rule is for months of this century: both dates are moved by 28 years, which keeps weekdays and leap years.
    b = budgets.calendar_budget(F.lit(7.0), F.lit("2026-06"), F.lit(None).cast("double"), F.add_months(F.col("l_shipdate").cast("date"), 336))
    return t.li.select("l_orderkey", "ord", b.alias("b")).select("l_orderkey", "ord", "b.by_start", "b.through_end")
