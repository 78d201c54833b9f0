"""The library's tables derived from the driver's, as SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Each table's SQL; {name} stands for another one. 1704067200000 is 2024-01-01 in milliseconds.
SQL: dict[str, str] = {
    "accounts": """
SELECT source || ':' || lower(c_name) AS id, source, c_name AS source_account_id, c_name AS public_handle, c_custkey AS custkey
FROM (SELECT c_custkey, c_name, CASE WHEN c_custkey % 8 < 6 THEN 'reddit' WHEN c_custkey % 8 = 6 THEN 'sdn' ELSE 'mdapplicants' END AS source FROM {customer}) c""",
    "profiles": """
SELECT 'p-' || lpad(cast(o_orderkey AS string), 10, '0') AS id, a.id AS account_id, a.source,
       cast(y AS string) || '-' || lpad(cast((y + 1) % 100 AS string), 2, '0') AS cycle,
       cast(row_number() OVER (PARTITION BY o_custkey, y ORDER BY o_orderdate, o_orderkey) AS bigint) AS version,
       CASE WHEN row_number() OVER (PARTITION BY o_custkey, y ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 THEN 1 ELSE 0 END AS is_current,
       CASE WHEN o_orderstatus = 'P' THEN 'needs_review' ELSE 'reviewed' END AS review_status,
       cast(cast(o_orderdate AS date) AS string) AS observed_at,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE cast(200 + (o_orderkey * 37) % 201 AS double) / 100 END AS gpa,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE cast(472 + (o_orderkey * 29) % 57 AS bigint) END AS mcat,
       CASE WHEN o_orderkey % 29 = 0 THEN 'retrospective_mixed' ELSE 'cycle_report' END AS timing_status,
       o_orderkey AS orderkey
FROM (SELECT *, cast(year(o_orderdate) AS bigint) + 24 AS y FROM {orders}) o JOIN {accounts} a ON a.custkey = o.o_custkey""",
    "li": """
SELECT *, cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) - 1 AS bigint) AS ord FROM {lineitem}""",
    "outcomes": """
SELECT p.id || ':' || cast(ord AS string) AS id, p.id AS profile_id, p.account_id, ord,
       CASE WHEN l_linenumber = 7 THEN cast(y + 1 AS string) || '-' || lpad(cast((y + 2) % 100 AS string), 2, '0') ELSE p.cycle END AS cycle,
       CASE l_partkey % 7 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' WHEN 2 THEN 'interview' WHEN 3 THEN 'waitlisted' WHEN 4 THEN 'withdrawn' WHEN 5 THEN 'pending' ELSE 'unknown' END AS status,
       CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE s_name END AS school,
       CASE WHEN l_linenumber = 6 THEN 1 ELSE 0 END AS conditional
FROM {li} l JOIN (SELECT *, cast(substr(cycle, 1, 4) AS bigint) AS y FROM {profiles}) p ON p.orderkey = l.l_orderkey JOIN {supplier} s ON s.s_suppkey = l.l_suppkey""",
    "activities": """
SELECT p.id AS profile_id, ord,
       CASE l_suppkey % 5 WHEN 0 THEN 'clinical' WHEN 1 THEN 'research' WHEN 2 THEN 'nonclinical' WHEN 3 THEN 'publications' ELSE 'other' END AS category,
       cast(l_quantity * 10 AS double) AS hours_min,
       CASE WHEN l_partkey % 8 = 4 THEN cast(l_quantity * 20 AS double) ELSE cast(l_quantity * 10 AS double) END AS hours_max,
       CASE l_partkey % 8 WHEN 4 THEN 'range' WHEN 5 THEN 'approximate' WHEN 6 THEN 'lower_bound' ELSE 'reported' END AS hours_precision,
       CASE WHEN l_returnflag = 'R' THEN 'projected' ELSE 'reported' END AS timing
FROM {li} l JOIN {profiles} p ON p.orderkey = l.l_orderkey""",
    "messages": """
SELECT 'm-' || cast(conv_id AS string) || '-' || cast(turn AS string) AS id, 'c-' || cast(conv_id AS string) AS chat_id, 'u-' || cast(conv_id % 40 AS string) AS user_id, conv_id, turn, role,
       cast(1704067200000 + conv_id * 3600000 + turn * 60000 AS bigint) AS created_at,
       CASE WHEN role <> 'assistant' THEN 'complete' WHEN (conv_id + turn) % 11 = 0 THEN 'failed' WHEN (conv_id + turn) % 11 = 1 THEN 'cancelled' ELSE 'complete' END AS status,
       CASE WHEN role = 'assistant' THEN text || ' [P' || cast(1 + (conv_id + turn) % 4 AS string) || ', P' || cast(1 + (conv_id * 3 + turn) % 6 AS string) || '] [C1]' ELSE text END AS content,
       CASE WHEN role = 'assistant' THEN 'm-' || cast(conv_id AS string) || '-' || cast(turn - 1 AS string) END AS reply_to_id
FROM {conversations} WHERE role <> 'system'""",
    "sources": """
SELECT m.id AS message_id, 'P' || cast(k AS string) AS id, 'profile' AS kind, 'a-' || cast((turn + k) % 3 AS string) AS applicant_id
FROM {messages} m CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) n WHERE role = 'assistant'
UNION ALL SELECT m.id, 'C1', 'calculation', NULL FROM {messages} m WHERE role = 'assistant'""",
    "attachments": """
SELECT 'f-' || cast(doc_id AS string) AS id, 'u-' || cast(doc_id % 7 AS string) AS user_id, 'c-' || cast(doc_id % 90 AS string) AS chat_id, doc_id,
       CASE WHEN n_chars * 2000 > 8388608 THEN 8388608 ELSE n_chars * 2000 END AS size, cast(1704067200000 + doc_id * 7919000 AS bigint) AS created_at,
       CASE doc_id % 9 WHEN 0 THEN 'processing' WHEN 1 THEN 'failed' ELSE 'ready' END AS status, text AS extracted_text
FROM {documents}""",
    "attempts": """
SELECT event_id, 'u-' || cast(user_id AS string) AS user_id, 'c-' || cast(user_id % 50 AS string) AS chat_id, event_type,
       CASE event_type WHEN 'signup' THEN 'begin' WHEN 'view' THEN 'renew' WHEN 'click' THEN 'write' WHEN 'purchase' THEN 'finish' ELSE 'cancel' END AS op, MILLIS AS at_ms
FROM {events}""",
    "requests": """
SELECT cast(p_partkey AS bigint) AS request_id,
       CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE cast(200 + p_partkey * 7 % 180 AS double) / 100 END AS gpa_min, CASE WHEN p_partkey % 97 = 0 OR p_partkey % 31 = 0 THEN NULL ELSE cast(215 + p_partkey * 7 % 180 AS double) / 100 END AS gpa_max,
       CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE cast(472 + p_partkey * 11 % 50 AS bigint) END AS mcat_min, CASE WHEN p_partkey % 97 = 0 OR p_partkey % 29 = 0 THEN NULL ELSE cast(480 + p_partkey * 11 % 50 AS bigint) END AS mcat_max,
       CASE p_partkey % 4 WHEN 0 THEN 'reddit' WHEN 1 THEN 'sdn' ELSE NULL END AS source,
       CASE p_partkey % 6 WHEN 0 THEN '2024-25' WHEN 1 THEN '2021-22' ELSE NULL END AS cycle,
       CASE p_partkey % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' ELSE NULL END AS outcome,
       CASE WHEN p_partkey % 7 = 0 THEN 'supplier#00000000' || cast(p_partkey % 10 AS string) ELSE NULL END AS school,
       CASE p_partkey % 18 WHEN 0 THEN '2022-23' WHEN 6 THEN '2016-17' ELSE NULL END AS cycle2, CASE p_partkey % 8 WHEN 0 THEN 'mdapplicants' ELSE NULL END AS source2,
       CASE p_partkey % 9 WHEN 0 THEN 'waitlisted' WHEN 1 THEN 'accepted' ELSE NULL END AS outcome2, CASE p_partkey % 13 WHEN 0 THEN 'RESEARCH Work' WHEN 1 THEN 'other WORK; ]' ELSE NULL END AS activity
FROM {part}""",
    "activity_texts": """
SELECT profile_id, '[' || max(CASE WHEN category = 'clinical' THEN 'Clinical work; ' ELSE '' END) || max(CASE WHEN category = 'research' THEN 'Research work; ' ELSE '' END) || max(CASE WHEN category = 'other' THEN 'Other work; ' ELSE '' END) || ']' AS activities_json
FROM {activities} GROUP BY profile_id""",
    "evidence": """
SELECT id, chat_id, user_id, conv_id, turn, status, reply_to_id, created_at, created_at AS updated_at, translate(head, '<>', chr(123) || chr(125)) AS head, translate(other_file, '<>', chr(123) || chr(125)) AS other_file,
       translate('<"id":"A3","kind":"attachment","title":"legacy">', '<>', chr(123) || chr(125)) AS legacy, translate(web, '<>', chr(123) || chr(125)) AS web, translate(rest, '<>', chr(123) || chr(125)) AS rest
FROM (SELECT *, '<"sources":[<"id":"P1","kind":"profile","applicantId":"a-' || cast(turn % 3 AS string) || '","excerpt":null>,<"id":"A1","kind":"attachment","title":"x","attachmentId":"f-' || cast(conv_id AS string) || '","excerpt":"private">,' AS head,
       '<"id":"A2","kind":"attachment","title":"y","attachmentId":"f-' || cast(conv_id + 1 AS string) || '">' AS other_file,
       '<"id":"W1","kind":"official","observedAt":"2026-01-0' || cast(1 + turn % 9 AS string) || '","title":"t","url":"https://aamc.org/">' AS web,
       '"cohort":<"filters":<"gpaMin":3.25,"school":null>,"total":' || cast(conv_id + 58 AS string) || '>,"later":<"b":[1,2.5,null,true]>,"notes":["n ' || cast(turn AS string) || '"]' AS rest
FROM {messages} WHERE role = 'assistant') m""",
}
MILLIS = {"spark": "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts AS timestamp_ntz)) div 1000", "duckdb": "(epoch_us(ts) // 1000)"}


def _needs(name: str) -> list[str]:
    return [n for n in (*SQL, *BASES) if "{" + n + "}" in SQL.get(name, "")]


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived or base table of the driver's files."""
    if name in BASES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = SQL[name].replace("MILLIS", MILLIS["spark"])
    return spark.sql(text, **{n: derived(spark, sf_dir, n) for n in _needs(name)})


def oracle(sql: str) -> str:
    """DuckDB SQL in which every {name} of a derived table is a common table expression."""
    order: list[str] = []

    def visit(text: str) -> None:
        for n in SQL:
            if "{" + n + "}" in text and n not in order:
                visit(SQL[n])
                if n not in order:
                    order.append(n)

    visit(sql)
    out = ", ".join(f"{n} AS MATERIALIZED ({SQL[n]})" for n in order)
    text = sql.strip()
    if out:
        text = f"WITH {out}, {text[4:].lstrip()}" if text.upper().startswith("WITH") else f"WITH {out} {text}"
    for n in (*SQL, *BASES):
        text = text.replace("{" + n + "}", n)
    return text.replace("MILLIS", MILLIS["duckdb"])
