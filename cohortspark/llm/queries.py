"""The numbered queries over the driver's tables, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import byte_shards

    return byte_shards(table(spark, sf_dir, "documents"), 16)


def op3_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tiling import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op6_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .nearjoin import near_join

    return near_join(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import digests, format_chats

    probe = spark.createDataFrame([(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(format_chats(rows.unionByName(probe)))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokenfile import file_digests

    return file_digests(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .templates import line_dedup

    return line_dedup(table(spark, sf_dir, "documents"))


def op11_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licences import licence_scans

    return licence_scans(table(spark, sf_dir, "documents")).drop("found")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bursttrie import conversation_trie

    return conversation_trie(table(spark, sf_dir, "conversations"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import centroid_clusters

    return centroid_clusters(table(spark, sf_dir, "embeddings")).drop("centroid")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_rules, op2_sharding, op3_benchmark_leaks, op4_token_counts, op5_best_fit_packing, op6_near_join, op7_toxicity, op8_chat_formatting, op9_token_files, op10_line_dedup, op11_license_scans, op12_prefix_trie, op13_centroid_clustering)}


def _clusters_sql() -> str:
    """Three rounds and the last assignment, each a table of its own; floor division is exact also below zero."""
    parts = [
        "v AS (SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e::DOUBLE))) = 64)",
        "c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR) NULLS LAST, x) - 1 AS c, x FROM v QUALIFY c < 16)",
    ]
    for r in range(4):
        parts.append(f"d{r} AS (SELECT k, vec_id, v.x, c, list_sum(list_transform(list_zip(v.x, c{r}.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS distance FROM v CROSS JOIN c{r} QUALIFY row_number() OVER (PARTITION BY k ORDER BY distance, c) = 1)")
        if r < 3:
            parts.append(f"s{r} AS (SELECT c, j, sum(x[j])::BIGINT AS s, count(*) AS n FROM d{r}, unnest(range(1, 65)) AS u(j) GROUP BY c, j)")
            parts.append(f"c{r + 1} AS (SELECT c, coalesce(m.x, c{r}.x) AS x FROM c{r} LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS x FROM s{r} GROUP BY c) m USING (c))")
    return "WITH " + ", ".join(f"{p.partition(' AS ')[0]} AS MATERIALIZED {p.partition(' AS ')[2]}" for p in parts) + """
SELECT vec_id, d3.c::INTEGER AS cluster, distance, sum(distance) OVER (PARTITION BY d3.c)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c3.x, ',')) AS centroid_sha256
FROM d3 JOIN c3 USING (c)"""


_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

ORACLES: dict[str, str] = {
    "op1_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t, {_WORDS} AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
     win AS (SELECT k, i, (w[i], w[i + 1], w[i + 2]) AS win FROM d, unnest(range(1, len(w) - 1)) AS u(i)),
     rep AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, win) AS n FROM win) WHERE n > 1),
     cov AS (SELECT k, count(DISTINCT i + j) AS n FROM rep, unnest([0, 1, 2]) AS v(j) GROUP BY k),
     c AS (SELECT doc_id, t, w, lines, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
                  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(t, '[^!]+', '', 'g'))::BIGINT AS n_exclamations,
                  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
                  len(list_filter(w, lambda x: list_contains(STOPS, x))) AS n_stop_words, len(lines) AS n_lines,
                  len(list_filter(lines, lambda x: regexp_matches(x, '^\s*[-*•]'))) AS n_bullet_lines,
                  len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS n_ellipsis_lines
           FROM d LEFT JOIN cov USING (k))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND RULES AS kept FROM c""",
    "op8_chat_formatting": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
     e AS (SELECT *, regexp_matches(text, '### |</turn>|\\[blhc]') AS hard, length(text) + length(regexp_replace(text, '[^\\<#:]', '', 'g')) AS long FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(14 + length(role) + CASE WHEN hard THEN long ELSE length(text) END)::BIGINT AS formatted_chars, true AS round_trip
FROM (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM e) GROUP BY conv_id, alone""",
    # Sequences as lists of (role, text): a node is a list, its subtree what lies between its ends in the sorted order of lists.
    "op12_prefix_trie": """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos, md5(coalesce(role, '') || chr(0) || coalesce(text, '')) AS id,
                            octet_length(encode(coalesce(text, '')))::BIGINT AS size FROM conversations WHERE conv_id IS NOT NULL),
     a AS (SELECT conv_id, list({'id': id, 'size': size} ORDER BY pos) AS l FROM t GROUP BY conv_id),
     h AS (SELECT conv_id, l, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
                                              lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295) % 9 AS h FROM a),
     r AS (SELECT h.conv_id, list_concat(coalesce(o.l[1:h.h], []), h.l[h.h + 1:]) AS l FROM h LEFT JOIN a o ON o.conv_id = h.conv_id - h.conv_id % 5),
     n AS (SELECT conv_id, d, l[1:d] AS p, len(l) AS long, CASE WHEN d > 0 THEN l[d].size ELSE 0 END AS size FROM r, unnest(range(0, len(l) + 1)) AS u(d)),
     g AS (SELECT p, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE long = d), '') AS ends FROM n GROUP BY p),
     c AS (SELECT p[1:len(p) - 1] AS up, count(*) AS n_children FROM g WHERE depth > 0 GROUP BY 1),
     f AS (SELECT g.*, coalesce(c.n_children, 0) AS n_children FROM g LEFT JOIN c ON c.up = g.p),
     s AS (SELECT f.p[1:k] AS p, sum((n_convs - 1) * size) AS saved, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM f, unnest(range(0, depth + 1)) AS u(k) GROUP BY 1)
SELECT f.conv_id, depth::BIGINT AS depth, CASE WHEN depth > 0 THEN up.conv_id END AS parent_conv_id, f.n_convs, n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(ends) AS ends_sha256
FROM f JOIN s USING (p) LEFT JOIN (SELECT p, conv_id FROM g) up ON up.p = f.p[1:depth - 1] AND depth > 0""",
    "op13_centroid_clustering": _clusters_sql(),
}


def _quality_sql(sql: str) -> str:
    from .quality import RULES, STOP_WORDS, compiled

    stops = "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS)) + "]"
    return sql.replace("STOPS", stops).replace("RULES", " AND ".join(c.rpartition(" AS ")[0] for c in compiled(RULES)))


ORACLES["op1_quality_rules"] = _quality_sql(ORACLES["op1_quality_rules"])
