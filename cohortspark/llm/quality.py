"""Quality rules: a threshold table compiled into one projection of Spark expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from .common import BLANKS

# Common function words of English, German, French and Spanish.
STOP_WORDS = (
    "the be to of and that have with in is it for on was as are at by an a from this "
    "der die das und in zu den von mit sich des auf für ist im dem nicht ein eine als "
    "le la les de des et en un une du est que dans pour qui sur au par pas plus "
    "el los las y del se por con para una su al lo como más es no"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= metric <= high; a bound of None is open."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: Each metric is a SQL expression over the counts of `counted`.
RULES = (
    Rule("length", "n_words", 50, 1_000_000),
    Rule("word_length", "word_chars / n_words", 2, 15),
    Rule("symbols", "n_symbols / n_words", None, 0.1),
    Rule("exclamations", "n_exclamations / n_words", None, 0.3),
    Rule("stop_words", "n_stop_words", 2, None),
    Rule("stop_word_share", "n_stop_words / n_words", 0.01, None),
    Rule("duplicate_lines", "n_dup_lines / n_lines", None, 0.5),
    Rule("bullet_lines", "n_bullet_lines / n_lines", None, 0.9),
    Rule("ellipsis_lines", "n_ellipsis_lines / n_lines", None, 0.3),
    Rule("repeated_words", "n_repeat_words / n_words", None, 0.5),
)


def _sql(s: str) -> str:
    return "'" + "".join(f"\\u{ord(c):04x}" if ord(c) < 32 or c in "\\'" else c for c in s) + "'"


def counted(docs: DataFrame) -> DataFrame:
    """One row per document with its counts; everything stays in JVM expressions over single rows.

    Words are runs of characters other than space and U+0009-U+000D; a null or blank text has none and all
    counts are 0. Repeated 3-word windows are found per text by sorting the windows' 64-bit hashes with
    their positions, so a text of n words costs n log n and no row leaves its task. Repeated rows and
    doc_ids stay separate rows; a null doc_id stays null; other columns are ignored.
    """
    blanks, stops = _sql(BLANKS), ", ".join(_sql(w) for w in dict.fromkeys(STOP_WORDS))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    split = base.selectExpr(
        "doc_id",
        "t",
        f"CASE WHEN translate(t, {blanks}, '') = '' THEN array() ELSE split(trim(BOTH {blanks} FROM t), '[\\\\x20\\\\x09-\\\\x0D]+') END AS w",
        f"filter(split(t, '\\n'), x -> translate(x, {blanks}, '') <> '') AS lines",
    )
    hashed = split.selectExpr(
        "doc_id",
        "cast(size(w) AS long) AS n_words",
        f"cast(length(translate(t, {blanks}, '')) AS long) AS word_chars",
        "cast(length(t) - length(translate(t, '#*$%&|<>', '')) AS long) AS n_symbols",
        "cast(length(t) - length(translate(t, '!', '')) AS long) AS n_exclamations",
        f"cast(size(filter(w, x -> x IN ({stops}))) AS long) AS n_stop_words",
        "cast(size(lines) AS long) AS n_lines",
        "cast(size(lines) - size(array_distinct(lines)) AS long) AS n_dup_lines",
        "cast(size(filter(lines, x -> x RLIKE '^\\\\s*[-*•]')) AS long) AS n_bullet_lines",
        "cast(size(filter(lines, x -> x RLIKE '(\\\\.\\\\.\\\\.|…)\\\\s*$')) AS long) AS n_ellipsis_lines",
        "CASE WHEN size(w) < 4 THEN array() ELSE transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])) END AS h",
    )
    plain = ["doc_id", "n_words", "word_chars", "n_symbols", "n_exclamations", "n_stop_words", "n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines"]
    ordered = hashed.selectExpr(*plain, "CASE WHEN size(array_distinct(h)) = size(h) THEN NULL ELSE sort_array(transform(h, (x, i) -> struct(x AS h, i AS i))) END AS p")
    repeated = ordered.selectExpr(*plain, "sort_array(transform(filter(p, (e, k) -> get(p, k - 1).h <=> e.h OR get(p, k + 1).h <=> e.h), e -> e.i)) AS r")
    return repeated.selectExpr(
        *plain,
        "cast(CASE WHEN r IS NULL OR size(r) = 0 THEN 0 ELSE 3 + aggregate(zip_with(slice(r, 1, size(r) - 1), slice(r, 2, size(r) - 1), (a, b) -> least(3, b - a)), 0, (s, x) -> s + x) END AS long) AS n_repeat_words",
    )


def compiled(rules: tuple[Rule, ...] = RULES) -> list[str]:
    """The rules as SQL columns pass_<name>; a metric that divides by zero counts as 0."""
    out = []
    for r in rules:
        value = f"coalesce({re.sub(r'/ (\w+)', r'/ nullif(\1, 0)', r.metric)}, 0)"
        parts = [f"{value} >= {r.low}"] * (r.low is not None) + [f"{value} <= {r.high}"] * (r.high is not None)
        out.append(f"({' AND '.join(parts)}) AS pass_{r.name}")
    return out


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts, one boolean per rule, base_failed and kept for every document.

    base_failed: fewer than 50 words, or over half of the words in 3-word windows that occur twice. kept is
    false then, else whether all rules pass. Null and empty texts have 0 words, so they are not kept.
    """
    judged = counted(docs).selectExpr("*", *compiled(rules), "(n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed")
    passed = " AND ".join(f"pass_{r.name}" for r in rules) or "true"
    return judged.selectExpr("*", f"(NOT base_failed AND {passed}) AS kept")
