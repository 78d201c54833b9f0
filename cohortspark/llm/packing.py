"""Best-fit packing of token sequences, planned on the histogram of lengths."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import smaller, table_size, texts_of, written
from .tokens import byte_words


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """One row per piece: doc_id, piece, start, length and the crc32 of its ids.

    A document is its ids and the end id, so an empty or null text has one piece of length 1. Only a
    document longer than the capacity is cut; its remainder is the first piece. Texts are encoded whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = byte_words(tokenizer_path)
        last = np.array([end_id], "<u4")
        for batch in smaller(batches):
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), words.encode(batch.column(1))):
                ids = np.concatenate([ids, last])
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
                rows += [(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            doc, piece, start, length, crc = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts_of(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Place all lengths: rows (length, first rank, count, first sequence, offset).

    The count pieces of a length from a rank on go to as many sequences in a row, one each, at an offset.
    Lengths above a third of the capacity meet at most twice in a sequence: from the longest down, each takes
    the longest that still fits it. Each smaller length then goes, from the longest down, to the sequences
    whose gap fits it best, and to new ones when none fits. Work and memory follow the number of
    distinct lengths, not of pieces.
    """
    rows, sequences = [], 0
    left = {n: c for n, c in sorted(histogram.items(), reverse=True) if c}
    rank: dict[int, int] = defaultdict(int)
    gaps: dict[int, list[list[int]]] = defaultdict(list)  # gap -> [first sequence, count]

    def put(length: int, count: int, first: int, offset: int) -> None:
        rows.append((length, rank[length], count, first, offset))
        rank[length] += count

    large = [n for n in left if 3 * n > capacity]
    for n in large:
        while left[n]:
            fits = next((m for m in large if m <= min(n, capacity - n) and left[m] > (m == n)), None)
            if fits is None:
                count = left[n]
                put(n, count, sequences, 0)
                left[n] = 0
                gaps[capacity - n].append([sequences, count])
            else:
                count = left[n] // 2 if fits == n else min(left[n], left[fits])
                put(n, count, sequences, 0)
                put(fits, count, sequences, n)
                left[n] -= count
                left[fits] -= count
                gaps[capacity - n - fits].append([sequences, count])
            sequences += count
    for n in (n for n in left if 3 * n <= capacity):
        while left[n]:
            gap = min((g for g, runs in gaps.items() if g >= n and runs), default=None)
            if gap is None:
                each = capacity // n
                count = max(1, left[n] // each)
                gaps[capacity].append([sequences, count])
                sequences += count
                gap = capacity
            run = gaps[gap][-1]
            count = min(run[1], left[n])
            put(n, count, run[0], capacity - gap)
            left[n] -= count
            gaps[gap - n].append([run[0], count])
            run[0] += count
            run[1] -= count
            if not run[1]:
                gaps[gap].pop()
    return rows


def best_fit(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Give every piece a sequence and an offset in it, gapless from 0, with as few sequences as best fit finds.

    Pieces are written once. Their histogram (at most `capacity` rows, whatever the input) is planned on the
    driver; each piece's rank among its length comes from counts per (length, part) with parts by hash of the
    row, so equal lengths spread over all parts. The plan, at most a few rows per pair of lengths, is
    joined back by rank. An empty input gives no rows; repeated rows are packed each.
    """
    spark = pieces.sparkSession
    parts = table_size(spark)
    key = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32", F.rand(5)), F.lit(parts)).cast("int")
    rows = written(pieces.withColumn("part", key), "pieces")
    per = rows.groupBy("length", "part").agg(F.count("*").alias("rows"))
    histogram = {r["length"]: r["rows"] for r in per.groupBy("length").agg(F.sum("rows").alias("rows")).collect()}
    placed = spark.createDataFrame(plan(histogram, capacity) or [], "length long, rank long, count long, first long, at long")
    # Where each part's pieces of a length begin: one small window per length over its parts.
    base = per.select("length", "part", F.coalesce(F.sum("rows").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    # Plan rows that meet a part's ranks: joined by length and part, so that no row is compared with a whole plan.
    spans = base.join(per, ["length", "part"]).join(placed, "length").where((F.col("rank") < F.col("base") + F.col("rows")) & (F.col("rank") + F.col("count") > F.col("base")))
    table = spans.groupBy("length", "part").agg(F.first("base").alias("base"), F.sort_array(F.collect_list(F.struct("rank", "count", "first", "at"))).alias("spans"))
    ranked = rows.withColumn("n", F.row_number().over(W.partitionBy("part", "length").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1)
    joined = ranked.join(table, ["length", "part"]).withColumn("r", F.col("base") + F.col("n"))
    span = F.get(F.filter("spans", lambda s: (s["rank"] <= F.col("r")) & (F.col("r") < s["rank"] + s["count"])), F.lit(0))
    return joined.withColumn("span", span).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("span.first") + F.col("r") - F.col("span.rank")).alias("sequence_id"), F.col("span.at").alias("offset"))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Cut and pack all documents; null doc_ids stay null and repeated rows are packed each."""
    return best_fit(token_pieces(docs, tokenizer_path, capacity, end_id), capacity)
