"""Sharding: contiguous, byte-balanced shards from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .common import table_size, written


def byte_shards(docs: DataFrame, shards: int = 16, parts: int | None = None) -> DataFrame:
    """Put every document into one of `shards` contiguous runs of (doc_id) order with near equal bytes.

    A document's size is its UTF-8 bytes plus 1 (a null text: 1). Documents are range-partitioned in order and
    written once, only as ids and sizes; each partition's total is summed, the totals (one row per
    partition) give each partition's offset, and a running sum inside the partition gives the global byte
    position. A document belongs to the shard in which its middle byte lies, so a shard misses its equal
    target by at most one document. Repeated rows and null doc_ids (first) are spread by a random salt among equal
    keys, so no partition is bound to one key; an empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    parts = parts or table_size(docs.sparkSession)
    sized = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.rand(11).alias("salt"),
    )
    order = ["doc_id", "text_crc32", "salt"]
    ranged = sized.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    placed = written(ranged, "shard-sizes")
    totals = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    # One row per range partition, a number the job sets itself.
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"),
        F.sum("bytes").over(W.partitionBy(F.lit(1))).alias("total"),
    )
    inside = W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    at = placed.withColumn("ends", F.sum("size").over(inside)).join(F.broadcast(offsets), "part")
    middle = F.col("base") + F.col("ends") - F.ceil(F.col("size") / 2)
    cut = at.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle.cast("decimal(38,0)") * shards / F.col("total"))).cast("int"))
    # Slots: rows of a shard in order, again from per-partition totals.
    per = cut.groupBy("shard", "part").agg(F.count("*").alias("rows"))
    first = per.select("shard", "part", F.coalesce(F.sum("rows").over(W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    rank = F.row_number().over(W.partitionBy("part", "shard").orderBy(*order))
    return (
        cut.withColumn("rank", rank)
        .join(F.broadcast(first), ["shard", "part"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
