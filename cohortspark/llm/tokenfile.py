"""Token files: frequency-ranked ids in byte-aligned variable-length coding, control bytes apart from data."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import dropped, removed, shared_folder, smaller, table_size, texts_of, written
from .tokens import folded_words

#: Bytes of each of the four numbers that a control byte describes, two bits each.
SIZES = np.array([[1 + (c >> (2 * k) & 3) for k in range(4)] for c in range(256)], np.uint8)
#: Documents' tokens that a block holds before the next one starts.
BLOCK_TOKENS = 1 << 18
FILE = "file int, block int, first long, doc_ids array<long>, lengths array<long>, control binary, data binary"


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit numbers, 1 to 4 data bytes each."""
    ranks = ranks.astype("<u4")
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    used = np.arange(4, dtype=np.uint8)[None, :] < size[:, None]
    return control.astype(np.uint8).tobytes(), ranks.view(np.uint8).reshape(-1, 4)[used].tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The numbers again: lengths looked up by control byte, then gathered byte by byte."""
    size = SIZES[np.frombuffer(control, np.uint8)].reshape(-1)[:n].astype(np.int64)
    at = np.cumsum(size) - size
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = size > k
        if more.any():
            out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def tokenised(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """doc_id, the ids (with the end id) of each whole text and their crc32, two bytes an id while the vocabulary allows, else four.

    Each task adds one last row that has only `counts`: how often each id came, eight bytes a count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = folded_words(tokenizer_path)
        size = words.library.get_vocab_size()
        kind = "<u2" if size <= 1 << 16 else "<u4"
        last, total = np.array([end_id], "<u4"), np.zeros(max(size, end_id + 1), "<i8")
        names = ["doc_id", "ids", "short", "crc", "counts"]
        for batch in smaller(batches, most=6_000_000):
            ids = [np.concatenate([x, last]) for x in words.encode(batch.column(1))]
            total += np.bincount(np.concatenate(ids), minlength=len(total))
            n = len(ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.astype(kind).tobytes() for x in ids], pa.binary()), pa.array([kind == "<u2"] * n), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.nulls(n, pa.binary())], names=names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.bool_()), pa.nulls(1, pa.int64()), pa.array([total.tobytes()], pa.binary())], names=names)

    return texts_of(docs).mapInArrow(run, "doc_id long, ids binary, short boolean, crc long, counts binary")


def _ids(raw: bytes, short: bool) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if short else "<u4")


def frequencies(tokens: DataFrame) -> DataFrame:
    """id and its count over all documents, from the tasks' own counts: a row for each id and task at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                n = np.frombuffer(raw, "<i8")
                total = n + np.pad(total, (0, len(n) - len(total)))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "count"])

    return tokens.where("counts IS NOT NULL").select("counts").mapInArrow(run, "id long, count long").groupBy("id").agg(F.sum("count").alias("count"))


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Write all documents to token files below `path` in ascending doc_id order; returns the id table in rank order.

    Texts are encoded once into a written table, which also counts their ids. Ids are ranked by falling count (ties
    by id); that table has one row per vocabulary entry. The encoded documents are range-partitioned by doc_id (null
    first, rows of one doc_id spread by the crc32 of their ids, then at random) and each partition writes blocks of
    whole documents. Blocks carry their documents' ids and lengths and the place of the first token within the file.
    """
    spark = docs.sparkSession
    tokens = written(tokenised(docs, tokenizer_path, end_id).withColumn("salt", F.rand(3)), "tokens")
    # Bounded by the vocabulary, whatever the input.
    by_rank = [r["id"] for r in frequencies(tokens).orderBy(F.desc("count"), "id").collect()]
    rank_of = np.zeros(max(by_rank, default=0) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs_held, ids_held, held, first, block, file = [], [], 0, 0, 0, 0
        schema = pa.schema([("file", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary())])

        def full() -> pa.RecordBatch:
            control, data = encode_ranks(rank_of[np.concatenate(ids_held)])
            return pa.RecordBatch.from_pylist([{"file": file, "block": block, "first": first, "doc_ids": docs_held, "lengths": [len(x) for x in ids_held], "control": control, "data": data}], schema=schema)

        for batch in batches:
            for doc, raw, short, part in zip(*(c.to_pylist() for c in batch.columns)):
                file = part
                docs_held.append(doc)
                ids_held.append(_ids(raw, short))
                held += len(ids_held[-1])
                if held >= BLOCK_TOKENS:
                    yield full()
                    first, block, docs_held, ids_held, held = first + held, block + 1, [], [], 0
        if docs_held:
            yield full()

    order = ["doc_id", "crc", "salt"]
    ranged = tokens.where("counts IS NULL").repartitionByRange(table_size(spark), *order).sortWithinPartitions(*order)
    ranged.select("doc_id", "ids", "short", F.spark_partition_id().alias("file")).mapInArrow(blocks, FILE).write.parquet(f"{path}/blocks")
    dictionary = spark.createDataFrame([(k, i) for k, i in enumerate(by_rank)], "rank long, id long")
    dictionary.coalesce(1).write.parquet(f"{path}/ids")
    removed(tokens)
    return dictionary


def read_token_files(spark, path: str, digest: bool = False) -> DataFrame:
    """Read token files back: doc_id, start, n_tokens and ids of every document, decoded block by block.

    ids are little-endian unsigned 32-bit bytes; with digest there is their crc32 (ids_crc32) instead.
    """
    # The vocabulary's size bounds this table.
    by_rank = np.array([r["id"] for r in spark.read.parquet(f"{path}/ids").orderBy("rank").collect()], "<u4")

    column, kind = ("ids_crc32", "long") if digest else ("ids", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dropped()
        for batch in batches:
            for file, first, doc_ids, lengths, control, data in zip(*(c.to_pylist() for c in batch.columns)):
                ids = by_rank[decode_ranks(control, data, sum(lengths))]
                ends = np.cumsum(lengths)
                own = [ids[e - n : e] for e, n in zip(ends.tolist(), lengths)]
                last = pa.array([zlib.crc32(x) for x in own], pa.int64()) if digest else pa.array([x.tobytes() for x in own], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(own), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(first + ends - lengths), pa.array(lengths, pa.int64()), last], names=["file", "doc_id", "within", "n_tokens", column])

    stored = spark.read.schema(FILE).parquet(f"{path}/blocks")
    # One row per file, a number the writer sets.
    totals = stored.groupBy("file").agg(F.max(F.col("first") + F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("tokens"))
    bases = totals.select("file", F.coalesce(F.sum("tokens").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    rows = stored.select("file", "first", "doc_ids", "lengths", "control", "data").mapInArrow(run, f"file int, doc_id long, within long, n_tokens long, {column} {kind}")
    return rows.join(F.broadcast(bases), "file").select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", column)


def file_digests(docs: DataFrame, tokenizer_path: str, end_id: int = 1, path: str | None = None) -> DataFrame:
    """Write, read back and digest: doc_id, start, n_tokens, ids_crc32 for every document (null texts: the end id only)."""
    path = path or f"{shared_folder(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, path, tokenizer_path, end_id)
    return read_token_files(docs.sparkSession, path, digest=True)
