"""Shared helpers: the staging folder, written tables, Arrow batches, word hashes and what a worker keeps."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

#: The characters that separate words: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
BASE = np.uint64(0x9E3779B97F4A7C15)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); where none is set a temporary one in local mode, else an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        configured = known.get() if known.isDefined() else None
    if not configured:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df below the shared folder and read it again: cuts the lineage and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def removed(*tables: DataFrame) -> None:
    """Delete tables that `written` made and that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id and text only: other columns, whatever their names, play no part; a null text is empty."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))


def smaller(batches: Iterator[pa.RecordBatch], column: int = 1, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `most` bytes of text, or one row: bounds what a task holds.

    At the end of a task what it has freed goes back to the system, since workers live on.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype("int64").cumsum()
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(ends.searchsorted(done + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
        del batch
    freed()


def split_words(texts: pa.Array, pattern: str = " ") -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Split each text at a pattern: each part's number, the first part of each text (and the end), and the distinct parts."""
    lists = pc.split_pattern(texts, pattern)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    return coded.indices.to_numpy(), offsets - offsets[0], coded.dictionary


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of strings (none null) one after the other, and where each begins (and the end)."""
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    _, places, data = texts.buffers()
    at = np.frombuffer(places, np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of all spans, one span after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def _byte_hashes(byte_at: np.ndarray) -> np.ndarray:
    """A mixed number for each byte and its place in its word, given as byte + 256 * place."""
    return mixed((byte_at.astype(np.uint64) + np.uint64(1)) * BASE)


with np.errstate(over="ignore"):
    #: Those of the first 64 places of a word, looked up.
    _BYTES = _byte_hashes(np.arange(64 * 256))


def summed(x: np.ndarray) -> np.ndarray:
    """Prefix sums, with the nought before them."""
    out = np.zeros(len(x) + 1, x.dtype)
    np.cumsum(x, out=out[1:])
    return out


def hashed_words(raw: np.ndarray, size: np.ndarray, most: int = 1 << 15) -> np.ndarray:
    """64-bit hashes of words, whose bytes lie one after the other: the sum of a mixed number for each byte and its place, mixed with the length.

    `most` words at a time, so that what is at work stays near the processor.
    """
    out, at = np.zeros(len(size), np.uint64), 0
    with np.errstate(over="ignore"):
        for k in range(0, len(size), most):
            long = size[k : k + most]
            ends = summed(long)
            byte_at = np.arange(ends[-1])
            byte_at -= np.repeat(ends[:-1], long)
            byte_at <<= 8
            byte_at |= raw[at : at + ends[-1]]
            values = _BYTES.take(byte_at, mode="clip")
            far = np.flatnonzero(byte_at >= len(_BYTES))
            values[far] = _byte_hashes(byte_at[far])
            total = summed(values)
            out[k : k + most] = mixed(total[ends[1:]] - total[ends[:-1]] + long.astype(np.uint64) * BASE)
            at += ends[-1]
    return out


def hashed(words: pa.Array) -> np.ndarray:
    """64-bit hashes of strings (none null)."""
    raw, at = bytes_of(words)
    return hashed_words(raw, np.diff(at))


class Seen:
    """What a worker has learnt about words, by their hash: sorted keys with a value each, and in how many batches they came."""

    def __init__(self, kind: Any, most: int):
        self.most = most
        self.keys, self.values, self.met = np.zeros(0, np.uint64), np.zeros(0, kind), np.zeros(0, np.int32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each key and whether it is there."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        return at, self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        keys, once = np.unique(keys, return_index=True)
        fresh = ~self.find(keys)[1]
        keys, values = keys[fresh], values[once][fresh]
        at = np.searchsorted(self.keys, keys)
        self.keys, self.values, self.met = np.insert(self.keys, at, keys), np.insert(self.values, at, values), np.insert(self.met, at, 1)

    def get(self, keys: np.ndarray, learn: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The value of each key; learn(places) gives those of the keys not seen yet."""
        at, there = self.find(keys)
        self.met[at[there]] += 1
        out = np.zeros(len(keys), self.values.dtype)
        out[there] = self.values[at[there]]
        new = np.flatnonzero(~there)
        if len(new):
            out[new] = learn(new)
            self.add(keys[new], out[new])
        return out

    def full(self) -> bool:
        return len(self.keys) > self.most

    def trim(self) -> None:
        """Keep words that came in several batches, a third of what is allowed at most; counts start anew."""
        floor = max(2, int(np.partition(self.met, len(self.met) - self.most // 3)[len(self.met) - self.most // 3]) + 1)
        stay = self.met >= floor
        self.keys, self.values, self.met = self.keys[stay], self.values[stay], np.zeros(int(stay.sum()), np.int32)


_KEPT: dict[Hashable, Any] = {}


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """The one thing that this Python worker keeps between its tasks; another key drops it.

    Workers outlive stages, so what each stage had learnt would otherwise add up in memory.
    """
    if key not in _KEPT:
        dropped()
        _KEPT[key] = make()
    return _KEPT[key]


def dropped() -> None:
    """At the start of a task: give up what the worker kept for another stage."""
    pa.set_memory_pool(pa.system_memory_pool())
    if _KEPT:
        _KEPT.clear()
    freed()


def freed() -> None:
    """Give unused memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def gathered(df: DataFrame) -> tuple[np.ndarray, ...]:
    """The long columns of a table of bounded size on the driver, as arrays: each partition sends its bytes, no rows."""
    n = len(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        columns = [np.concatenate([b.column(k).to_numpy() for b in parts]) if parts else np.zeros(0, np.int64) for k in range(n)]
        yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], names=[f"c{k}" for k in range(n)])

    rows = df.mapInArrow(run, ", ".join(f"c{k} binary" for k in range(n))).collect()
    return tuple(np.frombuffer(b"".join(r[k] for r in rows), np.int64) for k in range(n))


def table_size(spark: SparkSession) -> int:
    """The session's shuffle partitions, the unit in which jobs here size their own."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
