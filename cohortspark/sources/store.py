"""A published corpus on shared storage: each release writes the buckets it touches, the newest finished version counts."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from cohortspark.operators.publish import PIECES, publish_release

#: The column by whose hash a table is cut into buckets; the ledger is small and written whole.
LAYOUT = {"accounts": "id", "profiles": "account_id", "outcomes": "profile_id", "imports": None}
#: Within a bucket rows lie sorted by these, so that reads by them skip files.
ORDER = {"accounts": ("id",), "profiles": ("account_id", "cycle"), "outcomes": ("profile_id",)}
DONE, BUCKETS = "_PUBLISHED", 64
#: Stored and staged tables repeat names and words in long texts, which this codec stores in little more than half of the default one's bytes.
CODEC = "zstd"
#: Tables whose rows are large are dealt out and written in so many rounds, each of some of the touched buckets, so that no more of them is shuffled at once.
ROUNDS = {"profiles": 4, "outcomes": 4}
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Within it the shuffle files of a finished query go at once, and not when the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, True)
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def gone(spark: SparkSession, path: str) -> None:
    fs, at = _files(spark, path)
    fs.delete(at, True)


def _folders(spark: SparkSession, path: str) -> list[str]:
    fs, at = _files(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()) if fs.exists(at) else []


def versions(spark: SparkSession, path: str) -> list[tuple[int, bool]]:
    """(number, finished) of each version below path, in order."""
    known = sorted(int(n[2:]) for n in _folders(spark, path) if n.startswith("v-") and n[2:].isdigit())
    return [(n, _files(spark, path)[0].exists(_files(spark, f"{path}/v-{n:08d}/{DONE}")[1])) for n in known]


def _marker(spark: SparkSession, path: str, number: int) -> dict:
    """What a finished version says: the number of buckets, the tables' schemas, and the version that holds each bucket."""
    fs, at = _files(spark, f"{path}/v-{number:08d}/{DONE}")
    stream = fs.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def newest(spark: SparkSession, path: str) -> tuple[int, dict] | None:
    done = [n for n, finished in versions(spark, path) if finished]
    return (done[-1], _marker(spark, path, done[-1])) if done else None


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _table(spark: SparkSession, path: str, marker: dict, name: str, only: set[int] | None = None) -> DataFrame:
    """A table of a version, or those of its buckets: from each version that holds some, the partitions it holds."""
    schema = T.StructType.fromJson(marker["schemas"][name])
    held: dict[int, list[int]] = {}
    for bucket, number in marker["held"][name].items():
        if only is None or int(bucket) in only:
            held.setdefault(number, []).append(int(bucket))
    out = spark.createDataFrame([], schema)
    for number, wanted in sorted(held.items()):
        rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(f"{path}/v-{number:08d}/{name}")
        rows = rows.where(F.col("bucket").isin(wanted)).drop("bucket")
        out = out.unionAll(rows) if len(held) > 1 else rows
    return out


def read_corpus(spark: SparkSession, path: str) -> dict[str, DataFrame] | None:
    """The tables of the newest finished version, None where there is none."""
    found = newest(spark, path)
    return {name: _table(spark, path, found[1], name) for name in LAYOUT} if found else None


def write_version(tables: dict[str, DataFrame], path: str, touched: dict[str, set[int]], buckets: int, keep: int = 2) -> int:
    """Write the touched buckets of each table as a new version and finish it with a marker file; readers see the old one until then.

    The tables hold the rows of the touched buckets alone and may read the store itself. All other buckets stay where they
    lie. A table that has its column bucket is dealt out already. A version left unfinished is never read. Afterwards versions go that none of the newest `keep` still
    needs, so a job that reads the one before goes on. One publisher at a time.
    """
    spark = tables["accounts"].sparkSession
    before = newest(spark, path)
    number = max((n for n, _ in versions(spark, path)), default=0) + 1
    folder = f"{path}/v-{number:08d}"
    held = {name: dict(before[1]["held"][name]) if before else {} for name in LAYOUT}
    for name, key in LAYOUT.items():
        dealt = "bucket" in tables[name].columns
        df = tables[name] if dealt else tables[name].withColumn("bucket", bucket_of(F.col(key), buckets) if key else F.lit(0))
        if key and not dealt:
            df = df.withColumn("_piece", F.pmod(F.xxhash64(*ORDER[name], F.lit(PIECES)), F.lit(PIECES))).repartition("bucket", "_piece").drop("_piece")
        rounds = max(1, min(ROUNDS.get(name, 1), len(touched[name])))
        for k in range(rounds):
            part = df.where(F.col("bucket").isin(sorted(touched[name])[k::rounds])) if rounds > 1 else df
            if key:
                part = part.sortWithinPartitions("bucket", *ORDER[name])
            part.write.mode("append").partitionBy("bucket").parquet(f"{folder}/{name}", compression=CODEC)
        held[name].update({str(b): number for b in touched[name]})
    told = {"buckets": buckets, "held": held, "schemas": {name: json.loads(tables[name].drop("bucket").schema.json()) for name in LAYOUT}}
    fs, marker = _files(spark, f"{folder}/{DONE}")
    stream = fs.create(marker, True)
    stream.write(bytearray(json.dumps(told).encode()))
    stream.close()
    known = versions(spark, path)
    done = [n for n, finished in known if finished][-keep:]
    needed = {n for v in done for part in _marker(spark, path, v)["held"].values() for n in part.values()} | set(done)
    for n, _ in known:
        if n < number and n not in needed:
            gone(spark, f"{path}/v-{n:08d}")
    return number


def _buckets(keys: DataFrame, buckets: int) -> set[int]:
    return {r[0] for r in keys.select(bucket_of(F.col(keys.columns[0]), buckets)).distinct().collect()}


def publish(path: str, profiles: DataFrame, release: str, imported_at: str, buckets: int = BUCKETS) -> int:
    """Publish a release into the store at path as a new version; what it writes follows the release, not the corpus.

    Touched are the buckets of the release's accounts, of the accounts that its known profiles have had, and of its profiles'
    outcomes. Of the rest of the corpus only ids and accounts are read. The number of buckets is that of the first version.
    """
    spark = profiles.sparkSession
    with tidy(spark):
        found = newest(spark, path)
        corpus = None
        if found:
            marker = found[1]
            buckets = marker["buckets"]
            named = profiles.select("id").distinct()
            moved = _table(spark, path, marker, "profiles").select("account_id", "id").join(named, "id", "left_semi").select("account_id")
            owners = _buckets(profiles.select("account_id").unionAll(moved), buckets)
            touched = {"accounts": owners, "profiles": owners, "outcomes": _buckets(named, buckets), "imports": {0}}
            corpus = {name: _table(spark, path, marker, name, touched[name]) for name in LAYOUT}
        else:
            touched = {name: set(range(buckets)) if key else {0} for name, key in LAYOUT.items()}
        tables = publish_release(corpus, profiles, release, imported_at, bucket_of(F.col(LAYOUT["profiles"]), buckets))
        return write_version(tables, path, touched, buckets)
