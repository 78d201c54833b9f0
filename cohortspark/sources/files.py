"""Releases, artifacts and answer streams as tables."""

from __future__ import annotations

import ctypes
from urllib.parse import quote, unquote

import _hashlib
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

#: A file of more bytes is hashed in pieces of so many, each by a task of its own.
PIECE = 256 << 20
#: Bytes of OpenSSL's SHA-256 state (plain memory, which can be taken up elsewhere), of a digest, and read at once.
STATE, DIGEST, READ = 112, 32, 8 << 20

PROFILE = """struct<id:string,accountId:string,source:string,sourceAccountId:string,publicHandle:string,cycle:string,version:int,gpa:double,scienceGpa:double,mcat:double,residence:string,summary:string,
activities:array<struct<category:string,description:string,hours:struct<min:double,max:double,precision:string>,timing:string,confidence:string>>,
outcomes:array<struct<status:string,program:string,school:string,cycle:string,reportedCount:double,countKind:string,evidence:string,sourceUrl:string,conditional:boolean>>,
sourceUrls:array<string>,observedAt:string,reviewStatus:string,extractionConfidence:string,reviewedAt:string,timingStatus:string,notes:array<string>,academics:map<string,string>,provenance:struct<sourceContentSha256:string,sourceArtifactKey:string>>"""


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows of files with their number over all files: the rows of earlier splits, then the place within the split.

    The ids that Spark gives rise by one within a split, since one task reads it from start to end.
    """
    placed = rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    splits = placed.groupBy("file", "start").agg(F.count("*").alias("rows"), F.min("row").alias("first"))
    earlier = W.orderBy("file", "start").rowsBetween(W.unboundedPreceding, -1)  # one row per split of a file
    before = splits.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    return placed.join(F.broadcast(before), ["file", "start"]).select((F.col("before") + F.col("row") - F.col("first")).alias("ordinal"), "value")


def read_release(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One profile a row with its place: a release document, or JSON lines of one profile each.

    Columns ordinal, raw (the profile's text) and p (parsed). A line's ordinal is its number over all files in the order
    of their names, however the files are split over tasks; blank lines count but fall out.
    """
    if lines:
        rows = _numbered(spark.read.text(path)).where(F.trim("value") != "").select("ordinal", F.col("value").alias("raw"))
    else:
        document = spark.read.schema("version int, release string, profiles array<string>").json(path, multiLine=True)
        rows = document.select("version", "release", F.posexplode("profiles").alias("ordinal", "raw"))
    return rows.withColumn("p", F.from_json("raw", PROFILE)).withColumn("content_sha256", F.sha2("raw", 256))


def release_headers(spark: SparkSession, path: str) -> DataFrame:
    """(release, version, profiles: their number) of release documents, empty ones included."""
    documents = spark.read.schema("version int, release string, profiles array<string>").json(path, multiLine=True)
    return documents.select("release", "version", F.coalesce(F.nullif(F.size("profiles"), F.lit(-1)), F.lit(0)).alias("profiles"))


def parse_documents(df: DataFrame, column: str, schema: str, name: str = "parsed") -> DataFrame:
    """A column of stored JSON texts as a struct or array `name`; null where a text is no such JSON."""
    return df.withColumn(name, F.from_json(column, schema))


def _opened(path: str):
    """A file by the name that Spark gives it, on any file system that Arrow knows."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem().open_input_file(rest)
    system, place = fs.FileSystem.from_uri(f"{scheme}:{quote(rest)}")
    return system.open_input_file(place)


def _hashed_on(path: str, length: int, start: int, piece: int, state: bytes | None) -> bytes:
    """The SHA-256 state of a file after the piece at start, given the state before it; the digest after the last piece."""
    openssl, held = ctypes.CDLL(_hashlib.__file__), ctypes.create_string_buffer(state or b"", STATE)
    if state is None:
        openssl.SHA256_Init(held)
    stop = min(start + piece, length)
    with _opened(path) as file:
        file.seek(start)
        while start < stop:
            data = file.read(min(READ, stop - start))
            if not data:
                raise OSError(f"{path} ends before its {length} bytes")
            openssl.SHA256_Update(held, data, ctypes.c_size_t(len(data)))
            start += len(data)
    if stop < length:
        return held.raw
    digest = ctypes.create_string_buffer(DIGEST)
    openssl.SHA256_Final(digest, held)
    return digest.raw


def artifact_digests(spark: SparkSession, path: str, piece: int = PIECE) -> DataFrame:
    """(name, sha256, length) of every file below path, of any size.

    A SHA-256 is a chain over a file's bytes. A file of more than `piece` bytes takes a round for each piece: a task takes up the
    state that the last round left, reads one piece and gives the state back, so no task reads more. The driver
    holds the names of files, as it does to list them, and these states. Spark reads no empty files; they are those
    that it lists only.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.substring_index("path", "/", -1).alias("name")
    listed = spark.createDataFrame([(file, unquote(file.rsplit("/", 1)[-1])) for file in files.inputFiles()], "file string, name string")
    place = lambda file: F.regexp_replace(file, "^file:/+", "/").alias("file")
    empty = listed.withColumn("file", place("file")).join(files.select(place("_metadata.file_path")), "file", "left_anti")
    empty = empty.select("name", F.sha2(F.lit("").cast("binary"), 256).alias("sha256"), F.lit(0).cast("long").alias("length"))
    whole = files.where(F.col("length") <= piece).select(name, F.sha2("content", 256).alias("sha256"), "length").unionAll(empty)
    large = [(r.path, r.length, None) for r in files.where(F.col("length") > piece).select("path", "length").collect()]
    if not large:
        return whole
    done, start = [], 0
    while large:
        step = lambda r, at=start: (r[0], r[1], _hashed_on(r[0], r[1], at, piece, r[2]))
        large = spark.sparkContext.parallelize(large, len(large)).map(step).collect()
        start += piece
        done += [r for r in large if r[1] <= start]
        large = [r for r in large if r[1] > start]
    hashed = spark.createDataFrame([(p, bytes(digest), n) for p, n, digest in done], "path string, digest binary, length long")
    return whole.unionAll(hashed.select(name, F.lower(F.hex("digest")).alias("sha256"), "length"))


def frame_data(block: Column) -> Column:
    """The data of a server-sent block: its data: lines without prefix and leading blanks, joined by line feeds."""
    lines = F.split(F.replace(block, F.lit("\r\n"), F.lit("\n")), "\n")
    data = F.filter(lines, lambda x: x.startswith("data:"))
    return F.array_join(F.transform(data, lambda x: F.regexp_replace(F.substr(x, F.lit(6)), r"^\s+", "")), "\n")


def read_event_frames(blocks: DataFrame) -> DataFrame:
    """Frames (message_id, seq, block) as (message_id, seq, text, finish, bad); empty blocks fall out."""
    rows = blocks.withColumn("data", frame_data(F.col("block"))).where("data <> ''")
    e = F.from_json("data", "choices array<struct<delta:struct<content:string>,finish_reason:string>>, error string")
    rows = rows.withColumn("e", F.when(F.col("data") != "[DONE]", e))
    first = F.get("e.choices", F.lit(0))
    bad = (F.col("data") != "[DONE]") & ((F.col("e.choices").isNull()) | F.col("e.error").isNotNull())
    return rows.select("message_id", "seq", first["delta"]["content"].alias("text"), F.when(F.col("data") == "[DONE]", F.lit(None).cast("string")).otherwise(first["finish_reason"]).alias("finish"), F.coalesce(bad, F.lit(True)).alias("bad"))
