"""Registration of a query with its DuckDB SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortspark.sources.store import CODEC, gone, tidy

from .fixtures import derived, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The derived tables of one run as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def folder(self, name: str) -> str:
        """A new folder of this run in the cluster's shared place; where none is set a temporary one in local mode, else an error."""
        base = self.spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not self.spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="spark-")
        return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """df written once and read again, for a table that a query uses several times."""
        path = self.folder(name)
        with tidy(self.spark):
            df.write.parquet(path, compression=CODEC)
        return self.spark.read.schema(df.schema).parquet(path)

    def removed(self, df: DataFrame) -> None:
        """The files of what `written` gave go; nothing reads them any more."""
        for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            gone(self.spark, path)

    def __getattr__(self, name: str) -> DataFrame:
        return derived(self.spark, self.sf_dir, name)


def query(sql: str | None = None, name: str | None = None):
    """Register f(tables) under its name, with DuckDB SQL over the derived tables where SQL can express it."""

    def add(f: Callable[[Tables], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[key] = oracle(sql)
        return f

    return add
