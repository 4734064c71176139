"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.session import checkpoint_dir

#: Words of the contracts: runs of anything but space and \t \n \v \f \r.
WORD_RE = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Plans made here drop their shuffle files once their result is written."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def frozen(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder: its lineage is cut and
    every later use reads the same rows, also after an executor is lost."""
    checkpoint_dir(df.sparkSession)
    with _shuffles_freed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


class Stored:
    """Like ``frozen``, as a Parquet table in that folder: smaller, for larger
    results. ``drop`` removes it once nothing reads it any more."""

    def __init__(self, df: DataFrame, name: str):
        self._spark = df.sparkSession
        self._path = f"{checkpoint_dir(self._spark)}/{name}-{uuid.uuid4().hex}"
        with _shuffles_freed(self._spark):
            df.select("*").write.option("compression", "zstd").parquet(self._path)
        self.df = self._spark.read.parquet(self._path)

    def drop(self) -> None:
        path = self._spark._jvm.org.apache.hadoop.fs.Path(self._path)
        path.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(path, True)


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 3 is 1: never learned from. False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def null_safe(left: DataFrame, right: DataFrame, keys: dict[str, str]) -> Column:
    """Join condition left[k] <=> right[v] for all pairs of ``keys``."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[v]) for k, v in keys.items()])


def set_aside(df: DataFrame, prefix: str | tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with the columns that begin with a helper column's ``prefix`` renamed, and the new names by the old ones;
    ``put_back`` undoes it. So no name of the caller's meets one of the helpers'."""
    away = {c: f"in:{c}" for c in df.columns if c.startswith(prefix)}
    return df.withColumnsRenamed(away), away


def put_back(df: DataFrame, away: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({new: old for old, new in away.items()})
