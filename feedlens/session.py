"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every feedlens job relies on: UTC wall clock (all timestamps are
# naive UTC), AQE for runtime coalescing / skew-join splitting, no web UI.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # coalesce shuffle output towards the advisory size (64 MB), not towards
    # maximum parallelism: the recommended setting on a busy cluster
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpoint files written to cut lineage are removed once unreferenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "feedlens", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the feedlens defaults.

    On a cluster ``master`` stays None so spark-submit decides; tests pass
    ``local[N]``.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, set once: the one ``spark.checkpoint.dir`` names.

    On a cluster that setting must name a folder all executors share; without
    it this raises. Only a local master, where driver and executors are one
    process, gets a scratch folder instead.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if not d:
        d = sc.getConf().get("spark.checkpoint.dir", None)
        if not d:
            if not re.match(r"local(\[|$)", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            d = tempfile.mkdtemp(prefix="feedlens-ckpt-")
        sc.setCheckpointDir(d)
        d = sc.getCheckpointDir()
    return d


def frozen(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder (a reliable, eager checkpoint):
    its lineage is cut and every later use reads the same rows, also after an executor is lost."""
    checkpoint_dir(df.sparkSession)
    with short_shuffles(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a job inside go when it ends, not when the driver next collects garbage.

    For writes: their plan runs once, so nothing asks for these files again."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


class Written:
    """``df`` as a Parquet table in the shared checkpoint folder, read back: like ``frozen``, but compressed,
    and a later use reads its columns alone. ``drop`` removes it once nothing reads it any more."""

    def __init__(self, df: DataFrame, name: str):
        self._spark = df.sparkSession
        self._path = f"{checkpoint_dir(self._spark)}/{name}-{uuid.uuid4().hex}"
        with short_shuffles(self._spark):
            df.write.option("compression", "zstd").parquet(self._path)
        self.df = self._spark.read.parquet(self._path)

    def drop(self) -> None:
        remove(self._spark, self._path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``Written`` that stays until the folder is cleared."""
    return Written(df, name).df
