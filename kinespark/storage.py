"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: list[str] = []
_KEPT: list[tuple] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a folder of our own in local mode,
    else an error (executors on other machines would not see it)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="kinespark-shared-"))
    return _OWN_DIR[0]


class SharedTable:
    """A DataFrame written to the shared folder: lineage is cut, lost executors only cost a reread."""

    def __init__(self, df: DataFrame, name: str, partitions: int | None = None):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark).rstrip('/')}/kinespark-{name}-{uuid.uuid4().hex}"
        with shuffle_cleanup(self.spark):
            # no marker: making one starts a chmod process beside the driver's JVM for each table
            df.write.option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(self.path)
        self.schema = df.schema
        _KEPT.append((self.spark, self.path))

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files; only for tables that no returned DataFrame still reads."""
        _delete(self.spark, self.path)
        _KEPT[:] = [x for x in _KEPT if x[1] != self.path]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _KEPT:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the session may have ended already
            pass


class shuffle_cleanup:
    """Within it, each finished query frees its shuffle files at once rather than at the next garbage collection."""

    KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self):
        self.before = self.spark.conf.get(self.KEY, "false")
        self.spark.conf.set(self.KEY, "true")

    def __exit__(self, *exc):
        self.spark.conf.set(self.KEY, self.before)
