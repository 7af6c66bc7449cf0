"""Parquet tables, and tables kept between jobs in the cluster's shared folder."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import time
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SETTING = "spark.checkpoint.dir"
#: Up to `threshold` folders are listed by the driver, more by a job of `parallelism` tasks at most.
LISTING = "spark.sql.sources.parallelPartitionDiscovery"
#: Folders of local applications that have no setting.
_own: dict[str, str] = {}
_known: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a data folder; only Spark's own reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextlib.contextmanager
def settings(spark: SparkSession, **values: object) -> Iterator[None]:
    """Settings of the session, by their names' last part below LISTING, while a table's files are listed."""
    names = {f"{LISTING}.{k}": str(v) for k, v in values.items()}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from `spark.checkpoint.dir`.

    Only a local master, where driver and executors are one process, may fall
    back to a temporary folder; a cluster without the setting is an error.
    """
    where = spark.conf.get(SETTING, None)
    if where:
        return where
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError(f"set {SETTING} to a folder that driver and executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = tempfile.mkdtemp(prefix="lumigraph-")
    return _own[context.applicationId]


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # at exit the JVM may be gone already
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder, which goes when the driver's Python ends."""
    path = f"{shared_dir(spark).rstrip('/')}/lumigraph/{spark.sparkContext.applicationId}"
    if path not in _known:
        _known.add(path)
        atexit.register(_delete, spark, path)
    return path


def work_dir(spark: SparkSession) -> str:
    """A new name below this application's part of the shared folder."""
    return f"{_own_dir(spark)}/{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Remove what this application has stashed so far; tables that are not yet written out can't be read any more."""
    _delete(spark, _own_dir(spark))


def sweep(spark: SparkSession, days: float = 7.0) -> int:
    """Remove what applications that crashed have left, if nothing was added for so many days: how many folders."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/lumigraph")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    old = [x.getPath() for x in fs.listStatus(root) if x.getModificationTime() < (time.time() - 86400 * days) * 1000] if fs.exists(root) else []
    old = [x for x in old if x.getName() != spark.sparkContext.applicationId]
    for x in old:
        fs.delete(x, True)
    return len(old)


def stash(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared folder and return it reread.

    Cuts the lineage: a lost executor costs the tasks it ran, never what was
    written.  The files go when the driver's Python ends.
    """
    path = work_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """`df` as `stash` keeps it, and how many rows it has, told by the write itself."""
    told = Observation()
    return stash(df.observe(told, F.count(F.lit(1)).alias("n"))), told.get["n"]


def stash_each(spark: SparkSession, frames: Iterable[DataFrame], schema: str | StructType) -> DataFrame:
    """All of `frames`, one after another, written to one folder and reread; no rows without frames."""
    path = work_dir(spark)
    spark.createDataFrame([], schema).write.parquet(path)
    for df in frames:
        df.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
