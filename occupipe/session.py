"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


# Temporary folders of local sessions that name no checkpoint folder.
_LOCAL: dict[str, str] = {}
# Applications whose scratch is deleted when Python ends.
_SCRATCH: set[str] = set()


def local_session(cores: int | str = "*", name: str = "occupipe") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    partitions = str(cores) if str(cores).isdigit() else "8"
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """A new folder that every executor can reach.

    It lies under ``spark.checkpoint.dir``. Where that is unset a local session gets a
    temporary folder; a cluster must name one, since executors share no local disk.
    """
    context = spark.sparkContext
    if context.applicationId not in _SCRATCH:
        _SCRATCH.add(context.applicationId)
        atexit.register(clear_scratch, spark)
    return os.path.join(_scratch(spark), uuid.uuid4().hex)


def clear_scratch(spark: SparkSession) -> None:
    """Delete the tables and checkpoints that this application has written under the shared folder.

    Called when Python ends; a long session may call it between jobs whose results are stored.
    """
    context = spark.sparkContext
    if context._jsc is not None and context._gateway is not None:
        path = context._jvm.org.apache.hadoop.fs.Path(_scratch(spark))
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def _scratch(spark: SparkSession) -> str:
    """This application's own folder."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        if context.applicationId not in _LOCAL:
            _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="occupipe-")
        base = _LOCAL[context.applicationId]
    return os.path.join(base, f"occupipe-{context.applicationId}")


def kept_dir(spark: SparkSession, name: str) -> str:
    """A folder of the warehouse that outlives the application, for tables that later runs read."""
    return os.path.join(spark.conf.get("spark.sql.warehouse.dir"), name)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives the loss of any executor."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


@contextmanager
def unsorted_writes(spark: SparkSession, writers: int = 8) -> Iterator[None]:
    """Writes by a column of few values keep a file open for each, and do not sort a task's rows.

    A task that meets more than ``writers`` values sorts the rest of its rows.
    """
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, writers)
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """What the queries run within have shuffled is deleted as each ends, not when the driver collects garbage.

    For frames that are run once, such as those written by ``through_table``.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def through_table(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write once as parquet under the shared folder and read back."""
    path = path or shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder under the shared folder that nothing reads any more."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def held_table(df: DataFrame) -> Iterator[DataFrame]:
    """``through_table`` for the steps within, then deleted."""
    path = shared_dir(df.sparkSession)
    try:
        yield through_table(df, path)
    finally:
        drop_folder(df.sparkSession, path)
