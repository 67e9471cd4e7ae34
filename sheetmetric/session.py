"""Session defaults and lineage cutting."""
from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "sheetmetric", master: str | None = None, **conf) -> SparkSession:
    """Session with adaptive execution; the shuffle width starts high and AQE coalesces it."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor reaches: the one named by ``spark.checkpoint.dir``.

    Only when the session names none and runs on one machine (tests) is a new local folder used; on a cluster
    that is an error, for a local folder would leave parts on separate disks.
    """
    sc = spark.sparkContext
    folder = sc.getCheckpointDir()
    if folder is None:
        if not (sc.master.startswith("local") and not sc.master.startswith("local-cluster")) and not spark.conf.get("spark.checkpoint.dir", None):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp")))
        folder = sc.getCheckpointDir()
    return folder


FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession):
    """What is written within frees its shuffle files as it ends; else they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(FREED, "false")
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(FREED, before)


_SCRATCH: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """Tables stored within are emptied as it ends: for steps whose result, written elsewhere, no longer reads them."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            spark.range(0).write.mode("overwrite").parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    """Written compressed; the shuffles that led to it are freed."""
    with shuffles_freed(df.sparkSession):
        df.write.mode("overwrite").parquet(path, compression="zstd")


def stored(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read from there, for large tables read several times.

    Unlike a checkpoint it is compressed, and each reader reads its own columns only; the files stay as long as the folder, or as
    long as a ``scratch`` around it.
    """
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    write_table(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: survives the loss of any executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
