"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where a local session has none, as in tests, a temporary folder is made and set, and removed at the end; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir isn't set: it must name a folder that all executors share")
        made = tempfile.mkdtemp(prefix="wirelake-shared-")
        atexit.register(shutil.rmtree, made, True)
        folder = "file://" + made
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


RUN = "spark.wirelake.run"


def new_path(spark: SparkSession, label: str) -> str:
    run = spark.conf.get(RUN, None)
    return f"{shared_folder(spark)}/wirelake/{run + '/' if run else ''}{label}-{uuid.uuid4().hex}"


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[str]:
    """Tables made inside go to a folder of their own, which is deleted at the end. Write results inside: they may read those tables until then."""
    before, run = spark.conf.get(RUN, None), f"run-{uuid.uuid4().hex}"
    spark.conf.set(RUN, run)
    try:
        yield run
    finally:
        spark.conf.unset(RUN) if before is None else spark.conf.set(RUN, before)
        discard(spark, f"{shared_folder(spark)}/wirelake/{run}")


def begin_stage(spark: SparkSession) -> None:
    """From here on tables go to a folder of their own; that of the stage before is deleted. For chains of stages that each write their result before the next begins."""
    before = spark.conf.get(RUN, None)
    if before and before.startswith("stage-"):
        discard(spark, f"{shared_folder(spark)}/wirelake/{before}")
    spark.conf.set(RUN, f"stage-{uuid.uuid4().hex}")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes a table in the shared folder and reads it back: lineage ends there and lost executors lose nothing."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard_table(df: DataFrame) -> None:
    """Deletes a table that ``stored`` wrote, once nothing reads it any more."""
    files = df.inputFiles()
    if files:
        discard(df.sparkSession, files[0].rpartition("/")[0])


def release_shuffles(spark: SparkSession, release: bool = True) -> None:
    """Lets Spark delete the shuffle files of jobs that are over; else they stay until the driver next collects garbage."""
    if release:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)  # events of the last job still hold its plan
        gc.collect()
        spark._jvm.System.gc()
