"""Lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the session names in spark.checkpoint.dir.

    Where none is set, a temporary folder serves local masters only: on a cluster it would lie on one machine, so that
    is an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        folder = tempfile.mkdtemp(prefix="lemmary-ckpt")
    sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared checkpoint folder; later plans start from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """Like :func:`cut`, as Parquet: a fraction of a checkpoint's size for many narrow rows, read by columns. Deleted when the application ends."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    sc = spark.sparkContext
    folder = f"{sc._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"
    target = sc._jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(target)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def release(*cuts: DataFrame) -> None:
    """Delete the files of cuts. Only for cuts whose every dependent has been cut itself, so that no lineage leads back."""
    for df in cuts:
        path = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if path.isDefined():
            target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path.get())
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Delete the shuffle files of plans that nobody holds any more; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
