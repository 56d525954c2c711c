"""Intermediate tables of a report, written once to the folder that driver and executors share.

A report that needs its driving rows several times (to join them, and to take the keys that its
lookups are cut down to) would otherwise read the line table once for each use. Executors may be
lost at any time: what is written here needs no recomputation, and Spark knows its size.

Disk: a step's shuffle files go when it is written, and a step may be deleted once the next one is
written from it. So a report of several steps holds the shuffles of one step, not of all.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Spark's setting to delete a query's shuffle files when it ends, in place of when the driver collects garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def steps_folder(spark: SparkSession) -> str:
    """The checkpoint folder: what ``spark.checkpoint.dir`` names, or what the session already uses.

    Where neither is set, a scratch folder is made for a local master only; on a cluster a folder of
    one machine would be invisible to the others, so that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ledgerframe-"))
    return sc.getCheckpointDir()


def written_once(df: DataFrame, name: str) -> DataFrame:
    """``df`` computed once and read back from Parquet; columns must have different names.

    The shuffle files of the job that writes it are deleted at its end, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{steps_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def forget_step(df: DataFrame, name: str) -> None:
    """Delete the step ``name`` that ``df`` reads, once nothing reads it any more; its other tables stay."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        if folder.rsplit("/", 1)[1].startswith(f"{name}-"):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
