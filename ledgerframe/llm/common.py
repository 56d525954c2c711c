"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerframe.operators.steps import steps_folder

#: The six characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share; an error on a cluster that names none."""
    return steps_folder(spark)


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    Lost executors then recompute from that table, not from the start, and Spark knows its size.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete what ``stored`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


#: Bitmaps have this many bits: 2,048 longs, a fixed size that a plan can carry as a literal.
BITMAP_BITS = 1 << 17


def bucket(hashed: Column) -> Column:
    return F.pmod(hashed, F.lit(BITMAP_BITS)).cast("int")


def bitmap_of(hashes: DataFrame) -> Column:
    """Array literal with the bit of each hash (first column of ``hashes``) set.

    BITMAP_BITS rows at most reach the driver, whatever the input's size. A set bit may belong to
    another hash as well, so callers use it to look closer or to fix an order, never to decide.
    """
    words_ = [0] * (BITMAP_BITS // 64)
    for (b,) in hashes.select(bucket(F.col(hashes.columns[0])).alias("b")).distinct().collect():
        words_[b // 64] |= 1 << b % 64
    return F.split(F.lit(",".join(str(x - (1 << 64) if x >> 63 else x) for x in words_)), ",").cast("array<bigint>")


def in_bitmap(hashed: Column, bitmap: Column) -> Column:
    b = bucket(hashed)
    return F.getbit(F.get(bitmap, F.shiftright(b, 6)), b.bitwiseAND(F.lit(63))) == 1


def workers_import(spark: SparkSession) -> None:
    """Python workers find this package where the driver has it (on a cluster it is installed there)."""
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    if root not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, environment.get("PYTHONPATH", "")]))


def only(df: DataFrame, condition: Column) -> DataFrame:
    """``df.filter(condition)`` for a costly condition.

    Spark would push the filter below the columns that it is made of and compute them anew for
    every mention; it doesn't push through a generated column.
    """
    return df.withColumn("_only", F.explode_outer(F.array(condition))).filter("_only").drop("_only")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """The runs of ``[^\\x20\\x09-\\x0D]+`` as an array; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), "")


def n_chars_of(text: Column, chars: str) -> Column:
    """How many code points of ``text`` are in ``chars``."""
    return F.length(text) - F.length(F.translate(text, chars, ""))
