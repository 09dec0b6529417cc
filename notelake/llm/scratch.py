"""Written steps between jobs, in the folder the cluster shares."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

NO_ID = (1 << 63) - 1  # rows without doc_id come after all others


def settled(df: DataFrame, label: str, *used_up: DataFrame) -> DataFrame:
    """``df`` written once; later reads neither recompute it nor depend on any executor.

    The shuffle files of the steps behind it are of no more use. Spark drops them when the driver
    collects its garbage, which it may not do for long, so it is asked to. ``used_up``: settled
    tables that only ``df`` needed; they go.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("error").parquet(path)
    for old in used_up:
        remove(spark, old.scratch_path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    written = spark.read.schema(df.schema).parquet(path)
    written.scratch_path = path
    return written


def remove(spark: SparkSession, path: str) -> None:
    """Delete one folder that ``scratch_path`` gave, through the file system it is on."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(conf).delete(folder, True)


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """id: doc_id (null: after all others); key: tells rows apart, equal only for rows equal in id and text; text: null is empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"),
        F.xxhash64(F.col("doc_id").cast("long"), text).alias("key"), *columns, text.alias("text"),
    )


def given_id() -> Column:
    return F.nullif(F.col("id"), F.lit(NO_ID)).alias("doc_id")


def row_key() -> Column:
    """The key that ``keyed`` gives the row."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def with_keys(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """``docs`` semi- or anti-joined to the rows of ``keys`` (key), with all its columns."""
    name = free_name(docs, "_row_key")
    return docs.withColumn(name, row_key()).join(keys.select(F.col("key").alias(name)).distinct(), name, how)
