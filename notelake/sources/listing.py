"""Names of files, including the empty ones that scans pass over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def decoded(path: Column) -> Column:
    """Plain path of a file URI. URIs are percent-encoded, but a plus sign stands for itself; ``file:///x`` is ``file:/x``."""
    one_form = F.regexp_replace(path, r"^([A-Za-z][A-Za-z0-9+.-]*):///", "$1:/")
    return F.url_decode(F.replace(one_form, F.lit("+"), F.lit("%2B")))


def list_files(spark: SparkSession, folder: str, glob: str, *, deep: bool = False) -> DataFrame:
    """``path`` and ``size`` of each file; contents are not read.

    A scan leaves out files of length zero, so these are added from the listing Spark made for it.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob)
    files = reader.option("recursiveFileLookup", str(deep).lower()).load(folder)
    scanned = files.select(decoded(F.col("_metadata.file_path")).alias("path"), F.col("length").alias("size"))
    named = spark.createDataFrame([(uri,) for uri in files.inputFiles()], "uri string")
    empty = named.select(decoded(F.col("uri")).alias("path")).join(scanned, "path", "left_anti")
    return scanned.unionByName(empty.withColumn("size", F.lit(0).cast("bigint")))
