"""Note files of one folder as a lines table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.lines import split_documents
from .listing import decoded, list_files

_GLOB = "*.md"
# Files without lines, which no part file can stand for. A name that file scans pass over.
_EMPTY = "_empty"


def _matches(spark: SparkSession, pattern: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path))


def read_memory_files(spark: SparkSession, folder: str) -> DataFrame:
    """Lines (path, line_no, line) of each ``*.md`` directly in ``folder``: files, and files as ``write_memory_files`` writes them.

    Files are read whole: a line's number cannot be known from a split in the middle of a file.
    """
    found = None
    if _matches(spark, f"{folder}/{_GLOB}") or not _matches(spark, f"{folder}/name=*"):
        files = spark.read.text(folder, wholetext=True, pathGlobFilter=_GLOB)
        texts = files.select(decoded(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("text"))
        empty = list_files(spark, folder, _GLOB).where("size = 0").select("path", F.lit("").alias("text"))
        found = split_documents(texts.unionByName(empty), "path", "text")
    if _matches(spark, f"{folder}/name=*"):
        written = _written_lines(spark, folder)
        found = written if found is None else found.unionByName(written)
    if _matches(spark, f"{folder}/{_EMPTY}"):
        empty = spark.read.schema("value string").text(f"{folder}/{_EMPTY}")
        found = found.unionByName(empty.select(F.concat(F.lit(f"{folder}/"), "value").alias("path"), F.lit(None).cast("int").alias("line_no"), F.lit(None).cast("string").alias("line")))
    return found


def _written_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of files in parts: a line's number is its place in its part and the lines of the parts before."""
    reader = spark.read.schema("value string, name string").option("basePath", folder)
    parts = reader.text(f"{folder}/name=*", wholetext=True).select("name", F.col("_metadata.file_name").alias("part"), F.col("value").alias("text"))
    lines = split_documents(parts.select(F.struct("name", "part").alias("at"), "text"), "at", "text")
    sizes = lines.groupBy("path").agg(F.count("line_no").alias("n"))
    before = Window.partitionBy("path.name").orderBy("path.part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("path", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return lines.where("line_no is not null").join(firsts, "path").select(
        F.concat(F.lit(f"{folder}/"), "path.name").alias("path"), (F.col("line_no") + F.col("first")).cast("int").alias("line_no"), "line")


def write_memory_files(lines: DataFrame, folder: str) -> None:
    """Write lines to a new folder, one sub-folder of ordered part files per source file; ``read_memory_files`` reads them back."""
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    named = lines.where("line_no is not null").select(name, "line_no", F.col("line").alias("value"))
    ordered = named.repartitionByRange("name", "line_no").sortWithinPartitions("name", "line_no")
    ordered.select("name", "value").write.partitionBy("name").text(folder)
    empty = lines.where("line_no is null").select(name.alias("value")).distinct()
    if not empty.isEmpty():
        empty.write.text(f"{folder}/{_EMPTY}")
