"""Tolerant reading of a tree of JSON-lines files, and the matching sink.

Layout: ``<root>/<role, any depth>/<category>.jsonl``. ``<category>.jsonl`` may also be a folder of part files.
A parallel writer produces ``<root>/role=<role>/category=<category>/part-...``; such a folder counts as one file too.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import GROUP_KEYS
from ..session import materialize
from .listing import decoded, list_files

_LAYOUT = r"^(?:(.*)/)?([^/]+)\.jsonl(?:/part-[^/]*)?$"
_WRITTEN = r"^role=([^/]+)/category=([^/]+)/part-[^/]*$"
_GLOB = "{*.jsonl,part-*}"
_RECORD = "text string, tags string, created_at string"
_STRICT = {"allowSingleQuotes": "false"}
OK, BLANK, MALFORMED, NO_TEXT, UNPLACED = "ok", "blank", "malformed", "no_text", "unplaced"


def _root_path(spark: SparkSession, root: str) -> str:
    """The root's absolute path within its file system, however it was spelled."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.makeQualified(folder).toUri().getPath().rstrip("/")


def _relative(path: Column, root: str) -> Column:
    """What follows ``root`` (an absolute path) in a file's URI; a file elsewhere is an error."""
    plain = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?(?=/)", "")
    elsewhere = F.raise_error(F.concat(F.lit(f"not below {root}: "), path)).cast("string")
    return F.when(F.startswith(plain, F.lit(root + "/")), F.substring(plain, F.lit(len(root) + 2), F.lit(1 << 20))).otherwise(elsewhere)


def list_jsonl_files(spark: SparkSession, root: str) -> DataFrame:
    """Every ``.jsonl`` file below ``root``, empty ones included: path, role, category."""
    found = list_files(spark, root, _GLOB, deep=True)
    files = found.select(_relative(F.col("path"), _root_path(spark, root)).alias("path"))
    return _placed(files).select("path", *GROUP_KEYS).distinct()


def _placed(rows: DataFrame) -> DataFrame:
    """Role and category from the path. A file directly below the root has no role."""
    def part(number: int) -> Column:
        # Names of partition folders are percent-encoded.
        return F.when(F.col("path").rlike(_WRITTEN), decoded(F.regexp_extract("path", _WRITTEN, number))).otherwise(F.regexp_extract("path", _LAYOUT, number))

    role, category = part(1), part(2)
    return (
        rows.where(F.col("path").rlike(_LAYOUT) | F.col("path").rlike(_WRITTEN))
        .withColumn("role", F.when(role != "", role))
        .withColumn("category", category)
        .withColumn("path", F.regexp_replace("path", r"(?<=\.jsonl|^role=[^/]{0,4096}/category=[^/]{0,4096})/part-[^/]*$", ""))
    )


def read_jsonl_lines(spark: SparkSession, root: str, as_of: date | str) -> DataFrame:
    """Every line with its ``status``; (path, block, line) is the reading order.

    Non-list tags become an empty list, a missing date becomes ``as_of``.
    """
    raw = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", _GLOB)
        .text(root)
        .select(
            _relative(decoded(F.col("_metadata.file_path")), _root_path(spark, root)).alias("path"),
            F.struct(
                F.col("_metadata.file_path").alias("part"), F.col("_metadata.file_block_start").alias("start"),
                F.monotonically_increasing_id().alias("line"),
            ).alias("position"),
            X.strip(F.col("value")).alias("value"),
        )
    )
    # Wrapped in brackets, anything but exactly one well-formed value has a length other than 1.
    single = F.json_array_length(F.concat(F.lit("["), F.col("value"), F.lit("]"))) == 1
    single = F.coalesce(single, F.lit(False))
    record = F.when(single, F.from_json("value", _RECORD, _STRICT))
    status = (
        F.when(F.col("value") == "", BLANK)
        .when(F.col("role").isNull(), UNPLACED)
        .when(F.col("r.text").isNotNull(), OK)
        .when(single & F.from_json("value", "map<string, string>", _STRICT).isNotNull(), NO_TEXT)
        .otherwise(MALFORMED)
    )
    return _placed(raw).withColumn("r", record).select(
        "path", *GROUP_KEYS, "position", status.alias("status"), "value",
        F.col("r.text").alias("text"), X.parse_tags(F.col("r.tags")).alias("tags"),
        F.coalesce("r.created_at", F.lit(str(as_of))).alias("created_at"),
    )


def read_jsonl_memories(spark: SparkSession, root: str, as_of: date | str) -> DataFrame:
    """Usable records only; see :func:`quarantine` for the rest."""
    rows = read_jsonl_lines(spark, root, as_of).where(F.col("status") == OK)
    return rows.drop("status", "value")


def quarantine(lines: DataFrame) -> DataFrame:
    return lines.where(~F.col("status").isin(OK, BLANK)).select("path", "status", "value")


def write_lines_tree(rows: DataFrame, root: str, order: str = "id") -> None:
    """Write lines (role, category, ``value``, ``order``) as ``<root>/role=.../category=.../`` folders of part files.

    Tasks write the folders where they belong; nothing is moved afterwards.
    """
    # A range partitioning looks at its input before it reads it; written once, the input is not computed twice.
    rows = materialize(rows.select(*GROUP_KEYS, "value", order), "json-lines")
    # Ranges, not a rebalance: part files of a group that several tasks write follow each other in order,
    # and the reading order decides which record is the first.
    ordered = rows.repartitionByRange(*GROUP_KEYS, order).sortWithinPartitions(*GROUP_KEYS, order).drop(order)
    ordered.write.partitionBy(*GROUP_KEYS).text(root)


def json_lines(entries: DataFrame) -> DataFrame:
    """Entries with ``value``, the line that stands for them in a tree."""
    return entries.withColumn("value", F.to_json(F.struct("text", "tags", "created_at")))


def write_jsonl_tree(entries: DataFrame, root: str, order: str = "id") -> None:
    """Write the tree form of entries; a group's lines are in ``order``."""
    write_lines_tree(json_lines(entries), root, order)
