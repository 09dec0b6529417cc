"""Trigram posting lists kept with a table.

A folder per build holds ``lists`` (role, category, gram, _b, ids), in files that each cover a range of (role, category,
gram), so that a search reads little more than the lists it asks for, and ``covered`` (last_id): entries up to this id are
listed. Entries added later are searched directly; removed ones are no longer found, since each candidate is looked
up in the table. A build becomes visible by its ``covered`` file, which is written last.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.blocks import BLOCK_ROWS
from ..operators.trigrams import postings
from ..schema import GROUP_KEYS

_LISTS = "role string, category string, gram bigint, _b int, ids array<bigint>"


@dataclass(frozen=True)
class KeywordIndex:
    """Posting lists of all entries with an id up to ``last_id``."""

    lists: DataFrame
    last_id: int


def write_keyword_index(entries: DataFrame, folder: str, *, block_rows: int = BLOCK_ROWS) -> None:
    """List the trigrams of all entries in a new build below ``folder``."""
    last = entries.agg(F.max("id")).first()[0]
    rows = entries.where(F.col("id") <= F.lit(last if last is not None else 0))
    hay = rows.select(*GROUP_KEYS, "id", X.haystack(F.col("text"), F.col("tags")).alias("hay"))
    lists = postings(hay, block_rows=block_rows).repartitionByRange(*GROUP_KEYS, "gram").sortWithinPartitions(*GROUP_KEYS, "gram", "_b")
    build = f"{folder}/build-{uuid.uuid4().hex}"
    lists.write.parquet(f"{build}/lists")
    entries.sparkSession.createDataFrame([(last if last is not None else -1,)], "last_id bigint").coalesce(1).write.parquet(f"{build}/covered")


def read_keyword_index(spark: SparkSession, folder: str) -> KeywordIndex | None:
    """The build that covers most; None if there is none."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    pattern = jvm.org.apache.hadoop.fs.Path(f"{folder}/build-*/covered/_SUCCESS")
    builds = [str(f.getPath().getParent().getParent()) for f in pattern.getFileSystem(conf).globStatus(pattern) or []]
    if not builds:
        return None
    covered = [(spark.read.schema("last_id bigint").parquet(f"{b}/covered").first()[0], b) for b in builds]
    last_id, best = max(covered)
    return KeywordIndex(spark.read.schema(_LISTS).parquet(f"{best}/lists"), last_id)
