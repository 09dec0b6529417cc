"""Continuous admission of arriving notes."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as X
from ..operators.blocks import MAX_BROADCAST_GROUPS
from ..operators.filters import reject_reason
from ..plans.admission import admit_batch, admitted_rows
from ..schema import DEDUP_THRESHOLD, GROUP_KEYS
from ..session import materialize, scratch_scope
from ..sources import snapshots


def stream_admit(arriving: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Exact-text admission: one row per (role, category, normalized text), for ever.

    State holds one digest per distinct text and grows with them by design, since a note admitted
    once stays admitted. Uses the RocksDB settings of the session when given.
    """
    valid = arriving.where(reject_reason().isNull()).withColumn("text_key", X.text_key(F.col("text")))
    unique = valid.dropDuplicates([*GROUP_KEYS, "text_key"])
    writer = unique.writeStream.format("parquet").outputMode("append").option("path", sink)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# So many writes of one size in a group are put together into one of the next size.
MERGED = 8


def read_admitted(spark: SparkSession, sink: str, schema: T.StructType, groups: list[tuple[str, str]] | None = None) -> DataFrame:
    """What a sink holds: of all groups, or of these (role, category)."""
    return _rows_of(spark, sink, schema, snapshots.current(spark, sink), groups)


def _rows_of(spark, sink, schema, now, groups) -> DataFrame:
    folders = now.folders if groups is None else [f for f in now.folders if snapshots.group_of(f) in {_folder_name(spark, g) for g in groups}]
    rows = snapshots.read_folders(spark, sink, schema, folders).select(*schema.names) if folders else spark.createDataFrame([], schema)
    # Sinks of the former layout: a folder per batch.
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{sink}/batch_id=*")
    if pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern):
        rows = rows.unionByName(spark.read.schema(schema).parquet(f"{sink}/batch_id=*"))
    return rows


def _folder_name(spark: SparkSession, group: tuple[str, str]) -> str:
    named = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    return "/".join(f"{k}={named(v)}" for k, v in zip(GROUP_KEYS, group))


def _size_class(folder: str) -> int:
    """How often a folder was put together from smaller ones."""
    return int(folder.split("/")[1].rpartition("-s")[2]) if "-s" in folder.split("/")[1] else 0


def _put_together(spark: SparkSession, sink: str, schema: T.StructType, now: snapshots.Snapshot, touched: set[str]) -> None:
    """Keep the folders of a group few: ``MERGED`` of one size become one. A row is rewritten a logarithmic number of times."""
    by_class: dict[tuple[str, int], list[str]] = {}
    for folder in now.folders:
        if snapshots.group_of(folder) in touched:
            by_class.setdefault((snapshots.group_of(folder), _size_class(folder)), []).append(folder)
    for size in sorted({c for (_, c), folders in by_class.items() if len(folders) >= MERGED}):
        old = [f for (_, c), folders in by_class.items() if c == size and len(folders) >= MERGED for f in folders]
        rows = snapshots.read_folders(spark, sink, schema, old).hint("rebalance", *GROUP_KEYS)
        now = snapshots.publish(spark, sink, now, snapshots.write_folders(rows, sink, f"-s{size + 1}"), instead_of=old)


def admit_into(
    sink: str, schema: T.StructType, threshold: float = DEDUP_THRESHOLD, stream: Callable[[], str] | None = None
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` step: admit each micro-batch against everything admitted before it.

    The sink is a table in versions, laid out by group: a batch reads the folders of its own groups, and those are kept
    few. A batch becomes visible in one step that also notes its number, so a replay after a failure finds it done and
    adds nothing. Numbers count per ``stream`` (the id that a checkpoint keeps), so that a new checkpoint
    over an old sink goes on where the other one ended instead of replacing its batches.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        name = stream() if stream else "only"
        with scratch_scope(spark, "stream"):
            # Admission reads the batch several times; the source is to be read once.
            batch = materialize(batch, "arriving")
            groups = batch.select(*GROUP_KEYS).distinct().limit(MAX_BROADCAST_GROUPS + 1).collect()
            listed = None if len(groups) > MAX_BROADCAST_GROUPS else [tuple(g) for g in groups if all(g)]
            while True:
                now = snapshots.current(spark, sink)
                if dict(now.batches).get(name, -1) >= batch_id:
                    return
                stored = _rows_of(spark, sink, schema, now, listed)
                verdict = admit_batch(batch, stored, threshold, with_text=False)
                folders = snapshots.write_folders(admitted_rows(verdict).select(*schema.names).hint("rebalance", *GROUP_KEYS), sink)
                try:
                    now = snapshots.publish(spark, sink, now, folders, depends=None, batch=(name, batch_id))
                    break
                except snapshots.Conflict:
                    continue
            _put_together(spark, sink, schema, now, {snapshots.group_of(f) for f in folders})

    return step


def checkpoint_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the stream that a checkpoint belongs to; it stays the same over restarts."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/metadata")
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()[-1])["id"]
    finally:
        stream.close()


def stream_admit_semantic(
    arriving: DataFrame, sink: str, checkpoint: str, threshold: float = DEDUP_THRESHOLD
) -> StreamingQuery:
    """Vector and text admission per micro-batch; ``id`` gives the order inside a batch. Read the sink with ``read_admitted``."""
    step = admit_into(sink, arriving.schema, threshold, lambda: checkpoint_id(arriving.sparkSession, checkpoint))
    writer = arriving.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
