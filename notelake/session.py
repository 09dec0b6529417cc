"""Session settings and the places where intermediate tables may be written."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Input up to this size may sit in fewer files than there are cores.
SMALL_INPUT_BYTES = 256 << 20
_CHECKPOINT_KEY = "spark.checkpoint.dir"
_scope: ContextVar[str] = ContextVar("scratch_scope", default="")


def build_session(app: str = "notelake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine is tuned for.

    Only a local master gets small fixed sizes; on a cluster the submit-time settings win.
    """
    # One BLAS thread per Python worker: Spark already runs one worker per core.
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
        # Admission streams keep every text they have seen; that does not fit on a heap.
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    if master:
        builder = builder.master(master)
    if master and master.startswith("local"):
        builder = (
            builder.config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.sql.shuffle.partitions", "8")
            .config("spark.driver.memory", "8g")
        )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster.

    Falls back to a private temporary folder only on a local master that names none.
    """
    configured = spark.conf.get(_CHECKPOINT_KEY, None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError(f"set {_CHECKPOINT_KEY} to a folder shared by all executors")
    fallback = tempfile.mkdtemp(prefix="notelake-")
    spark.conf.set(_CHECKPOINT_KEY, fallback)
    return fallback


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; never reused, so a retry cannot read stale data."""
    return f"{shared_dir(spark)}/notelake/{_scope.get()}{label}-{uuid.uuid4().hex}"


@contextmanager
def scratch_scope(spark: SparkSession, label: str) -> Iterator[None]:
    """Steps written inside go when it ends; for work that repeats, such as the batches of a stream."""
    folder = f"{label}-{uuid.uuid4().hex}"
    token = _scope.set(f"{_scope.get()}{folder}/")
    try:
        yield
    finally:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/notelake/{_scope.get()}")
        _scope.reset(token)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage through a written table that survives the loss of executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.mode("error").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_small(df: DataFrame) -> DataFrame:
    """Use all cores for costly per-row work on a small input that would be read by few tasks.

    Goes by the size of the tables underneath, known without running anything. Larger inputs are
    split by the scan itself and are left alone.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SMALL_INPUT_BYTES else df
