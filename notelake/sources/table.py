"""The stored table: Parquet, partitioned by role and category, in versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import norm
from ..operators.filters import filter_role_category
from ..schema import ENTRIES, GROUP_KEYS
from .snapshots import Snapshot, current, escaped, publish, read_folders, write_folders

STORED = T.StructType(
    [f for f in ENTRIES.fields if f.name not in GROUP_KEYS]
    + [T.StructField("has_embedding", T.BooleanType()), T.StructField("norm", T.DoubleType())]
    + [f for f in ENTRIES.fields if f.name in GROUP_KEYS]
)


def scan_entries(
    spark: SparkSession, path: str, role: str | None = None, category: str | None = None, *, snapshot: Snapshot | None = None
) -> DataFrame:
    """Read a stored table as of its newest version, or of ``snapshot``; role and category prune directories.

    The schema is given, since inferred partition types would turn role '01' into a number.
    """
    snapshot = snapshot or current(spark, path)
    # Folders of other groups are not even listed.
    named = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    wanted = [f"{k}={named(v)}" for k, v in zip(GROUP_KEYS, (role, category)) if v]
    folders = [f for f in snapshot.folders if set(wanted) <= set(f.split("/"))]
    if not folders:
        return filter_role_category(spark.createDataFrame([], STORED), role, category)
    plain = [f for f in folders if not f.startswith("data/")]
    parts = []
    if plain:
        parts.append(spark.read.schema(STORED).option("basePath", path).parquet(*[f"{path}/{escaped(f)}" for f in plain]))
    written = [f for f in folders if f.startswith("data/")]
    if written:
        parts.append(read_folders(spark, path, STORED, written))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return filter_role_category(found, role, category)


def to_stored(entries: DataFrame) -> DataFrame:
    """Full column set with the derived ``has_embedding`` and ``norm``."""
    columns = {f.name: F.col(f.name).cast(f.dataType) for f in ENTRIES.fields if f.name in entries.columns}
    no_tags = F.array().cast("array<string>")
    columns["tags"] = F.coalesce(columns["tags"], no_tags) if "tags" in columns else no_tags
    columns["has_embedding"] = F.col("embedding").isNotNull()
    columns["norm"] = norm(F.col("embedding"))
    return entries.select(*[columns[f.name].alias(f.name) for f in STORED.fields])


def append_entries(entries: DataFrame, path: str, *, base: Snapshot | None = None) -> Snapshot:
    """Write one directory per (role, category), seen by readers all at once.

    ``rebalance`` lets adaptive execution merge small groups into one task and split a large group
    over many, so neither tiny files nor one huge writer task come out. ``base``: the version that the rows were
    decided on; raises ``Conflict`` if it is no longer the newest.
    """
    spark = entries.sparkSession
    folders = write_folders(to_stored(entries).hint("rebalance", *GROUP_KEYS), path)
    return publish(spark, path, base or current(spark, path), folders, depends=() if base is None else None)


def replace_partitions(entries: DataFrame, path: str, *, base: Snapshot | None = None) -> Snapshot:
    """Put ``entries`` in place of the (role, category) directories that they are of.

    ``base``: the version that the rows were decided on; raises ``Conflict`` if one of these directories changed since.
    """
    spark = entries.sparkSession
    base = base or current(spark, path)
    return publish(spark, path, base, write_folders(to_stored(entries).hint("rebalance", *GROUP_KEYS), path), replace=True)
