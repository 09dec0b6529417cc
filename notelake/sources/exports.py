"""Ordered exports as rows, and their sinks.

A document is a sequence of lines with an order key, not one string: a role with a third of the
table still exports in parallel. Sinks write ordered part files per role; joined in name order they
are the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.filters import filter_role_category
from ..schema import RECORD_COLUMNS

MARKDOWN_ORDER = ("role", "section", "category", "kind", "created_at", "id")
_TITLE, _BODY, _END = 0, 1, 2
_HEADER, _BLANK, _ITEM = 0, 1, 2


def _record_columns() -> list[Column]:
    """The record's fields; no tags are an empty list, since JSON leaves NULL fields out."""
    no_tags = F.array().cast("array<string>")
    return [F.coalesce("tags", no_tags).alias("tags") if c == "tags" else F.col(c) for c in RECORD_COLUMNS]


def export_json(entries: DataFrame, role: str | None = None, category: str | None = None) -> DataFrame:
    """Records as JSON objects, with the columns that order them."""
    rows = filter_role_category(entries, role, category)
    return rows.select("role", "category", "created_at", "id", F.to_json(F.struct(*_record_columns())).alias("json"))


def export_markdown(entries: DataFrame, role: str | None = None, category: str | None = None) -> DataFrame:
    """Lines of one document per role; order by ``MARKDOWN_ORDER``."""
    rows = filter_role_category(entries, role, category)
    tags = F.when(
        F.size("tags") > 0, F.concat(F.lit(" `["), F.array_join("tags", ", "), F.lit("]`"))
    ).otherwise("")
    items = rows.select(
        "role", F.lit(_BODY).alias("section"), "category", F.lit(_ITEM).alias("kind"), "created_at", "id",
        F.concat(F.lit("- **"), F.col("created_at"), F.lit("**: "), F.col("text"), tags).alias("line"),
    )
    no_date, no_id = F.lit("").alias("created_at"), F.lit(0).cast("bigint").alias("id")
    heads = rows.select("role", "category").distinct().select(
        "role", F.lit(_BODY).alias("section"), "category",
        F.inline(F.array(
            F.struct(F.lit(_HEADER).alias("kind"), F.concat(F.lit("## "), F.col("category")).alias("line")),
            F.struct(F.lit(_BLANK).alias("kind"), F.lit("").alias("line")),
        )),
    ).select("role", "section", "category", "kind", no_date, no_id, "line")
    roles = rows.select("role").distinct()
    frame = F.array(
        F.struct(F.lit(_TITLE).alias("section"), F.lit(_HEADER).alias("kind"),
                 F.concat(F.lit("# "), F.col("role")).alias("line")),
        F.struct(F.lit(_TITLE).alias("section"), F.lit(_BLANK).alias("kind"), F.lit("").alias("line")),
        F.struct(F.lit(_END).alias("section"), F.lit(_BLANK).alias("kind"), F.lit("").alias("line")),
    )
    ends = roles.select("role", F.inline(frame)).select(
        "role", "section", F.lit("").alias("category"), "kind", no_date, no_id, "line"
    )
    lines = items.unionByName(heads).unionByName(ends)
    return lines.unionByName(_empty_document(roles, role)) if role else lines


def _empty_document(roles: DataFrame, role: str) -> DataFrame:
    spark = roles.sparkSession
    body = [(role, _TITLE, "", k, "", 0, line) for k, line in
            enumerate([f"# {role}", "", "No entries found.", ""])]
    lines = spark.createDataFrame(
        body, "role string, section int, category string, kind int, created_at string, id bigint, line string"
    )
    return lines.join(roles, "role", "left_anti")


def write_documents(lines: DataFrame, path: str) -> None:
    """Text sink for :func:`export_markdown`."""
    ordered = lines.repartitionByRange(*MARKDOWN_ORDER).sortWithinPartitions(*MARKDOWN_ORDER)
    ordered.select("role", F.col("line").alias("value")).write.partitionBy("role").text(path)


def write_json(entries: DataFrame, path: str) -> None:
    """JSON-lines sink in export order, one folder per role."""
    order = ("role", "category", "created_at", "id")
    rows = entries.select(*_record_columns()).repartitionByRange(*order).sortWithinPartitions(*order)
    rows.write.partitionBy("role").json(path)
