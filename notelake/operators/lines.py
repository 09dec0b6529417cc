"""Checks and pruning of line-structured note files.

Input is a lines table (path, line_no, line); a file without lines has one row with NULL line_no.
The session section is located by two small aggregates over header lines instead of a running
window, so neither a long file nor a hot path has to pass through one task in line order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import (
    ENTRY_PREFIX,
    MAX_LINES,
    MAX_SESSION_ENTRIES,
    MIN_SESSION_ENTRIES,
    SECTION_HEADER,
    SESSION_HEADER,
)
from ..session import materialize, spread_small


def session_bounds(lines: DataFrame) -> DataFrame:
    """Per file with a session section: line numbers of its header and of the next other section.

    The header lines are written out once, so the lines are read a single time for this.
    """
    headers = lines.where(F.col("line").startswith(SECTION_HEADER)).select(
        "path", "line_no", F.col("line").startswith(SESSION_HEADER).alias("is_session")
    )
    headers = materialize(headers, "headers")
    starts = headers.where("is_session").groupBy("path").agg(F.min("line_no").alias("start"))
    others = headers.where("not is_session").select("path", F.col("line_no").alias("other"))
    after = starts.join(others, "path", "left")
    return after.groupBy("path", "start").agg(
        F.min(F.when(F.col("other") > F.col("start"), F.col("other"))).alias("end")
    )


def _in_region() -> Column:
    ends_later = F.col("end").isNull() | (F.col("line_no") < F.col("end"))
    is_header = F.col("line").startswith(SESSION_HEADER)
    inside = (F.col("line_no") > F.col("start")) & ends_later & ~is_header
    return F.coalesce(inside, F.lit(False))


def session_log_region(lines: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """Lines with ``in_region`` and ``is_entry`` for the first session section of their file."""
    bounds = session_bounds(lines) if bounds is None else bounds
    marked = lines.join(bounds, "path", "left").withColumn("in_region", _in_region())
    is_entry = F.col("in_region") & F.col("line").startswith(ENTRY_PREFIX)
    return marked.withColumn("is_entry", is_entry).drop("start", "end")


def session_log_count(lines: DataFrame) -> DataFrame:
    return session_log_region(lines).groupBy("path").agg(
        F.count_if(F.col("is_entry")).alias("session_entries")
    )


def _drop_after(lines: DataFrame, bounds: DataFrame, limits: DataFrame, most: int) -> DataFrame:
    """Drop session entries beyond each file's ``keep`` (<= ``most``); other lines stay.

    Only the first ``most + 1`` entries of a file are ranked; the first one beyond the limit gives
    the line number from which entries go.
    """
    marked = session_log_region(lines, bounds)
    ranks = Window.partitionBy("path").orderBy("line_no")
    ranked = marked.where("is_entry").select("path", "line_no").withColumn("_r", F.row_number().over(ranks))
    heads = ranked.where(F.col("_r") <= most + 1)
    cuts = heads.join(limits, "path").where("_r = keep + 1").select("path", F.col("line_no").alias("_cut"))
    kept = marked.join(cuts, "path", "left").where(
        ~F.col("is_entry") | F.col("_cut").isNull() | (F.col("line_no") < F.col("_cut"))
    )
    return kept.select(*lines.columns)


def prune_session_log(lines: DataFrame, max_entries: int) -> DataFrame:
    """Keep the first ``max_entries`` session entries per file; they are stored newest first."""
    bounds = session_bounds(lines)
    limits = bounds.select("path", F.lit(max_entries).alias("keep"))
    return _drop_after(lines, bounds, limits, max_entries)


def check_files(lines: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """Size check per file."""
    counted = session_log_region(lines, bounds).groupBy("path").agg(
        F.count("line_no").alias("line_count"), F.count_if(F.col("is_entry")).alias("session_entries")
    )
    return _verdict(counted)


def _verdict(counted: DataFrame) -> DataFrame:
    over = F.col("line_count") > MAX_LINES
    return counted.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("name"), "line_count", "session_entries",
        over.alias("over_limit"), (F.col("session_entries") > MAX_SESSION_ENTRIES).alias("session_warn"),
        F.when(over, "FAIL").otherwise("PASS").alias("status"),
    )


def _fix_plan(lines: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """Per file, the entries to keep after both pruning passes, in closed form."""
    checked = check_files(lines, bounds)
    first = F.least(F.col("session_entries"), F.lit(MAX_SESSION_ENTRIES))
    excess = F.col("line_count") - (F.col("session_entries") - first) - MAX_LINES
    second = F.least(first, F.greatest(MAX_SESSION_ENTRIES - excess, F.lit(MIN_SESSION_ENTRIES)))
    keep = F.when(F.col("over_limit") | F.col("session_warn"), F.when(excess > 0, second).otherwise(first))
    keep = F.coalesce(keep, F.col("session_entries"))
    return checked.withColumn("keep", keep.cast("int")).withColumn(
        "gone", F.col("session_entries") - F.col("keep")
    )


def fix_files(lines: DataFrame) -> DataFrame:
    """Result of pruning per file. Original counts stay; flags are those after the fix."""
    plan = _fix_plan(lines)
    fixed = F.col("gone") > 0
    new_count = F.col("line_count") - F.col("gone")
    over = new_count > MAX_LINES
    return plan.select(
        "path", "name", "line_count", "session_entries",
        over.alias("over_limit"), (F.col("keep") > MAX_SESSION_ENTRIES).alias("session_warn"),
        fixed.alias("fixed"), F.when(fixed, new_count).alias("new_line_count"),
        F.when(over, "FAIL").otherwise("PASS").alias("status"),
    )


def fixed_lines(lines: DataFrame) -> DataFrame:
    """The lines that stay after :func:`fix_files`, for writing to a new folder."""
    bounds = session_bounds(lines)
    limits = materialize(_fix_plan(lines, bounds).where("gone > 0").select("path", "keep"), "fix-plan")
    return _drop_after(lines, bounds, limits, MAX_SESSION_ENTRIES)


def check_report(checked: DataFrame) -> DataFrame:
    """One row for a whole folder; it passes when no file is over its limit."""
    return checked.agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.bool_or("over_limit"), F.lit(False)).alias("any_fail"),
        F.coalesce(F.bool_or("session_warn"), F.lit(False)).alias("any_warn"),
        (~F.coalesce(F.bool_or("over_limit"), F.lit(False))).alias("passed"),
    )


def _lines_of(text: Column) -> Column:
    """Lines of a whole text; the last one counts with or without a line end."""
    parts = F.split(text, r"\r\n|\r|\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def split_documents(docs: DataFrame, path: str, text: str) -> DataFrame:
    """Lines of a (path, whole text) table."""
    rows = spread_small(docs.select(F.col(path).alias("path"), F.col(text).alias("_text")))
    return rows.select("path", F.posexplode_outer(_lines_of(F.col("_text"))).alias("line_no", "line"))


def check_documents(docs: DataFrame, path: str, text: str) -> DataFrame:
    """:func:`check_files` where each file already is one row: a single scan without any shuffle."""
    before, inside, after = 0, 1, 2

    def step(state: Column, line: Column) -> Column:
        header = line.startswith(SESSION_HEADER)
        where = F.when(header & (state["at"] == before), inside).when(
            ~header & (state["at"] == inside) & line.startswith(SECTION_HEADER), after
        ).otherwise(state["at"])
        counts = (where == inside) & line.startswith(ENTRY_PREFIX)
        return F.struct(where.cast("int").alias("at"), (state["n"] + counts.cast("bigint")).alias("n"))

    start = F.struct(F.lit(before).alias("at"), F.lit(0).cast("bigint").alias("n"))
    rows = spread_small(docs.select(F.col(path).alias("path"), F.col(text).alias("_text")))
    lines = rows.select("path", _lines_of(F.col("_text")).alias("_lines"))
    counted = lines.select(
        "path", F.size("_lines").cast("bigint").alias("line_count"),
        F.aggregate("_lines", start, step, lambda state: state["n"]).alias("session_entries"),
    )
    return _verdict(counted)
