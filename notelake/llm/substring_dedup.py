"""Substring dedup by level-wise doubling.

A window of ``window`` words can only repeat if what it holds at half its length repeats. So the
first level looks at half-length windows: of those inside a window, the one with the smallest hash
(its *anchor*) stands for it, in every copy of the window alike. About one word in fourteen starts
an anchor, and only anchors found at two places are extended to twice the length. Neighbouring
windows with one anchor travel as a *run*: equal runs are settled as a whole, by a pre-aggregated
minimum; only where one anchor has different surroundings are single windows compared, and of equal
runs only the first. No step gathers a group: hot passages meet in aggregates and in joins that
adaptive execution splits.

``repeat_levels`` goes on doubling from there until no candidate survives.

Defined results: null text counts as empty; texts shorter than the window keep everything; rows
without doc_id come after all others, and rows with equal doc_id (repeated rows, too) take nothing
from each other; columns beyond doc_id and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .scratch import given_id, keyed, settled

WINDOW = 50
_RUNS = "m long, ctx long, id long, key long, a int, w int"
_SPANS = "key long, a int, w int"
_WINDOWS = "h1 long, h2 long, id long, key long, a int"


def _hashed_words(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = K.utf8(piece.column("text"))
    starts, ends, rows = K.word_places(raw, offsets)
    return K.stretch_hashes(raw, starts, ends), rows


def anchor_runs(window: int):
    """Runs of neighbouring windows of one row with one anchor: (anchor, hash of the words, row, first window, windows)."""
    gram = (window + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in (p for b in batches for p in K.slices(b, "text")):
            words, rows = _hashed_words(piece)
            at = K.windows_in_rows(rows, window)
            if not len(at):
                continue
            rolling = K.Rolling(words, K.WORD_BASE)
            grams = np.arange(len(words) - gram + 1)
            anchor = K.sliding_min(rolling.of(grams, grams + gram), window - gram + 1)[at]
            new = np.ones(len(at), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
            first = np.flatnonzero(new)
            sizes = np.diff(np.append(first, len(at)))
            a = at[first]
            row = np.searchsorted(rows, a, "right") - 1
            yield pa.record_batch({
                "m": K.signed(anchor[first]), "ctx": K.signed(rolling.of(a, a + sizes + window - 1)),
                "id": piece.column("id").to_numpy()[row], "key": piece.column("key").to_numpy()[row],
                "a": (a - rows[row]).astype(np.int32), "w": sizes.astype(np.int32),
            })

    return run


def _windows_of(length: int):
    """128-bit hashes of all windows of the given runs (rows: id, key, text, runs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in (p for b in batches for p in K.slices(b, "text")):
            words, rows = _hashed_words(piece)
            runs = piece.column("runs")
            row = np.repeat(np.arange(len(runs)), runs.value_lengths().to_numpy())
            fields = runs.flatten()
            sizes = fields.field("w").to_numpy()
            at = K.ranges(fields.field("a").to_numpy() + rows[row], sizes)
            row = np.repeat(row, sizes)
            fits = at + length <= rows[row + 1]
            at, row = at[fits], row[fits]
            yield pa.record_batch({
                "h1": K.signed(K.Rolling(words, K.WORD_BASE).of(at, at + length)),
                "h2": K.signed(K.Rolling(K.mixed(words, 7), K.WIDE_BASE).of(at, at + length)),
                "id": piece.column("id").to_numpy()[row], "key": piece.column("key").to_numpy()[row],
                "a": (at - rows[row]).astype(np.int32),
            })

    return run


def _by_row(spans: DataFrame, name: str) -> DataFrame:
    return spans.distinct().groupBy("key").agg(F.collect_list(F.struct("a", "w")).alias(name))


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, a, w): of the row with this key, the w windows from word a on also start in a row with a smaller doc_id."""
    if window < 2:
        raise ValueError("a window has two words at least")
    rows = keyed(docs)
    runs = settled(rows.mapInArrow(anchor_runs(window), _RUNS), "op1-runs")
    anchors = runs.groupBy("m").agg(F.count(F.lit(1)).alias("n"), F.min("ctx").alias("low"), F.max("ctx").alias("high"))
    anchors = anchors.where("n > 1").select("m", (F.col("low") != F.col("high")).alias("mixed"))
    again = settled(runs.join(anchors, "m"), "op1-again", runs)
    first = again.groupBy("m", "ctx").agg(F.min("id").alias("first_id"))
    judged = settled(again.join(first, ["m", "ctx"]), "op1-judged", again)
    whole = judged.where("id > first_id").select("key", "a", "w")
    # What remains undecided: the first of equal runs, if its anchor has other surroundings elsewhere.
    open_runs = judged.where("id = first_id and mixed").select("key", "a", "w")
    windows = rows.join(_by_row(open_runs, "runs"), "key").mapInArrow(_windows_of(window), _WINDOWS)
    windows = settled(windows, "op1-windows")
    least = windows.groupBy("h1", "h2").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id")).where("last_id > first_id")
    single = windows.join(least, ["h1", "h2"]).where("id > first_id").select("key", "a", F.lit(1).cast("int").alias("w"))
    return settled(whole.unionByName(single), "op1-repeated", judged, windows)


def _kept(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in K.slices(batch, "text"):
                out = {"n_words": [], "n_removed": [], "kept": []}
                spans = piece.column("spans")
                bounds = np.append(0, np.cumsum(spans.value_lengths().fill_null(0).to_numpy()))
                fields = spans.flatten()
                a = fields.field("a").to_numpy()
                b = a + fields.field("w").to_numpy() + window - 1
                for i, text in enumerate(piece.column("text")):
                    words = text.as_py().encode().split()
                    gone = 0
                    if bounds[i] < bounds[i + 1]:
                        cut = K.covered(len(words), a[bounds[i]:bounds[i + 1]], b[bounds[i]:bounds[i + 1]])
                        gone = int(cut.sum())
                        kept = [w for w, c in zip(words, cut.tolist()) if not c]
                    else:
                        kept = words
                    out["n_words"].append(len(words))
                    out["n_removed"].append(gone)
                    out["kept"].append(b" ".join(kept))
                yield pa.record_batch([piece.column("id"), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()),
                                       pa.array(out["kept"], pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "kept_text"])

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Each row without the words of windows that also start in a row with a smaller doc_id: doc_id, n_words, n_removed, kept_text."""
    spans = _by_row(repeated_windows(docs, window), "spans")
    rows = keyed(docs).join(spans, "key", "left")
    return rows.mapInArrow(_kept(window), "id long, n_words long, n_removed long, kept_text string").select(
        given_id(), "n_words", "n_removed", "kept_text")


def repeat_levels(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Doubling goes on from ``window``: (doc_id, length, n_windows) of windows that also start in a row with a smaller
    doc_id, for length window, 2 * window, ... until none survives."""
    rows = keyed(docs)
    at = repeated_windows(docs, window)
    length, found = window, None
    while True:
        each = at.select("key", F.explode(F.sequence("a", F.expr("a + w - 1"))).alias("a")).distinct()
        here = each.groupBy("key").agg(F.count(F.lit(1)).alias("n_windows")).withColumn("length", F.lit(length).cast("long"))
        if each.isEmpty():
            break
        found = here if found is None else found.unionByName(here)
        length *= 2
        everywhere = rows.withColumn("runs", F.array(F.struct(F.lit(0).alias("a"), F.length("text").alias("w"))))
        windows = settled(everywhere.mapInArrow(_windows_of(length), _WINDOWS), "op1-level")
        halves = windows.join(each, ["key", "a"], "left_semi").join(each.select("key", (F.col("a") - length // 2).alias("a")), ["key", "a"], "left_semi")
        keys = halves.select("h1", "h2").distinct()
        least = windows.join(keys, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.min("id").alias("first_id"))
        at = settled(halves.join(least, ["h1", "h2"]).where("id > first_id").select("key", "a", F.lit(1).cast("int").alias("w")), "op1-longer", windows)
    if found is None:
        return rows.where("false").select(given_id(), F.lit(0).cast("long").alias("length"), F.lit(0).cast("long").alias("n_windows"))
    return rows.select("id", "key").join(found, "key").select(given_id(), "length", "n_windows")
