"""Quality classifier by importance resampling.

Two bags of hashed n-grams (tokens and neighbouring pairs) are counted: of the target, the good ones
of the labelled rows, and of the raw text, all rows. A row's log weight is the sum over its n-grams of
log(target share / raw share). Adding Gumbel noise and keeping the k largest keys samples k rows
without replacement in proportion to their weights. Noise comes from a hash of the row, so a run can
be repeated. k is the number of rows whose weight passes the threshold that best tells good from bad
labelled rows that the model has not seen; good is a row of quality 1 that is not toxic.

Toxic rows have a ratio of their own, as a few words tell them and a long clean text would outweigh
these in a sum. An n-gram's log odds compare the shares of toxic and clean labelled rows that have it; a
row's toxicity is the largest among its n-grams. Rows over the threshold that best tells toxic from
clean labelled rows that this model has not seen have no weight in the target: they are not drawn.

Both models are arrays of fixed size; each partition adds up its own, and a fixed number of tasks
add up those. ``LABELLED`` bounds the labelled rows used for fitting (those with the smallest id
hashes); the raw model, the weights and the selection cover all rows.

Defined results: null and empty texts have weight 0; labels without quality are ignored, toxic ones
are no target, a doc_id labelled twice counts by its lowest quality; without good or without bad
labelled rows the weights keep all rows, without toxic or without clean ones the toxicity does; repeated rows have one key and stay or go together, so ties at the k-th
key all stay; other columns are carried along; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .scratch import row_key, settled, with_keys

BUCKET_BITS = 18
LABELLED = 20_000
# Toxic labelled rows that an n-gram must be in to count.
TOXIC_ROWS = 3
_SUMMERS = 4
_ROW = 1 << 40  # place of the summing step's noise in 64-bit hashes

_KIND = np.ones(256, np.int8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = 2


def ngram_buckets(piece: pa.RecordBatch, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all tokens and neighbouring pairs of each row, row by row, and each row's first place.

    A token is a run of letters and digits or of punctuation. All pairs of equal tokens share one bucket.
    """
    raw, offsets = K.utf8(piece.column("text"))
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(len(piece) + 1, np.int64)
    kind = _KIND[raw]
    cut = np.ones(len(raw), bool)
    cut[1:] = kind[1:] != kind[:-1]
    cut[offsets[1:-1][offsets[1:-1] < len(raw)]] = True
    cuts = np.append(np.flatnonzero(cut), len(raw))
    solid = kind[cuts[:-1]] > 0
    starts, ends = cuts[:-1][solid], cuts[1:][solid]
    tokens = K.stretch_hashes(raw, starts, ends)
    rows = np.searchsorted(starts, offsets)
    pairs = K.mixed(K.mixed(tokens[:-1], 1) * np.uint64(3) + tokens[1:])
    pairs[tokens[:-1] == tokens[1:]] = np.uint64(_ROW)
    # Row by row: its tokens, then its pairs.
    sizes = np.diff(rows)
    pair_sizes = np.maximum(sizes - 1, 0)
    bounds = np.append(0, np.cumsum(sizes + pair_sizes))
    out = np.empty(bounds[-1], np.uint64)
    out[K.ranges(bounds[:-1], sizes)] = tokens
    out[K.ranges(bounds[:-1] + sizes, pair_sizes)] = pairs[K.ranges(rows[:-1], pair_sizes)]
    return (out >> np.uint64(64 - bits)).astype(np.int64), bounds


def _counted(bits: int):
    """One row per partition: n-gram counts of all rows and of the target rows (rows: text, target)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = (np.zeros(1 << bits, np.int64) for _ in range(2))
        for piece in (p for b in batches for p in K.slices(b, "text")):
            buckets, bounds = ngram_buckets(piece, bits)
            raw += np.bincount(buckets, minlength=len(raw))
            chosen = np.repeat(piece.column("target").to_numpy(zero_copy_only=False), np.diff(bounds))
            target += np.bincount(buckets[chosen], minlength=len(raw))
        yield pa.record_batch({"raw": pa.array([raw.tobytes()], pa.binary()), "target": pa.array([target.tobytes()], pa.binary())})

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray | int] = {"raw": 0, "target": 0}
    for batch in batches:
        for name in total:
            for value in batch.column(name):
                total[name] = total[name] + np.frombuffer(value.as_py(), np.int64)
    if not isinstance(total["raw"], int):
        yield pa.record_batch({n: pa.array([v.tobytes()], pa.binary()) for n, v in total.items()})


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's distinct n-grams (rows: text, toxic)."""
    for piece in (p for b in batches for p in K.slices(b, "text")):
        ngrams, bounds = ngram_buckets(piece, 64)
        toxic = piece.column("toxic").to_numpy(zero_copy_only=False)
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
            once = np.unique(ngrams[a:b])
            yield pa.record_batch({"ngram": once, "toxic": pa.array(np.full(len(once), toxic[i], np.int64))})


def toxic_odds(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """N-grams, sorted, that are in a larger share of the toxic than of the clean rows, and their log odds (rows: text, toxic; labelled ones)."""
    counts = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not counts.get(0) or not counts.get(1):
        return np.zeros(0, np.int64), np.zeros(0)
    held = rows.mapInArrow(_distinct, "ngram long, toxic long").groupBy("ngram").agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n"))
    odds = lambda have, of: F.log((have + 0.5) / (of - have + 0.5))
    # Bounded by the n-grams of ``labelled`` rows.
    held = held.where(F.col("toxic") >= TOXIC_ROWS).select("ngram", (odds(F.col("toxic"), counts[1]) - odds(F.col("n") - F.col("toxic"), counts[0])).alias("odds"))
    found = held.where("odds > 0").orderBy("ngram").toArrow()
    return found.column("ngram").to_numpy(), found.column("odds").to_numpy()


def _weighed(shared, bits: int):
    """``shared``: broadcast log ratios by bucket, n-grams of toxic rows and their odds. Adds log_weight and toxicity to the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio, ngrams, odds = shared.value
        maybe = np.zeros(1 << 20, bool)
        maybe[(ngrams.view(np.uint64) >> np.uint64(44)).astype(np.int64)] = True
        for piece in (p for b in batches for p in K.slices(b, "text")):
            hashes, bounds = ngram_buckets(piece, 64)
            hashes = hashes.view(np.uint64)
            sums = np.append(0.0, np.cumsum(ratio[(hashes >> np.uint64(64 - bits)).astype(np.int64)]))
            toxicity = np.zeros(len(piece))
            if len(ngrams):
                places = np.flatnonzero(maybe[(hashes >> np.uint64(44)).astype(np.int64)])
                some = hashes[places].view(np.int64)
                at = np.minimum(np.searchsorted(ngrams, some), len(ngrams) - 1)
                same = ngrams[at] == some
                np.maximum.at(toxicity, np.searchsorted(bounds, places[same], "right") - 1, odds[at[same]])
            yield pa.record_batch({"key": piece.column("key"), "doc_id": piece.column("doc_id"), "log_weight": sums[bounds[1:]] - sums[bounds[:-1]], "toxicity": toxicity})

    return run


def _threshold(good: np.ndarray, bad: np.ndarray) -> float:
    """The lowest weight among those that tell the two sides best apart."""
    if not len(good) or not len(bad):
        return -np.inf
    tries = np.unique(np.concatenate([good, bad]))
    kept = 1 - np.searchsorted(np.sort(good), tries) / len(good)
    gone = np.searchsorted(np.sort(bad), tries) / len(bad)
    return float(tries[np.flatnonzero(kept + gone >= (kept + gone).max() - 0.002)[0]])


def _kth_largest(keys: DataFrame, k: int) -> float:
    """The k-th largest key: the range that holds it is cut into 4,096 parts until it is one value."""
    low, high = keys.agg(F.min("key_value"), F.max("key_value")).first()
    above = 0
    while low < high:
        step = (high - low) / 4096
        part = F.least(F.floor((F.col("key_value") - low) / step), F.lit(4095)) if step > 0 else F.lit(0)
        inside = keys.where(F.col("key_value").between(low, high)).groupBy(part.alias("part"))
        parts = inside.agg(F.count(F.lit(1)).alias("n"), F.min("key_value").alias("low"), F.max("key_value").alias("high")).orderBy(F.desc("part")).collect()
        for p in parts:
            if above + p["n"] >= k:
                low, high = p["low"], p["high"]
                break
            above += p["n"]
        if len(parts) == 1:  # neighbouring doubles
            return low
    return low


def gumbel_top_k(weighed: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """The rows with the k largest log_weight + Gumbel noise (rows: key, log_weight, ...); ties at the last key stay."""
    uniform = (F.shiftrightunsigned(F.xxhash64("key", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    keys = settled(weighed.withColumn("key_value", F.col("log_weight") - F.log(-F.log(uniform))), "op10-keys")
    if k <= 0:
        return keys.where("false")
    if k >= keys.count():
        return keys
    return keys.where(F.col("key_value") >= _kth_largest(keys, k))


def log_weights(docs: DataFrame, labels: DataFrame, bits: int = BUCKET_BITS, labelled: int = LABELLED) -> tuple[DataFrame, float]:
    """(key, doc_id, log_weight) per row that is not toxic, and the threshold on log_weight."""
    spark = docs.sparkSession
    sample = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    # Half of the labelled rows make the target model, the others the threshold.
    sample = settled(sample.select("doc_id", "quality", "toxic", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 0).alias("fits")), "op10-labelled")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    # Bounded by ``labelled`` rows of four small numbers.
    marked = rows.join(F.broadcast(sample), "doc_id", "left")
    target = F.coalesce(F.col("fits") & (F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))
    parts = marked.select("text", target.alias("target")).mapInArrow(_counted(bits), "raw binary, target binary")
    sums = parts.repartition(_SUMMERS).mapInArrow(_added, "raw binary, target binary").toArrow()
    raw, aim = (np.sum([np.frombuffer(x.as_py(), np.int64) for x in sums.column(c)], axis=0) if len(sums) else np.zeros(1 << bits) for c in ("raw", "target"))
    # Few labelled rows cannot fill many buckets: neighbours are joined until the target has some 16 n-grams per bucket.
    bits = min(bits, max(10, int(aim.sum() // 16).bit_length() - 1))
    raw, aim = (counts.reshape(1 << bits, -1).sum(axis=1) for counts in (raw, aim))
    # Add-one smoothing; without any target row the models are equal.
    share = lambda counts: (counts + 1.0) / (counts.sum() + len(counts))
    ratio = np.log(share(aim) / share(raw)) if aim.sum() else np.zeros(1 << bits)
    fitted = rows.join(F.broadcast(sample.where("fits")), "doc_id").select("text", (F.col("toxic") > 0).cast("long").alias("toxic"))
    spread = spark.sparkContext.broadcast((ratio, *toxic_odds(fitted)))
    weighed = settled(rows.mapInArrow(_weighed(spread, bits), "key long, doc_id long, log_weight double, toxicity double"), "op10-weights")
    seen = weighed.join(F.broadcast(sample.where("not fits")), "doc_id").groupBy("doc_id").agg(
        F.min("log_weight").alias("w"), F.max("toxicity").alias("t"), F.max("quality").alias("q"), F.max("toxic").alias("toxic"))
    seen = seen.toArrow()
    weights, toxicity, toxic = seen.column("w").to_numpy(), seen.column("t").to_numpy(), seen.column("toxic").to_numpy() > 0
    least = _threshold(-toxicity[~toxic], -toxicity[toxic])
    passed, good = -toxicity >= least, (seen.column("q").to_numpy() == 1) & ~toxic
    weighed = weighed.where(-F.col("toxicity") >= least).drop("toxicity")
    return weighed, _threshold(weights[passed & good], weights[passed & ~good])


def resampled(docs: DataFrame, labels: DataFrame, bits: int = BUCKET_BITS, labelled: int = LABELLED, seed: int = 0) -> DataFrame:
    """The rows that importance resampling keeps: key, doc_id, log_weight, key_value."""
    weighed, threshold = log_weights(docs, labels, bits, labelled)
    k = weighed.where(F.col("log_weight") >= threshold).count()
    return gumbel_top_k(weighed, k, seed)


def quality_filter(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    return with_keys(docs, resampled(docs, labels, **options), "left_semi").select(*docs.columns)
