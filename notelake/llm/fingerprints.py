"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A document is a bag of words weighted by their counts. For each of ``samples`` hash seeds every word
w draws, from hashes of the word alone, r and c from Gamma(2, 1) and b from the uniform distribution.
With t = floor(ln(weight) / r + b) the word's value is ln c - r * (t - b + 1), and the smallest value
of a document is its sample. Two documents agree in a sample with the probability of their
generalised Jaccard similarity, the sum of the smaller weights over the sum of the larger ones.
Values are continuous, so the smallest value itself tells the word and its t.

Logarithms are what a value costs. c * exp(-r * (t - b + 1)) of a word of weight n is exponentially distributed
with rate n, so the smallest of a document of N words is over ``REACH`` / N with probability exp(-``REACH``).
A bound from below, without logarithms, tells most words that cannot get there; their values are not made.
A document whose smallest value does lie beyond that is sampled again from all its words, so nothing rests on chance.

Documents in descending doc_id order are edited with their successor's beginning. Order comes from
windows over blocks of ``BLOCK`` ids; a block's last document takes its successor from the next
block's head, and only heads, one per block, are ever ordered as a whole. Everything from there to the
samples stays in one stage, since all groupings keep the block.

Defined results: null text counts as empty; texts without words have one common fingerprint; rows
without doc_id come first in descending order; rows of equal doc_id are ordered by a hash of the
text, repeated rows stay; a single row is its own successor; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import given_id, keyed, settled

SAMPLES = 64
BLOCK = 1024
REACH = 24.0


def _uniform(h: Column, first: int, bits: int) -> Column:
    """A number between 0 and 1 from some bits of a hash."""
    part = F.shiftrightunsigned(h, first) if first else h
    if first + bits < 64:
        part = part.bitwiseAND(F.lit((1 << bits) - 1))
    return (part + 0.5) * (0.5**bits)


def _value(word: Column, log_weight: Column, seed: int, limit: Column | None = None) -> Column:
    """The word's value; null for some words whose value lies over ln ``limit``."""
    rough, fine = F.xxhash64(word, F.lit(2 * seed)), F.xxhash64(word, F.lit(2 * seed + 1))
    b, q = _uniform(rough, 0, 21), _uniform(rough, 21, 21) * _uniform(rough, 42, 22)
    p = _uniform(fine, 0, 32) * _uniform(fine, 32, 32)
    r, log_c = -F.ln(q), F.ln(-F.ln(p))
    # A word that occurs once has t = floor(b) = 0.
    steps = F.when(log_weight == 0.0, 1.0 - b).otherwise(F.floor(log_weight / r + b) - b + 1)
    value = log_c - r * steps
    if limit is None:
        return value
    # -ln p >= 2 (1 - p) / (1 + p); q^(1 - b) >= q / (1 - b + b q); and r * steps <= r + log_weight in any case.
    below = F.when(log_weight == 0.0, 1.0 - b + b * q).otherwise(F.exp(log_weight))
    return F.when(2.0 * (1.0 - p) * q <= limit * (1.0 + p) * below, value)


def _with_successor(docs: DataFrame, block: int) -> DataFrame:
    """block, nth (in the block), id, key, text, and next_key and next_text of the next row in descending order."""
    rows = keyed(docs).withColumn("block", F.floor(F.col("id") / block))
    inside = Window.partitionBy("block").orderBy(F.desc("id"), F.desc("key"))
    placed = rows.withColumns({"nth": F.row_number().over(inside), "next_key": F.lead("key").over(inside), "next_text": F.lead("text").over(inside)})
    heads = rows.groupBy("block").agg(F.max(F.struct("id", "key", "text")).alias("head"))
    heads = settled(heads.select("block", F.col("head.key").alias("head_key"), F.col("head.text").alias("head_text")), "op5-heads")
    # One row per block, without text.
    downward = Window.orderBy(F.desc("block"))
    order = heads.select("block").select("block", F.coalesce(F.lead("block").over(downward), F.first("block").over(downward)).alias("below"))
    below = heads.withColumnRenamed("block", "below").join(order, "below").drop("below")
    return placed.join(below, "block").select(
        "block", "nth", "id", "key", "text",
        F.coalesce("next_key", "head_key").alias("next_key"), F.coalesce("next_text", "head_text").alias("next_text"))


def _word_counts(text: Column) -> tuple[Column, Column]:
    """Hashes of all words, ascending; and, over them, (place of a word's first, its count) for each distinct word."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashes = F.sort_array(F.transform(words, lambda w: F.xxhash64(w)))
    h = F.col("hashes")
    firsts = F.filter(F.transform(h, lambda x, i: F.when((i == 0) | (x != F.get(h, i - 1)), i)), lambda i: i.isNotNull())
    return hashes, firsts


def _edited(docs: DataFrame, block: int) -> DataFrame:
    """block, nth, id, key, next_key, n_chars, text, edited (the edited text) of each row."""
    rows = _with_successor(docs, block)
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    return rows.select("block", "nth", "id", "key", "next_key", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))


def _sampled(rows: DataFrame, samples: int, reach: float | None) -> DataFrame:
    """id, key, next_key, n_chars, edited_sha256, own and changed (the samples' codes of both texts), and sure: no smaller
    value was left out. reach: null for all values."""
    rows = rows.select(*[c for c in rows.columns if c not in ("text", "edited")], F.sha2("edited", 256).alias("edited_sha256"),
                       F.explode(F.array(F.struct(F.lit(0).alias("side"), "text"), F.struct(F.lit(1).alias("side"), F.col("edited").alias("text")))).alias("view"))
    keep = ["block", "nth", "id", "key", "next_key", "n_chars", "edited_sha256", "side"]
    hashes, firsts = _word_counts(F.col("text"))
    rows = rows.select(*keep[:-1], "view.side", F.col("view.text").alias("text")).select(*keep, hashes.alias("hashes"))
    rows = rows.select(*keep, "hashes", firsts.alias("firsts"))
    rows = rows.select(*keep, "hashes", "firsts", F.posexplode_outer("firsts").alias("at", "first"))
    count = F.coalesce(F.get("firsts", F.col("at") + 1), F.size("hashes")) - F.col("first")
    limit = F.lit(reach) / F.greatest(F.size("hashes"), F.lit(1))
    rows = rows.select(*keep, F.get("hashes", F.col("first")).alias("word"), F.ln(count.cast("double")).alias("log_weight"), limit.alias("limit"))
    within = None if reach is None else F.col("limit")
    values = [F.min(_value(F.col("word"), F.col("log_weight"), k, within)).alias(f"v{k}") for k in range(samples)]
    drawn = rows.groupBy(*keep).agg(*values, F.max("limit").alias("limit"), F.count("word").alias("n_words"))
    sure = F.lit(True)
    if reach is not None:
        # What was left out lies over ln limit; the margin is for the rounding of either.
        most = F.greatest(*[F.coalesce(f"v{k}", F.lit(float("inf"))) for k in range(samples)], F.lit(float("-inf")))
        sure = (F.col("n_words") == 0) | (most < F.ln("limit") - 1e-9)
    # A sample's code; without words there is no value, and no word's code is likely to be that of none.
    codes = F.array(*[F.xxhash64(f"v{k}").bitwiseAND(F.lit(0xFFFFFFFF)) for k in range(samples)])
    sides = drawn.select(*keep, codes.alias("codes"), sure.alias("sure")).groupBy(*keep[:-1]).agg(
        *[F.max(F.when(F.col("side") == i, F.col("codes"))).alias(name) for i, name in enumerate(("own", "changed"))], F.min("sure").alias("sure"))
    return sides.drop("block", "nth")


def fingerprints(docs: DataFrame, samples: int = SAMPLES, block: int = BLOCK, reach: float = REACH) -> DataFrame:
    """Per row: doc_id, n_chars, edited_text_sha256, fingerprint, edited_fingerprint (one hexadecimal number per sample), and
    near_edited and near_next, the shares of equal samples with the edited text and with the next document."""
    rows = _edited(docs, block)
    sides = settled(_sampled(rows, samples, reach), "op5-samples")
    unsure = sides.where("not sure").select("key").distinct()
    if not unsure.isEmpty():
        again = settled(_sampled(rows.join(unsure, "key", "left_semi"), samples, None), "op5-again")
        sides = sides.join(unsure, "key", "left_anti").unionByName(again)
    sides = sides.drop("sure")
    others = sides.groupBy("key").agg(F.max("own").alias("other")).withColumnRenamed("key", "next_key")
    both = sides.join(settled(others, "op5-others"), "next_key")
    text_of = lambda c: F.array_join(F.transform(c, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")
    near = lambda a, b: F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / float(samples)
    return both.select(given_id(), "n_chars", "edited_sha256", text_of("own").alias("fingerprint"), text_of("changed").alias("edited_fingerprint"),
                       near("own", "changed").alias("near_edited"), near("own", "other").alias("near_next"))
