"""The registered queries of this subpackage and the SQL each is checked against, where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import oracles
from .chat_perspectives import rotated
from .decontamination import leaks
from .edited_counts import edited_token_counts
from .fingerprints import fingerprints
from .ngram_join import ngram_components
from .piece_lattice import nbest_encode
from .merkle import manifest, proofs, tampered_text
from .packing import packed
from .quality import resampled
from .spelling import spelling_groups, word_counts
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .token_files import read_token_files, write_token_files

# On every machine of the cluster at the same place.
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup(_table(spark, sf_dir, "documents"), window=50)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = ngram_components(_table(spark, sf_dir, "documents"), words=5, percent=75)
    return joined.select("doc_id", "n_shingles", "component_id")


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup(_table(spark, sf_dir, "documents"), length=100)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return kept.select("doc_id", F.round("log_weight", 6).alias("log_weight"), F.round("key_value", 6).alias("sampling_key"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", *[F.round(c, 4).alias(c) for c in ("lcs_share", "answer_share", "cosine")])


def op2_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "op2-tokens")
    write_token_files(_table(spark, sf_dir, "documents"), root, BYTE_BPE, end_id=0)
    return read_token_files(spark, root, digest=True)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with three edits: its source put in front, 64 code points in its middle replaced by its language, its last 32 deleted."""
    docs = _table(spark, sf_dir, "documents")
    n = F.length(F.coalesce("text", F.lit("")))
    middle = F.floor(n / 2).cast("int")
    edits = [
        (F.lit(0), F.lit(0), F.concat(F.coalesce("source", F.lit("")), F.lit(" "))),
        (middle, F.least(F.lit(64), F.greatest(n - 32 - middle, F.lit(0))), F.coalesce("lang", F.lit(""))),
        (F.greatest(n - 32, middle), F.lit(32), F.lit("")),
    ]
    column = F.array(*[F.struct(a.alias("start"), b.alias("length"), c.alias("replacement")) for a, b, c in edits])
    return edited_token_counts(docs.select("doc_id", "text", column.alias("edits")), BYTE_BPE)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbest_encode(_table(spark, sf_dir, "documents"), PIECES, n=3, digest=True)


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotated(_table(spark, sf_dir, "conversations"))


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(_table(spark, sf_dir, "documents"))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_table(spark, sf_dir, "documents"), WORD_BPE, end_id=1, words=True)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(word_counts(_table(spark, sf_dir, "documents"), noise_every=31))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's proof, and what verification gives after line feeds are deleted from half of the texts."""
    return proofs(manifest(_table(spark, sf_dir, "documents"), presented=tampered_text()))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_token_id_output": op2_token_id_output,
    "op3_token_counts": op3_token_counts,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op5_document_fingerprints": op5_document_fingerprints,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_best_fit_packing": op11_best_fit_packing,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_merkle_manifest": op13_merkle_manifest,
}
ORACLES: dict[str, str] = {
    "op1_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op4_ngram_jaccard_join": oracles.NGRAM_JACCARD_JOIN,
    "op7_chat_formatting": oracles.CHAT_FORMATTING,
    "op9_suffix_array_dedup": oracles.SUFFIX_ARRAY_DEDUP,
    "op12_spelling_variants": oracles.SPELLING_GROUPS,
    "op13_merkle_manifest": oracles.MERKLE_MANIFEST,
}
