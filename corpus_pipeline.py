"""From documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor kept and returns a
DataFrame; all but the last return the columns of ``documents``. What they decide, SQL cannot express
(a fitted classifier, a piece lattice), so there is no SQL for the whole. The operators are tested one by one, the
stages on planted documents (``tests/llm/test_pipeline.py``).

Null and empty texts, repeated rows, missing doc_ids and further columns go through all stages as each operator's
docstring says; an empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm.decontamination import decontaminated
from notelake.llm.ngram_join import without_near_duplicates
from notelake.llm.piece_lattice import nbest_encode
from notelake.llm.quality import quality_filter
from notelake.llm.scratch import settled
from notelake.llm.suffix_dedup import without_repeated_strings

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays."""
    return without_near_duplicates(docs)


def repeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that also start earlier go from the texts; n_chars follows."""
    cut = without_repeated_strings(docs, length=100)
    return cut.withColumn("n_chars", F.length("text").cast("long"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The two best segmentations of each document."""
    return nbest_encode(docs, public_tokenizers.path("piece_bpe_32k.model"), n=2)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_text", repeated_text),
    ("decontamination", decontamination),
    ("pieces", pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
