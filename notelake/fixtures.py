"""Entry tables, query batches and note files that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-03-31"
EVENTS_AS_OF = "2024-01-30"
_NO_TAGS = "cast(array() as array<string>)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_as_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1: one entry per document, half of them with a vector, tags from the labels."""
    docs, vecs = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    labels = table(spark, sf_dir, "labels")
    tags = F.expr(
        f"""case when l_id is null then {_NO_TAGS}
             when toxic = 1 and quality = 1 then array('quality', 'toxic')
             when toxic = 1 then array('toxic') when quality = 1 then array('quality')
             else array('plain') end"""
    )
    return (
        docs.join(vecs.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
        .join(labels.withColumn("l_id", F.col("doc_id")), "doc_id", "left")
        .select(
            F.col("doc_id").alias("id"), F.col("lang").alias("role"), F.col("source").alias("category"), "text",
            "embedding", tags.alias("tags"),
            F.expr("cast(date_add(date '2024-01-01', cast(doc_id % 90 as int)) as string)").alias("created_at"),
        )
    )


def documents_as_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E2: the same documents under one role, category = language."""
    return documents_as_entries(spark, sf_dir).drop("category").select(
        "id", F.lit("corpus").alias("role"), F.col("role").alias("category"), "text", "embedding", "tags", "created_at"
    )


def vector_copies_of(vectors: DataFrame) -> DataFrame:
    """E3: every vector and four copies of it with more and more leading dimensions zeroed.

    ``copy_no`` 0 is the vector itself; copy 1 also has its text in capitals with a line end.
    """
    name = "concat('vector item number ', lpad(cast(vec_id as string), 5, '0'))"
    return vectors.select("*", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("copy_no")).select(
        F.expr("vec_id * 5 + copy_no").alias("id"), F.lit("vec").alias("role"),
        F.expr("concat('c', label)").alias("category"),
        F.expr(f"case when copy_no = 1 then concat(upper({name}), chr(10)) else {name} end").alias("text"),
        F.expr("transform(embedding, (x, i) -> if(i < 4 * copy_no, cast(0 as float), x))").alias("embedding"),
        F.expr(_NO_TAGS).alias("tags"), F.lit(AS_OF).alias("created_at"), "vec_id", "copy_no",
    )


def vector_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_copies_of(table(spark, sf_dir, "embeddings"))


def mixed_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E3M: E3 where the last copy of every seventh vector has none."""
    lost = F.expr("copy_no = 4 and vec_id % 7 = 0")
    return vector_copies(spark, sf_dir).withColumn("embedding", F.when(~lost, F.col("embedding")))


def query_batch(spark: SparkSession, sf_dir: str, limit: int | None = 3) -> DataFrame:
    """Q: one query per vector: a matching vector, an opposite one, or none."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.lit("vec").alias("role"), F.expr("concat('c', label)").alias("category"),
        F.expr("concat('unrelated ', lpad(cast(vec_id as string), 5, '0'))").alias("query"),
        F.expr(
            """case when vec_id % 3 = 0 then embedding
                    when vec_id % 3 = 1 then transform(embedding, x -> -x) end"""
        ).alias("embedding"),
        F.lit(limit).cast("int").alias("lim"),
    )


def events_as_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5: one entry per event."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("role"),
        F.expr("concat('u', user_id % 10)").alias("category"), F.col("props").alias("text"),
        F.expr("cast(null as array<float>)").alias("embedding"), F.expr(_NO_TAGS).alias("tags"),
        F.expr("cast(cast(ts as date) as string)").alias("created_at"),
    )


def note_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E4: lines of one note file per (language, source), one session entry per document."""
    docs = table(spark, sf_dir, "documents").select(
        F.expr("concat(lang, '/', source, '.md')").alias("path"), "doc_id"
    )
    files = docs.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    fixed = files.select(
        "path",
        F.inline(
            F.expr(
                """array(named_struct('part', 0, 'seq', 0L, 'line', concat('# ', path)),
                         named_struct('part', 1, 'seq', 0L, 'line', ''),
                         named_struct('part', 2, 'seq', 0L, 'line', '## Learnings'),
                         named_struct('part', 3, 'seq', 1L, 'line', '- [2024-01-01] learning'),
                         named_struct('part', 3, 'seq', 2L, 'line', '- [2024-01-02] learning'),
                         named_struct('part', 4, 'seq', 0L, 'line', '## Session Log'),
                         named_struct('part', 6, 'seq', 0L, 'line', ''),
                         named_struct('part', 7, 'seq', 0L, 'line', '## Notes'))"""
            )
        ),
    )
    sessions = docs.select(
        "path", F.lit(5).alias("part"), (-F.col("doc_id")).alias("seq"),
        F.expr("concat('- [2024-02-01] doc ', doc_id)").alias("line"),
    )
    notes = files.select("path", F.lit(8).alias("part"), F.explode(F.expr("sequence(0L, 2 * n - 1)")).alias("seq"))
    notes = notes.withColumn("line", F.expr("concat('- [x] note ', seq)"))
    lines = fixed.unionByName(sessions).unionByName(notes)
    # Any increasing number will do for the line order, so no file has to be numbered in one task.
    return lines.selectExpr("path", "part * 1000000000000 + 500000000000 + seq as line_no", "line")
