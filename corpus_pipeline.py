"""The corpus pipeline: raw documents to the pieces of clean, distinct, uncontaminated ones.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each
as Parquet to the shared folder and reads it again, so a lost executor costs a
stage's missing tasks at most. All stages but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadmill.llm import decontaminate, lines, pieces, quality, similar
from leadmill.llm.common import discard, materialise, table

#: Most rows and bytes of whole texts that Spark hands to Python, and gets from it, at once. A batch stands in the executor's
#: native memory and in its worker's, and neither gives it back; Spark's own 10,000 rows are 20 MB and more of texts.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def in_small_batches(spark: SparkSession) -> None:
    """From now on the session's batches are of BATCH; a stage's result is worked out after it returns, so it stays so."""
    for key, most in BATCH.items():
        spark.conf.set(key, most)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules reject go."""
    in_small_batches(spark)
    judged = quality.judge(docs.select(F.struct("*").alias("row"), F.col("text").alias("text")), keep_text=False)
    return judged.where("kept").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go; n_chars follows the text. Every document stays."""
    cut = lines.drop_recurring(docs.select("doc_id", "text", F.struct(*[c for c in docs.columns if c != "text"]).alias("row")))
    own = lambda c: F.col("text") if c == "text" else F.length("text").cast(docs.schema["n_chars"].dataType) if c == "n_chars" else F.col(f"row.{c}")
    return cut.select(*[own(c).alias(c) for c in docs.columns])


def simhash_neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity of 0.8 at least) one
    document stays, that of least doc_id. A document without an id stays only where its group has none."""
    in_small_batches(spark)
    return similar.representatives(docs, shingle=5, similarity=0.8)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a leaked benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece_ids, n_pieces and whether the pieces decode to the text."""
    in_small_batches(spark)
    return pieces.encode(docs.select("doc_id", "text"), check=True).drop("text")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_neardup", simhash_neardup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece),
]

#: Expectation maximisation, components and pieces can't be put in SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = table(spark, sf_dir, "documents"), None
    before = {key: spark.conf.get(key) for key in BATCH}
    try:
        for name, stage in STAGES:
            docs = materialise(stage(spark, docs, sf_dir), name)
            if written:
                discard(spark, written)
            written = docs
    finally:
        for key, most in before.items():
            spark.conf.set(key, most)
    return docs
