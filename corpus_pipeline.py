"""Corpus pipeline: quality, near-duplicates, long repeats, benchmark passages, source mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import decontaminate, mixing, quality, shingle_dedup, suffix_dedup
from recollect.llm._runtime import materialize, release, scratch


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects rows whose whole text scores below 0.3; learnt from the labels of the stage's own documents.

    Null and empty texts score as an empty text does, repeated rows alike; an empty table gives an empty table. Columns
    of any name are kept. Without labels of both kinds every row has the same score.
    """
    return quality.keep(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), 0.3)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by 5-word shingle similarity 0.8, the one with the smallest doc_id.

    The SimHash trees give first links, which are verified on whole shingle sets; a prefix filter finds the pairs whose
    fingerprints differ in more bits. Null, empty and word-less texts are alike; rows of one doc_id stand and fall
    together, rows without doc_id stay. An empty table gives an empty table. Columns of any name are kept.
    """
    return shingle_dedup.drop_near_duplicates(docs, threshold=0.8, shingle=5)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out bytes of 50-byte strings that a smaller document has; rows that lose their last word go.

    Rows of one doc_id do not cut each other and keep their own text; rows without doc_id, null and empty texts stay as
    they are. An empty table gives an empty table. Columns of any name are kept; n_chars is that of the new text.
    """
    cut = suffix_dedup.drop_repeats(docs, 50)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects rows into whose text a benchmark item leaks; repeated rows alike, null and empty texts stay.

    No items reject nothing; an empty table gives an empty table. Columns of any name are kept.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row per repetition taken, numbered by `repetition`; the one at a source's cut has its first words.

    Rows without words are not taken; null sources are one source; repeated rows are taken each by itself. An empty
    table gives an empty table. Columns of any name are kept, but an input `repetition` gives way.
    """
    return mixing.repetitions(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
]

# SQL cannot train the classifier or tile passages; tests/llm hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again, so a lost executor costs one stage."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch(spark) as made:
            docs, path = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
            made.keep(path)
        if before:
            release(spark, before)
        before = path
    return docs
