"""A cleaning pipeline over ``documents``, made of the operators in ``starfold.llm``.

Each stage reads all that the one before kept, and is judged on that alone. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# SQL cannot express the stages; the tests compare them with brute force.
ORACLE_SQL = None
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier finds good. It learns from ``labels`` of the documents at hand."""
    from starfold.llm import quality

    views = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, views, keep=COLUMNS[1:]).filter("good = 1").select(*COLUMNS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id."""
    from starfold.llm.neardup import first_of_each

    return first_of_each(docs).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, passages that other documents have too cut out of all but one."""
    from starfold.llm.substring import without_repeats

    cut = without_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))
    return cut.select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``."""
    from starfold.llm.decontam import without_leaks

    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and digests of each document's ids, and of the bytes that they decode to."""
    from starfold.llm.queries import encoded_and_decoded

    return encoded_and_decoded(docs)


STAGES = [("quality_classifier", classify_quality), ("near_dedup", deduplicate), ("substring_dedup", cut_repeats),
          ("decontamination", decontaminate), ("byte_bpe", tokenize)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each over what the one before kept, written as Parquet and read again in between."""
    from starfold.llm.scratch import Scratch

    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
