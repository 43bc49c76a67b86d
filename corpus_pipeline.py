"""Corpus pipeline: the stages that turn raw documents into a training mix, each a call of one operator.

A stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and reread as the next stage's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starslice.llm import decontaminate, line_dedup, mixing, ngram_jaccard, quality_classifier
from starslice.llm.common import Scratch


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    model = quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.classify(docs, model, only_kept=True).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks of lines that an earlier one has; those that lose all their words go."""
    made = line_dedup.dedup_lines(docs).filter("n_removed_words < n_words OR n_words = 0")
    length = F.when(F.col("n_removed_words") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return made.withColumn("n_chars", length).select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of five words, similarity 0.8 or more."""
    return ngram_jaccard.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix: documents in training order, with epoch, words taken and position."""
    return mixing.training_order(docs)


STAGES = [
    ("quality classifier", classify_quality), ("line dedup", dedup_lines), ("n-gram Jaccard join", dedup_near),
    ("benchmark decontamination", drop_benchmark), ("mixing sources to target weights", mix_sources),
]
ORACLE_SQL = None  # a trained scorer is no SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch, docs, before = Scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return made
        docs = scratch.put(name.replace(" ", "_"), made)
        if before:
            scratch.drop(before)
        before = name.replace(" ", "_")
    return docs
