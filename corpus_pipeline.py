"""Documents to a training mix: the stages, and the run that chains them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelflight.llm import decontaminate, line_dedup, mixing, ngram_join, toxicity
from shelflight.llm.common import table, unwrapped
from shelflight.session import scratch_path, tune


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; the examples are labelled rows among ``docs``."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go from all of them; every document stays."""
    return unwrapped(line_dedup.drop_common_lines(docs), docs.columns)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar texts stays, the one with the smallest id."""
    return ngram_join.one_per_class(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out of the texts; every document stays."""
    return unwrapped(decontaminate.without_benchmark(docs, table(spark, sf_dir, "benchmark")), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: a row per document with the number of its copies, 1 or more."""
    return mixing.mix(docs).filter(F.col("copies") > 0)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("ngram_join", join_near_copies),
    ("decontamination", cut_benchmark),
    ("mixing", mix_sources),
]

# The stages score, index and draw; SQL cannot express that.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again by the next."""
    tune(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
