"""Corpus pipeline over ``documents``: STAGES, in order, each a function of
``(spark, docs, sf_dir)`` whose result is written and read again as the next
stage's documents.  Each works on all rows its predecessor kept; all but the last
return the columns of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieve.llm import decontaminate, lines, mixing, quality, simhash
from sieve.llm.common import bounded_batches
from sieve.session import materialize


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior of being good is 0.5 or more stay; the classifier is
    trained on at most 20,000 labelled documents of ``docs``.  Empty texts go, unless
    their source outweighs that."""
    bounded_batches(spark)
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 code points or more that 3 documents or more hold stay only in the
    one with the largest id.  All documents stay, with the lines left to them and
    ``n_chars`` counted anew; a null text becomes empty."""
    bounded_batches(spark)
    kept = lines.drop_repeated_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else kept


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays (3-word shingles, 3 bits): that
    with the smallest id.  Rows without an id stay."""
    bounded_batches(spark)
    return simhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a 10-word window of the benchmark go."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of half of all tokens (expected) whose shares by source, language and topic
    are those of ``docs`` tempered by 0.7, as far as tokens without repetition can meet
    them, with each document's weight and chance."""
    dims = {"source": F.col("source"), "lang": F.col("lang"), "topic": mixing.topic_column(F.col("text"))}
    mixed = mixing.mix(docs, dims, alpha=0.7, share=0.5, out=("mix_weight", "mix_probability", "mix_sampled"))
    return mixed.where("mix_sampled").drop("mix_sampled")


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_dedup),
    ("benchmark decontamination", decontamination),
    ("source mixing", source_mixing),
]

#: a trained classifier, XXH64 over shingles and iterated raking are beyond SQL: the
#: stages are tested against brute force instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; every stage's rows are written to
    the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
