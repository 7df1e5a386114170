"""The corpus pipeline: five stages, each written as Parquet and reread by the next.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of documents.  The tables live in the shared folder, so no stage
recomputes another and lost executors cost only their tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import mixing, ngram_join, packing, pii, quality_rules
from lodestone.runtime import saved


#: A line of more distinct documents of a host goes, however large the host is.
MAX_DOCS = 100


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without lines that are frequent on their host."""
    return quality_rules.clean(docs, max_docs=MAX_DOCS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return ngram_join.deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by pseudonyms."""
    return pii.replace_pii(docs, pii.session_key(spark), spans_as=None)


def weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights ask."""
    return mixing.resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed training sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("ngram_join", near_duplicates),
    ("pii", personal_data),
    ("mixing", weights),
    ("packing", sequences),
]

#: Minima over hashes, keyed permutations and trained weights are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
