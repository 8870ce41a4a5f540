"""Documents to a training corpus: stages that each write their result before the next one reads it.

A stage takes what its predecessor kept and returns documents with all their columns; the last one returns
the plan of the shards. Each works on its own input: models, counts and groups are those of the documents
that reach it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mendery.llm.decontamination import without_leaks
from mendery.llm.mixing import PRODUCTION, calibrate, sample
from mendery.llm.near_duplicates import PIPELINE, without_near_duplicates
from mendery.llm.quality import fit, keep_good
from mendery.llm.sharding import shard_documents, topology
from mendery.session import settle_table

SHARDS = 8
KEEP_TOKENS = 0.8  # of the tokens that reach the mixture


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the line field accept."""
    return keep_good(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: shingles of five words, similarity of 0.8 or more."""
    return without_near_duplicates(docs, PIPELINE)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark, verbatim or with other values."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens meet the targets for source, language and topic."""
    return sample(docs, calibrate(docs, PRODUCTION._replace(keep=KEEP_TOKENS)))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the shards of a hash tree, with the shard that one more would give."""
    return shard_documents(docs, topology(SHARDS), topology(SHARDS, added=1))


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: No statement: most stages are beyond SQL; tests hold them against plain versions.
ORACLE_SQL = None
