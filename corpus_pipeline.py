"""A corpus pipeline: five stages over ``documents``, each written as Parquet and read
again before the next.  A stage takes all rows that its predecessor kept; all but the last
return the columns of ``documents``.

Cases: a stage treats null, empty, long, repeated and additional data as its operator
states; a table that a stage leaves empty goes on as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from churnlens.llm.common import documents, scratch_path
from churnlens.llm.decontaminate import decontaminate
from churnlens.llm.mixing import mixed_texts
from churnlens.llm.quality_rules import quality_rules
from churnlens.llm.simhash_dedup import one_of_each_group
from churnlens.llm.token_files import token_digests


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no rule, of hosts that are not rejected."""
    return quality_rules(docs).where("_quality.kept").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group."""
    return one_of_each_group(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes; a document taken twice gives two rows."""
    return mixed_texts(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and the digest of each of their documents."""
    return token_digests(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_dedup", near_duplicate_stage),
    ("decontaminate", decontamination_stage),
    ("mix_sources", mixing_stage),
    ("token_files", token_stage),
]

#: The stages need XXH64, SimHash search and a tokenizer, which SQL does not have.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
