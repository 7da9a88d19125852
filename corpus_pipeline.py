"""A corpus from documents to token files: quality, near duplicates, benchmark leaks, mixture, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vecrec.llm.common import cut_lineage, table
from vecrec.llm.decontaminate import decontaminate
from vecrec.llm.mixing import mixed_documents
from vecrec.llm.quality import filter_quality
from vecrec.llm.simhash import drop_near_duplicates
from vecrec.llm.token_file import token_digest


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return filter_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs, max_repeats=2.0)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_digest(spark, docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("mixture", mixture), ("token_ids", token_ids)]

#: The near-duplicate stage rests on hash sketches and the mixture on hash blocks; tests compare the near-duplicate and quality stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
