"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and
returns a DataFrame that is written as Parquet and read again as the next one's docs.
All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from statloom.llm.decontaminate import decontaminate
from statloom.llm.packing import pack
from statloom.llm.pathjoin import one_of_each
from statloom.llm.quality import keep_good
from statloom.llm.scratch import stage
from statloom.llm.secrets import redact
from statloom.session import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier doesn't reject."""
    ship(spark)
    return keep_good(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id.

    Rows are told apart by doc_id and text. A row without doc_id, or without words, belongs to no group and stays.
    """
    ship(spark)
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without passages of the benchmark, row by row: a shared or missing doc_id takes no other row along."""
    ship(spark)
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets replaced by a mark and n_chars made to fit; null texts and repeated rows stay as they are."""
    ship(spark)
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's pieces with their sequences and offsets; a null text is its end token, repeated rows are packed each."""
    ship(spark)
    return pack(docs)


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", deduplicate), ("benchmark decontamination", decontamination), ("secret scans", secret_scan), ("best-fit packing", packing)]

#: A trained scorer, a tokenizer and a packing can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, with what each keeps written in between."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, name.replace(" ", "-").lower())
    return docs
