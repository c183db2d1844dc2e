"""From raw documents to token files: filter, de-duplicate, decontaminate, mix, write."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from brontide.llm.decontaminate import decontaminated
from brontide.llm.mixing import mixed_documents
from brontide.llm.near_dups import without_near_duplicates
from brontide.llm.quality import good_documents
from brontide.llm.shared import shared_path
from brontide.llm.token_files import token_files


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted quality is 1."""
    return good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, on five-word shingles at 0.8."""
    return without_near_duplicates(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them, spans repeated as often as they are taken."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and what each document has in them."""
    return token_files(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_dups", near_dups), ("decontaminate", decontaminate), ("mix", mix), ("tokens", tokens)]

#: The classifier, the permutations and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read again.

    Null and empty texts, which no stage can hold against a document, drop out in
    the mix, as they have no words to take. Rows without doc_id are filtered by
    their text alone and stay; of rows that share a doc_id the near-duplicate stage
    keeps one. Extra columns travel along up to the token files, whatever their
    names; texts of any length are read whole; empty tables give no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        out, path = stage(spark, docs, sf_dir), shared_path(spark, f"stage-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
