"""Documents to packed sequences, in four stages over the operators of weftwork.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the columns
that documents has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftwork.llm import budget_mix, cut_packing, language_id, shingle_groups
from weftwork.llm.common import TEXTS, written
from weftwork.llm.queries import language_fold, tree, WEIGHTS
from weftwork.llm.token_cache import default_path

#: Share of the tokens that the mixing stage lets through, each document at most once.
BUDGET = 0.8


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language is found (null, empty or letterless texts)."""
    return language_id.accepted(docs, language_id.learn(docs.where(language_fold() != 2)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates (five-word shingles, similarity 0.8
    or more), that of the smallest doc_id: candidates by the Hamming trees, then an exact check."""
    return shingle_groups.one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Brings domains, languages and sources to their target weights."""
    return budget_mix.mixed(docs, tree(), budget_mix.Params(budget=BUDGET, epochs=1, weights=WEIGHTS), keep=True)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences of 4,096 tokens."""
    return cut_packing.pieces(docs, default_path(), end_id=2, width=4096)


STAGES = [("language_id", languages), ("near_duplicates", near_duplicates), ("mixture", mixture), ("packing", packing)]

#: Tokenizing, hashing and fitted machines are beyond SQL; tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from all of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name, batch=TEXTS)
    return docs
