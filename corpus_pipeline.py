"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs
of the next. All but the last return the columns of documents. Models are fitted on the labelled rows of the given
documents (and of the labels table) that are not held out.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterglass.llm import langid, minhash, packing, quality
from meterglass.llm.bpe import VOCABULARY
from meterglass.llm.common import stage_table, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those in none of the known languages."""
    network = langid.train(docs, F.col("doc_id"), F.col("text"), F.col("lang"))
    return langid.keep_known(docs, F.col("text"), network)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score below the threshold."""
    labels = table(spark, sf_dir, "labels")
    ranking = quality.train(docs, F.col("doc_id"), F.col("text"), labels, F.col("doc_id"), F.col("quality"))
    return quality.keep_good(docs, F.col("text"), ranking)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each group of near duplicates."""
    return minhash.keep_one(docs, F.col("doc_id"), F.col("text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left in sequences of 2048 tokens."""
    return packing.digest(packing.pack_texts(docs, F.col("text"), "doc_id", path=public_tokenizers.path(VOCABULARY)))


STAGES = [("language_id", language_id), ("quality", quality_filter), ("near_dedup", near_dedup), ("packing", pack)]

#: The stages train models and pack by a heuristic, which SQL cannot express; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
