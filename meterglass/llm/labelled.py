"""Labels to learn from, and a bounded sample of labelled texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterglass.llm.common import checkpointed, held_out, least_hashed


def known_labels(labels: DataFrame, label_id: Column, label: Column) -> DataFrame:
    """(doc_id, label) of the documents that are not held out: of several labels 1 (any that is above 0)."""
    given = labels.select(label_id.cast("long").alias("doc_id"), label.cast("int").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    return given.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("label") > 0).cast("int").alias("label"))


def labelled_sample(docs: DataFrame, doc_id: Column, text: Column, labels: DataFrame, label_id: Column, label: Column, rows: int) -> DataFrame:
    """(doc_id, text, label) of at most ``rows`` labelled documents that are not held out, those with the least hash of their ids.

    One row per doc_id: of several labels 1 (any that is above 0), of several texts the least. Rows whose id or label is
    null are left out; a null text counts as empty. The texts stay on the executors, in a checkpoint.
    """
    known = known_labels(labels, label_id, label)
    chosen = docs.sparkSession.createDataFrame(least_hashed(known, "doc_id", rows).collect(), known.schema)
    texts = docs.select(doc_id.cast("long").alias("doc_id"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))
    return checkpointed(texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label"))
