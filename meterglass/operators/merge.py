"""Merging the repeated lines of one response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COUNTERS = ("input_tokens", "output_tokens", "cache_read", "cache_creation", "eph_5m", "eph_1h")


def merge_key() -> dict[str, Column]:
    """The parts of a line's key: request, message, and for a line without a message_id, which stays alone, its ``ord``."""
    alone = F.coalesce(F.col("message_id"), F.lit("")) == ""
    return {"r": F.when(~alone, F.coalesce("request_id", F.lit("\0"))), "m": F.when(~alone, F.col("message_id")), "o": F.when(alone, F.col("ord"))}


def merge_usage(lines: DataFrame, keep_key: bool = False) -> DataFrame:
    """One fact per (request_id, message_id): the maximum of every counter, and the first line's ts, model and account.

    A key starts with its first line that has a timestamp: lines before it are dropped with their counters, lines
    after it merge even without one. Lines without a message_id stay alone. Nulls of the two cache buckets lose
    against numbers. ``ord`` gives the order of ingestion. Keys are dealt evenly, so one shuffle by key does it all.
    ``keep_key`` adds the key as ``request_id``, ``message_id`` and ``line``.
    """
    first = F.min_by(F.struct("ts", "model_raw", "account", "provider", "ord"), "ord").alias("first")
    merged = counted_lines(lines).groupBy("key").agg(first, *[F.max(c).alias(c) for c in COUNTERS])
    return merged.select(*[F.col("key.r").alias("request_id"), F.col("key.m").alias("message_id"), F.col("key.o").alias("line")] if keep_key else [], "first.*", *COUNTERS)


def counted_lines(lines: DataFrame) -> DataFrame:
    """``lines`` with their ``key``, from each key's first line with a timestamp on."""
    keyed = lines.withColumn("key", F.struct(*[c.alias(n) for n, c in merge_key().items()]))
    start = F.min(F.when(F.col("ts").isNotNull(), F.col("ord"))).over(Window.partitionBy("key"))
    return keyed.withColumn("start", start).where(F.col("ord") >= F.col("start")).drop("start")


def merge_counts(lines: DataFrame) -> DataFrame:
    """One row: ``records`` that the merge gives, and ``duplicates``, the lines that went into another's record."""
    each = counted_lines(lines).groupBy("key").agg(F.count("*").alias("n"))
    return each.agg(F.count("*").alias("records"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def states(lines: DataFrame, *by: str) -> DataFrame:
    """Lines reduced to what later lines of their key can still change: states, which merge in any order (`combined`).

    A key has one state of its dated lines (the first of them and the maxima of the counters). Lines without a timestamp
    count only behind the first dated one, which may still come, so they stay apart: of those that are equal in all
    counters only the last matters. Sums and minima alone, so tasks reduce before they shuffle and no key is gathered.
    States of lines that differ in a column of ``by`` stay apart.
    """
    dated = F.col("ts").isNotNull()
    parts = [c.alias(n) for n, c in merge_key().items()]
    first = F.when(dated, F.struct("ts", "model_raw", "account", "provider", "ord")).alias("first")
    return combined(lines.select(*by, *parts, dated.alias("dated"), F.col("ord"), first, *COUNTERS), *by)


def combined(some: DataFrame, *by: str) -> DataFrame:
    """States of the same keys as one: `combined(a + b) = combined(combined(a) + combined(b))`."""
    apart = [F.when(~F.col("dated"), F.col(c)).alias(f"_{c}") for c in COUNTERS]
    grouped = some.groupBy(*by, "r", "m", "o", "dated", *apart)
    merged = grouped.agg(F.max("ord").alias("ord"), F.min_by("first", F.col("first.ord")).alias("first"), *[F.max(c).alias(c) for c in COUNTERS])
    return merged.drop(*[f"_{c}" for c in COUNTERS])


def state_facts(some: DataFrame, keep_key: bool = False) -> DataFrame:
    """The facts of combined states, those of `merge_usage` of all their lines."""
    keys = ["r", "m", "o"]
    # one row for each key and, as the line's ord is set apart where it is null, keys that are equal with nulls meet
    key = F.struct(*keys).alias("key")
    dated = some.where("dated").select(key, "first", *COUNTERS)
    late = some.where(~F.col("dated")).select(key, F.col("ord").alias("_ord"), *[F.col(c).alias(f"_{c}") for c in COUNTERS])
    behind = dated.select("key", F.col("first.ord").alias("_start")).join(late, "key").where("_ord > _start").groupBy("key").agg(*[F.max(f"_{c}").alias(f"_{c}") for c in COUNTERS])
    both = dated.join(behind, "key", "left")
    counters = [F.greatest(c, f"_{c}").alias(c) for c in COUNTERS]
    return both.select(*[F.col("key.r").alias("request_id"), F.col("key.m").alias("message_id"), F.col("key.o").alias("line")] if keep_key else [], "first.*", *counters)
