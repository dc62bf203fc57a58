"""Usage from parsed log lines, tolerant of every wrong type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterglass.functions.calendar import iso_timestamp
from meterglass.operators.limits import is_object, once, part, text

#: The members of lines that are read; a struct is null where there is no object.
USAGE = (
    "struct<type: variant, timestamp: variant, requestId: variant, message: struct<id: variant, model: variant, usage: struct<input_tokens: variant, output_tokens: variant, "
    "cache_read_input_tokens: variant, cache_creation_input_tokens: variant, cache_creation: struct<ephemeral_5m_input_tokens: variant, ephemeral_1h_input_tokens: variant>>>>"
)
_COUNTERS = "struct<input_tokens: variant, cached_input_tokens: variant, output_tokens: variant>"
ROLLOUT = f"struct<type: variant, timestamp: variant, payload: struct<type: variant, model: variant, info: struct<total_token_usage: {_COUNTERS}, last_token_usage: {_COUNTERS}>>>"


def integer(value: Column) -> Column:
    """An integer or truth value as it is; anything else, also null, is 0."""
    kind = F.schema_of_variant(value)
    return F.coalesce(F.when(kind == "BIGINT", F.try_variant_get(value, "$", "bigint")).when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("bigint")), F.lit(0).cast("long"))


def timestamp(value: Column) -> Column:
    """An ISO timestamp, without zone in UTC (the session's zone must be UTC); null if it is none."""
    return iso_timestamp(text(value))


def usage_lines(parsed: DataFrame) -> DataFrame:
    """Usage lines of the first provider: counters, ids, model and timestamp (null if unreadable), with file and ord."""
    cut = once(parsed, F.try_variant_get("j", "$", USAGE), "_f")
    fit = cut.where((text(F.col("_f.type")) == "assistant") & F.col("_f.message").isNotNull() & F.col("_f.message.usage").isNotNull())
    n = lambda name: integer(F.col(f"_f.message.usage.{name}"))
    split = F.col("_f.message.usage.cache_creation").isNotNull()
    out = fit.select(
        "file", "ord", timestamp(F.col("_f.timestamp")).alias("ts"), text(F.col("_f.requestId")).alias("request_id"), text(F.col("_f.message.id")).alias("message_id"), text(F.col("_f.message.model")).alias("model_raw"),
        n("input_tokens").alias("input_tokens"), n("output_tokens").alias("output_tokens"), n("cache_read_input_tokens").alias("cache_read"), n("cache_creation_input_tokens").alias("whole"),
        F.when(split, n("cache_creation.ephemeral_5m_input_tokens")).alias("eph_5m"), F.when(split, n("cache_creation.ephemeral_1h_input_tokens")).alias("eph_1h"),
    )
    both = F.coalesce("eph_5m", F.lit(0)) + F.coalesce("eph_1h", F.lit(0))
    named = out.where(F.coalesce(F.col("model_raw") != "<synthetic>", F.lit(True)))
    return named.withColumn("cache_creation", F.when((F.col("whole") == 0) & (both > 0), both).otherwise(F.col("whole"))).drop("whole")


def rollout_events(parsed: DataFrame) -> DataFrame:
    """Marker and token lines of the second provider: file, ord, ts, marker, is_token, total, last, and the limits variant."""
    is_token = F.coalesce(text(F.col("_f.payload.type")) == "token_count", F.lit(False))
    counter = lambda v: F.greatest(F.lit(0).cast("long"), integer(v))

    def usage(name: str) -> Column:
        found = f"_f.payload.info.{name}"
        value = F.struct(counter(F.col(f"{found}.input_tokens")).alias("input"), counter(F.col(f"{found}.cached_input_tokens")).alias("cached"), counter(F.col(f"{found}.output_tokens")).alias("output"))
        return F.when(is_token & F.col(found).isNotNull(), value)

    seen = once(parsed, F.try_variant_get("j", "$", ROLLOUT), "_f").where(F.col("_f.payload").isNotNull())
    marker = F.when(text(F.col("_f.type")) == "turn_context", F.nullif(text(F.col("_f.payload.model")), F.lit("")))
    limits = part(F.col("j"), "$.payload.rate_limits")
    out = seen.select("file", "ord", timestamp(F.col("_f.timestamp")).alias("ts"), marker.alias("marker"), is_token.alias("is_token"), usage("total_token_usage").alias("total"), usage("last_token_usage").alias("last"), F.when(is_token & is_object(limits), limits).alias("limits"))
    return out.where("is_token OR marker IS NOT NULL")
