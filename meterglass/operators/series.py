"""Regular activity series and their chart levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterglass.operators.pricing import exact_sum
from meterglass.operators.windows import WINDOWS

BUCKETS = 48
DOTS = 4


def activity_series(facts: DataFrame, now_us: Column, window: str = "24h", metric: str = "cost", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, value, records, unpriced_tokens) for every bucket; start < ts <= now, the last bucket takes its edge."""
    secs = dict(WINDOWS)[window]
    width = secs * 1_000_000
    since = F.unix_micros("ts") - (now_us - width)
    at = F.least(F.lit(buckets - 1).cast("long"), F.floor((since * buckets) / F.lit(width).cast("decimal(20,0)")).cast("long"))
    value = exact_sum(F.col("cost")) if metric == "cost" else F.sum("total_tokens").cast("double")
    held = facts.where((since > 0) & (F.unix_micros("ts") <= now_us))
    sums = held.groupBy(at.alias("bucket")).agg(value.alias("value"), F.count("*").alias("records"), F.coalesce(F.sum(F.when(~F.col("known"), F.col("total_tokens"))), F.lit(0)).alias("unpriced_tokens"))
    spine = facts.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    return spine.join(sums, "bucket", "left").fillna(0, ["value", "records", "unpriced_tokens"])


def peak_bucket(series: DataFrame, now_us: Column, window: str, buckets: int = BUCKETS) -> DataFrame:
    """The first bucket of the greatest value, its centre and age. The series has a fixed number of rows."""
    secs = dict(WINDOWS)[window]
    first = series.orderBy(F.desc("value"), "bucket").limit(1)
    centre = now_us - secs * 1_000_000 + ((2 * F.col("bucket") + 1) * (secs * 1_000_000)) / (2 * buckets)
    return first.select("bucket", "value", centre.cast("long").alias("centre_us"), (now_us - centre.cast("long")).alias("age_us"))


def series_levels(series: DataFrame, rows: int = 3) -> DataFrame:
    """Heights of 1 to rows * 4 dots in proportion to the peak, and the dots of each row from the bottom."""
    most = rows * DOTS
    peak = F.max("value").over(Window.partitionBy())
    level = F.when((peak <= 0) | (F.col("value") <= 0), 1).otherwise(F.greatest(F.lit(1), F.least(F.lit(most), F.bround(F.col("value") / peak * most, 0).cast("int"))))
    split = lambda k: F.greatest(F.lit(0), F.least(F.lit(DOTS), F.col("level") - DOTS * k))
    return series.withColumn("level", level).withColumns({f"row_{k}": split(k) for k in range(rows)})
