"""The facts of a report as one table of partial sums, and the rollups that follow from it.

The grain is model, provider and account, the narrowest rolling window that holds the facts, the bucket of the activity
series, and the local day of a range. Tables of a report are sums over it, so facts are read once. Money is kept as exact
decimals, so sums of sums are those of the facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterglass.functions.calendar import day_end_us, day_start_us, local_day
from meterglass.operators.cells import SUMS, amounts, summed
from meterglass.operators.series import BUCKETS
from meterglass.operators.windows import WINDOWS

NAMES = [name for name, _ in WINDOWS]
GRAIN = ("model_norm", "known", "provider", "account", "narrowest", "bucket", "in_range", "day")


def usage_cube(facts: DataFrame, now_us: Column, window: str = "24h", buckets: int = BUCKETS, days: tuple[str, str, str] | None = None) -> DataFrame:
    """`GRAIN` and sums of priced facts: ``narrowest`` is a place in `WINDOWS`, ``bucket`` that of the series of ``window``.

    ``days`` is a range (first, last day and time zone); without it no row is in range.
    """
    us = F.unix_micros("ts")
    age = now_us - us
    narrowest = F.lit(len(WINDOWS) - 1)
    for k in range(len(WINDOWS) - 2, -1, -1):
        narrowest = F.when(age <= WINDOWS[k][1] * 1_000_000, k).otherwise(narrowest)
    secs = dict(WINDOWS)[window]
    if secs is None:
        bucket = F.lit(None).cast("long")
    else:
        since = us - (now_us - secs * 1_000_000)
        at = F.least(F.lit(buckets - 1).cast("long"), F.floor((since * buckets) / F.lit(secs * 1_000_000).cast("decimal(20,0)")).cast("long"))
        bucket = F.when((since > 0) & (us <= now_us), at)
    if days is None:
        inside, day = F.lit(False), F.lit(None).cast("date")
    else:
        first, last, zone = days
        inside = us.between(day_start_us(F.lit(first).cast("date"), zone), day_end_us(F.lit(last).cast("date"), zone))
        day = F.when(inside, local_day(F.col("ts"), zone))
    rows = facts.select("model_norm", "known", "provider", "account", narrowest.alias("narrowest"), bucket.alias("bucket"), inside.alias("in_range"), day.alias("day"), *amounts())
    return rows.groupBy(*GRAIN).agg(*summed())


def measures() -> list[Column]:
    """Of cube rows the sums, as `windows.measures` gives them of facts."""
    return [*[F.coalesce(F.sum(c), F.lit(0)).cast("double" if c == "cost" else "long").alias(c) for c in SUMS], F.bool_and("known").alias("known")]


def rolling_windows(cube: DataFrame) -> DataFrame:
    """Totals of all windows; those without facts have zeros."""
    sums = [F.coalesce(F.sum(F.when(F.col("narrowest") <= k, F.col(c))), F.lit(0)).cast("double" if c == "cost" else "long").alias(f"{c}_{k}") for k in range(len(NAMES)) for c in SUMS]
    rows = [F.struct(F.lit(name).alias("window"), *[F.col(f"{c}_{k}").alias(c) for c in SUMS]) for k, name in enumerate(NAMES)]
    return cube.agg(*sums).select(F.explode(F.array(*rows)).alias("w")).select("w.*")


def model_rollup(cube: DataFrame) -> DataFrame:
    """Window by model with a total row per window (``is_total`` 1, no model name)."""
    held = F.slice(F.array(*map(F.lit, NAMES)), F.col("narrowest") + 1, F.lit(len(NAMES)))
    window, model = F.col("window"), F.col("model_norm")
    return cube.withColumn("window", F.explode(held)).groupingSets([[window, model], [window]], window, model).agg(F.grouping(model).cast("int").alias("is_total"), *measures())


def by_account(cube: DataFrame, accounts: DataFrame, window: str) -> DataFrame:
    """`windows.by_account` of cube rows."""
    held = cube.where(F.col("narrowest") <= NAMES.index(window)) if window in NAMES else cube
    rows = accounts.join(held.groupBy("provider", "account").agg(*measures()), ["provider", "account"], "left").where("provider = 'claude' OR records IS NOT NULL")
    rows = rows.fillna(0, [*SUMS]).drop("known")
    # over the rows of accounts, which are few
    whole = F.sum(F.col("cost").cast("decimal(20,12)")).over(Window.partitionBy()).cast("double")
    return rows.withColumn("share", F.when(whole > 0, F.round(F.col("cost") / whole, 9)).otherwise(0.0))


def activity(cube: DataFrame, metric: str = "cost", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, value, records, unpriced_tokens) for every bucket."""
    value = F.sum("cost" if metric == "cost" else "total_tokens").cast("double")
    sums = cube.where("bucket IS NOT NULL").groupBy("bucket").agg(value.alias("value"), F.sum("records").alias("records"), F.sum("unpriced_tokens").alias("unpriced_tokens"))
    spine = cube.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    return spine.join(sums, "bucket", "left").fillna(0, ["value", "records", "unpriced_tokens"])


def range_by_day(cube: DataFrame, first: str, last: str) -> DataFrame:
    """One row per local day of the range, also for days without facts."""
    days = cube.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    return days.join(cube.where("in_range").groupBy("day").agg(*measures()), "day", "left").fillna(0, [*SUMS]).drop("known")
