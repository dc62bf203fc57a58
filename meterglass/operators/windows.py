"""Rolling windows, date ranges and accounts over priced facts.

Priced facts have ts, model_norm, known, cost, provider, account and the token columns. Every rollup aggregates before
it shuffles; the few-row dimensions are literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterglass.functions.calendar import day_end_us, day_start_us, local_day
from meterglass.operators.pricing import exact_sum

# The rolling windows and their seconds; the last has no bound.
WINDOWS = [("1h", 3600), ("5h", 18000), ("24h", 86400), ("7d", 604800), ("all", None)]
TOKENS = ("input_tokens", "output_tokens", "cache_read", "cache_creation", "total_tokens")


def measures() -> list[Column]:
    """Token sums, exact cost, unpriced tokens, count of facts, and whether all have a price."""
    unpriced = F.coalesce(F.sum(F.when(~F.col("known"), F.col("total_tokens"))), F.lit(0)).alias("unpriced_tokens")
    return [*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in TOKENS], F.coalesce(exact_sum(F.col("cost")), F.lit(0.0)).alias("cost"), unpriced, F.count("ts").alias("records"), F.bool_and("known").alias("known")]


def coverage(unpriced: Column, total: Column) -> Column:
    """The share of tokens that have a price; 1 where there are none."""
    return F.when(total == 0, 1.0).otherwise(F.round(F.greatest(F.lit(0.0), 1 - unpriced / total), 12))


def scoped(facts: DataFrame, scope: str, accounts: list[str]) -> DataFrame:
    """The facts of one account; of all for 'all' and for an account that is not listed."""
    return facts.where(F.col("account") == scope) if scope != "all" and scope in accounts else facts


def in_windows(facts: DataFrame, now_us: Column) -> DataFrame:
    """Each fact once per rolling window that holds it (age at most the window's seconds; later facts are in all)."""
    age = now_us - F.unix_micros("ts")
    held = F.array(*[F.when(F.lit(True) if secs is None else age <= secs * 1_000_000, F.lit(name)) for name, secs in WINDOWS])
    return facts.withColumn("window", F.explode(F.array_compact(held)))


def rolling_windows(facts: DataFrame, now_us: Column) -> DataFrame:
    """Totals of all five windows in one pass over the facts; windows without facts have zeros."""
    age = now_us - F.unix_micros("ts")
    inside = [F.lit(True) if secs is None else age <= secs * 1_000_000 for _, secs in WINDOWS]
    sums = []
    for k, on in enumerate(inside):
        sums += [F.coalesce(F.sum(F.when(on, F.col(c))), F.lit(0)).alias(f"{c}_{k}") for c in TOKENS]
        sums += [F.coalesce(exact_sum(F.when(on, F.col("cost"))), F.lit(0.0)).alias(f"cost_{k}"), F.coalesce(F.sum(F.when(on & ~F.col("known"), F.col("total_tokens"))), F.lit(0)).alias(f"unpriced_tokens_{k}"), F.count(F.when(on, F.col("ts"))).alias(f"records_{k}")]
    names = [*TOKENS, "cost", "unpriced_tokens", "records"]
    rows = [F.struct(F.lit(name).alias("window"), *[F.col(f"{c}_{k}").alias(c) for c in names]) for k, (name, _) in enumerate(WINDOWS)]
    return facts.agg(*sums).select(F.explode(F.array(*rows)).alias("w")).select("w.*")


def window_by_model(facts: DataFrame, now_us: Column) -> DataFrame:
    return in_windows(facts, now_us).groupBy("window", "model_norm").agg(*measures())


def model_rollup(facts: DataFrame, now_us: Column) -> DataFrame:
    """Window by model with a total row per window (``is_total`` 1, no model name)."""
    window, model = F.col("window"), F.col("model_norm")
    return in_windows(facts, now_us).groupingSets([[window, model], [window]], window, model).agg(F.grouping(model).cast("int").alias("is_total"), *measures())


def by_model(facts: DataFrame) -> DataFrame:
    return facts.groupBy("model_norm").agg(*measures())


def by_account(facts: DataFrame, accounts: DataFrame, now_us: Column, window: str) -> DataFrame:
    """Listed accounts (provider, account) with their totals and share of cost, in one window (an unknown name: all).

    Accounts of provider 'claude' always have a row, those of others only with facts in the window.
    """
    secs = dict(WINDOWS).get(window)
    held = facts if secs is None else facts.where(now_us - F.unix_micros("ts") <= secs * 1_000_000)
    sums = held.groupBy("provider", "account").agg(*measures())
    rows = accounts.join(sums, ["provider", "account"], "left").where("provider = 'claude' OR records IS NOT NULL")
    rows = rows.fillna(0, [*TOKENS, "cost", "unpriced_tokens", "records"]).drop("known")
    # over the rows of accounts, which are few, so the facts are read once
    whole = F.sum(F.col("cost").cast("decimal(20,12)")).over(Window.partitionBy()).cast("double")
    return rows.withColumn("share", F.when(whole > 0, F.round(F.col("cost") / whole, 9)).otherwise(0.0))


def in_range(facts: DataFrame, start_us: Column, end_us: Column) -> DataFrame:
    """Facts between two moments, both included. The bounds are on ``ts`` itself, so that they reach the scan."""
    return facts.where(F.col("ts").between(F.timestamp_micros(start_us), F.timestamp_micros(end_us)))


def day_range(facts: DataFrame, start: str, end: str, zone: str) -> DataFrame:
    """Facts of the local days ``start`` to ``end``, both included."""
    return in_range(facts, day_start_us(F.lit(start).cast("date"), zone), day_end_us(F.lit(end).cast("date"), zone))


def range_totals(facts: DataFrame) -> DataFrame:
    return facts.agg(*measures()).drop("known").withColumn("coverage", coverage(F.col("unpriced_tokens"), F.col("total_tokens")))


def range_by_day(facts: DataFrame, start: str, end: str, zone: str) -> DataFrame:
    """One row per local day, also for days without facts."""
    days = facts.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day"))
    sums = day_range(facts, start, end, zone).groupBy(local_day(F.col("ts"), zone).alias("day")).agg(*measures())
    return days.join(sums, "day", "left").fillna(0, [*TOKENS, "cost", "unpriced_tokens", "records"]).drop("known")


def active_days(days: DataFrame) -> DataFrame:
    return days.agg(F.count_if((F.col("total_tokens") > 0) | (F.col("cost") > 0)).alias("active_days"), F.count("*").alias("n_days"))


def unknown_models(facts: DataFrame) -> DataFrame:
    return facts.where(~F.col("known") & (F.col("model_norm") != "")).select("model_norm").distinct()


def earliest_day(facts: DataFrame, today: Column, zone: str) -> DataFrame:
    """The local day of the first fact; without facts a year before today."""
    return facts.agg(F.min("ts").alias("ts")).select(F.coalesce(local_day(F.col("ts"), zone), F.date_sub(today, 365)).alias("day"))
