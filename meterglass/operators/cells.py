"""Rolling windows at many moments, by cells of a minute and one sweep.

A window at a moment holds all facts from its edge on, so what matters of a fact is only on which side of the edges it
lies. Facts of a minute without an edge are one cell; only facts of minutes that an edge cuts stay apart. Cells, these
facts and the edges are swept once from the latest on, with running sums: within a day, and over the totals of days. So
facts are never joined with moments, and stored cells make a refresh read no facts but those of the cut minutes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterglass.operators.windows import TOKENS, WINDOWS

MINUTE, DAY = 60_000_000, 86_400_000_000
#: Moments become literals of the plan, with an edge for each window.
MOST_MOMENTS = 2000
SUMS = (*TOKENS, "cost", "unpriced_tokens", "records")
#: Before all time: the edge of the window without bound.
NEVER = -(1 << 62)


def amounts() -> list[Column]:
    """What a fact adds to each of `SUMS`; money as an exact decimal."""
    unpriced = F.when(~F.col("known"), F.col("total_tokens")).otherwise(F.lit(0).cast("long"))
    return [*[F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in TOKENS], F.coalesce("cost", F.lit(0.0)).cast("decimal(20,12)").alias("cost"), unpriced.alias("unpriced_tokens"), F.lit(1).cast("long").alias("records")]


def summed() -> list[Column]:
    return [F.sum(c).cast("decimal(38,12)" if c == "cost" else "long").alias(c) for c in SUMS]


def minute_of(ts: str = "ts") -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(MINUTE))


def minute_cells(facts: DataFrame) -> DataFrame:
    """(minute, sums) of priced facts with a time; cells of parts add up (`added_cells`)."""
    return added_cells(facts.where("ts IS NOT NULL").select(minute_of().alias("minute"), *amounts()))


def added_cells(some: DataFrame) -> DataFrame:
    return some.groupBy("minute").agg(*summed())


def edges_of(moments: list[int]) -> list[tuple[int, str, int]]:
    """(moment, window, first microsecond of the window)."""
    if len(moments) > MOST_MOMENTS:
        raise ValueError(f"more than {MOST_MOMENTS} moments")
    return [(m, name, NEVER if secs is None else m - secs * 1_000_000) for m in sorted(set(moments)) for name, secs in WINDOWS]


def cut_minutes(moments: list[int]) -> list[int]:
    """The minutes that an edge lies in, but not at the beginning of: at most five for each moment."""
    return sorted({edge // MINUTE for _, _, edge in edges_of(moments) if edge != NEVER and edge % MINUTE})


def windows_at(facts: DataFrame, moments: list[int]) -> DataFrame:
    """`windows.rolling_windows` of priced facts for each moment (microseconds), in one pass over the facts."""
    cut = F.broadcast(facts.sparkSession.createDataFrame([(m,) for m in cut_minutes(moments)], "minute long").withColumn("cut", F.lit(True)))
    rows = facts.where("ts IS NOT NULL").select(minute_of().alias("minute"), F.unix_micros("ts").alias("us"), *amounts()).join(cut, "minute", "left")
    at = F.when(F.col("cut"), F.col("us")).otherwise(F.col("minute") * MINUTE).alias("at")
    return swept(rows.groupBy(at).agg(*summed()), moments)


def windows_from_cells(cells: DataFrame, facts: DataFrame, moments: list[int]) -> DataFrame:
    """The same from stored cells of all facts, and those facts that lie in cut minutes; the filter on ``ts`` reaches the scan."""
    minutes = cut_minutes(moments)
    whole = cells.where(~F.col("minute").isin(minutes)).select((F.col("minute") * MINUTE).alias("at"), *SUMS)
    inside = F.lit(False)
    for first, last in spans(minutes):
        inside = inside | F.col("ts").between(F.timestamp_micros(F.lit(first * MINUTE)), F.timestamp_micros(F.lit((last + 1) * MINUTE - 1)))
    single = facts.where(inside).select(F.unix_micros("ts").alias("at"), *amounts())
    return swept(whole.unionByName(single).groupBy("at").agg(*summed()), moments)


def spans(minutes: list[int]) -> list[tuple[int, int]]:
    """Runs of consecutive minutes."""
    out: list[tuple[int, int]] = []
    for m in minutes:
        if out and out[-1][1] == m - 1:
            out[-1] = (out[-1][0], m)
        else:
            out.append((m, m))
    return out


def swept(rows: DataFrame, moments: list[int]) -> DataFrame:
    """(moment_us, window, sums) by rows (at, sums) that no edge cuts: the sum of all from each edge on."""
    spark = rows.sparkSession
    edges = spark.createDataFrame(edges_of(moments), "moment_us long, window string, at long")
    both = rows.unionByName(edges, allowMissingColumns=True).withColumn("day", F.floor(F.col("at") / F.lit(DAY)))
    # the latest first; at one time rows come before edges, which hold them
    later = Window.partitionBy("day").orderBy(F.desc("at"), F.col("window").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    within = both.select("day", "moment_us", "window", *[F.sum(c).over(later).alias(c) for c in SUMS]).where("window IS NOT NULL")
    days = rows.groupBy(F.floor(F.col("at") / F.lit(DAY)).alias("day")).agg(*summed())
    # a row for each day
    spine = days.unionByName(edges.select(F.floor(F.col("at") / F.lit(DAY)).alias("day")).distinct(), allowMissingColumns=True).groupBy("day").agg(*summed())
    after = Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
    rest = spine.select("day", *[F.sum(c).over(after).alias(f"_{c}") for c in SUMS])
    # narrower than the widest decimal, so that the sum of two keeps its scale
    kind = lambda c: "decimal(36,12)" if c == "cost" else "long"
    total = lambda c: F.coalesce(F.col(c).cast(kind(c)), F.lit(0).cast(kind(c))) + F.coalesce(F.col(f"_{c}").cast(kind(c)), F.lit(0).cast(kind(c)))
    out = [total(c).cast("double" if c == "cost" else "long").alias(c) for c in SUMS]
    return within.join(rest, "day").select("moment_us", "window", *out)
