"""Local calendar days and date ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The names of the presets.
PRESETS = ("last7", "last30", "thismonth", "lastmonth", "all")
#: Days that the earliest day lies back when there is no record.
NO_RECORD_DAYS = 365
#: ISO timestamps as logs nearly always have them, which Spark reads as they are.
PLAIN = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:?\d{2})?)?$"
#: All ISO timestamps: a calendar or week date, any character, a time to the hour, minute, second or beyond, and a zone.
ANY = (
    r"^\s*(?<y>\d{4})(?:(?<d1>-?)(?<m>\d{2})\k<d1>(?<d>\d{2})|(?<d2>-?)W(?<w>\d{2})(?:\k<d2>(?<wd>[1-7]))?)"
    r"(?:.(?<hh>\d{2})(?:(?<c>:?)(?<mm>\d{2})(?:\k<c>(?<ss>\d{2})(?:[.,](?<f>\d+))?)?)?(?<z>[+-]\d{2}(?::?\d{2})?)?)?Z?\s*$"
)
#: The groups of `ANY`, in their order.
GROUPS = ("y", "d1", "m", "d", "d2", "w", "wd", "hh", "c", "mm", "ss", "f", "z")


def plain_timestamp(written: Column) -> Column:
    """As `iso_timestamp`, for whole dates and times to the second only."""
    return F.when(written.rlike(PLAIN), F.try_to_timestamp(written))


def iso_timestamp(written: Column) -> Column:
    """An ISO timestamp in text, without zone in UTC (the session's zone must be UTC); null if it is none.

    Digits beyond microseconds are cut off. White space around it does not count.
    """
    # the rare forms are read in a lambda, so that they do not swell the code that is generated for the usual one
    rare = F.get(F.transform(F.array(written), _rare_timestamp), F.lit(0))
    return F.coalesce(plain_timestamp(written), F.when(~written.rlike(PLAIN), rare))


def _rare_timestamp(written: Column) -> Column:
    g = {n: F.nullif(F.regexp_extract(written, ANY, k + 1), F.lit("")) for k, n in enumerate(GROUPS)}
    number = lambda n: F.coalesce(g[n], F.lit("1")).try_cast("int")
    # week 1 is the one that has January 4
    first = F.trunc(F.try_to_date(F.concat(g["y"], F.lit("-01-04"))), "week")
    of_week = F.date_add(first, (number("w") - 1) * 7 + number("wd") - 1)
    week = F.when(F.weekofyear(of_week) == number("w"), of_week.cast("string"))
    day = F.when(g["w"].isNotNull(), week).otherwise(F.concat_ws("-", g["y"], g["m"], g["d"]))
    hour, minute, second = (F.coalesce(g[n], F.lit("00")) for n in ("hh", "mm", "ss"))
    time = F.concat(F.concat_ws(":", hour, minute, second), F.lit("."), F.substring(F.rpad(F.coalesce(g["f"], F.lit("0")), 6, "0"), 1, 6))
    digits = F.replace(g["z"], F.lit(":"), F.lit(""))
    zone = F.coalesce(F.concat(F.substring(digits, 1, 3), F.lit(":"), F.rpad(F.substring(digits, 4, 2), 2, "0")), F.lit("Z"))
    return F.when(written.rlike(ANY), F.try_to_timestamp(F.concat(day, F.lit("T"), time, zone)))


def local_day(ts: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def day_start_us(day: Column, zone: str) -> Column:
    """The first microsecond of a local day, since the epoch. The session's time zone must be UTC."""
    return F.unix_micros(F.to_utc_timestamp(day.cast("timestamp"), zone))


def day_end_us(day: Column, zone: str) -> Column:
    """The last microsecond of a local day, which may have 23 or 25 hours."""
    return day_start_us(F.date_add(day, 1), zone) - 1


def add_months(day: Column, months: int) -> Column:
    return F.add_months(day, months)


def add_years(day: Column, years: int) -> Column:
    return F.add_months(day, 12 * years)


def preset_range(preset: Column, today: Column, earliest: Column) -> Column:
    """Struct of start and end of a preset; the end is at most today, the start at most the end."""
    month = F.trunc(today, "MM")
    start = (
        F.when(preset == "last7", F.date_sub(today, 6)).when(preset == "last30", F.date_sub(today, 29)).when(preset == "thismonth", month)
        .when(preset == "lastmonth", F.add_months(month, -1)).when(preset == "all", earliest)
    )
    end = F.least(F.when(preset == "lastmonth", F.date_sub(month, 1)).otherwise(today), today)
    return F.struct(F.least(start, end).alias("start"), end.alias("end"))


def preset_table(spark: SparkSession, days: DataFrame) -> DataFrame:
    """(preset, start, end) for one row of (today, earliest)."""
    presets = spark.createDataFrame([(p,) for p in PRESETS], "preset string")
    return presets.crossJoin(F.broadcast(days)).select("preset", preset_range(F.col("preset"), F.col("today"), F.col("earliest")).alias("r")).select("preset", "r.start", "r.end")
