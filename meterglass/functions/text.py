"""Names and labels of reports, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Provider prefixes of routed model ids, stripped in this order.
PREFIXES = ("us.anthropic.", "eu.anthropic.", "anthropic.", "anthropic/")


def normalize_model(model: Column) -> Column:
    """The key that the price table has for a model id; null or empty gives the empty string."""
    m = F.lower(F.trim(F.coalesce(model, F.lit(""))))
    m = F.trim(F.regexp_replace(m, r"\[\s*1m\s*\]", ""))
    for prefix in PREFIXES:
        m = F.regexp_replace(m, "^" + prefix.replace(".", r"\."), "")
    return F.trim(F.regexp_replace(F.regexp_replace(m, r"-\d{4}-\d{2}-\d{2}$", ""), r"-\d{6,8}$", ""))


def pretty_model(model: Column) -> Column:
    """'claude-opus-4-8' as 'Opus 4.8'; other names as they are, none as '(unknown)'."""
    form = r"^claude-([a-z]+)-(\d+)(?:-(\d+))?$"
    minor = F.regexp_extract(model, form, 3)
    pretty = F.concat(F.initcap(F.regexp_extract(model, form, 1)), F.lit(" "), F.regexp_extract(model, form, 2), F.when(minor != "", F.concat(F.lit("."), minor)).otherwise(""))
    return F.when(F.coalesce(model, F.lit("")) == "", "(unknown)").when(model.rlike(form), pretty).otherwise(model)


def human_tokens(tokens: Column) -> Column:
    """1234 as '1K', 1100000 as '1.1M'; halves go to the even digit."""
    size = F.abs(F.bround(tokens.cast("double"), 0).cast("long"))
    sign = F.when(tokens < 0, "-").otherwise("")
    short = (
        F.when(size >= 1_000_000_000, F.format_string("%.1fB", F.bround(size / 1e9, 1)))
        .when(size >= 1_000_000, F.format_string("%.1fM", F.bround(size / 1e6, 1)))
        .when(size >= 1_000, F.format_string("%.0fK", F.bround(size / 1e3, 0)))
        .otherwise(size.cast("string"))
    )
    return F.coalesce(F.concat(sign, short), F.lit("0"))


def human_money(amount: Column) -> Column:
    """58.05 as '$58.05', always two decimals; null as '$0.00'."""
    return F.format_string("$%,.2f", F.bround(F.coalesce(amount.cast("double"), F.lit(0.0)), 2))


def human_duration(seconds: Column) -> Column:
    """'4d03h', '2h11m', '1m05s', '7s'; zero or less is 'now', null a dash."""
    s = seconds.cast("long")
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    d, h, m, sec = F.floor(s / 86400), F.floor(F.pmod(s, F.lit(86400)) / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    return (
        F.when(s.isNull(), "—").when(s <= 0, "now")
        .when(d > 0, F.concat(d.cast("string"), F.lit("d"), two(h), F.lit("h")))
        .when(h > 0, F.concat(h.cast("string"), F.lit("h"), two(m), F.lit("m")))
        .when(m > 0, F.concat(m.cast("string"), F.lit("m"), two(sec), F.lit("s")))
        .otherwise(F.concat(sec.cast("string"), F.lit("s")))
    )


def cost_label(cost: Column, unpriced: Column) -> Column:
    """Money, or 'unpriced' where nothing with a known price was spent."""
    return F.when((unpriced > 0) & (cost <= 0), "unpriced").otherwise(human_money(cost))


def relative_day(day: Column, today: Column) -> Column:
    """'(today)', '(1 day ago)', '(in 3 days)'."""
    n = F.datediff(day, today)
    days = F.concat(F.abs(n).cast("string"), F.when(F.abs(n) == 1, " day").otherwise(" days"))
    return F.when(n == 0, "(today)").when(n < 0, F.concat(F.lit("("), days, F.lit(" ago)"))).otherwise(F.concat(F.lit("(in "), days, F.lit(")")))


def limit_label(minutes: Column, key: Column) -> Column:
    """The name of a limit window: by its minutes, or else by its key."""
    by_key = F.when(key == "five_hour", "5-HOUR").when(key == "seven_day", "WEEKLY").otherwise(F.upper(F.replace(key, F.lit("_"), F.lit(" "))))
    n = minutes.cast("long")
    part = lambda unit: F.floor(n / unit).cast("string")
    return (
        F.when(minutes.isNull() | (minutes <= 0), by_key)
        .when(n % 10080 == 0, F.when(n == 10080, "WEEKLY").otherwise(F.concat(part(10080), F.lit("-WEEK"))))
        .when(n % 1440 == 0, F.concat(part(1440), F.lit("-DAY")))
        .when(n % 60 == 0, F.concat(part(60), F.lit("-HOUR")))
        .otherwise(F.concat(n.cast("string"), F.lit("-MIN")))
    )


def root_label(path: Column, prefix: str) -> Column:
    """The last part of a path without a provider's prefix or a leading dot; never empty."""
    name = F.regexp_extract(path, r"([^/]+)/*$", 1)
    short = F.when(name.startswith(prefix), F.substr(name, F.lit(len(prefix) + 1))).when(name.startswith("."), F.substr(name, F.lit(2))).otherwise(name) if prefix else F.regexp_replace(name, r"^\.", "")
    return F.when(short != "", short).when(name != "", name).otherwise("account")
