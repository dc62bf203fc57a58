"""The whole report over log directories: named DataFrames over one cube of the facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterglass.functions import text
from meterglass.operators import cube, limits, merge, pricing, rollout, series, windows
from meterglass.operators.accounts import tag_accounts
from meterglass.plans.events import written
from meterglass.sources import extract
from meterglass.sources.lines import ingest_quality, parsed, rollout_prefilter, scan_usage, usage_prefilter
from meterglass.sources.store import file_listing


def log_facts(spark: SparkSession, paths: list[str], claude_roots: DataFrame, codex_roots: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Facts of both providers, limit snapshots per account, and ingest quality per file.

    A line's account is that of the first enabled root above its file; lines of either provider are told apart by
    their content. The logs are read once, when this is called: lines that can hold usage are written to the shared folder.
    """
    lines = written(scan_usage(spark, *paths))
    claude = tag_accounts(extract.usage_lines(parsed(lines.where(usage_prefilter(F.col("value"))))), F.col("file"), claude_roots, "claude").withColumn("provider", F.lit("claude"))
    events = tag_accounts(extract.rollout_events(parsed(lines.where(rollout_prefilter(F.col("value"))))), F.col("file"), codex_roots, "codex")
    facts = merge.merge_usage(claude).unionByName(rollout.rollout_usage(events))
    snapshots = limits.limit_snapshots(events.where("limits IS NOT NULL").select("account", (F.unix_micros("ts") / 1e6).alias("captured_at"), "ord", "limits"))
    return facts, limits.captures(snapshots, "ord"), ingest_quality(lines)


def ingest_counts(spark: SparkSession, paths: list[str], pattern: str = "*.jsonl") -> DataFrame:
    """One row: files, lines read, records, duplicates (lines merged into another's record) and malformed lines."""
    lines = written(scan_usage(spark, *paths, pattern=pattern))
    quality = ingest_quality(lines).agg(F.coalesce(F.sum("lines_read"), F.lit(0)).alias("lines_read"), F.coalesce(F.sum("malformed"), F.lit(0)).alias("malformed"))
    merged = merge.merge_counts(extract.usage_lines(parsed(lines.where(usage_prefilter(F.col("value"))))))
    used = rollout.rollout_usage(extract.rollout_events(parsed(lines.where(rollout_prefilter(F.col("value"))))).withColumn("account", F.lit("codex"))).agg(F.count("*").alias("others"))
    files = file_listing(spark, *paths, pattern=pattern).agg(F.count("*").alias("files"))
    row = quality.crossJoin(F.broadcast(merged)).crossJoin(F.broadcast(used)).crossJoin(F.broadcast(files))  # of one row each
    return row.select("files", "lines_read", (F.col("records") + F.col("others")).alias("records"), "duplicates", "malformed")


def usage_report(
    facts: DataFrame, prices: DataFrame, now_us: Column, accounts: DataFrame, window: str = "24h", metric: str = "cost", scope: str = "all",
    captures: DataFrame | None = None, days: tuple[str, str, str] | None = None,
) -> dict[str, DataFrame]:
    """All tables of the one-shot report over unpriced facts.

    ``accounts`` (provider, account, and for limits provider_rank and root_rank) are the enabled ones, few. ``scope`` is
    one of them or 'all'; an unknown one counts as 'all'. The table of accounts has rows only for 'all', and only where
    there are at least two. ``captures`` (account, captured_at, buckets) adds the limits, and ``days`` (first, last and
    time zone) the tables of a date range.

    The facts are read once, when this is called: their cube is written to the shared folder, and every table follows
    from it.
    """
    known = scope != "all" and not accounts.where(F.col("account") == scope).isEmpty()
    every = written(cube.usage_cube(pricing.price_facts(facts, prices), now_us, window, days=days))
    held = windows.scoped(every, scope, [scope] if known else [])
    activity = cube.activity(held, metric)
    labels = [text.pretty_model(F.col("model_norm")).alias("name"), text.human_tokens(F.col("total_tokens")).alias("tokens_label"), text.cost_label(F.col("cost"), F.col("unpriced_tokens")).alias("cost_label")]
    by_cost = [F.desc("cost"), F.desc("total_tokens")]
    shown = (F.count("*").over(Window.partitionBy()) >= 2) & F.lit(not known)
    covered = windows.coverage(F.col("unpriced_tokens"), F.col("total_tokens"))
    tables = {
        "windows": cube.rolling_windows(held).withColumn("coverage", covered),
        "models": cube.model_rollup(held).select("*", *labels).orderBy("window", "is_total", *by_cost, "model_norm"),
        # over the rows of accounts, which are few
        "accounts": cube.by_account(every, accounts.select("provider", "account"), window).withColumn("shown", shown).where("shown").drop("shown").orderBy(*by_cost, "provider", "account"),
        "activity": activity.orderBy("bucket"),
        "peak": series.peak_bucket(activity, now_us, window),
        "levels": series.series_levels(activity).orderBy("bucket"),
        "unknown_models": windows.unknown_models(every).orderBy("model_norm"),
    }
    has_codex = every.agg(F.coalesce(F.bool_or(F.col("provider") == "codex"), F.lit(False)).alias("has_codex"), F.coalesce(F.sum("records"), F.lit(0)).alias("records"))
    if captures is None:
        tables["providers"] = has_codex.withColumn("has_limits", F.lit(False))
    else:
        own = captures.join(F.broadcast(accounts.select("account")), "account", "left_semi")
        tables["providers"] = has_codex.crossJoin(F.broadcast(own.agg((F.count("*") > 0).alias("has_limits"))))
        tables["limits"] = limits.limit_status(limits.limits_by_account(own, accounts), F.floor(now_us / 1e6))
    if days is not None:
        within = held.where("in_range")
        by_day = cube.range_by_day(held, *days[:2])
        totals = within.agg(*cube.measures()).drop("known").withColumn("coverage", covered)
        tables |= {
            "range": totals.crossJoin(F.broadcast(windows.active_days(by_day))),
            "range_days": by_day.orderBy("day"),
            "range_models": within.groupBy("model_norm").agg(*cube.measures()).select("*", *labels).orderBy(*by_cost, "model_norm"),
        }
    return tables


#: What `in_order` shows of each table: key, other key, flag, count, amount and more.
SHOWN = {
    "windows": ("window", None, None, "total_tokens", "cost", "records"),
    "models": ("window", "model_norm", "known", "total_tokens", "cost", "records"),
    "accounts": ("provider", "account", None, "total_tokens", "cost", "records"),
    "activity": ("bucket", None, None, "unpriced_tokens", "value", "records"),
    "peak": ("bucket", None, None, None, "value", None),
    "levels": ("bucket", None, None, "level", None, None),
    "unknown_models": ("model_norm", None, None, None, None, None),
    "providers": (None, None, "has_codex", "records", None, None),
    "limits": ("account", "key", None, None, "shown_percentage", None),
    "range": (None, None, None, "total_tokens", "cost", "active_days"),
    "range_days": ("day", None, None, "total_tokens", "cost", "records"),
    "range_models": ("model_norm", None, "known", "total_tokens", "cost", "records"),
}


def in_order(tables: dict[str, DataFrame]) -> DataFrame:
    """The rows of all tables (``table``, ``place``, and what `SHOWN` says): ``place`` is where a row stands in its table. They are small."""
    out = None
    for name, table in tables.items():
        kinds = ("string", "string", "boolean", "long", "double", "long")
        columns = [(F.lit(None) if c is None else F.col(c)).cast(kind).alias(n) for c, kind, n in zip(SHOWN[name], kinds, ("key", "other", "flag", "n", "amount", "more"), strict=True)]
        rows = table.coalesce(1).select(F.lit(name).alias("table"), F.monotonically_increasing_id().alias("place"), *columns)
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("amount", F.round("amount", 9))


def summary(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n, total_tokens, cost): the rows of each table and the sums of what it has of the two."""
    out = None
    for name, table in tables.items():
        tokens = F.coalesce(F.sum("total_tokens"), F.lit(0)) if "total_tokens" in table.columns else F.lit(None).cast("long")
        cost = F.coalesce(pricing.exact_sum(F.col("cost")), F.lit(0.0)) if "cost" in table.columns else F.lit(None).cast("double")
        row = table.agg(F.count("*").alias("n"), tokens.alias("total_tokens"), cost.alias("cost")).select(F.lit(name).alias("table"), "n", "total_tokens", "cost")
        out = row if out is None else out.unionByName(row)
    return out
