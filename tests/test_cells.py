"""Windows by cells and sweep, and the cube of the report."""

import random
from bisect import bisect_left
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from meterglass.operators import cells, cube, pricing, windows
from meterglass.plans import events as ev
from meterglass.plans.report import usage_report

COLUMNS = ["window", "input_tokens", "output_tokens", "cache_read", "cache_creation", "total_tokens", "cost", "unpriced_tokens", "records"]


@pytest.fixture(scope="module")
def facts(spark):
    """Facts of 40 days, many at edges of minutes, some after the last moment."""
    base = spark.range(4000).withColumn("us", F.when(F.rand(3) < 0.3, F.floor(F.rand(1) * 57_600) * 60_000_000).otherwise(F.floor(F.rand(2) * 3_456_000_000_000)))
    counters = [(F.col("id") * k % 97).alias(n) for k, n in enumerate(windows.TOKENS, 1)]
    return base.select(F.timestamp_micros("us").alias("ts"), (F.col("id") % 5 > 0).alias("known"), (F.col("id") / 7).alias("cost"), *counters, F.concat(F.lit("m"), F.col("id") % 3).alias("model_norm"), F.when(F.col("id") % 4 == 0, "codex").otherwise("claude").alias("provider"), F.concat(F.lit("a"), F.col("id") % 6).alias("account")).cache()


def rows_of(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


def moments(n, seed):
    rng = random.Random(seed)
    return [rng.choice([rng.randrange(3_600_000_000_000), rng.randrange(60_000) * 60_000_000, rng.randrange(60_000) * 60_000_000 + rng.choice([-1, 1])]) for _ in range(n)]


def test_sweep_equals_windows_at_a_thousand_moments(spark, facts):
    some = sorted(set(moments(1000, 1)))
    got = {(r["moment_us"], r["window"]): r for r in cells.windows_at(facts, some).collect()}
    assert len(got) == 5 * len(some)
    given = sorted(facts.select(F.unix_micros("ts"), "total_tokens", F.col("cost").cast("decimal(20,12)")).collect(), key=lambda g: g[0])
    times, tokens, costs = [g[0] for g in given], list(accumulate((g[1] for g in given), initial=0)), list(accumulate((g[2] for g in given), initial=0))
    for (moment, name), r in got.items():
        secs = dict(windows.WINDOWS)[name]
        at = 0 if secs is None else bisect_left(times, moment - secs * 1_000_000)
        assert (r["records"], r["total_tokens"], r["cost"]) == (len(given) - at, tokens[-1] - tokens[at], float(costs[-1] - costs[at]))
    for moment in (0, some[5], 3_456_000_000_000):
        assert rows_of(cells.windows_at(facts, [moment]), *COLUMNS) == rows_of(windows.rolling_windows(facts, F.lit(moment)), *COLUMNS)


def test_stored_cells_and_facts_of_cut_minutes_give_the_same(spark, facts, tmp_path):
    facts.write.parquet(str(tmp_path / "facts"))
    parts = [cells.minute_cells(facts.where(F.col("input_tokens") % 3 == k)) for k in range(3)]
    cells.added_cells(parts[0].unionByName(parts[1]).unionByName(parts[2])).write.parquet(str(tmp_path / "cells"))
    held, stored = spark.read.parquet(str(tmp_path / "cells")), spark.read.parquet(str(tmp_path / "facts"))
    some = moments(60, 2)
    got = cells.windows_from_cells(held, stored, some)
    assert rows_of(got, "moment_us", *COLUMNS) == rows_of(cells.windows_at(facts, some), "moment_us", *COLUMNS)
    plan = cells.windows_from_cells(held, stored, some[:1])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan.replace("\n", "")  # the cut minutes reach the scan
    with pytest.raises(ValueError):
        cells.windows_at(facts, list(range(2001)))
    assert cells.windows_at(facts.limit(0), [5]).where("records = 0 AND cost = 0").count() == 5


def test_cube_gives_the_rollups_of_the_facts(spark, facts):
    now = F.lit(3_456_000_000_000).cast("long")
    days = ("1970-01-10", "1970-01-20", "America/New_York")
    table = cube.usage_cube(facts, now, "7d", days=days).cache()
    same = lambda a, b, *c: rows_of(a, *c) == rows_of(b, *c)
    assert same(cube.rolling_windows(table), windows.rolling_windows(facts, now), *COLUMNS)
    assert same(cube.model_rollup(table), windows.model_rollup(facts, now), "model_norm", "is_total", "known", *COLUMNS)
    accounts = spark.createDataFrame([("claude", "a1"), ("codex", "a4"), ("claude", "idle")], "provider string, account string")
    assert same(cube.by_account(table, accounts, "24h"), windows.by_account(facts, accounts, now, "24h"), "provider", "account", "share", *COLUMNS[1:])
    held = windows.day_range(facts, *days)
    assert same(cube.range_by_day(table, *days[:2]), windows.range_by_day(facts, *days), "day", *COLUMNS[1:])
    assert same(table.where("in_range").groupBy("model_norm").agg(*cube.measures()), windows.by_model(held), "model_norm", "known", *COLUMNS[1:])


def test_the_report_reads_its_facts_once(spark, sf, tmp_path):
    ev.usage_facts(ev.events(spark, sf)).write.parquet(str(tmp_path / "kept_facts"))
    facts = spark.read.parquet(str(tmp_path / "kept_facts"))
    accounts = spark.createDataFrame([("claude", "acct-0"), ("codex", "acct-4")], "provider string, account string")
    tables = usage_report(facts, pricing.default_prices(spark), ev.now_us(spark, sf), accounts, window="7d", days=("2024-01-05", "2024-01-20", "UTC"))
    assert len(tables) == 11
    for table in tables.values():
        assert "kept_facts" not in table._jdf.queryExecution().executedPlan().toString()
