"""Mergeable states, levelled runs, versions and the carry scan."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from meterglass.operators import merge, rollout
from meterglass.sources import snapshots
from meterglass.streaming import levels
from meterglass.streaming import usage as st

T = dt.datetime(2026, 6, 1)
LINE = "ord long, ts timestamp, request_id string, message_id string, model_raw string, account string, provider string, input_tokens long, output_tokens long, cache_read long, cache_creation long, eph_5m long, eph_1h long"
COLUMNS = ["ts", "model_raw", "account", "provider", "ord", *merge.COUNTERS]


def random_lines(rng, n):
    some = lambda *x: rng.choice(x)
    return [(k, some(None, None, T + dt.timedelta(seconds=k)), some(None, "r", "q"), some(None, "", "m", "n"), some("x", "y"), "a", "claude", rng.randint(0, 9), rng.randint(0, 9), rng.randint(0, 9), rng.randint(0, 9), some(None, rng.randint(0, 9)), some(None, 3)) for k in range(n)]


def same(a, b):
    return sorted(map(str, a.select(COLUMNS).collect())) == sorted(map(str, b.select(COLUMNS).collect()))


def test_states_merge_in_any_order(spark):
    for seed in range(4):
        rng = random.Random(seed)
        rows = random_lines(rng, 200)
        whole = spark.createDataFrame(rows, LINE)
        rng.shuffle(rows)
        parts = [merge.states(spark.createDataFrame(rows[k::3], LINE)) for k in range(3)]
        some = merge.combined(parts[0].unionByName(parts[1])).unionByName(parts[2])
        assert same(merge.state_facts(merge.combined(some)), merge.merge_usage(whole))


def test_runs_cover_all_batches_once():
    for fan in (2, 3, 8):
        for n in range(1, 200):
            runs = levels.runs_of(n, fan)
            assert sum(fan**level for level, _ in runs) == n and len(runs) <= (fan - 1) * 8
            at = 0
            for level, number in runs:
                assert number * fan**level == at
                at += fan**level
        made = {(0, k) for k in range(200)} | {(level, k) for n in range(200) for level, k, _ in levels.merges_of(n, fan)}
        assert set(levels.runs_of(200, fan)) <= made


def test_fifty_batches_read_and_write_by_levels(spark, tmp_path, monkeypatch):
    """Rows read by merges stay below rows times levels, folders below (fan - 1) * levels + the runs kept for one batch more."""
    log, rng, read = str(tmp_path / "log"), random.Random(1), []
    rows = random_lines(rng, 500)
    rng.shuffle(rows)
    whole = spark.createDataFrame(rows, LINE).cache()
    inner = levels._read

    def counted(spark, like, path, parts):
        df = inner(spark, like, path, parts)
        read.append((parts, df.count()))
        return df

    monkeypatch.setattr(levels, "_read", counted)
    apply = st.ingest_usage(log)
    for n in range(50):
        apply(whole.where(F.col("ord") % 50 == n).coalesce(1), n)
    merges = [sum(r for _, r in read)]
    assert len(read) == 50 // 8 and merges[0] <= 500
    assert all(len(parts) == 8 for parts, _ in read)
    monkeypatch.setattr(levels, "_read", inner)
    assert len(levels.runs_of(50)) == 8
    held = [n for level in snapshots.names(spark, log) if level.startswith("level") for n in snapshots.names(spark, f"{log}/{level}")]
    assert len(held) <= 8 + 8
    assert same(st.merged_log(spark, log), merge.merge_usage(whole))
    apply(whole.where(F.col("ord") % 50 == 49).coalesce(1), 49)  # a batch that runs again
    assert same(st.merged_log(spark, log), merge.merge_usage(whole))


def test_a_stopped_writer_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    write = lambda value: lambda to: spark.range(value).write.parquet(to)
    assert snapshots.current(spark, path) is None
    snapshots.publish(spark, path, write(3))
    steps = ["remove", "before", "half", "mark"]
    for step in steps:
        with monkeypatch.context() as m:

            def stop(*_):
                raise RuntimeError(step)

            def half(to):
                if step == "before":
                    stop()
                spark.range(9).write.parquet(to)
                if step == "half":
                    snapshots.remove(spark, f"{to}/_SUCCESS")
                    stop()

            if step in ("remove", "mark"):
                m.setattr(snapshots, step, stop)
            with pytest.raises(RuntimeError):
                snapshots.publish(spark, path, half)
        assert spark.read.parquet(snapshots.current(spark, path)).count() == 3
    snapshots.publish(spark, path, write(5))
    assert spark.read.parquet(snapshots.current(spark, path)).count() == 5
    for n in (6, 7):
        snapshots.publish(spark, path, write(n))
    snapshots.vacuum(spark, path)
    assert spark.read.parquet(snapshots.current(spark, path)).count() == 7
    assert snapshots.names(spark, path) == ["_versions", "version=0000000003", "version=0000000004"]


def windowed(events):
    """By windows over whole files."""
    so_far = Window.partitionBy("file").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    whole = so_far.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = so_far.rowsBetween(Window.unboundedPreceding, -1)
    named = events.withColumn("model_raw", F.coalesce(F.last("marker", ignorenulls=True).over(so_far), F.first("marker", ignorenulls=True).over(whole), F.lit(rollout.UNATTRIBUTED)))
    return named.where("is_token AND ts IS NOT NULL").withColumn("previous", F.last("total", ignorenulls=True).over(before))


def random_events(spark, rows, files, seed):
    r = lambda k: F.rand(seed + k)
    total = F.struct((F.col("id") * 7 % 5000 + F.col("id")).alias("input"), (F.col("id") % 90).alias("cached"), (F.col("id") * 3).alias("output"))
    marker = F.when(r(1) < 0.02, F.concat(F.lit("m"), F.floor(r(2) * 4)))
    base = spark.range(rows).select(F.col("id").alias("ord"), F.when(F.col("id") % files > 0, F.col("id") % files).alias("file"), F.when(r(3) > 0.1, F.timestamp_seconds("id")).alias("ts"), F.lit("a").alias("account"), marker.alias("marker"), F.when(r(4) > 0.3, total).alias("total"), F.when(r(5) < 0.2, total).alias("last"))
    return base.withColumn("is_token", F.col("marker").isNull()).cache()


@pytest.mark.parametrize(("files", "chunk", "struct"), [(1, 50, False), (7, 10, False), (3, 1, True), (2, 10_000, True)])
def test_carry_scan_equals_windows_over_files(spark, monkeypatch, files, chunk, struct):
    monkeypatch.setattr(rollout, "CHUNK_LINES", chunk)
    events = random_events(spark, 3000, files, files)
    if struct:
        events = events.withColumn("ord", F.struct(F.lit("f").alias("file"), F.floor(F.col("ord") / 700).alias("block"), F.col("ord").alias("line")))
    rows = windowed(events).select("ord", "model_raw", "previous.input").collect()
    seen = rollout.carry_scan(events, before={"previous": rollout._total()}, upto={"_latest": F.col("marker")}, first={"_first": F.col("marker")})
    got = rollout._named(seen).where("is_token AND ts IS NOT NULL").select("ord", "model_raw", "previous.input").collect()
    assert sorted(map(str, got)) == sorted(map(str, rows))


def test_one_huge_file_is_many_tasks(spark):
    events = random_events(spark, 300_000, 1, 3)
    used = rollout.rollout_usage(events)
    rows = used.count()
    tasks = used.select(F.spark_partition_id().alias("p")).distinct().count()
    assert rows > 100_000 and tasks == 4  # all shuffle partitions of the session
    plan = used._jdf.queryExecution().optimizedPlan().toString()
    # files are windows over a row for each chunk only
    assert plan.count("Window") == 2
