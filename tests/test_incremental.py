"""Facts by file against a full rebuild, and digests of sets."""

import json
import os

import pytest
from pyspark.sql import functions as F

from meterglass.plans.report import log_facts
from meterglass.sources import incremental, snapshots, store

ROOTS = "label string, path string, source string, enabled boolean, root_rank int"


def usage(n, key, ts="2026-06-01T10:00:00Z"):
    return json.dumps({"type": "assistant", "requestId": f"r{key}", "timestamp": ts, "message": {"id": key if key is None else f"m{key}", "model": "x", "usage": {"input_tokens": n}}})


def token(n, model=None):
    if model:
        return json.dumps({"type": "turn_context", "payload": {"model": model}})
    return json.dumps({"timestamp": "2026-06-01T11:00:00Z", "type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": n, "output_tokens": n}}}})


def write(path, *rows, ended=True):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(r + "\n" for r in rows[:-1]) + rows[-1] + ("\n" if ended else ""))


def rows_of(df):
    return sorted(map(str, df.select(*incremental.FACTS).collect()))


@pytest.fixture
def refreshed(spark, tmp_path):
    logs, path = tmp_path / "logs", str(tmp_path / "store")
    claude = spark.createDataFrame([("home", f"{logs}/home", "config", True, 0), ("work", f"{logs}/work", "config", True, 1)], ROOTS)
    codex = spark.createDataFrame([("win", f"{logs}/home", "config", True, 0)], ROOTS)

    def run():
        changed = incremental.refresh(spark, path, str(logs), claude_roots=claude, codex_roots=codex)
        assert rows_of(incremental.facts(spark, path)) == rows_of(log_facts(spark, [str(logs)], claude, codex)[0])
        return changed

    return logs, path, run


def test_refreshes_equal_full_rebuilds(spark, refreshed, monkeypatch):
    logs, path, run = refreshed
    write(logs / "home/a.jsonl", usage(1, 1), usage(9, 2, "bad"), usage(3, None), token(5), token(0, "gpt-5.4"))
    write(logs / "home/b.jsonl", usage(5, 1), usage(2, 2), usage(4, 3))
    write(logs / "work/c.jsonl", usage(8, 2), usage(7, 5), usage(1, 6), ended=False)
    write(logs / "work/d.jsonl", token(50), token(70), usage(3, 1))
    assert run() and not run()
    write(logs / "work/c.jsonl", usage(8, 2), usage(7, 5), usage(1, 6), usage(2, 7))  # grown, its open line ended
    write(logs / "home/a.jsonl", usage(9, 2, "bad"), token(6))  # cut
    assert run()
    (logs / "work/sub").mkdir()
    (logs / "home/b.jsonl").rename(logs / "work/sub/b.jsonl")  # moved to another account
    (logs / "work/d.jsonl").unlink()
    os.utime(logs / "home/a.jsonl", (1e9, 1e9))  # touched
    write(logs / "home/e.jsonl", usage(100, 1), token(1))
    assert run()
    monkeypatch.setattr(incremental, "MOST_RUNS", 2)  # runs are put together
    write(logs / "home/f.jsonl", usage(100, 2))
    assert run()
    assert incremental.ledger_of(spark, path).select("run").distinct().count() == 1
    incremental.vacuum(spark, path, keep=1)
    assert len(snapshots.names(spark, f"{path}/runs")) == 1
    assert rows_of(incremental.facts(spark, path))
    for f in logs.rglob("*.jsonl"):
        f.unlink()
    write(logs / "home/z.jsonl", "no usage")
    assert run() and rows_of(incremental.facts(spark, path)) == []


def test_a_refresh_writes_no_file_for_each_bucket_or_log(spark, sf, refreshed, monkeypatch):
    """States and facts have a file for a task at most, not one for each bucket and task, and generated logs share folders."""
    from meterglass.plans import events as ev
    from meterglass.plans import queries

    logs, path, run = refreshed
    for n in range(60):
        write(logs / f"home/{n % 3}/{n}.jsonl", *[usage(k, f"{n}-{k}") for k in range(30)])
    assert run()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for kind in ("runs/run=1/usage", "facts/gen=1"):
        assert 0 < sum(name.endswith(".parquet") for _, _, names in os.walk(f"{path}/{kind}") for name in names) <= tasks
    made = []
    shared = ev.shared_folder
    monkeypatch.setattr(ev, "shared_folder", lambda *a: made.append(shared(*a)) or made[-1])
    queries.facts_by_file(spark, sf)
    users = ev.events(spark, sf).select("user_id").distinct().count()
    assert 0 < sum(len(folders) for _, folders, _ in os.walk(made[1].removeprefix("file:"))) < users


def test_unchanged_files_are_not_opened(spark, refreshed):
    logs, path, run = refreshed
    write(logs / "home/a.jsonl", usage(1, 1), usage(3, None))
    write(logs / "home/b.jsonl", usage(5, 7))
    assert run()
    held = os.stat(logs / "home/a.jsonl")
    before = rows_of(incremental.facts(spark, path))
    (logs / "home/a.jsonl").write_text("x" * held.st_size)
    os.utime(logs / "home/a.jsonl", ns=(held.st_atime_ns, held.st_mtime_ns))
    write(logs / "home/b.jsonl", usage(5, 7), "other")
    none = spark.createDataFrame([("home", f"{logs}/home", "config", True, 0)], ROOTS)
    assert incremental.refresh(spark, path, str(logs), claude_roots=none, codex_roots=none)
    assert rows_of(incremental.facts(spark, path)) == before


@pytest.mark.parametrize("step", ["scan_usage", "_merged", "mark"])
def test_a_stopped_refresh_leaves_the_old_facts(spark, refreshed, monkeypatch, step):
    logs, path, run = refreshed
    write(logs / "home/a.jsonl", usage(1, 1))
    assert run()
    before = rows_of(incremental.facts(spark, path))
    write(logs / "home/b.jsonl", usage(5, 1), token(9))

    def stop(*_, **__):
        raise RuntimeError(step)

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(snapshots if step in ("publish", "mark") else incremental, step, stop)
        run()
    assert rows_of(incremental.facts(spark, path)) == before
    assert run()


def test_stored_facts_stay_when_a_writer_stops(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    some = spark.createDataFrame([(1, "claude")], "n long, provider string").withColumn("ts", F.timestamp_seconds("n"))
    store.write_facts(some, path)
    with pytest.raises(Exception):
        store.write_facts(some.withColumn("n", F.raise_error(F.lit("stop")).cast("long")), path)
    monkeypatch.setattr(snapshots, "mark", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.write_facts(some.unionByName(some), path)
    assert store.read_facts(spark, path).count() == 1


def test_digests_of_sets_add_up(spark):
    rows = spark.range(300).select((F.col("id") % 40).alias("a"), F.when(F.col("id") % 3 > 0, F.lit("x")).alias("b"))
    whole = store.set_digest(rows).first()
    assert store.set_digest(rows.repartition(7)).first() == whole == store.set_digest(rows.orderBy(F.desc("a")).coalesce(1)).first()
    parts = [store.set_digest(rows.where(F.col("a") % 2 == k)) for k in range(2)]
    assert store.added_digests(parts[0].unionByName(parts[1])).first() == whole
    other = rows.withColumn("b", F.when(F.col("a") == 7, "y").otherwise(F.col("b")))
    assert store.set_digest(other).first() != whole
    out = store.set_digest(rows.where("a = 7")).withColumn("n", -F.col("n"))
    changed = store.added_digests(store.set_digest(rows).unionByName(out).unionByName(store.set_digest(other.where("a = 7"))))
    assert changed.first() == store.set_digest(other).first()
    assert store.set_digest(rows.limit(0)).first()["n"] == 0
    plan = store.set_digest(rows)._jdf.queryExecution().executedPlan().toString()
    assert "collect" not in plan
