"""The one-pass source of log lines against reading whole files, for any blocks."""

import json
import random
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meterglass.sources import blocks, store
from meterglass.sources.lines import ingest_quality, prefilter, scan_lines, scan_usage, write_files


def random_bytes(rng):
    text = b"".join(rng.choice([b"", b"a", b"bc", b"\xff\xfe", "ä漢".encode(), b" ", b"\r", b"x" * rng.randint(0, 40)]) + rng.choice([b"\n", b"\n", b"", b"\n\n"]) for _ in range(rng.randint(0, 30)))
    return text


@pytest.mark.parametrize("read", [1, 3, 7, 4096])
def test_blocks_give_every_ended_line_once(tmp_path, monkeypatch, read):
    monkeypatch.setattr(blocks, "READ_BYTES", read)
    rng = random.Random(read)
    for k in range(60):
        folder = tmp_path / str(k)
        folder.mkdir()
        want = {}
        for n in range(rng.randint(1, 3)):
            data = random_bytes(rng)
            (folder / f"{n}.jsonl").write_bytes(data)
            want[f"file:{folder}/{n}.jsonl"] = [x for x in data.split(b"\n")[:-1] if x.strip(b" \t\r\f\v")]
        reader = blocks.BlockReader([str(folder)], "*.jsonl", rng.choice([1, 2, 5, 16, 1000]), rng.choice([1, 10, 100]))
        got = {name: [] for name in want}
        for part in reader.partitions():
            for batch in reader.read(part):
                for value, file, at, line in zip(batch["value"].cast("binary").to_pylist(), batch["file"].to_pylist(), batch["block"].to_pylist(), batch["line"].to_pylist()):
                    got[file].append((at, line, value))
        assert {name: [v for _, _, v in sorted(rows, key=lambda r: r[:2])] for name, rows in got.items()} == want
        assert all(len({r[:2] for r in rows}) == len(rows) for rows in got.values())


def test_listing(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "_hidden").mkdir()
    (tmp_path / "_part=1").mkdir()
    for name in ("a/x.jsonl", "_hidden/y.jsonl", "_part=1/z.jsonl", "a/.t.jsonl", "a/u.txt"):
        (tmp_path / name).write_text("1\n")
    (tmp_path / "a/empty.jsonl").write_text("")
    names = [f.shown.removeprefix(f"file:{tmp_path}/") for f in blocks.listed([f"file:{tmp_path}", str(tmp_path / "a/x.jsonl")], "*.jsonl")]
    assert names == ["_part=1/z.jsonl", "a/x.jsonl"]
    with pytest.raises(FileNotFoundError):
        blocks.listed([str(tmp_path / "none")], "*")


def test_a_scan_is_one_pass_and_runs_nothing_beforehand(spark, tmp_path):
    for n in range(5):
        (tmp_path / f"{n}.jsonl").write_text("".join(f"line {k} of {n}\n" for k in range(1000)) + "open line")
    tracker = spark.sparkContext.statusTracker()
    group = f"scan-{tmp_path}"
    spark.sparkContext.setJobGroup(group, "scan")
    lines = scan_lines(spark, str(tmp_path), block=4096)
    assert tracker.getJobIdsForGroup(group) == []
    assert lines.count() == 5000 and lines.where("value LIKE 'open%'").isEmpty()
    spark.sparkContext.setJobGroup("other", "other")
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchScan") == 1
    first = lines.groupBy("file").agg(F.min_by("value", "ord").alias("a"), F.max_by("value", "ord").alias("b")).orderBy("file").collect()
    assert [(r["a"], r["b"]) for r in first] == [(f"line 0 of {n}", f"line 999 of {n}") for n in range(5)]


def test_usage_scan_gives_candidates_and_counts(spark, tmp_path):
    rng = random.Random(1)
    some = ['{"usage": 1, "type": "assistant"}', '{"usage": 1}', '{"payload": "token_count"}', "  \t", "", "other", '{"x": "turn_context"', "assistant"]
    want = {}
    for n in range(4):
        rows = [rng.choice(some) for _ in range(rng.choice([0, 1, 50, 400]))]
        (tmp_path / f"{n}.jsonl").write_bytes("".join(r + "\n" for r in rows).encode() + b"\xff\xfe\nopen \"token_count\"")
        want[n] = (sum(bool(r.strip()) for r in rows) + 1, sum(r in (some[0], some[2], some[6]) for r in rows))
    got = scan_usage(spark, str(tmp_path), block=300)
    per = {int(r["file"][-7]): (r["n"], r["c"]) for r in got.groupBy("file").agg(F.sum("lines").alias("n"), F.count("value").alias("c")).collect()}
    assert per == want
    lines = scan_lines(spark, str(tmp_path), block=300)
    assert sorted(map(str, ingest_quality(lines).collect())) == sorted(map(str, ingest_quality(got).collect()))
    kept = got.where("value IS NOT NULL").select("value", "ord")
    assert sorted(map(str, kept.collect())) == sorted(map(str, lines.where(prefilter(F.col("value"))).select("value", "ord").collect()))


def test_a_scan_by_a_listing_is_that_by_paths(spark, tmp_path):
    rng = random.Random(2)
    for n in range(40):
        rows = [json.dumps({"usage": 1, "type": "assistant", "n": n, "k": k}) if rng.random() < 0.7 else "other" for k in range(rng.choice([0, 1, 30, 900]))]
        (tmp_path / f"{n}.jsonl").write_text("".join(r + "\n" for r in rows) + "open assistant \"usage\"")
    want = sorted(map(str, scan_usage(spark, str(tmp_path), block=4000).collect()))
    listing = store.file_listing(spark, str(tmp_path))
    assert sorted(map(str, scan_usage(spark, listing=listing, block=4000).collect())) == want
    assert scan_usage(spark, listing=listing.where("size < 0")).isEmpty()


def test_a_listing_has_tasks_by_files_read_or_not(spark, tmp_path):
    for n in range(300):
        (tmp_path / f"{n}.jsonl").write_text("x" * n + "\n")
    tasks = lambda: store.file_listing(spark, str(tmp_path)).rdd.getNumPartitions()
    before = tasks()
    with store.files_unread(spark):
        assert tasks() <= spark.sparkContext.defaultParallelism < before
        assert store.file_listing(spark, str(tmp_path)).agg(F.sum("size")).first()[0] == sum(range(1, 301))
    assert tasks() == before


def test_rows_of_short_files_go_on_together():
    batches = [pa.RecordBatch.from_pydict({"a": list(range(k, k + 7))}) for k in range(0, 70_000, 7)]
    got = list(blocks.together(iter(batches)))
    assert len(got) == 8 and pa.Table.from_batches(got)["a"].to_pylist() == list(range(70_000))
    assert list(blocks.together(iter([]))) == []


def test_files_are_written_whole_and_in_order(spark, tmp_path):
    rows = spark.range(5000).select(F.concat(F.lit("a/"), (F.col("id") % 300).cast("string"), F.lit(".txt")).alias("path"), F.col("id").alias("ord"), F.concat(F.lit("ü "), F.col("id").cast("string")).alias("value"))
    for _ in range(2):  # the second time, each is replaced by the same
        write_files(rows, f"file:{tmp_path}/x")
    files = {p.name: p.read_text() for p in (tmp_path / "x/a").iterdir()}
    assert files == {f"{n}.txt": "".join(f"ü {k}\n" for k in range(n, 5000, 300)) for n in range(300)}


def test_a_file_of_a_stopped_task_is_not_seen(tmp_path):
    def batches():
        yield pa.RecordBatch.from_pydict({"path": ["a", "a", "b"], "value": ["1\n", "2\n", "3\n"]})
        raise RuntimeError("stop")

    with pytest.raises(RuntimeError):
        blocks.FileWriter(str(tmp_path)).write(batches())
    assert {p.name: p.read_text() for p in Path(tmp_path).iterdir()} == {"a": "1\n2\n"}
