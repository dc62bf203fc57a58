"""Operators on small hand-made rows."""

import datetime as dt
import itertools
import json
import time

import pytest
from pyspark.sql import functions as F

from meterglass.functions import text
from meterglass.functions.calendar import day_end_us, day_start_us, iso_timestamp
from meterglass.operators import limits, merge, pricing, rollout, series, windows
from meterglass.operators.accounts import tag_accounts
from meterglass.plans.report import ingest_counts
from meterglass.sources import extract, lines, store
from meterglass.streaming import usage as st

LINE = "ord long, ts timestamp, request_id string, message_id string, model_raw string, account string, provider string, input_tokens long, output_tokens long, cache_read long, cache_creation long, eph_5m long, eph_1h long"
T = dt.datetime(2026, 6, 1, 12)
NOW = 1_000_000_000


def line(n, ts, r, m, counters, eph=(None, None)):
    return (n, ts, r, m, "claude-opus-4-8", "a", "claude", *counters, *eph)


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def test_merge_takes_maxima_and_the_first_line(spark):
    rows = [line(0, T, "r", "m", (300, 7, 800, 100)), line(1, T, "r", "m", (900, 2000, 200, 400)), line(2, T, "r", "m", (600, 500, 500, 250), (1, None))]
    got = merge.merge_usage(spark.createDataFrame(rows, LINE)).collect()
    assert [(g.input_tokens, g.output_tokens, g.cache_read, g.cache_creation, g.eph_5m, g.eph_1h, g.ord) for g in got] == [(900, 2000, 800, 400, 1, None, 0)]


def test_merge_starts_at_the_first_dated_line_and_takes_later_undated_ones(spark):
    rows = [line(0, None, "r", "m", (999, 0, 0, 0)), line(1, T, "r", "m", (1, 0, 0, 0)), line(2, None, "r", "m", (5, 0, 0, 0)), line(3, None, "x", "y", (7, 0, 0, 0))]
    assert [(g.input_tokens, g.ord) for g in merge.merge_usage(spark.createDataFrame(rows, LINE)).collect()] == [(5, 1)]


def test_lines_without_message_id_stay_alone_and_null_requests_form_a_key(spark):
    rows = [line(0, T, "r", None, (1, 0, 0, 0)), line(1, T, "r", "", (2, 0, 0, 0)), line(2, T, None, "m", (3, 0, 0, 0)), line(3, T, None, "m", (4, 0, 0, 0))]
    assert sorted(g.input_tokens for g in merge.merge_usage(spark.createDataFrame(rows, LINE)).collect()) == [1, 2, 4]


@pytest.mark.parametrize("exact", [True, False])
def test_streamed_merges_equal_the_batch_merge(spark, tmp_path, exact):
    """Null and empty ids, and lines without a timestamp, over several batches in another order than that of the lines."""
    T2 = dt.datetime(2026, 6, 2)
    chunks = [
        [line(9, T2, "r", None, (1, 0, 0, 0)), line(5, None, "q", "m", (50, 1, 0, 0)), line(6, T, "q", "m", (6, 0, 0, 0)), line(0, None, "q", "m", (900, 0, 0, 0))],
        [line(1, T, "r", None, (2, 0, 0, 0)), line(2, T, "r", "", (3, 0, 0, 0)), line(3, T2, "q", "m", (1, 9, 0, 0)), line(4, None, None, "m", (4, 0, 0, 0))],
        [line(7, T, None, None, (7, 0, 0, 0)), line(8, None, None, None, (8, 0, 0, 0)), line(10, T, None, "m", (5, 0, 0, 0), (2, None)), line(11, None, None, "m", (9, 0, 0, 0)), line(12, T, "r", "", (3, 0, 0, 0))],
        [line(13, T, None, None, (7, 0, 0, 0)), line(14, T, None, "", (7, 0, 0, 0)), line(15, None, "z", "z", (1, 0, 0, 0))],
    ]
    landing, folder = str(tmp_path / "landing"), str(tmp_path / "stream")
    for rows in chunks:
        spark.createDataFrame(rows, LINE).coalesce(1).write.mode("append").parquet(landing)
    lines_ = spark.readStream.schema(LINE).option("maxFilesPerTrigger", 1).parquet(landing)
    if exact:
        st.run_updates(lines_, folder, st.ingest_usage(f"{folder}/log"), "append")
        got = st.merged_log(spark, f"{folder}/log")
    else:
        st.run_updates(st.merged_stream(lines_), folder)
        got = st.newest(spark, f"{folder}/rows", *st.MERGE_KEY).select("first.*", *merge.COUNTERS)
    columns = ["ts", "model_raw", "account", "provider", *merge.COUNTERS]
    want = merge.merge_usage(spark.createDataFrame(sum(chunks, []), LINE)).select(columns)
    found = sorted(map(str, got.select(columns).collect()))
    assert found == sorted(map(str, want.collect())) and len(found) == 9


def test_long_context_price(spark):
    rates = spark.createDataFrame([("m", 5.0, 30.0, 0.5, None, 272000.0, 2.0, 1.5)], f"model string, {pricing.RATES}")
    facts = spark.createDataFrame([(T, "m", "claude", 100000, 1000, 200000, 0, 0, 0), (T, "other", "claude", 1, 1, 1, 1, None, None)], "ts timestamp, model_raw string, provider string, input_tokens long, output_tokens long, cache_read long, cache_creation long, eph_5m long, eph_1h long")
    got = {r.model_norm: (r.known, r.cost) for r in pricing.price_facts(facts, rates).collect()}
    assert got["m"] == (True, pytest.approx(1.245)) and got["other"] == (False, 0.0)


def test_sample_log(spark, tmp_path):
    usage = {"input_tokens": 1000, "output_tokens": 1, "cache_read_input_tokens": 10000, "cache_creation_input_tokens": 4000, "cache_creation": {"ephemeral_5m_input_tokens": 1000, "ephemeral_1h_input_tokens": 3000}}
    record = lambda i, model, u, ts="2026-06-01T10:00:00Z": json.dumps({"type": "assistant", "requestId": f"q{i}", "timestamp": ts, "message": {"id": f"m{i}", "model": model, "usage": u}})
    text_lines = [
        record(1, "claude-opus-4-8", usage), record(1, "claude-opus-4-8", usage | {"output_tokens": 2000}), record(2, "claude-sonnet-4-6[1m]", {"input_tokens": True, "output_tokens": "12", "cache_read_input_tokens": 1.5}),
        '{"type": "assistant", "usage": ', record(3, "<synthetic>", usage), '{"type": "user", "message": {"usage": 1}}', record(4, "x", usage, "2026"), record(5, "x", usage)[:-1] + '} "assistant" x', "",
    ]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "s.jsonl").write_text("\n".join(text_lines) + "\n")
    (tmp_path / "b.jsonl").write_text(record(6, "x", usage) + "\n" + record(7, "x", usage))
    scanned = lines.scan_lines(spark, str(tmp_path))
    assert scanned.count() == 9
    quality = {r.file.rsplit("/", 1)[1]: (r.lines, r.malformed) for r in lines.ingest_quality(scanned).collect()}
    assert quality == {"s.jsonl": (8, 2), "b.jsonl": (1, 0)}
    got = merge.merge_usage(extract.usage_lines(lines.parsed(scanned)).withColumns({"account": F.lit("a"), "provider": F.lit("claude")}))
    rows = sorted((r.model_raw, r.input_tokens, r.output_tokens, r.cache_read, r.cache_creation, r.eph_5m) for r in got.collect())
    assert rows == [("claude-opus-4-8", 1000, 2000, 10000, 4000, 1000), ("claude-sonnet-4-6[1m]", 1, 0, 0, 0, None), ("x", 1000, 1, 10000, 4000, 1000)]
    cost = pricing.price_facts(got.where("model_raw = 'claude-opus-4-8'"), pricing.default_prices(spark)).first()["cost"]
    assert cost == pytest.approx(1000 * 5e-6 + 2000 * 25e-6 + 10000 * 0.5e-6 + 1000 * 6.25e-6 + 3000 * 10e-6)


def test_creation_total_comes_from_its_parts(spark):
    body = {"type": "assistant", "timestamp": "20260601T000000", "message": {"model": "x", "usage": {"cache_creation": {"ephemeral_5m_input_tokens": 2, "ephemeral_1h_input_tokens": 3}}}}
    df = lines.parsed(spark.createDataFrame([(json.dumps(body), "f", 0)], "value string, file string, ord long"))
    row = extract.usage_lines(df).first()
    assert (row.cache_creation, row.eph_5m, row.eph_1h, row.ts) == (5, 2, 3, dt.datetime(2026, 6, 1))


def test_rollout_log(spark):
    total = lambda i, c, o: {"input_tokens": i, "cached_input_tokens": c, "output_tokens": o}
    token = lambda ts, info: json.dumps({"timestamp": ts, "type": "event_msg", "payload": {"type": "token_count", "info": info}})
    marker = json.dumps({"type": "turn_context", "payload": {"model": "gpt-5.4"}})
    values = [token("2026-06-01T10:00:00Z", {"total_token_usage": total(100, 40, 10)}), token("bad", {"total_token_usage": total(9000, 0, 0)}), token("2026-06-01T10:01:00Z", {"total_token_usage": total(250, 100, 30)}), token("2026-06-01T10:02:00Z", {}), marker]
    df = lines.parsed(spark.createDataFrame([(v, "f", k) for k, v in enumerate(values)], "value string, file string, ord long"))
    got = rollout.rollout_usage(extract.rollout_events(df).withColumn("account", F.lit("c"))).orderBy("ord").collect()
    assert [(r.input_tokens, r.cache_read, r.output_tokens, r.model_raw) for r in got] == [(60, 40, 10, "gpt-5.4"), (90, 60, 20, "gpt-5.4")]


def facts(spark, rows):
    schema = "ts timestamp, model_norm string, known boolean, cost double, provider string, account string, input_tokens long, output_tokens long, cache_read long, cache_creation long, total_tokens long"
    return spark.createDataFrame([(dt.datetime.fromtimestamp(NOW - age, dt.UTC).replace(tzinfo=None), "m", True, n / 10, "claude", "a", n, 0, 0, 0, n) for age, n in rows], schema)


def test_window_edges(spark):
    rows = [(1800, 10), (3600, 100), (3601, 7), (7200, 1000), (36000, 10000), (259200, 50000), (604800, 3), (604801, 8), (1209600, 100000)]
    now = F.lit(NOW * 1_000_000)
    got = {r.window: r.input_tokens for r in windows.rolling_windows(facts(spark, rows), now).collect()}
    assert got == {"1h": 110, "5h": 1117, "24h": 11117, "7d": 61120, "all": 161128}
    by_model = {r.window: r.input_tokens for r in windows.window_by_model(facts(spark, rows), now).collect()}
    assert by_model == got
    assert windows.rolling_windows(facts(spark, rows).limit(0), now).where("records = 0").count() == 5


def test_series_edges(spark):
    now = F.lit(NOW * 1_000_000)
    got = series.activity_series(facts(spark, [(18000, 1), (17999, 2), (0, 4), (-1, 8)]), now, "5h", "tokens")
    assert {r.bucket: r.value for r in got.where("value > 0").collect()} == {0: 2.0, 47: 4.0}
    levels = {r.bucket: (r.level, r.row_0, r.row_2) for r in series.series_levels(got).collect()}
    assert levels[47] == (12, 4, 4) and levels[0] == (6, 4, 0) and levels[5] == (1, 1, 0)


def test_days_may_have_23_or_25_hours(spark):
    size = lambda d: one(spark, day_end_us(F.col("d").cast("date"), "America/New_York") - day_start_us(F.col("d").cast("date"), "America/New_York"), d=d) + 1
    assert [size(d) // 3_600_000_000 for d in ("2026-03-08", "2026-06-01", "2026-11-01")] == [23, 24, 25]


@pytest.mark.parametrize(("raw", "norm"), [("X[1m]", "x"), ("claude-haiku-4-5-20251001", "claude-haiku-4-5"), ("gpt-5.4-2026-03-05", "gpt-5.4"), ("us.anthropic.claude-opus-4-8", "claude-opus-4-8"), (" A ", "a"), (None, ""), ("", "")])
def test_normalize_model(spark, raw, norm):
    assert one(spark, text.normalize_model(F.col("m").cast("string")), m=raw) == norm


def test_labels(spark):
    assert [one(spark, text.human_duration(F.col("s")), s=s) for s in (356400, 7860, 65, 7, 0)] == ["4d03h", "2h11m", "1m05s", "7s", "now"]
    assert [one(spark, text.human_tokens(F.col("n")), n=n) for n in (999, 1234, 2500, 1_100_000, 12_300_000, 2_000_000_000, -5)] == ["999", "1K", "2K", "1.1M", "12.3M", "2.0B", "-5"]
    assert [one(spark, text.human_money(F.col("n")), n=n) for n in (58.05, 1234.5)] == ["$58.05", "$1,234.50"]
    assert [one(spark, text.limit_label(F.col("n"), F.lit("primary")), n=n) for n in (10080, 300, 4320, 20160, 7, 0)] == ["WEEKLY", "5-HOUR", "3-DAY", "2-WEEK", "7-MIN", "PRIMARY"]
    assert [one(spark, text.pretty_model(F.col("m")), m=m) for m in ("claude-opus-4-8", "claude-fable-5", "gpt-5.5", "")] == ["Opus 4.8", "Fable 5", "gpt-5.5", "(unknown)"]


def test_newest_limit_snapshot_wins_and_ties_go_to_the_later(spark):
    rows = [("a", 10.0, 0, 10), ("a", 12.0, 1, 28), ("a", 11.0, 2, 19), ("b", None, 0, 1), ("b", None, 1, 2), ("c", 5.0, 0, 1), ("c", 5.0, 1, 2)]
    df = spark.createDataFrame(rows, "account string, captured_at double, ord long, buckets long")
    assert {r.account: r.buckets for r in limits.latest_limits(df).collect()} == {"a": 28, "b": 2, "c": 2}


RESPONSE = "provider string, account string, captured_at double, response long, raw string"


def test_landed_responses_give_buckets_or_a_warning(spark):
    item = lambda kind, p, **more: {"kind": kind, "percent": p, "resets_at": "2026-06-01T12:00:00Z", **more}
    bodies = [
        ("claude", {"limits": [item("session", 26), item("weekly_scoped", 35.5, scope={"model": {"id": "opus-x"}}), item("weekly_scoped", 4, scope={"surface": "web"}), item("odd_kind", 1), item("session", "no"), 3, item(None, True)]}),
        ("claude", {"limits": [item("session", None)], "five_hour": {"utilization": 69, "resets_at": 1780315200}, "x": 1}),
        ("claude", {"limits": [], "seven_day": {"utilization": None, "resets_at": 1}}), ("claude", [1]), ("claude", "not json {"), ("claude", None),
        ("codex", {"rateLimitsByLimitId": {"std": {"limitName": "Std", "primary": {"usedPercent": 99, "windowDurationMins": 300, "resetsAt": 5}, "secondary": None}}}),
        ("codex", {"rateLimits": {"individualLimit": {"usedPercent": 35, "resetsAt": 7}}}), ("codex", {"rateLimitsByLimitId": {"std": {}}, "rateLimits": {"primary": {"usedPercent": 1, "resetsAt": 1}}}),
    ]
    # all of one account and second: the response's id alone tells them apart
    rows = [(p, "a", 100.0, k, b if b is None or isinstance(b, str) else json.dumps(b)) for k, (p, b) in enumerate(bodies)]
    buckets, warnings = limits.landed_limits(spark.createDataFrame(rows, RESPONSE).repartition(3))
    got = {}
    for r in buckets.collect():
        got.setdefault(r.response, {})[r.key] = (r.label, r.used_percentage, r.window_minutes)
    assert got == {
        0: {"session": ("5-HOUR", 26.0, None), "weekly_scoped": ("OPUS-X WEEKLY", 35.5, None), "weekly_scoped_2": ("WEB WEEKLY", 4.0, None), "odd_kind": ("ODD KIND", 1.0, None), "limit_6": ("LIMIT 6", 1.0, None)},
        1: {"five_hour": (None, 69.0, None)}, 6: {"std_primary": ("STD 5-HOUR", 99.0, 300.0)}, 7: {"codex_individualLimit": ("INDIVIDUALLIMIT", 35.0, None)},
    }
    told = {r.response: r.warning for r in warnings.collect()}
    assert set(told) == {2, 3, 4, 5, 8} and told[2] == "Claude returned no usable usage limits" and told[3] == told[4] == told[5] == "Claude returned an invalid usage response" and told[8].startswith("Codex returned no")
    plan = buckets._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("REPARTITION_BY_NUM")


def test_limit_expiry(spark):
    df = spark.createDataFrame([(70.0, 1000.0), (70.0, 2000.0)], "used_percentage double, resets_at double")
    got = [(r.shown_percentage, r.note) for r in limits.limit_status(df, F.lit(1000)).orderBy("resets_at").collect()]
    assert got == [(0.0, "reset just now · refresh pending"), (70.0, "resets in 16m40s")]


def test_price_file_is_tolerant(spark, tmp_path):
    path = tmp_path / "p.json"
    path.write_text(json.dumps({"models": {"A": {"input": "1.5", "output": 2, "cache_read": "x"}, "b": {"input": 1}, "c": 3}}))
    assert [(r.model, r.input, r.output, r.cache_read) for r in store.price_file(spark, str(path)).collect()] == [("a", 1.5, 2.0, None)]
    path.write_text("not json")
    assert store.price_file(spark, str(path)).count() == 0


def test_fingerprint_ignores_order(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string"), spark.createDataFrame([(2, None), (1, "x")], "k int, v string")
    c = spark.createDataFrame([(2, "y"), (1, "x")], "k int, v string")
    digests = [store.fingerprint(d).first()["digest"] for d in (a, b, c)]
    assert digests[0] == digests[1] != digests[2]


def test_first_enabled_root_wins(spark):
    roots = spark.createDataFrame([("off", "/d", "config", False, 0), ("one", "/d/x", "config", True, 1), ("two", "/d", "config", True, 2)], "label string, path string, source string, enabled boolean, root_rank int")
    files = spark.createDataFrame([("/d/x/f",), ("/d/f",), ("/dd/f",)], "path string")
    assert {r.path: r.account for r in tag_accounts(files, F.col("path"), roots, "none").collect()} == {"/d/x/f": "one", "/d/f": "two", "/dd/f": "none"}


def test_roots_of_all_depths(spark):
    roots = spark.createDataFrame([(f"r{k}", path, "config", path != "/off", k) for k, path in enumerate(["/a/b/c", "/a/", "/a/b", "/x y", "/off", "/a/b/c/d/e", "/a/b/c"])], "label string, path string, source string, enabled boolean, root_rank int")
    paths = ["/a/b/c/f", "/a/b/f", "/a/f", "/a", "/a/b/c/d/e/f/g", "/x y/f", "/off/f", "/ab/f", "f", "", None]
    got = {r.path: r.account for r in tag_accounts(spark.createDataFrame([(p,) for p in paths], "path string"), F.col("path"), roots, "none").collect()}
    assert got == dict(zip(paths, ["r0", "r1", "r1", "none", "r0", "r3", "none", "none", "none", "none", "none"], strict=True))
    assert tag_accounts(spark.createDataFrame([("/a/f",)], "path string"), F.col("path"), roots.limit(0), "none").first()["account"] == "none"


def test_models_before_and_after_markers(spark):
    rows = [("f", k, m) for k, m in enumerate([None, None, "a", None, "b", None])] + [("g", k, None) for k in range(3)] + [("h", 0, "c"), ("h", 1, None)]
    got = rollout.attribute_models(spark.createDataFrame(rows, "file string, ord long, marker string").repartition(4), F.col("marker"))
    assert [r.model_raw for r in got.orderBy("file", "ord").collect()] == ["a", "a", "a", "a", "b", "b", *["codex-unattributed"] * 3, "c", "c"]


def test_attribution_of_a_long_file_is_linear(spark):
    events = spark.range(300_000).select(F.lit("f").alias("file"), F.col("id").alias("ord"), F.when(F.col("id") == 299_999, "late").alias("marker"))
    start = time.monotonic()
    assert rollout.attribute_models(events, F.col("marker")).where("model_raw = 'late'").count() == 300_000
    assert time.monotonic() - start < 60


def test_facts_are_made_again_only_for_other_dimensions(spark, tmp_path):
    prices, roots = pricing.default_prices(spark), spark.createDataFrame([("a", "/a")], "label string, path string")
    made = []

    def make():
        made.append(1)
        return merge.merge_usage(spark.createDataFrame([line(0, T, "r", "m", (1, 2, 3, 4))], LINE))

    path = str(tmp_path / "store")
    runs = [store.refresh_facts(make, path, *dims) for dims in ((prices, roots), (prices.orderBy("model"), roots), (prices.where("input > 1"), roots), (prices.where("input > 1"), roots.withColumn("path", F.lit("/b"))))]
    assert runs == [True, False, True, True] and len(made) == 3
    assert store.read_facts(spark, path).count() == 1


def claude_text(n, ts="2026-06-01T10:00:00Z", key=0, **more):
    return json.dumps({"type": "assistant", "requestId": f"r{key}", "timestamp": ts, "message": {"id": f"m{key}", "model": "claude-opus-4-8", "usage": {"input_tokens": n}}, **more})


def test_streamed_log_text_equals_a_batch_scan_and_a_moved_file_counts_once(spark, tmp_path):
    landing, folder = tmp_path / "landing", str(tmp_path / "stream")
    (landing / "active").mkdir(parents=True)
    chunks = [[claude_text(5, "bad", 1), claude_text(7, key=1), "", "{broken \"usage\" assistant"], [claude_text(9, "bad", 1), claude_text(1, key=2), '{"type": "user"}'], [claude_text(3, key=1), claude_text(4, key=3)]]

    def ingest():
        stream = st.line_stream(spark, str(landing), files_per_trigger=1)
        none = spark.createDataFrame([], "label string, path string, source string, enabled boolean, root_rank int")
        st.run_updates(stream, folder, st.ingest_logs(spark, folder, none, none), "append")
        return sorted(r.input_tokens for r in st.log_facts(spark, folder).collect())

    seen = []
    for k, rows in enumerate(chunks):
        (landing / "active" / f"chunk-{k}.jsonl").write_text("\n".join(rows) + "\n")
        seen.append(ingest())
    assert seen == [[7], [1, 9], [1, 4, 9]]
    (landing / "archive").mkdir()
    for f in (landing / "active").iterdir():
        f.rename(landing / "archive" / f.name)
    assert ingest() == [1, 4, 9]
    scanned = lines.parsed(lines.scan_lines(spark, str(landing)))
    batch = merge.merge_usage(extract.usage_lines(scanned).withColumns({"account": F.lit("a"), "provider": F.lit("claude")}))
    assert sorted(r.input_tokens for r in batch.collect()) == [1, 4, 9]


def test_ingest_counts(spark, tmp_path):
    token = json.dumps({"timestamp": "2026-06-01T10:00:00Z", "type": "event_msg", "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": 5}}}})
    for folder, name, rows in (("active", "a", [claude_text(1, key=1), claude_text(2, key=1), claude_text(3, "bad", 9), "assistant \"usage\"", "  ", "other"]), ("archive", "b", [claude_text(4, key=1), token, '{"type": "turn_context", "payload": {"model": "x"}}'])):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / f"{name}.jsonl").write_text("\n".join(rows) + "\n" + claude_text(50, key=50))
    (tmp_path / "archive" / "empty.jsonl").write_text("")
    # an account's active and archived folders are read together; empty files are not listed
    got = ingest_counts(spark, [str(tmp_path / "active"), str(tmp_path / "archive")]).first().asDict()
    assert got == {"files": 2, "lines_read": 5, "records": 2, "duplicates": 2, "malformed": 1}


def test_partitioning_changes_nothing(spark):
    rows = [line(k, T if k % 3 else None, f"r{k % 5}", f"m{k % 5}", (k, k * 2 % 7, k % 4, k)) for k in range(60)]
    df = spark.createDataFrame(rows, LINE)
    assert sorted(merge.merge_usage(df.repartition(7)).collect()) == sorted(merge.merge_usage(df.coalesce(1)).collect())


def test_lines_with_numbers_that_json_lacks(spark):
    values = ['{"a": NaN, "b": 1}', '{"a": [-Infinity, Infinity], "t": "NaN, -Infinity \\" NaN"}', '{"a": NaN', '{"a": xNaN}', '{"t": "NaN"}', '{"a": -1, "b": 2}', '{"a": "\\u00e4 NaN\\\\", "b": NaN}']
    df = lines.parsed(spark.createDataFrame([(v,) for v in values], "value string"))
    got = [(r["malformed"], r["j"]) for r in df.select("malformed", F.to_json("j").alias("j")).collect()]
    assert [m for m, _ in got] == [False, False, True, True, False, False, False]
    assert [json.loads(j) for m, j in got if not m] == [{"a": None, "b": 1}, {"a": [None, None], "t": 'NaN, -Infinity " NaN'}, {"t": "NaN"}, {"a": -1, "b": 2}, {"a": "ä NaN\\", "b": None}]


def test_iso_timestamps_in_all_forms(spark):
    """Dates of both calendars, with and without dashes, times to any part, and zones, as the standard library reads them."""

    def plain(value):
        written = value.strip()
        try:
            found = dt.datetime.fromisoformat(written[:-1] + "+00:00" if written.endswith("Z") else written)
        except ValueError:
            return None
        return found.replace(tzinfo=found.tzinfo or dt.UTC).astimezone(dt.UTC).replace(tzinfo=None)

    days = ["2024-02-29", "20240229", "2023-02-29", "2024-W01-1", "2024W527", "2020-W53-7", "2024-W53-1", "2024-W10", "2024W10", "2024-0229", "2024-13-01", "202402", "x"]
    times = ["", "T10", "T1030", "T10:30", " 10:30:15", "T103015", "T10:3015", "T10:30:15.5", "T10:30:15,123456789", "_103015.25", "T24:30", "T10:60", "T10:30:61", "T1", "T"]
    values = ["".join(x) for x in itertools.product(days, times, ["", "Z", "+02:00", "-0530", "+02", "+02:0", "+1", "ZZ", " "])] + ["  2024-01-01T00:00:00Z ", "", "2024"]
    got = [r.t for r in spark.createDataFrame([(v,) for v in [*values, None]], "v string").coalesce(1).select(iso_timestamp(F.col("v")).alias("t")).collect()]
    assert got == [*map(plain, values), None] and sum(g is not None for g in got) > 300


def test_limit_bodies_of_any_type(spark):
    """Bodies and members that are no objects give no bucket; members with a utilization and a reset time do."""
    good = {"utilization": 5, "resets_at": "2026-06-01T10:00:00Z"}
    bodies = [{"a": good, "b": 1, "c": [good], "d": {"utilization": "5", "resets_at": 1}, "e": {"utilization": True, "resets_at": 2.5}}, [good], 3, "x", None, {"limits": 7, "a": good}, {}]
    df = spark.createDataFrame([(k, json.dumps(b)) for k, b in enumerate(bodies)], "account long, raw string").select("account", F.try_parse_json("raw").alias("body"))
    got = sorted((r.account, r.key, r.used_percentage, r.resets_at) for r in limits.limits_from_list(df).collect())
    reset = dt.datetime(2026, 6, 1, 10, tzinfo=dt.UTC).timestamp()
    assert got == [(0, "a", 5.0, reset), (0, "e", 1.0, 2.5), (5, "a", 5.0, reset)]


def test_a_line_is_parsed_once(spark):
    """Fields of any wrong type, and a plan whose line is parsed where the line's variant is made and nowhere else."""
    odd = [1, None, "x", [], [1], {}, {"usage": 1}, {"usage": {"input_tokens": "5", "output_tokens": 1.5, "cache_creation": []}}, {"id": {}, "usage": {"input_tokens": 7, "cache_creation": {"ephemeral_5m_input_tokens": 3}}}]
    rows = [(json.dumps({"type": "assistant", "timestamp": None, "message": m}), "f", k) for k, m in enumerate(odd)] + [('{"payload": 1}', "f", 98), ('{"type": "turn_context", "payload": {"model": "m", "info": 2}}', "f", 99)]
    seen = lines.parsed(spark.createDataFrame(rows, "value string, file string, ord long"))
    used = extract.usage_lines(seen)
    assert [(r.ord, r.input_tokens, r.output_tokens, r.cache_creation, r.eph_5m, r.eph_1h, r.message_id) for r in used.collect()] == [(7, 0, 0, 0, None, None, None), (8, 7, 0, 3, 3, 0, None)]
    assert [(r.ord, r.marker, r.is_token, r.total) for r in extract.rollout_events(seen).collect()] == [(99, "m", False, None)]
    plan = used._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parsejson") == 2  # the other one is for lines with odd numbers


def test_batches_of_streams_are_not_written_by_one_task(spark, sf, monkeypatch):
    """A batch of several files is still one batch: the watermark drops what it dropped, and lines keep their order."""
    from oracle import compare

    from meterglass.plans import queries
    from meterglass.plans.sql import SQL

    monkeypatch.setattr(queries, "FACTS_PER_FILE", 50)
    sizes = []
    repartition = type(spark.range(1)).repartition
    monkeypatch.setattr(type(spark.range(1)), "repartition", lambda df, n, *more: (sizes.append(n), repartition(df, n, *more))[1])
    got = queries.stream_watermark(spark, sf)
    assert max(n for n in sizes if isinstance(n, int)) > 1
    assert compare(got, sf, SQL["stream_watermark"]) == ""
