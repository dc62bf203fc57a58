import json

from pyspark.sql import functions as F

from meterglass.operators import limits, pricing
from meterglass.plans.report import log_facts, usage_report

ROOTS = "label string, path string, source string, enabled boolean, root_rank int"


def test_report_over_two_providers(spark, tmp_path):
    usage = {"input_tokens": 1000, "output_tokens": 2000, "cache_read_input_tokens": 10000, "cache_creation_input_tokens": 0}
    line = {"type": "assistant", "requestId": "r", "timestamp": "2026-06-01T10:00:00Z", "message": {"id": "m", "model": "claude-opus-4-8", "usage": usage}}
    token = {"timestamp": "2026-06-01T11:00:00Z", "type": "event_msg", "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": 50, "cached_input_tokens": 20, "output_tokens": 5}}, "rate_limits": {"primary": {"used_percent": 12.5, "window_minutes": 300, "resets_at": 1780315200}, "secondary": None}}}
    for folder, name, rows in (("work", "a", [line, line]), ("work", "b", [line | {"requestId": "q"}]), ("codex", "c", [token, {"type": "turn_context", "payload": {"model": "gpt-5.5"}}])):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / f"{name}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    root = lambda label, folder: spark.createDataFrame([(label, f"file:{tmp_path}/{folder}", "config", True, 0)], ROOTS)
    facts, snapshots, quality = log_facts(spark, [str(tmp_path)], root("work", "work"), root("win", "codex"))
    assert quality.agg(F.sum("lines"), F.sum("malformed")).first() == (5, 0)
    assert sorted((r.account, r.model_raw, r.input_tokens, r.cache_read) for r in facts.collect()) == [("win", "gpt-5.5", 30, 20), ("work", "claude-opus-4-8", 1000, 10000), ("work", "claude-opus-4-8", 1000, 10000)]
    accounts = spark.createDataFrame([("claude", "work"), ("claude", "idle"), ("codex", "win"), ("codex", "off")], "provider string, account string")
    now = F.lit(1780315200 * 1_000_000)  # noon of that day
    tables = usage_report(facts, pricing.default_prices(spark), now, accounts)
    assert {r.window: r.records for r in tables["windows"].collect()} == {"1h": 1, "5h": 3, "24h": 3, "7d": 3, "all": 3}
    assert [r.account for r in tables["accounts"].collect()] == ["work", "win", "idle"]
    assert tables["models"].where("is_total = 1 AND window = 'all'").first()["records"] == 3
    assert tables["unknown_models"].count() == 0 and tables["providers"].first()["has_codex"] and not tables["providers"].first()["has_limits"]
    assert [r.coverage for r in tables["windows"].collect()] == [1.0] * 5
    captures = limits.latest_limits(snapshots)
    owners = accounts.select("provider", "account", F.when(F.col("provider") == "claude", 0).otherwise(1).alias("provider_rank"), F.lit(0).alias("root_rank"))
    whole = usage_report(facts, pricing.default_prices(spark), now, owners, captures=captures, days=("2026-05-31", "2026-06-02", "UTC"))
    assert [(r.account, r.label, r.shown_percentage) for r in whole["limits"].collect()] == [("win", "WIN 5-HOUR", 0.0)] and whole["providers"].first()["has_limits"]
    assert [r.records for r in whole["range_days"].collect()] == [0, 3, 0] and whole["range"].first()["active_days"] == 1 and whole["range"].first()["n_days"] == 3
    assert [r.name for r in whole["range_models"].collect()] == ["Opus 4.8", "gpt-5.5"]
    # one account's report has no table of accounts; an unknown scope is that of all
    scoped = usage_report(facts, pricing.default_prices(spark), now, owners, scope="work")
    assert scoped["accounts"].count() == 0 and scoped["windows"].where("window = 'all'").first()["records"] == 2
    assert usage_report(facts, pricing.default_prices(spark), now, owners, scope="nobody")["accounts"].count() == 3
    assert usage_report(facts, pricing.default_prices(spark), now, owners.where("account = 'work'"))["accounts"].count() == 0
    held = limits.latest_limits(snapshots).first()
    assert held.account == "win" and [(b.key, b.used_percentage) for b in held.buckets] == [("codex_primary", 12.5)]
