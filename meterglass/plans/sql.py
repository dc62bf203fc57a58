"""DuckDB SQL for the registered queries, over the driver's tables."""

import json

from meterglass.operators.pricing import ALIASES, DEFAULT_PRICES, RATE_NAMES

PRICES = ", ".join("(" + ", ".join("NULL::DOUBLE" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" for v in row) + ")" for row in [*DEFAULT_PRICES, *[(alias, *row[1:]) for alias, name in ALIASES.items() for row in DEFAULT_PRICES if row[0] == name]])

NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(lower(trim(coalesce({0}, ''))), '\[\s*1m\s*\]', '', 'g')), '^us\.anthropic\.', ''), '^eu\.anthropic\.', ''), '^anthropic\.', ''), '^anthropic/', ''), '-\d{{4}}-\d{{2}}-\d{{2}}$', ''), '-\d{{6,8}}$', ''))"

LINES = """
raw AS (SELECT event_id AS ord, epoch_us(CAST(ts AS TIMESTAMP)) AS us, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
clock AS (SELECT max(us) AS now FROM raw),
lines AS (SELECT ord, CASE WHEN ord % 11 <> 0 THEN us END AS ts_us, 'r' || (ord // 3) AS request_id, 'm' || (ord // 3) AS message_id,
  CASE event_type WHEN 'view' THEN 'claude-opus-4-8[1m]' WHEN 'click' THEN 'us.anthropic.claude-sonnet-4-6-20251001' WHEN 'purchase' THEN 'gpt-5.4-2026-03-05' WHEN 'signup' THEN 'claude-haiku-4-5' ELSE 'mystery-9' END AS model_raw,
  k * 1000 AS input_tokens, CAST(floor(value * 10) AS BIGINT) AS output_tokens, k * 3000 AS cache_read, k * 50 AS cache_creation,
  CASE WHEN ord % 3 <> 0 THEN k * 20 END AS eph_5m, CASE WHEN ord % 3 <> 0 THEN k * 30 END AS eph_1h,
  'acct-' || (user_id % 5) AS account, CASE WHEN user_id % 5 = 4 THEN 'codex' ELSE 'claude' END AS provider, user_id AS file,
  CASE WHEN event_type = 'signup' THEN CASE k % 3 WHEN 0 THEN 'gpt-5.5' WHEN 1 THEN 'gpt-5.4-2026-03-05' ELSE 'mystery-9' END END AS marker, k FROM raw),
gated AS (SELECT *, min(CASE WHEN ts_us IS NOT NULL THEN ord END) OVER (PARTITION BY request_id, message_id) AS start FROM lines WHERE provider = 'claude'),
merged AS (SELECT arg_min(coalesce(ts_us, -1), ord) AS ts_us, arg_min(model_raw, ord) AS model_raw, arg_min(account, ord) AS account, 'claude' AS provider, min(ord) AS ord,
  max(input_tokens) AS input_tokens, max(output_tokens) AS output_tokens, max(cache_read) AS cache_read, max(cache_creation) AS cache_creation, max(eph_5m) AS eph_5m, max(eph_1h) AS eph_1h
  FROM gated WHERE ord >= start GROUP BY request_id, message_id),
logs AS (SELECT *, coalesce(last_value(marker IGNORE NULLS) OVER (PARTITION BY file ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(marker IGNORE NULLS) OVER (PARTITION BY file ORDER BY ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 'codex-unattributed') AS model,
  sum(CASE WHEN marker IS NULL THEN input_tokens END) OVER w AS tin, sum(CASE WHEN marker IS NULL THEN k * 400 END) OVER w AS tcached, sum(CASE WHEN marker IS NULL THEN output_tokens END) OVER w AS tout
  FROM lines WHERE provider = 'codex' WINDOW w AS (PARTITION BY file ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
tokens AS (SELECT *, ord % 7 <> 0 AS has_total, ord % 5 = 0 AS has_last FROM logs WHERE marker IS NULL AND ts_us IS NOT NULL),
before AS (SELECT *, coalesce(last_value(CASE WHEN has_total THEN tin END IGNORE NULLS) OVER p, 0) AS pin, coalesce(last_value(CASE WHEN has_total THEN tcached END IGNORE NULLS) OVER p, 0) AS pcached, coalesce(last_value(CASE WHEN has_total THEN tout END IGNORE NULLS) OVER p, 0) AS pout
  FROM tokens WINDOW p AS (PARTITION BY file ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
used AS (SELECT *, CAST(CASE WHEN has_last THEN input_tokens ELSE greatest(0, tin - pin) END AS BIGINT) AS raw_input, CAST(CASE WHEN has_last THEN k * 1200 ELSE greatest(0, tcached - pcached) END AS BIGINT) AS cached, CAST(CASE WHEN has_last THEN output_tokens ELSE greatest(0, tout - pout) END AS BIGINT) AS out
  FROM before WHERE has_last OR has_total),
rollout AS (SELECT ts_us, model AS model_raw, account, 'codex' AS provider, ord, raw_input - least(raw_input, cached) AS input_tokens, out AS output_tokens, least(raw_input, cached) AS cache_read, 0::BIGINT AS cache_creation, 0::BIGINT AS eph_5m, 0::BIGINT AS eph_1h
  FROM used WHERE raw_input <> 0 OR out <> 0),
facts AS (SELECT * FROM merged UNION ALL SELECT * FROM rollout)"""

PRICED = (
    LINES
    + f""",
prices(model, input, output, cache_read, cache_write, threshold, input_mult, output_mult) AS (VALUES {PRICES}),
named AS (SELECT *, CASE WHEN {NORM.format("model_raw")} = '' THEN CASE WHEN provider = 'codex' THEN 'codex-unattributed' ELSE '(unknown)' END ELSE {NORM.format("model_raw")} END AS model_norm FROM facts),
carded AS (SELECT n.*, p.model IS NOT NULL AS known, p.input * im AS input_rate, p.output * om AS output_rate, im, p.cache_read AS read_card, p.cache_write AS write_card
  FROM (SELECT n.*, p.model AS m, CASE WHEN coalesce(n.input_tokens + n.cache_read > p.threshold, false) THEN coalesce(p.input_mult, 1.0) ELSE 1.0 END::DOUBLE AS im, CASE WHEN coalesce(n.input_tokens + n.cache_read > p.threshold, false) THEN coalesce(p.output_mult, 1.0) ELSE 1.0 END::DOUBLE AS om FROM named n LEFT JOIN prices p ON n.model_norm = p.model) n LEFT JOIN prices p ON n.m = p.model),
priced AS (SELECT *, cache_read + cache_creation AS cache_tokens, input_tokens + output_tokens + cache_read + cache_creation AS total_tokens,
  CASE WHEN NOT known THEN 0.0::DOUBLE ELSE input_tokens * (input_rate / 1e6::DOUBLE) + output_tokens * (output_rate / 1e6::DOUBLE)
   + cache_read * (CASE WHEN read_card IS NOT NULL THEN read_card * im ELSE input_rate * 0.1::DOUBLE END) / 1e6::DOUBLE
   + (CASE WHEN write_card IS NOT NULL THEN cache_creation * write_card * im / 1e6::DOUBLE WHEN eph_5m IS NULL AND eph_1h IS NULL THEN cache_creation * (input_rate / 1e6::DOUBLE) * 1.25::DOUBLE
      ELSE coalesce(eph_5m, 0) * (input_rate / 1e6::DOUBLE) * 1.25::DOUBLE + coalesce(eph_1h, 0) * (input_rate / 1e6::DOUBLE) * 2.0::DOUBLE END) END AS cost FROM carded)"""
)

#: The lines that stand between those of the events (see `events.NOISE`).
MALFORMED, FOREIGN, NO_OBJECT = ("count(CASE WHEN ord % {} = 0 THEN 1 END)".format(n) for n in (13, 19, 23))
LOGGED = f"count(*) + {MALFORMED} + {FOREIGN} + {NO_OBJECT}"
#: Lines without a message id are their own keys.
ALONE = "CASE WHEN ord % 29 = 0 THEN 'line ' || ord ELSE request_id || ' ' || message_id END"
SUMS = ", ".join(f"coalesce(sum({c}), 0)::BIGINT AS {c}" for c in ("input_tokens", "output_tokens", "cache_read", "cache_creation", "total_tokens"))
COST = "coalesce(CAST(sum(CAST(cost AS DECIMAL(20,12))) AS DOUBLE), 0.0)"
MEASURES = f"{SUMS}, {COST} AS cost, coalesce(sum(CASE WHEN NOT known THEN total_tokens END), 0)::BIGINT AS unpriced_tokens, count(ts_us) AS records"
WINDOWS = "(VALUES ('1h', 3600::BIGINT), ('5h', 18000), ('24h', 86400), ('7d', 604800), ('all', NULL)) AS w(\"window\", secs)"
INSIDE = "(w.secs IS NULL OR (SELECT now FROM clock) - ts_us <= w.secs * 1000000)"
# the first and last microsecond of the days 2024-01-05 to 2024-01-20 in New York, which is at UTC-5 then
ZONE, FIRST, LAST = "America/New_York", "2024-01-05", "2024-01-20"
OFFSET = 5 * 3600 * 1_000_000
RANGE = f"ts_us BETWEEN epoch_us(TIMESTAMP '{FIRST} 00:00:00') + {OFFSET} AND epoch_us(TIMESTAMP '{LAST} 00:00:00') + {OFFSET} + 86400000000 - 1"


def q(select: str, base: str = PRICED) -> str:
    return f"WITH {base.strip()} {select}"


def series(window: str, secs: int, metric: str, n: int = 48) -> str:
    value = "CAST(sum(CAST(cost AS DECIMAL(20,12))) AS DOUBLE)" if metric == "cost" else "sum(total_tokens)::DOUBLE"
    width = secs * 1_000_000
    since = f"(ts_us - ((SELECT now FROM clock) - {width}))"
    return f"""spine AS (SELECT range AS bucket FROM range({n})), cells AS (SELECT least({n - 1}, ({since} * {n}) // {width})::BIGINT AS bucket, {value} AS value, count(*) AS records, coalesce(sum(CASE WHEN NOT known THEN total_tokens END), 0)::BIGINT AS unpriced_tokens
  FROM priced WHERE {since} > 0 AND ts_us <= (SELECT now FROM clock) GROUP BY 1), series AS (SELECT s.bucket, coalesce(value, 0.0)::DOUBLE AS value, coalesce(records, 0)::BIGINT AS records, coalesce(unpriced_tokens, 0)::BIGINT AS unpriced_tokens FROM spine s LEFT JOIN cells USING (bucket))"""


BY_DAY = f"""days AS (SELECT CAST(d AS DATE) AS day FROM range(DATE '{FIRST}', DATE '{LAST}' + 1, INTERVAL 1 DAY) t(d)),
daily AS (SELECT CAST(make_timestamp(ts_us - {OFFSET}) AS DATE) AS day, {MEASURES} FROM priced WHERE {RANGE} GROUP BY 1),
by_day AS (SELECT CAST(days.day AS VARCHAR) AS day, {", ".join(f"coalesce(daily.{c}, 0)::BIGINT AS {c}" for c in ("input_tokens", "output_tokens", "cache_read", "cache_creation", "total_tokens"))}, coalesce(daily.cost, 0.0) AS cost, coalesce(daily.unpriced_tokens, 0)::BIGINT AS unpriced_tokens, coalesce(daily.records, 0)::BIGINT AS records FROM days LEFT JOIN daily ON days.day = daily.day)"""

FACT_COLUMNS = "ts_us, model_raw, account, provider, input_tokens, output_tokens, cache_read, cache_creation, eph_5m, eph_1h"
TOTALS = "input_tokens, output_tokens, cache_read, cache_creation, total_tokens, cost, unpriced_tokens, records"
COVERAGE = "CASE WHEN total_tokens = 0 THEN 1.0::DOUBLE ELSE round(greatest(0.0::DOUBLE, 1 - unpriced_tokens::DOUBLE / total_tokens), 12) END"
PRESETS = """clock2 AS (SELECT CAST(max(ts) AS DATE) AS today, CAST(min(CASE WHEN event_id % 11 <> 0 THEN ts END) AS DATE) AS earliest FROM events),
spans AS (SELECT preset, CASE preset WHEN 'last7' THEN today - 6 WHEN 'last30' THEN today - 29 WHEN 'thismonth' THEN CAST(date_trunc('month', today) AS DATE) WHEN 'lastmonth' THEN CAST(date_trunc('month', today) - INTERVAL 1 MONTH AS DATE) ELSE earliest END AS s,
  least(CASE WHEN preset = 'lastmonth' THEN CAST(date_trunc('month', today) AS DATE) - 1 ELSE today END, today) AS e, today FROM clock2, (VALUES ('last7'), ('last30'), ('thismonth'), ('lastmonth'), ('all')) p(preset))"""

SQL: dict[str, str] = {
    "normalize_models": q(f"SELECT model_raw, {NORM.format('model_raw')} AS model_norm, count(*) AS n FROM lines GROUP BY 1, 2", LINES),
    "merge_usage": q(f"SELECT {FACT_COLUMNS} FROM merged", LINES),
    "counter_delta": q("SELECT ord, input_tokens, output_tokens, cache_read FROM rollout", LINES),
    "asof_attribution": q("SELECT ord, model AS model_raw FROM logs", LINES),
    "rollout_usage": q(f"SELECT {FACT_COLUMNS} FROM rollout", LINES),
    "usage_extract": q("SELECT ts_us, model_raw, provider, input_tokens, output_tokens, cache_read, cache_creation, eph_5m, eph_1h FROM facts", LINES),
    "scan_lines": q(f"SELECT provider, ({LOGGED})::BIGINT AS n_lines FROM lines GROUP BY 1", LINES),
    "line_prefilter": q(f"SELECT ({LOGGED})::BIGINT AS n_lines, (count(*) + {MALFORMED} + {NO_OBJECT})::BIGINT AS n_candidates FROM lines", LINES),
    "ingest_quality": q(f"SELECT ({LOGGED})::BIGINT AS n_lines, (count(*) + {MALFORMED} + {NO_OBJECT})::BIGINT AS candidates, ({MALFORMED})::BIGINT AS malformed, count(*) AS objects, count(CASE WHEN ts_us IS NULL THEN 1 END) AS undated FROM lines WHERE provider = 'claude'", LINES),
    "ingest_totals": q(f"""SELECT (SELECT count(DISTINCT CASE WHEN provider = 'claude' THEN 'a' || (ord // 1000000) ELSE 'b' || file END) FROM lines) AS files, (SELECT count(*) FROM lines WHERE provider = 'claude' OR marker IS NULL) AS lines_read,
  (SELECT count(*) FROM facts) AS records, (SELECT (count(*) - count(DISTINCT request_id || '|' || message_id))::BIGINT FROM gated WHERE ord >= start) AS duplicates, (SELECT ({MALFORMED})::BIGINT FROM lines) AS malformed""", LINES),
    "facts_store": q("SELECT provider, CAST(CAST(make_timestamp(ts_us) AS DATE) AS VARCHAR) AS event_date, count(*) AS n, sum(input_tokens)::BIGINT AS input_tokens FROM facts WHERE CAST(make_timestamp(ts_us) AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY 1, 2", LINES),
    "priced_usage": q("SELECT ts_us, model_norm, known, account, provider, total_tokens, round(cost, 9) AS cost FROM priced"),
    "rolling_windows": q(f'SELECT w."window", {MEASURES.replace("count(ts_us)", "count(ts_us)")} FROM {WINDOWS} LEFT JOIN priced ON {INSIDE} GROUP BY 1'),
    "window_by_model": q(f'SELECT w."window", model_norm, {MEASURES}, bool_and(known) AS known FROM {WINDOWS} JOIN priced ON {INSIDE} GROUP BY 1, 2'),
    "model_rollup": q(f'SELECT w."window", model_norm, grouping(model_norm)::INTEGER AS is_total, {MEASURES}, bool_and(known) AS known FROM {WINDOWS} JOIN priced ON {INSIDE} GROUP BY GROUPING SETS ((w."window", model_norm), (w."window"))'),
    "pricing_coverage": q(f'SELECT "window", total_tokens, unpriced_tokens, {COVERAGE} AS coverage FROM (SELECT w."window", {MEASURES} FROM {WINDOWS} LEFT JOIN priced ON {INSIDE} GROUP BY 1)'),
    "by_account": q(f"""SELECT a.provider, a.account, {", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in ("input_tokens", "output_tokens", "cache_read", "cache_creation", "total_tokens", "unpriced_tokens", "records"))}, coalesce(cost, 0.0) AS cost,
  CASE WHEN sum(coalesce(cost, 0.0)) OVER () > 0 THEN round(coalesce(cost, 0.0) / CAST(sum(CAST(coalesce(cost, 0.0) AS DECIMAL(20,12))) OVER () AS DOUBLE), 9) ELSE 0.0::DOUBLE END AS share
  FROM (VALUES ('claude', 'acct-0'), ('claude', 'acct-1'), ('claude', 'acct-2'), ('claude', 'acct-3'), ('claude', 'acct-idle'), ('codex', 'acct-4'), ('codex', 'acct-idle')) a(provider, account)
  LEFT JOIN (SELECT provider, account, {MEASURES} FROM priced WHERE (SELECT now FROM clock) - ts_us <= 604800000000 GROUP BY 1, 2) s ON a.provider = s.provider AND a.account = s.account WHERE a.provider = 'claude' OR s.account IS NOT NULL"""),
    "scope_filter": q(f"SELECT {MEASURES} FROM priced WHERE account = 'acct-2'"),
    "activity_series": q("SELECT * FROM series").replace("SELECT * FROM series", ", " + series("24h", 86400, "cost") + " SELECT bucket, value, records, unpriced_tokens FROM series", 1),
    "series_levels": q("SELECT * FROM series").replace("SELECT * FROM series", ", " + series("7d", 604800, "tokens") + """, leveled AS (SELECT bucket, value, CASE WHEN max(value) OVER () <= 0 OR value <= 0 THEN 1 ELSE greatest(1, least(12, CAST(round_even(value / max(value) OVER () * 12, 0) AS INTEGER))) END AS level FROM series)
  SELECT bucket, level, greatest(0, least(4, level)) AS row_0, greatest(0, least(4, level - 4)) AS row_1, greatest(0, least(4, level - 8)) AS row_2 FROM leveled""", 1),
    "peak_bucket": q("SELECT * FROM series").replace("SELECT * FROM series", ", " + series("7d", 604800, "tokens") + " SELECT bucket, value, (SELECT now FROM clock) - 604800000000 + ((2 * bucket + 1) * 6300000000)::BIGINT AS centre_us FROM series ORDER BY value DESC, bucket LIMIT 1", 1),
    "range_totals": q(f"SELECT *, {COVERAGE} AS coverage FROM (SELECT {MEASURES} FROM priced WHERE {RANGE})"),
    "range_by_model": q(f"SELECT model_norm, {MEASURES}, bool_and(known) AS known FROM priced WHERE {RANGE} GROUP BY 1"),
    "range_by_day": q("SELECT * FROM by_day").replace("SELECT * FROM by_day", ", " + BY_DAY + " SELECT * FROM by_day", 1),
    "active_days": q("SELECT * FROM by_day").replace("SELECT * FROM by_day", ", " + BY_DAY + " SELECT count(CASE WHEN total_tokens > 0 OR cost > 0 THEN 1 END) AS active_days, count(*) AS n_days FROM by_day", 1),
    "range_presets": f"WITH {PRESETS} SELECT preset, CAST(least(s, e) AS VARCHAR) AS start_day, CAST(e AS VARCHAR) AS end_day, CASE WHEN e = today THEN '(today)' WHEN today - e = 1 THEN '(1 day ago)' ELSE '(' || (today - e) || ' days ago)' END AS label FROM spans",
    "earliest_day": q("SELECT CAST(CAST(make_timestamp(min(ts_us)) AS DATE) AS VARCHAR) AS day FROM facts", LINES),
    "unknown_models": q("SELECT DISTINCT model_norm FROM priced WHERE NOT known AND model_norm <> ''"),
    "pricing_overlay": q(f"""SELECT model, input, output, cache_read FROM prices WHERE model <> 'gpt-5.6' AND model NOT IN (SELECT DISTINCT {NORM.format("model_raw")} FROM lines)
  UNION ALL SELECT DISTINCT {NORM.format("model_raw")}, 1.0::DOUBLE, 2.0::DOUBLE, NULL::DOUBLE FROM lines"""),
    "report_labels": q("""SELECT model_norm, CASE WHEN regexp_matches(model_norm, '^claude-([a-z]+)-(\\d+)(?:-(\\d+))?$') THEN upper(substr(split_part(model_norm, '-', 2), 1, 1)) || substr(split_part(model_norm, '-', 2), 2) || ' ' || split_part(model_norm, '-', 3) || CASE WHEN split_part(model_norm, '-', 4) <> '' THEN '.' || split_part(model_norm, '-', 4) ELSE '' END ELSE model_norm END AS name,
  CASE WHEN t >= 1000000000 THEN printf('%.1fB', t / 1e9) WHEN t >= 1000000 THEN printf('%.1fM', t / 1e6) WHEN t >= 1000 THEN printf('%.0fK', t / 1e3) ELSE CAST(t AS VARCHAR) END AS tokens_label,
  CASE WHEN u > 0 AND c <= 0 THEN 'unpriced' ELSE format('${:,.2f}', c) END AS cost_label,
  CASE WHEN age >= 86400 THEN printf('%dd%02dh', age // 86400, age % 86400 // 3600) WHEN age >= 3600 THEN printf('%dh%02dm', age // 3600, age % 3600 // 60) WHEN age >= 60 THEN printf('%dm%02ds', age // 60, age % 60) WHEN age > 0 THEN printf('%ds', age) ELSE 'now' END AS age_label
  FROM (SELECT model_norm, sum(total_tokens)::BIGINT AS t, """ + COST + """ AS c, coalesce(sum(CASE WHEN NOT known THEN total_tokens END), 0)::BIGINT AS u, CAST(((SELECT now FROM clock) - max(ts_us)) // 1000000 AS BIGINT) AS age FROM priced GROUP BY 1)"""),
    "latest_limits": q("SELECT account, arg_max(used, struct_pack(a := captured, b := ord)) AS used_percentage, max(captured) AS captured_at FROM (SELECT account, ord, coalesce(ts_us, 0) // 3600000000 AS captured, k AS used FROM lines) GROUP BY account", LINES),
    "stream_merge": q(f"SELECT request_id, message_id, count(*) AS n, max(input_tokens) AS input_tokens, max(output_tokens) AS output_tokens, max(cache_read) AS cache_read, max(eph_5m) AS eph_5m, arg_min(model_raw, ord) AS model_raw FROM lines WHERE provider = 'claude' AND ts_us IS NOT NULL GROUP BY 1, 2".replace("count(*) AS n, ", ""), LINES),
    "stream_tumbling": q(f"SELECT ts_us // 21600000000 * 21600000000 AS start_us, {COST} AS cost, sum(total_tokens)::BIGINT AS total_tokens, count(*) AS records FROM priced GROUP BY 1"),
    "stream_live_windows": q(f'SELECT w."window", {MEASURES} FROM {WINDOWS} LEFT JOIN priced ON {INSIDE} GROUP BY 1'),
    "stream_latest_limits": q("SELECT account, arg_max(used, struct_pack(a := captured, b := ord)) AS used_percentage, max(captured)::DOUBLE AS captured_at FROM (SELECT account, ord, coalesce(ts_us, 0) // 3600000000 AS captured, k AS used FROM lines) GROUP BY account", LINES),
    "stream_late_data": q(f"SELECT ts_us // 86400000000 * 86400000000 AS start_us, {COST} AS cost, sum(total_tokens)::BIGINT AS total_tokens, count(*) AS records FROM priced GROUP BY 1"),
    "stream_attribution": q(f"SELECT {FACT_COLUMNS} FROM rollout", LINES),
    "stream_ingest": q(f"SELECT {FACT_COLUMNS} FROM merged", LINES),
    "stream_resume": q("SELECT provider, count(*) AS n_lines, sum(k)::BIGINT AS k FROM lines GROUP BY 1", LINES),
    "turns_by_role": "SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1",
    "daily_sales": "SELECT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(20,6))) AS DOUBLE) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' GROUP BY 1",
}
SQL |= {
    "facts_refresh": q("SELECT run, written, n, output_tokens FROM (SELECT count(*) AS n, sum(output_tokens)::BIGINT AS output_tokens FROM facts), (VALUES (0, true), (1, false), (2, true)) r(run, written)", LINES),
    "range_shift": "SELECT CAST(d AS VARCHAR) AS day, " + ", ".join(f"CAST(CAST(d {sign} INTERVAL 1 {unit} AS DATE) AS VARCHAR) AS {name}" for name, sign, unit in (("next_month", "+", "MONTH"), ("last_month", "-", "MONTH"), ("next_year", "+", "YEAR"), ("last_year", "-", "YEAR"))) + " FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events)",
    "stream_log_ingest": q("SELECT ts_us, model_raw, provider, input_tokens, output_tokens, cache_read, cache_creation, eph_5m, eph_1h FROM merged", LINES.replace("PARTITION BY request_id, message_id", f"PARTITION BY {ALONE}").replace("GROUP BY request_id, message_id", f"GROUP BY {ALONE}")),
    "stream_watermark": q(f"""SELECT ts_us // 86400000000 * 86400000000 AS start_us, {COST} AS cost, sum(total_tokens)::BIGINT AS total_tokens, count(*) AS records FROM priced
  WHERE ord % 3 <> 0 OR (ts_us // 86400000000 + 1) * 86400000000 > (SELECT max(ts_us) // 1000 * 1000 - 172800000000 FROM priced WHERE ord % 3 = 1) GROUP BY 1"""),
}
# the rows of a dimension as JSON, digested one by one and then together in the order of their digests
PRICE_ROWS = ", ".join("('{" + ",".join(f'"{c}":{json.dumps(v)}' for c, v in sorted(zip(["model", *RATE_NAMES], row, strict=True))) + "}')" for row in DEFAULT_PRICES)
#: Sessions of five users each, below two roots, in three batches; within a batch files follow their paths.
MIXED = LINES.replace("'acct-' || (user_id % 5) AS account", "CASE WHEN user_id % 5 = 4 THEN 'codex-' ELSE 'claude-' END || ((user_id - user_id % 5 + 4) % 2) AS account").replace(
    "gated AS (", "placed AS (SELECT * REPLACE (row_number() OVER (ORDER BY ord // ((SELECT max(ord) FROM raw) // 3 + 1), (file - file % 5 + 4) % 2, file - file % 5 + 4, ord) AS ord) FROM lines),\ngated AS ("
).replace("AS start FROM lines WHERE", "AS start FROM placed WHERE")
SQL["stream_mixed_logs"] = q(f"SELECT {FACT_COLUMNS} FROM facts", MIXED)
SQL["dim_fingerprint"] = f"""WITH {LINES.strip()}, dims(dim, j) AS (SELECT 0, j FROM (VALUES {PRICE_ROWS}) v(j) UNION ALL SELECT DISTINCT 1, '{{"account":"' || account || '","provider":"' || provider || '"}}' FROM lines)
  SELECT dim, sha256(string_agg(sha256(j), ',' ORDER BY sha256(j))) AS digest FROM dims GROUP BY dim"""
SQL["set_digest"] = f"""WITH {LINES.strip()}, rows AS (SELECT account, md5('{{"input_tokens":' || input_tokens || ',"model_raw":"' || model_raw || '","ord":' || ord || '}}') AS h FROM lines WHERE ord % 5 <> 0)
  SELECT account, count(*) AS n, (sum(CAST(('0x' || substr(h, 1, 16)) AS UBIGINT)::HUGEINT) % 18446744073709551616)::VARCHAR AS high, (sum(CAST(('0x' || substr(h, 17)) AS UBIGINT)::HUGEINT) % 18446744073709551616)::VARCHAR AS low FROM rows GROUP BY 1"""
#: Files by user in folders by the user's remainder, whose order is that of the merge; the first half of those that are gone does not count.
BY_FILE = LINES.replace("gated AS (", """placed AS (SELECT * REPLACE (row_number() OVER (ORDER BY CASE file % 4 WHEN 1 THEN 'archive' WHEN 0 THEN 'grown' WHEN 2 THEN 'new' ELSE 'same' END, file, ord >= (SELECT max(ord) FROM raw) // 2, ord) AS ord)
  FROM lines WHERE file % 4 <> 2 OR ord >= (SELECT max(ord) FROM raw) // 2),\ngated AS (""").replace("AS start FROM lines WHERE", "AS start FROM placed WHERE")
# what was written at one time is a file of its own
BY_FILE = BY_FILE.replace("marker, k FROM raw)", "marker, k, user_id * 2 + CASE WHEN user_id % 4 IN (0, 2) AND ord >= (SELECT max(ord) FROM raw) // 2 THEN 1 ELSE 0 END AS part, user_id % 4 <> 2 OR ord >= (SELECT max(ord) FROM raw) // 2 AS present FROM raw)")
for old, new in (("_value(marker IGNORE NULLS) OVER (PARTITION BY file", "_value(CASE WHEN present THEN marker END IGNORE NULLS) OVER (PARTITION BY part"), ("WHERE marker IS NULL AND ts_us IS NOT NULL", "WHERE marker IS NULL AND ts_us IS NOT NULL AND present"), ("WINDOW p AS (PARTITION BY file", "WINDOW p AS (PARTITION BY part")):
    assert old in BY_FILE
    BY_FILE = BY_FILE.replace(old, new)
SQL["facts_by_file"] = q("SELECT provider, provider AS account, output_tokens, input_tokens, ts_us FROM facts", BY_FILE)
LIMITS = "src AS (SELECT 'e' || event_id AS account, (epoch_us(CAST(ts AS TIMESTAMP)) // 1000000)::DOUBLE AS captured_at, event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"
NAMES = "used_percentage, resets_at, window_minutes"


def shape_b(src: str, more: str = "") -> str:
    return f"""SELECT account, captured_at, 'std_primary' AS key, 'SPARK 5-HOUR' AS label, k::DOUBLE AS used_percentage, captured_at + 3600 AS resets_at, 300.0::DOUBLE AS window_minutes FROM {src} WHERE k % 2 = 0
  UNION ALL SELECT account, captured_at, 'std_secondary', 'SPARK 2-WEEK', k::DOUBLE, captured_at + 3600, 20160.0 FROM {src} WHERE k % 2 = 0
  UNION ALL SELECT account, captured_at, 'codex_primary', '90-MIN', k::DOUBLE, captured_at + 3600, 90.0 FROM {src} WHERE k % 2 = 1
  UNION ALL SELECT account, captured_at, 'codex_individualLimit', 'INDIVIDUALLIMIT', k::DOUBLE, captured_at + 3600, NULL FROM {src} WHERE k % 2 = 1"""


HOURLY = LIMITS + ", hourly AS (SELECT 'acct-' || (user_id % 5) AS account, floor(captured_at / 3600) * 3600 AS captured_at, max(k) AS k FROM src GROUP BY 1, 2)"
AGO = "CASE WHEN {0} >= 86400 THEN printf('%dd%02dh', {0} // 86400, {0} % 86400 // 3600) WHEN {0} >= 3600 THEN printf('%dh%02dm', {0} // 3600, {0} % 3600 // 60) WHEN {0} >= 60 THEN printf('%dm%02ds', {0} // 60, {0} % 60) WHEN {0} > 0 THEN printf('%ds', {0}) ELSE 'now' END"
FILES = """users AS (SELECT user_id, count(*) AS size FROM events GROUP BY 1),
ledger AS (SELECT '/logs/active/rollout-' || user_id || '.jsonl' AS path, size, 1 AS modified FROM users WHERE user_id % 7 <> 0),
listing AS (SELECT CASE WHEN user_id % 5 = 3 THEN '/logs/archive/rollout-' ELSE '/logs/active/rollout-' END || user_id || '.jsonl' AS path, CASE user_id % 5 WHEN 1 THEN size + 10 WHEN 2 THEN size - 1 ELSE size END AS size, CASE WHEN user_id % 5 = 4 THEN 2 ELSE 1 END AS modified FROM users WHERE user_id % 11 <> 3)"""
LABEL = "CASE WHEN m IS NULL THEN CASE WHEN k % 2 = 0 THEN '5-HOUR' ELSE 'MY KEY' END WHEN m % 10080 = 0 THEN CASE WHEN m = 10080 THEN 'WEEKLY' ELSE (m // 10080) || '-WEEK' END WHEN m % 1440 = 0 THEN (m // 1440) || '-DAY' WHEN m % 60 = 0 THEN (m // 60) || '-HOUR' ELSE m || '-MIN' END"

SQL |= {
    "limit_snapshots": f"""WITH {LIMITS} SELECT account, 'codex_primary' AS key, NULL::VARCHAR AS label, k::DOUBLE AS used_percentage, captured_at + 3600 AS resets_at, CASE k % 3 WHEN 0 THEN 10080.0::DOUBLE WHEN 1 THEN 300.0::DOUBLE END AS window_minutes FROM src""",
    "limits_normalize_a": f"""WITH {LIMITS} SELECT account, key, label, used_percentage, resets_at, NULL::DOUBLE AS window_minutes FROM (
  SELECT account, 'session' AS key, '5-HOUR' AS label, k::DOUBLE AS used_percentage, captured_at AS resets_at FROM src WHERE k % 2 = 0
  UNION ALL SELECT account, 'weekly_scoped', 'OPUS WEEKLY', 1.5, captured_at + 3600 FROM src WHERE k % 2 = 0
  UNION ALL SELECT account, 'weekly_scoped_2', 'WEB WEEKLY', 2.0, captured_at + 3600 FROM src WHERE k % 2 = 0
  UNION ALL SELECT account, 'limit_3', 'LIMIT 3', 3.0, captured_at + 3600 FROM src WHERE k % 2 = 0
  UNION ALL SELECT account, 'five_hour', NULL, k::DOUBLE, captured_at + 3600 FROM src WHERE k % 2 = 1)""",
    "limits_normalize_b": f"WITH {LIMITS} SELECT account, key, label, {NAMES} FROM ({shape_b('src')})",
    "limit_labels": f"WITH {LIMITS}, ks AS (SELECT DISTINCT k, CASE WHEN k > 0 THEN k * 30 END AS m FROM src) SELECT k, {LABEL} AS label FROM ks",
    "limit_status": f"""WITH {LIMITS}, t AS (SELECT (max(epoch_us(CAST(ts AS TIMESTAMP))) // 1000000)::DOUBLE AS now FROM events), b AS (SELECT *, (now - resets_at)::BIGINT AS age FROM ({shape_b("src")}), t)
  SELECT account, key, CASE WHEN now >= resets_at THEN 0.0::DOUBLE ELSE used_percentage END AS shown_percentage,
  CASE WHEN now >= resets_at THEN 'reset ' || CASE WHEN age <= 0 THEN 'just now' ELSE {AGO.format("age")} || ' ago' END || ' · refresh pending' ELSE 'resets in ' || {AGO.format("(-age)")} END AS note FROM b""",
    "limits_store": f"WITH {LIMITS} SELECT CASE k % 3 WHEN 0 THEN 'claude:' ELSE 'codex:' END || account AS name, captured_at AS capture FROM src WHERE k % 3 <> 2 AND k % 7 <> 0",
    "limits_current": f"""WITH {HOURLY}, best AS (SELECT account, max(captured_at) AS captured_at FROM hourly WHERE account IN ('acct-0', 'acct-1', 'acct-3') AND (CAST(captured_at / 3600 AS BIGINT) % 3 < 2 OR account = 'acct-1') GROUP BY 1)
  SELECT account, captured_at, 2 AS n_buckets FROM best""",
    "limits_isolated": f"""WITH {HOURLY}, newest AS (SELECT account, max(captured_at) AS captured_at FROM hourly GROUP BY 1)
  SELECT account, CASE WHEN account IN ('acct-1', 'acct-4') THEN captured_at ELSE captured_at + 3600 END AS captured_at, 2 AS n_buckets, CASE WHEN account IN ('acct-1', 'acct-4') THEN 'no answer' END AS warning FROM newest""",
    "limits_by_account": f"""WITH {HOURLY}, newest AS (SELECT account, max(captured_at) AS captured_at, arg_max(k, captured_at) AS k FROM hourly GROUP BY 1)
  SELECT account, key, CASE account WHEN 'acct-0' THEN 'CLAUDE' ELSE upper(account) END || ' ' || label AS label, used_percentage, resets_at FROM ({shape_b("newest")}) WHERE account IN ('acct-0', 'acct-1', 'acct-2')""",
    "changed_files": f"""WITH {FILES} SELECT l.path, l.size, CASE WHEN o.path IS NULL THEN 'new' WHEN l.size > o.size THEN 'grown' WHEN l.size < o.size THEN 'truncated' ELSE 'touched' END AS change
  FROM listing l LEFT JOIN ledger o ON l.path = o.path WHERE o.path IS NULL OR l.size <> o.size OR l.modified <> o.modified""",
    "moved_files": f"""WITH {FILES}, gone AS (SELECT *, regexp_extract(path, '[^/]+$') AS name FROM ledger WHERE path NOT IN (SELECT path FROM listing)),
  fresh AS (SELECT regexp_extract(path, '[^/]+$') AS name, min(path) AS new_path, min(size) AS size, count(*) AS n FROM listing WHERE path NOT IN (SELECT path FROM ledger) GROUP BY 1)
  SELECT g.path, CASE WHEN f.n = 1 AND f.size >= g.size THEN f.new_path END AS new_path, NOT coalesce(f.n = 1 AND f.size >= g.size, false) AS rebuild FROM gone g LEFT JOIN fresh f ON g.name = f.name""",
    "tag_accounts": "SELECT CASE WHEN user_id % 5 = 1 THEN 'home' WHEN user_id % 5 = 3 THEN 'three' ELSE 'claude' END AS account, count(*) AS n FROM events GROUP BY 1",
    "account_roots": """WITH paths AS (SELECT DISTINCT event_type, p || event_type AS path, p FROM events, (VALUES ('/home/.claude-'), ('/mnt/.claude-')) v(p))
  SELECT CASE WHEN p = '/home/.claude-' THEN CASE WHEN event_type = 'view' THEN 'view-2' ELSE event_type END ELSE event_type || CASE WHEN event_type = 'view' THEN '-3' ELSE '-2' END END AS label, path, 'config' AS source, event_type <> 'error' AS enabled, row_number() OVER (ORDER BY path)::INTEGER AS root_rank FROM paths""",
    "pricing_dim": "SELECT lower(trim(n_name)) AS model, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey ELSE n_nationkey + 0.5 END::DOUBLE AS input, (n_nationkey * 5)::DOUBLE AS output FROM nation WHERE n_nationkey % 5 <> 0",
}
TABLE = "SELECT '{}' AS \"table\", count(*) AS n, {} AS total_tokens, {} AS cost FROM ({})".format
TOKENS = "coalesce(sum(total_tokens), 0)::BIGINT"
NO_TOKENS, NO_COST = "NULL::BIGINT", "NULL::DOUBLE"


def wide(name: str) -> str:
    return TABLE(name, TOKENS, COST, SQL[{"windows": "rolling_windows", "models": "model_rollup", "accounts": "by_account"}.get(name, name)])


#: Accounts and series of the report are those of the queries, but for idle accounts and the metric of the series.
ACTIVE = SQL["by_account"].replace("('claude', 'acct-idle'), ", "").replace(", ('codex', 'acct-idle')", "")
SQL["usage_report"] = " UNION ALL ".join(
    [
        wide("windows"), wide("models"), TABLE("accounts", TOKENS, COST, ACTIVE), TABLE("unknown_models", NO_TOKENS, NO_COST, SQL["unknown_models"]),
        *[TABLE(name, NO_TOKENS, NO_COST, f"SELECT * FROM range({n})") for name, n in (("activity", 48), ("peak", 1), ("levels", 48), ("providers", 1))],
        TABLE("limits", NO_TOKENS, NO_COST, f"WITH {HOURLY}, newest AS (SELECT account, max(captured_at) AS captured_at, arg_max(k, captured_at) AS k FROM hourly GROUP BY 1) {shape_b('newest')}"),
        TABLE("range", TOKENS, COST, SQL["range_totals"]), TABLE("range_days", TOKENS, COST, SQL["range_by_day"]), TABLE("range_models", TOKENS, COST, SQL["range_by_model"]),
    ]
)
WEEK = SQL["activity_series"].replace(series("24h", 86400, "cost"), series("7d", 604800, "cost"))
OWNERS = "CASE WHEN account = 'acct-4' THEN 1 ELSE 0 END, account"


def placed(name: str, order: str, columns: str, base: str) -> str:
    """Rows of a table of the report with their places: key, other key, flag, count, amount and more."""
    return f"SELECT '{name}' AS \"table\", row_number() OVER (ORDER BY {order}) - 1 AS place, {columns} FROM ({base})"


ALL = "total_tokens AS n, round(cost, 9) AS amount, records::BIGINT AS more"
BY_COST = "cost DESC, total_tokens DESC"
NONE = "NULL::VARCHAR AS other, NULL::BOOLEAN AS flag"
LEVELED = """ , leveled AS (SELECT bucket, CASE WHEN max(value) OVER () <= 0 OR value <= 0 THEN 1 ELSE greatest(1, least(12, CAST(round_even(value / max(value) OVER () * 12, 0) AS INTEGER))) END AS level FROM series) SELECT * FROM leveled"""
SHOWN_LIMITS = f"""WITH {HOURLY}, newest AS (SELECT account, max(captured_at) AS captured_at, arg_max(k, captured_at) AS k FROM hourly GROUP BY 1), t AS (SELECT (max(epoch_us(CAST(ts AS TIMESTAMP))) // 1000000)::DOUBLE AS now FROM events)
  SELECT account, key, CASE WHEN now >= resets_at THEN 0.0::DOUBLE ELSE used_percentage END AS shown FROM ({shape_b('newest')}), t"""
SQL["report_tables"] = " UNION ALL ".join(
    [
        placed("windows", """CASE "window" WHEN '1h' THEN 0 WHEN '5h' THEN 1 WHEN '24h' THEN 2 WHEN '7d' THEN 3 ELSE 4 END""", f'"window" AS key, {NONE}, {ALL}', SQL["rolling_windows"]),
        placed("models", f'"window", is_total, {BY_COST}, model_norm', f'"window", model_norm, known, {ALL}', SQL["model_rollup"]),
        placed("accounts", f"{BY_COST}, provider, account", f"provider, account, NULL::BOOLEAN, {ALL}", ACTIVE),
        placed("activity", "bucket", f"bucket::VARCHAR, {NONE}, unpriced_tokens, round(value, 9), records", WEEK),
        placed("peak", "bucket", f"bucket::VARCHAR, {NONE}, NULL::BIGINT, round(value, 9), NULL::BIGINT", f"SELECT * FROM ({WEEK}) ORDER BY value DESC, bucket LIMIT 1"),
        placed("levels", "bucket", f"bucket::VARCHAR, {NONE}, level::BIGINT, NULL::DOUBLE, NULL::BIGINT", WEEK.replace("SELECT bucket, value, records, unpriced_tokens FROM series", LEVELED)),
        placed("unknown_models", "model_norm", f"model_norm, {NONE}, NULL::BIGINT, NULL::DOUBLE, NULL::BIGINT", SQL["unknown_models"]),
        placed("providers", "n", "NULL::VARCHAR, NULL::VARCHAR, flag, n, NULL::DOUBLE, NULL::BIGINT", q("SELECT bool_or(provider = 'codex') AS flag, count(*) AS n FROM facts", LINES)),
        placed("limits", f"{OWNERS}, key", "account, key, NULL::BOOLEAN, NULL::BIGINT, shown, NULL::BIGINT", SHOWN_LIMITS),
        placed("range", "total_tokens", f"NULL::VARCHAR, {NONE}, total_tokens, round(cost, 9), active_days", f"SELECT * FROM ({SQL['range_totals']}), ({SQL['active_days']})"),
        placed("range_days", "day", f"day, {NONE}, {ALL}", SQL["range_by_day"]),
        placed("range_models", f"{BY_COST}, model_norm", f"model_norm, NULL::VARCHAR, known, {ALL}", SQL["range_by_model"]),
    ]
)
SQL["scope_fallback"] = q(f"SELECT {MEASURES} FROM priced")
SQL["usage_lines"] = q("""SELECT ord, model_raw, CASE WHEN ord % 2 = 1 THEN cache_creation WHEN ord % 3 <> 0 THEN k * 50 ELSE 0 END AS cache_creation, eph_5m, eph_1h FROM lines WHERE provider = 'claude' AND ord % 31 <> 0""", LINES)
SQL["active_and_archive"] = q("SELECT ts_us, model_raw, provider, input_tokens, output_tokens, cache_read, cache_creation, eph_5m, eph_1h FROM merged", LINES)
EVENT = "CAST(substr(account, 2) AS BIGINT)"
SQL["limits_landed"] = f"""SELECT account, key, used_percentage, NULL::VARCHAR AS warning FROM ({SQL["limits_normalize_a"]}) WHERE {EVENT} % 3 = 0 AND {EVENT} % 10 < 8
  UNION ALL SELECT account, key, used_percentage, NULL FROM ({SQL["limits_normalize_b"]}) WHERE {EVENT} % 3 <> 0 AND {EVENT} % 10 < 8
  UNION ALL SELECT 'e' || event_id, NULL, NULL, CASE WHEN event_id % 3 = 0 THEN 'Claude' ELSE 'Codex' END || CASE WHEN event_id % 10 = 9 THEN ' returned an invalid usage response' ELSE ' returned no usable usage limits' END FROM events WHERE event_id % 10 >= 8"""
SQL["windows_at_moments"] = q(f"""SELECT m.us AS moment_us, w."window", {MEASURES} FROM (SELECT (SELECT now FROM clock) - range * 25211000007 AS us FROM range(600)) m CROSS JOIN {WINDOWS}
  LEFT JOIN priced ON w.secs IS NULL OR m.us - ts_us <= w.secs * 1000000 GROUP BY 1, 2""")
# a query string goes on with further common tables after the base
SQL = {k: v.replace("cost FROM carded) ,", "cost FROM carded),").replace("FROM rollout) ,", "FROM rollout),") for k, v in SQL.items()}
