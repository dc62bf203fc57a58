"""Subscription limits: normalising responses and snapshots, the freshest per account, and their view."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterglass.functions.calendar import plain_timestamp
from meterglass.functions.text import human_duration, limit_label

# The limits that come first, and below the kinds and their label texts.
ORDER = ("five_hour", "seven_day")
NUMERIC = ("BIGINT", "DOUBLE", "FLOAT")
BUCKET = "key string, label string, used_percentage double, resets_at double, window_minutes double"


def number(value: Column, kind: str = "double", found: Column | None = None) -> Column:
    """A JSON number (or truth value) of a variant; null for anything else. ``found`` is its schema, where that is known."""
    found = F.schema_of_variant(value) if found is None else found
    return F.when(found.isin(*NUMERIC) | found.startswith("DECIMAL"), F.try_variant_get(value, "$", kind)).when(found == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("int").cast(kind))


def is_object(value: Column) -> Column:
    # any object is a struct without fields; its schema as text would go through all that it holds
    return F.try_variant_get(value, "$", "struct<>").isNotNull()


def text(value: Column, found: Column | None = None) -> Column:
    return F.when((F.schema_of_variant(value) if found is None else found) == "STRING", F.try_variant_get(value, "$", "string"))


def epoch(value: Column, found: Column | None = None) -> Column:
    """Seconds since the epoch of a JSON number or an ISO timestamp to the second (without zone: UTC)."""
    written = text(value, found)
    iso = F.unix_micros(plain_timestamp(written)) / 1e6
    return F.coalesce(number(value, found=found), iso)


def part(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def once(df: DataFrame, column: Column, name: str) -> DataFrame:
    """``df`` with a column that is computed once a row, however often it is used: what a generator gives is not inlined."""
    return df.select("*", F.explode(F.array(column)).alias(name))


def limits_from_list(responses: DataFrame) -> DataFrame:
    """Buckets of responses (account, captured_at, body variant, and columns that identify one) of the first shape.

    Its ``limits`` list gives rows named by kind; a kind that came before gets its index as suffix. A response without
    any such row gives those of its members that have a utilization. All of it stays within the row of the response,
    so nothing is shuffled and two responses of one account and time are never mixed.
    """
    bodies = once(responses, F.col("body"), "_body")
    fields = "struct<kind: variant, percent: variant, resets_at: variant, scope: variant>"
    # all fields of all items at once; item by item where one is no object
    typed = F.try_variant_get("_body", "$.limits", f"array<{fields}>")
    single = F.transform(F.when(F.schema_of_variant(part(F.col("_body"), "$.limits")).startswith("ARRAY"), F.try_variant_get("_body", "$.limits", "array<variant>")), lambda x: F.try_variant_get(x, "$", fields))
    items = once(bodies, F.coalesce(typed, single), "_items")

    # a lambda computes what it repeats again, so schemas and values follow in steps
    def schemas(item: Column, at: Column) -> Column:
        kind = F.when(F.schema_of_variant(item["kind"]) == "STRING", F.try_variant_get(item["kind"], "$", "string"))
        return F.struct(at.alias("at"), kind.alias("k"), item["percent"].alias("p"), item["resets_at"].alias("r"), item["scope"].alias("scope"), F.schema_of_variant(item["percent"]).alias("ps"), F.schema_of_variant(item["resets_at"]).alias("rs"))

    def bucket(b: Column) -> Column:
        return F.struct(b["at"].alias("at"), b["k"].alias("k"), b["scope"].alias("scope"), number(b["p"], found=b["ps"]).alias("used_percentage"), epoch(b["r"], b["rs"]).alias("resets_at"))

    complete = lambda b: b["used_percentage"].isNotNull() & b["resets_at"].isNotNull()
    listed = once(items, F.filter(F.transform(F.transform("_items", schemas), bucket), complete), "_listed")
    kinds = once(listed, F.transform("_listed", lambda b: F.when(b["k"] != "", b["k"]).otherwise(F.concat(F.lit("limit_"), b["at"].cast("string")))), "_kinds")
    # a kind that came before among those that are complete
    named = F.transform("_listed", lambda b, k: F.struct(F.get("_kinds", k).alias("kind"), (F.array_position("_kinds", F.get("_kinds", k)) <= k).alias("taken"), b["at"].alias("at"), b["scope"].alias("scope"), b["used_percentage"].alias("used_percentage"), b["resets_at"].alias("resets_at")))
    # a body or member that is no object has no entries or fields
    entries = F.map_entries(F.try_variant_get("_body", "$", "map<string,variant>"))
    cut = F.transform(entries, lambda e: F.struct(e["key"].alias("key"), F.try_variant_get(e["value"], "$", "struct<utilization: variant, resets_at: variant>").alias("v")))
    seen = F.transform(cut, lambda e: F.struct(e["key"].alias("k"), e["v"]["utilization"].alias("p"), e["v"]["resets_at"].alias("r"), F.schema_of_variant(e["v"]["utilization"]).alias("ps"), F.schema_of_variant(e["v"]["resets_at"]).alias("rs")))
    member = lambda b: F.struct(b["k"].alias("kind"), F.lit(None).cast("boolean").alias("taken"), F.lit(None).cast("int").alias("at"), F.lit(None).cast("variant").alias("scope"), number(b["p"], found=b["ps"]).alias("used_percentage"), epoch(b["r"], b["rs"]).alias("resets_at"))
    members = F.filter(F.transform(seen, member), complete)
    rows = kinds.select(*identity(responses), F.inline(F.when(F.size("_listed") > 0, named).otherwise(members)))
    scope = lambda p: F.nullif(text(part(F.col("scope"), f"$.{p}")), F.lit(""))
    model = F.coalesce(*map(scope, ("model.display_name", "model.id", "surface")), F.lit("SCOPED"))
    kind = F.col("kind")
    label = F.when(kind == "session", "5-HOUR").when(kind == "weekly_all", "WEEKLY").when(kind == "weekly_scoped", F.upper(F.concat(model, F.lit(" WEEKLY")))).otherwise(F.upper(F.replace(kind, F.lit("_"), F.lit(" "))))
    key = F.when(F.col("taken"), F.concat_ws("_", "kind", F.col("at").cast("string"))).otherwise(kind)
    return rows.select(*identity(responses), key.alias("key"), F.when(F.col("taken").isNotNull(), label).alias("label"), "used_percentage", "resets_at", F.lit(None).cast("double").alias("window_minutes"))


def identity(responses: DataFrame) -> list[str]:
    """The columns of a response besides its body."""
    return [c for c in responses.columns if c != "body"]


def limits_from_map(responses: DataFrame) -> DataFrame:
    """Buckets of responses of the second shape: limits by id (or a single one), each with up to three windows."""
    bodies = once(responses, F.struct(part(F.col("body"), "$.rateLimitsByLimitId").alias("many"), part(F.col("body"), "$.rateLimits").alias("one")), "_body")
    many = once(bodies, F.when(is_object(F.col("_body.many")), F.try_variant_get("_body.many", "$", "map<string,variant>")), "_many")
    limits = many.select(*identity(responses), F.explode(F.when(F.size("_many") > 0, F.col("_many")).otherwise(F.create_map(F.lit("codex"), F.col("_body.one")))).alias("id", "limit"))
    # all fields of a limit at once, and then those of a window; anything but an object has none
    slots = ("primary", "secondary", "individualLimit")
    cut = once(limits.drop("_body"), F.try_variant_get("limit", "$", f"struct<limitName: variant, {', '.join(f'{s}: variant' for s in slots)}>"), "_cut")
    named = cut.select(*identity(responses), "id", text(F.col("_cut.limitName")).alias("name"), F.inline(F.array(*[F.struct(F.lit(s).alias("slot"), F.col(f"_cut.{s}").alias("w")) for s in slots]))).where("w IS NOT NULL")
    windows = once(named, F.try_variant_get("w", "$", "struct<usedPercent: variant, resetsAt: variant, windowDurationMins: variant>"), "_w")
    kinds = once(windows.drop("w"), F.struct(*[F.schema_of_variant(f"_w.{n}").alias(n) for n in ("usedPercent", "resetsAt", "windowDurationMins")]), "_kind")
    value = lambda n, f: f(F.col(f"_w.{n}"), found=F.col(f"_kind.{n}"))
    name = F.when(F.col("name") != "", F.col("name")).alias("name")
    rows = kinds.select(*identity(responses), "id", name, "slot", value("usedPercent", number).alias("used_percentage"), value("resetsAt", epoch).alias("resets_at"), value("windowDurationMins", number).alias("window_minutes")).where("used_percentage IS NOT NULL AND resets_at IS NOT NULL")
    label = F.upper(F.concat_ws(" ", "name", limit_label(F.col("window_minutes"), F.col("slot"))))
    return rows.select(*identity(responses), F.concat_ws("_", "id", "slot").alias("key"), label.alias("label"), "used_percentage", "resets_at", "window_minutes")


def landed_limits(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Buckets and warnings of landed responses (provider, account, captured_at, raw: JSON text; and ``response``, their id).

    Responses of provider 'claude' have the first shape, others the second. A response that is no object, or gives no
    bucket, has a warning row (provider, account, captured_at, response, warning) instead.
    """
    bodies = once(responses, F.try_parse_json("raw"), "body").drop("raw")
    first, second = F.col("provider") == "claude", F.coalesce(F.col("provider") != "claude", F.lit(True))
    buckets = limits_from_list(bodies.where(first)).unionByName(limits_from_map(bodies.where(second)))
    found = limits_found(F.col("provider"), F.col("body"))
    name = F.initcap(F.coalesce("provider", F.lit("unknown")))
    what = F.when(is_object(F.col("body")), F.concat(name, F.lit(" returned no usable usage limits"))).otherwise(F.concat(name, F.lit(" returned an invalid usage response")))
    return buckets, bodies.where(~found).select(*identity(bodies), what.alias("warning"))


def limits_found(provider: Column, body: Column) -> Column:
    """Whether a response gives any bucket, decided within its row."""
    usable = lambda item, used, reset: F.coalesce(is_object(item) & number(part(item, used)).isNotNull() & epoch(part(item, reset)).isNotNull(), F.lit(False))
    items = F.when(F.schema_of_variant(part(body, "$.limits")).startswith("ARRAY"), F.try_variant_get(body, "$.limits", "array<variant>"))
    members = lambda path: F.map_values(F.when(is_object(part(body, path)), F.try_variant_get(body, path, "map<string,variant>")))
    listed = F.exists(items, lambda x: usable(x, "$.percent", "$.resets_at"))
    named = F.exists(members("$"), lambda x: usable(x, "$.utilization", "$.resets_at"))
    slots = lambda x: reduce(or_, [usable(part(x, f"$.{s}"), "$.usedPercent", "$.resetsAt") for s in ("primary", "secondary", "individualLimit")])
    by_id = members("$.rateLimitsByLimitId")
    many, one = F.exists(by_id, slots), slots(part(body, "$.rateLimits"))
    second = F.when(F.size(by_id) > 0, many).otherwise(one)
    return F.coalesce(F.when(provider == "claude", F.coalesce(listed, F.lit(False)) | F.coalesce(named, F.lit(False))).otherwise(second), F.lit(False))


def limit_snapshots(lines: DataFrame) -> DataFrame:
    """Buckets of snapshots inside log lines (account, captured_at or null, ord, limits variant); malformed windows are skipped."""
    slots = F.array(*[F.struct(F.lit(f"codex_{s}").alias("key"), part(F.col("limits"), f"$.{s}").alias("w")) for s in ("primary", "secondary")])
    rows = lines.select("account", F.coalesce("captured_at", F.lit(0.0)).alias("captured_at"), "ord", F.inline(slots)).where(is_object(F.col("w")))
    rows = rows.select("account", "captured_at", "ord", "key", F.lit(None).cast("string").alias("label"), number(part(F.col("w"), "$.used_percent")).alias("used_percentage"), number(part(F.col("w"), "$.resets_at")).alias("resets_at"), number(part(F.col("w"), "$.window_minutes")).alias("window_minutes"))
    return rows.where("used_percentage IS NOT NULL AND resets_at IS NOT NULL")


def captures(buckets: DataFrame, *order: str) -> DataFrame:
    """One row per capture: account, captured_at (and ``order``) and an array of its buckets."""
    fields = [x.split()[0] for x in BUCKET.split(", ")]
    return buckets.groupBy("account", "captured_at", *order).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("buckets"))


def latest_limits(snapshots: DataFrame) -> DataFrame:
    """The newest capture (account, captured_at, ord, buckets) of each account; ties go to the later one read."""
    best = F.max_by(F.struct("captured_at", "buckets"), F.struct(F.coalesce("captured_at", F.lit(0.0)), F.col("ord")))
    return snapshots.groupBy("account").agg(best.alias("b")).select("account", "b.*")


def current_limits(snapshot: DataFrame, last_good: DataFrame, landed: DataFrame, enabled: DataFrame, default_account: str) -> DataFrame:
    """The freshest capture (account, captured_at, buckets) of every enabled account.

    Ties go to the snapshot, then the stored one, then the landed response, which is only of the default account. A
    capture without a time is older than all.
    """
    ranked = [d.select("account", "captured_at", "buckets", F.lit(k).alias("src")) for k, d in enumerate((snapshot, last_good, landed.where(F.col("account") == default_account)))]
    rows = ranked[0].unionByName(ranked[1]).unionByName(ranked[2]).join(enabled.select("account"), "account", "left_semi")
    best = F.max_by(F.struct("captured_at", "buckets"), F.struct(F.coalesce("captured_at", F.lit(float("-inf"))), -F.col("src")))
    return rows.groupBy("account").agg(best.alias("b")).select("account", "b.*")


def isolate_failures(fresh: DataFrame, last_good: DataFrame) -> DataFrame:
    """New captures (account, captured_at, buckets, error); an account whose fetch failed keeps its stored one and its warning."""
    old = last_good.select("account", F.col("captured_at").alias("old_at"), F.col("buckets").alias("old"))
    rows = fresh.join(old, "account", "full_outer")
    ok = F.col("error").isNull() & F.col("buckets").isNotNull()
    return rows.select("account", F.when(ok, F.col("captured_at")).otherwise(F.col("old_at")).alias("captured_at"), F.when(ok, F.col("buckets")).otherwise(F.col("old")).alias("buckets"), F.col("error").alias("warning"))


def limits_by_account(current: DataFrame, accounts: DataFrame) -> DataFrame:
    """Ordered bucket rows with labels. The prefix is the provider's name, or the account's where the provider has several.

    ``accounts``: provider, account, provider_rank, root_rank.
    """
    several = accounts.groupBy("provider").agg((F.count("*") > 1).alias("several"))
    named = accounts.join(F.broadcast(several), "provider")
    rows = current.join(F.broadcast(named), "account").select("provider", "account", "provider_rank", "root_rank", "several", F.inline("buckets"))
    own = F.coalesce(F.nullif(F.col("label"), F.lit("")), limit_label(F.col("window_minutes"), F.col("key")))
    prefix = F.upper(F.when(F.col("several"), F.col("account")).otherwise(F.col("provider")))
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ORDER)), F.col("key")), F.lit(0)), F.lit(len(ORDER) + 1))
    out = rows.select("provider", "account", "provider_rank", "root_rank", "key", F.concat_ws(" ", prefix, own).alias("label"), "used_percentage", "resets_at", place.alias("place"))
    return out.orderBy("provider_rank", "root_rank", "place", "key")


def limit_status(buckets: DataFrame, now: Column) -> DataFrame:
    """What is shown of a bucket: an expired one is at 0 percent and tells its age, others what remains."""
    expired = now >= F.col("resets_at")
    age = human_duration(F.floor(now - F.col("resets_at")))
    ago = F.when(age == "now", "just now").otherwise(F.concat(age, F.lit(" ago")))
    note = F.when(expired, F.concat(F.lit("reset "), ago, F.lit(" · refresh pending"))).otherwise(F.concat(F.lit("resets in "), human_duration(F.floor(F.col("resets_at") - now))))
    return buckets.withColumn("shown_percentage", F.when(expired, 0.0).otherwise(F.col("used_percentage"))).withColumn("note", note)
