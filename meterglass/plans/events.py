"""Usage derived from the driver's events table, the same for every registered query and its SQL."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterglass.operators.merge import merge_usage
from meterglass.operators.pricing import default_prices, price_facts
from meterglass.operators.rollout import rollout_usage
from meterglass.sources.extract import rollout_events, usage_lines
from meterglass.sources.lines import parsed, scan_usage

#: Events of a generated log file of the first provider.
EVENTS_PER_FILE = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the cluster's shared one (spark.checkpoint.dir); a temporary one only within one machine where that is unset."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return f"{base or tempfile.mkdtemp(prefix='usage-')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _int(c: Column) -> Column:
    return c.cast("long")


def event_lines(events: DataFrame) -> DataFrame:
    """A log line per event: usage counters, ids, model, account, provider and file."""
    ord_, k = F.col("event_id"), _int(F.get_json_object("props", "$.k"))
    group = F.floor(ord_ / 3).cast("string")
    model = (
        F.when(F.col("event_type") == "view", "claude-opus-4-8[1m]").when(F.col("event_type") == "click", "us.anthropic.claude-sonnet-4-6-20251001")
        .when(F.col("event_type") == "purchase", "gpt-5.4-2026-03-05").when(F.col("event_type") == "signup", "claude-haiku-4-5").otherwise("mystery-9")
    )
    marker = F.when(F.col("event_type") == "signup", F.when(k % 3 == 0, "gpt-5.5").when(k % 3 == 1, "gpt-5.4-2026-03-05").otherwise("mystery-9"))
    split = ord_ % 3 == 0
    return events.select(
        ord_.alias("ord"), F.when(ord_ % 11 != 0, F.col("ts").cast("timestamp")).alias("ts"), F.concat(F.lit("r"), group).alias("request_id"), F.concat(F.lit("m"), group).alias("message_id"),
        model.alias("model_raw"), (k * 1000).alias("input_tokens"), _int(F.floor(F.col("value") * 10)).alias("output_tokens"), (k * 3000).alias("cache_read"), (k * 50).alias("cache_creation"),
        F.when(~split, k * 20).alias("eph_5m"), F.when(~split, k * 30).alias("eph_1h"), F.concat(F.lit("acct-"), (F.col("user_id") % 5).cast("string")).alias("account"),
        F.when(F.col("user_id") % 5 == 4, "codex").otherwise("claude").alias("provider"), F.col("user_id").alias("file"), marker.alias("marker"), k.alias("k"),
    )


def claude_lines(events: DataFrame) -> DataFrame:
    return event_lines(events).where("provider = 'claude'")


def codex_events(events: DataFrame) -> DataFrame:
    """Marker and token lines: running totals of each file, missing in every seventh line, and last usage in every fifth."""
    lines = event_lines(events).where("provider = 'codex'")
    token = F.col("marker").isNull()
    upto = Window.partitionBy("file").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    sums = [F.sum(F.when(token, c)).over(upto).cast("long").alias(n) for n, c in (("input", F.col("input_tokens")), ("cached", F.col("k") * 400), ("output", F.col("output_tokens")))]
    total = F.when(token & (F.col("ord") % 7 != 0), F.struct(*sums))
    last = F.when(token & (F.col("ord") % 5 == 0), F.struct(F.col("input_tokens").alias("input"), (F.col("k") * 1200).alias("cached"), F.col("output_tokens").alias("output")))
    return lines.select("file", "ord", "ts", "account", "marker", token.alias("is_token"), total.alias("total"), last.alias("last"))


def usage_facts(events: DataFrame) -> DataFrame:
    """Merged facts of the first provider and de-cumulated ones of the second."""
    return merge_usage(claude_lines(events)).unionByName(rollout_usage(codex_events(events)))


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return price_facts(usage_facts(events(spark, sf_dir)), default_prices(spark))


def now_value(spark: SparkSession, sf_dir: str) -> int:
    """The time of the last event in microseconds: one scan of the column."""
    return events(spark, sf_dir).agg(F.unix_micros(F.max("ts").cast("timestamp")).alias("t")).first()["t"]


def now_us(spark: SparkSession, sf_dir: str) -> Column:
    """The time of the last event as a literal."""
    return F.lit(now_value(spark, sf_dir)).cast("long")


def usage_json(lines: DataFrame) -> Column:
    """The log line of each of `event_lines` of the first provider."""
    usage = F.struct(
        F.col("input_tokens"), F.col("output_tokens"), F.col("cache_read").alias("cache_read_input_tokens"), F.col("cache_creation").alias("cache_creation_input_tokens"),
        F.when(F.col("eph_5m").isNotNull(), F.struct(F.col("eph_5m").alias("ephemeral_5m_input_tokens"), F.col("eph_1h").alias("ephemeral_1h_input_tokens"))).alias("cache_creation"),
    )
    message = F.struct(F.col("message_id").alias("id"), F.col("model_raw").alias("model"), usage.alias("usage"))
    return F.to_json(F.struct(F.lit("assistant").alias("type"), F.col("request_id").alias("requestId"), stamp().alias("timestamp"), message.alias("message")))


def stamp() -> Column:
    return F.when(F.col("ts").isNotNull(), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).otherwise("not a time")


#: What stands between the lines of a log besides usage: which events it follows, and the text for each provider.
NOISE = {
    "malformed": (13, {"claude": '{"type": "assistant", "usage": ', "codex": '{"payload": {"type": "token_count"'}),
    "blank": (17, {"claude": "  \t ", "codex": " "}),
    "foreign": (19, {"claude": '{"type": "user", "text": "hello"}', "codex": '{"type": "session_meta"}'}),
    "no object": (23, {"claude": '["assistant", {"usage": 1}]', "codex": '["token_count"]'}),
}
#: The last line of each file, not ended yet.
OPEN = {
    "claude": '{"type": "assistant", "timestamp": "2024-01-01T00:00:00Z", "message": {"id": "open", "usage": {"input_tokens": 1}}}',
    "codex": '{"timestamp": "2024-01-01T00:00:00Z", "type": "event_msg", "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": 1}}}}',
}


def codex_values(events: DataFrame) -> DataFrame:
    """The log line (file, ord, value) of each of `codex_events`."""
    counters = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(f"{c}.input").alias("input_tokens"), F.col(f"{c}.cached").alias("cached_input_tokens"), F.col(f"{c}.output").alias("output_tokens")))
    token = F.struct(F.lit("token_count").alias("type"), F.struct(counters("total").alias("total_token_usage"), counters("last").alias("last_token_usage")).alias("info"))
    value = F.when(F.col("is_token"), F.to_json(F.struct(stamp().alias("timestamp"), F.lit("event_msg").alias("type"), token.alias("payload")))).otherwise(F.to_json(F.struct(stamp().alias("timestamp"), F.lit("turn_context").alias("type"), F.struct(F.col("marker").alias("model")).alias("payload"))))
    return codex_events(events).select("file", "ord", value.alias("value"))


def write_logs(events: DataFrame, folder: str) -> None:
    """The events as JSONL files of both providers: files of consecutive events, and one file per user.

    Malformed, blank and foreign lines and lines that are no object stand between them (`NOISE`), and the last line of
    every file is open: a space, not a line end, follows each row that is written.
    """
    file = F.lpad(F.floor(F.col("ord") / EVENTS_PER_FILE).cast("string"), 12, "0")
    lines = claude_lines(events)
    claude = lines.select(file.alias("file"), "ord", usage_json(lines).alias("value"))
    codex = codex_values(events).select(F.lpad(F.col("file").cast("string"), 12, "0").alias("file"), "ord", "value")
    for name, usage in (("claude", claude), ("codex", codex)):
        rows = [F.struct(F.lit(0).alias("place"), F.concat("value", F.lit("\n")).alias("value"))]
        rows += [F.when(F.col("ord") % n == 0, F.struct(F.lit(k + 1).alias("place"), F.lit(text[name] + "\n").alias("value"))) for k, (n, text) in enumerate(NOISE.values())]
        mixed = usage.select("file", "ord", F.inline(F.array_compact(F.array(*rows))))
        last = usage.groupBy("file").agg(F.max("ord").alias("ord")).select("file", "ord", F.lit(len(rows)).alias("place"), F.lit(OPEN[name]).alias("value"))
        ordered = mixed.unionByName(last).repartition("file").sortWithinPartitions("file", "ord", "place").drop("ord", "place")
        ordered.write.option("lineSep", " ").partitionBy("file").text(f"{folder}/{name}")


def scanned(spark: SparkSession, folder: str, provider: str) -> DataFrame:
    """Parsed candidate lines of a provider's generated logs."""
    return parsed(scan_usage(spark, f"{folder}/{provider}", pattern="*.txt").where("value IS NOT NULL"))


def extracted_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Facts by way of the logs: scan, parse, extract, merge and de-cumulate. All have one account per provider."""
    claude = usage_lines(scanned(spark, folder, "claude")).withColumns({"account": F.lit("claude"), "provider": F.lit("claude")})
    # two steps of the carry scan use the events, and a scan of logs is not reused
    codex = written(rollout_events(scanned(spark, folder, "codex")).drop("limits").withColumn("account", F.lit("codex")))
    return merge_usage(claude).drop("ord").unionByName(rollout_usage(codex).drop("ord"))
