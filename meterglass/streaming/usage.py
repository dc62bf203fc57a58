"""Structured Streaming forms of the operators.

A landing directory receives immutable chunk files; progress lives in the checkpoint. None of these has a watermark
unless one is given: late lines count as they do in a batch, and state grows with the keys, as documented there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterglass.operators.accounts import tag_accounts
from meterglass.operators.cells import DAY, MINUTE, added_cells, cut_minutes, minute_cells, windows_from_cells
from meterglass.operators.merge import COUNTERS, combined, merge_key, state_facts, states
from meterglass.operators.rollout import rollout_usage
from meterglass.sources import snapshots
from meterglass.sources.extract import rollout_events, usage_lines
from meterglass.sources.lines import parsed, prefilter, rollout_prefilter, usage_prefilter
from meterglass.sources.store import few_listing_tasks
from meterglass.streaming.levels import add_run, place, read_runs

#: Folders of a run in a log of events; a batch of few files touches few of them.
BUCKETS = 32
#: A log that grows lands as chunk files in a folder of its own, in the order of their names; a level of folders named chunk=... is passed over.
SESSION = r"^(.*?)(?:/chunk=[^/]*)?/[^/]*$"


def line_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None, pattern: str = "*.jsonl") -> DataFrame:
    """New lines (value, file, file_size, block) of chunk files, which are immutable: a last line without a line end counts."""
    few_listing_tasks(spark)
    reader = spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("lineSep", "\n")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("file_size"), F.col("_metadata.file_block_start").alias("block"))


#: The columns of a merged fact's key; ``line`` is null but for lines without a message_id, which stay alone.
MERGE_KEY = ("request_id", "message_id", "line")


def merged_stream(lines: DataFrame) -> DataFrame:
    """The merge as a streaming aggregate: per `MERGE_KEY` the maxima of the counters and the first dated line's fields.

    A line without a timestamp counts only after the key's first dated one, which may still come; so the state holds
    the counters of those lines one by one. A key without a dated line gives no row.
    """
    dated = F.col("ts").isNotNull()
    first = F.min_by(F.struct("ts", "model_raw", "account", "provider", "ord"), F.when(dated, F.col("ord"))).alias("first")
    undated = F.collect_list(F.when(~dated, F.struct("ord", *COUNTERS))).alias("undated")
    most = [F.max(F.when(dated, F.col(c))).alias(c) for c in COUNTERS]
    merged = lines.groupBy("request_id", "message_id", merge_key()["o"].alias("line")).agg(first, undated, *most).where("first IS NOT NULL")
    later = F.filter("undated", lambda x: x["ord"] > F.col("first.ord"))
    counters = [F.greatest(F.col(c), F.array_max(later[c])).alias(c) for c in COUNTERS]
    return merged.select(*MERGE_KEY, "first", *counters)


def ingest_usage(log: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch that keeps the states of usage lines in a levelled log; `merged_log` gives their facts.

    Nothing older is read but what a merge of levels takes up, and a batch that runs again changes nothing.
    """

    def apply(batch: DataFrame, number: int) -> None:
        add_run(states(batch), log, number, combined)

    return apply


def merged_log(spark: SparkSession, log: str) -> DataFrame:
    """The facts of all whole batches of a log of states, with `MERGE_KEY`: those of a batch merge of all lines."""
    return state_facts(combined(read_runs(spark, log)), keep_key=True)


def ingest_events(log: str, facts: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch for event logs: files that a batch touches are attributed and counted anew, late markers included.

    Of older batches only the folders of the touched buckets are read. A file without usage is kept, too, as a row
    without ``ord``, lest its older facts stay. `newest_facts` gives the facts.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64("file"), F.lit(BUCKETS)).cast("int"))
        add_run(rows.repartition("bucket"), log, number, lambda runs: runs.repartition("bucket"), by=["bucket"])
        own = spark.read.schema(rows.schema).parquet(place(log, 0, number))
        files = own.select("file").distinct()
        touched = [r["bucket"] for r in own.select("bucket").distinct().collect()]
        lines = read_runs(spark, log, rows, number + 1).where(F.col("bucket").isin(touched)).join(files, "file", "left_semi").drop("bucket")
        used = rollout_usage(lines, keep_file=True).unionByName(files, allowMissingColumns=True).withColumn("version", F.lit(number))
        add_run(used, facts, number, newest_of_files)

    return apply


def newest_of_files(rows: DataFrame) -> DataFrame:
    """Of each file the rows of its newest version."""
    newest = rows.groupBy("file").agg(F.max("version").alias("version"))
    return rows.join(newest, ["file", "version"], "left_semi").select(*rows.columns)


def newest_facts(spark: SparkSession, facts: str) -> DataFrame:
    """Facts by file as `ingest_events` left them."""
    return newest_of_files(read_runs(spark, facts)).where("ord IS NOT NULL").drop("file", "version")


def first_seen(lines: DataFrame, ledger: str, number: int) -> DataFrame:
    """``lines`` (value, file, file_size, ord) without those of files that earlier batches had under another path.

    A file is known by its name, its size and the digest of its first line here: a moved or copied one counts once, and
    files of one name in different folders both count. The ledger is a levelled log with a row for each file.
    """
    spark = lines.sparkSession
    name = F.element_at(F.split("file", "/"), -1)
    own = lines.groupBy("file").agg(F.sha2(F.min_by("value", "ord"), 256).alias("head"), F.max("file_size").alias("size")).withColumn("name", name)
    one = own.groupBy("head", "size", "name").agg(F.min("file").alias("file"))  # of copies that land together
    known = read_runs(spark, ledger, one, number) if number else None
    new = one if known is None else one.join(known.select("head", "size", "name"), ["head", "size", "name"], "left_anti")
    add_run(new.select(*one.columns), ledger, number, lambda runs: runs.dropDuplicates(["head", "size", "name"]))
    kept = spark.read.schema(one.schema).parquet(place(ledger, 0, number))
    return lines.join(kept.select("file"), "file", "left_semi")


def ingest_logs(spark: SparkSession, folder: str, claude_roots: DataFrame, codex_roots: DataFrame) -> Callable[[DataFrame, int], None]:
    """A foreachBatch for `line_stream` of both providers' logs, in any mixture; `log_facts` gives the facts.

    The lines that can hold usage are written once, so log text is read once. Lines of the first provider are merged
    as states, in the order of batch, file and line. Events of the second are attributed by the log that they belong to
    (`SESSION`), in the order of its chunks, whenever these land. An account is that of the first enabled root above
    the file. Malformed, foreign and undated lines are treated as in a batch scan.
    """
    usage, events = ingest_usage(f"{folder}/usage"), ingest_events(f"{folder}/events", f"{folder}/rollouts")

    def apply(batch: DataFrame, number: int) -> None:
        landed = f"{folder}/lines/batch={number}"
        order = F.struct(F.lit(number).cast("long").alias("batch"), "file", "block", F.monotonically_increasing_id().alias("line"))
        batch.where(prefilter(F.col("value"))).withColumn("ord", order).select("value", "file", "file_size", "ord").write.mode("overwrite").parquet(landed)
        lines = first_seen(spark.read.parquet(landed), f"{folder}/ledger", number)
        first = tag_accounts(usage_lines(parsed(lines.where(usage_prefilter(F.col("value"))))), F.col("file"), claude_roots, "claude")
        usage(first.drop("file").withColumn("provider", F.lit("claude")), number)
        second = tag_accounts(rollout_events(parsed(lines.where(rollout_prefilter(F.col("value"))))), F.col("file"), codex_roots, "codex").drop("limits")
        events(second.withColumn("ord", F.struct("ord.file", "ord.block", "ord.line")).withColumn("file", F.regexp_extract("file", SESSION, 1)), number)
        snapshots.remove(spark, landed)

    return apply


def log_facts(spark: SparkSession, folder: str) -> DataFrame:
    """The facts of both providers that `ingest_logs` has taken in so far."""
    return merged_log(spark, f"{folder}/usage").drop(*MERGE_KEY, "ord").unionByName(newest_facts(spark, f"{folder}/rollouts").drop("ord"))


def newest(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """Of each key the row of the newest batch under ``path`` (folders batch=N)."""
    rows = spark.read.parquet(path)
    columns = [c for c in rows.columns if c not in (*keys, "version", "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), "batch").alias("r")).select(*keys, "r.*")


def latest_limits_stream(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot (account, captured_at, ord, value) per account as state; an older one never replaces it."""
    best = F.max_by(F.struct("captured_at", "value"), F.struct(F.coalesce("captured_at", F.lit(0.0)), F.col("ord")))
    return snapshots.groupBy("account").agg(best.alias("b")).select("account", "b.*")


def tumbling(facts: DataFrame, width: str, watermark: str | None = None) -> DataFrame:
    """Cost and tokens per event-time bucket, closed on the left."""
    timed = facts.withWatermark("ts", watermark) if watermark else facts
    cost = F.sum(F.col("cost").cast("decimal(20,12)")).alias("cost")
    return timed.groupBy(F.window("ts", width)).agg(cost, F.sum("total_tokens").alias("total_tokens"), F.count("*").alias("records")).select(F.unix_micros("window.start").alias("start_us"), F.col("cost").cast("double").alias("cost"), "total_tokens", "records")


def live_windows(folder: str, now: Callable[[], int]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch that asks for all rolling windows at ``now`` (microseconds) anew, into ``result`` of the folder.

    A batch adds its cells of a minute to one levelled log, and its priced facts by day to another. The answer reads
    cells, and of the facts only the days and minutes that an edge cuts.
    """
    table, cells = f"{folder}/facts", f"{folder}/cells"

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.where("ts IS NOT NULL").withColumn("day", F.floor(F.unix_micros("ts") / DAY).cast("int"))
        add_run(rows.repartition("day"), table, number, lambda runs: runs.repartition("day"), by=["day"])
        add_run(minute_cells(rows), cells, number, added_cells)
        moment = now()
        days = {m * MINUTE // DAY for m in cut_minutes([moment])}
        facts = read_runs(spark, table, rows).where(F.col("day").isin(sorted(days)))
        found = windows_from_cells(added_cells(read_runs(spark, cells)), facts, [moment])
        found.drop("moment_us").write.mode("overwrite").parquet(f"{folder}/result/batch={number}")

    return apply


def run_updates(stream: DataFrame, folder: str, write: Callable[[DataFrame, int], None] | None = None, mode: str = "update") -> None:
    """Runs a stream over what has landed; each batch's rows replace the folder of its number. The checkpoint is beside them."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write or keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
