"""Facts kept by file: only files that changed are read, and only what their lines can change is merged again.

A refresh compares a listing with the ledger of the version before. Lines of new, grown, cut and touched files become
states of a new run, by file; the ledger says of each file which run has it, so what older runs hold of changed or
removed files counts no more, without any rewriting. A file that only moved keeps its states under its new path. Keys
are dealt over buckets by hash; the buckets that lines came to or went from are merged anew from all live states, others
keep theirs. Logs of the second provider are counted by file, so a changed file's facts replace its old ones.

A version is the ledger and the list of buckets; it is published last (`snapshots`), so a refresh that stops leaves the
version before it readable. Runs and buckets that no kept version needs are removed by `vacuum`. Spark's driver lists the
files once; what is changed stays in the ledger, and tasks take it from there. States and facts are sorted by bucket
within their files, so neither the number of logs nor that of buckets makes more of these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from meterglass.operators.accounts import tag_accounts
from meterglass.operators.merge import COUNTERS, combined, state_facts, states
from meterglass.operators.rollout import rollout_usage
from meterglass.sources import snapshots
from meterglass.sources.extract import rollout_events, usage_lines
from meterglass.sources.lines import parsed, rollout_prefilter, scan_usage, usage_prefilter
from meterglass.sources.store import file_listing, files_unread

BUCKETS = 64
#: So many runs are put together by the next refresh.
MOST_RUNS = 32
LEDGER = "path string, size long, modified timestamp, origin string, run int"
LINES = "value string, file string, file_size long, ord struct<file: string, block: bigint, line: bigint>"
FACTS = ["ts", "model_raw", "account", "provider", *COUNTERS]
FACT_TYPES = "ts timestamp, model_raw string, account string, provider string, " + ", ".join(f"{c} long" for c in COUNTERS)


def ledger_of(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, modified, origin, run) of each file of the newest version: ``origin`` is its path when it was read, into ``run``."""
    held = snapshots.current(spark, path)
    return spark.read.parquet(f"{held}/ledger") if held else spark.createDataFrame([], LEDGER)


def next_ledger(listing: DataFrame, old: DataFrame, run: int) -> DataFrame:
    """The ledger after a refresh: unchanged and moved files keep their origin and run, all others are read into ``run``.

    A file has moved if its path is gone and exactly one new path has its name, size and time.
    """
    both = listing.join(old.withColumnsRenamed({"size": "_size", "modified": "_modified"}), "path", "left")
    same = F.col("_size").eqNullSafe(F.col("size")) & F.col("_modified").eqNullSafe(F.col("modified"))
    kept = both.where(same).select("path", "size", "modified", "origin", "run")
    rest = both.where(~same)
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    sign = ["name", "size", "modified"]
    gone = old.join(listing.select("path"), "path", "left_anti").select(name, "size", "modified", "origin", "run")
    once = gone.groupBy(*sign).agg(F.count("*").alias("_n"), F.min(F.struct("origin", "run")).alias("_from")).where("_n = 1")
    new = rest.where("_size IS NULL").select("path", name, "size", "modified")
    target = new.groupBy(*sign).agg(F.count("*").alias("_m"), F.min("path").alias("path")).where("_m = 1")
    moved = target.join(once, sign).select("path", "_from.*")
    return kept.unionByName(rest.select("path", "size", "modified").join(moved, "path", "left").select("path", "size", "modified", F.coalesce("origin", "path").alias("origin"), F.coalesce("run", F.lit(run)).alias("run")))


def _runs(spark: SparkSession, path: str, kind: str, ledger: DataFrame, schema: StructType | str, *more: str) -> DataFrame | None:
    """What the ledger's runs have of ``kind``, with ``path`` of each file now, and ``more`` of the ledger; None without runs."""
    numbers = [r["run"] for r in ledger.select("run").distinct().collect()]
    found = [spark.read.schema(schema).parquet(f"{path}/runs/run={n}/{kind}").withColumn("run", F.lit(n)) for n in sorted(numbers)]
    if not found:
        return None
    rows = found[0]
    for other in found[1:]:
        rows = rows.unionByName(other)
    return rows.join(ledger.select("path", F.col("origin").alias("file"), "run", *more), ["file", "run"])


def refresh(spark: SparkSession, path: str, *paths: str, claude_roots: DataFrame, codex_roots: DataFrame, pattern: str = "*.jsonl") -> bool:
    """Brings the facts in ``path`` up to date with the files below ``paths``; whether anything had changed."""
    number = (snapshots.newest(spark, path) or 0) + 1
    run, old = f"{path}/runs/run={number}", ledger_of(spark, path)
    snapshots.remove(spark, run)  # of a refresh that stopped
    with files_unread(spark):
        file_listing(spark, *paths, pattern=pattern).write.parquet(f"{run}/listing")  # once, as the ledger's joins read it thrice
    listing = spark.read.schema("path string, size long, modified timestamp").parquet(f"{run}/listing")
    next_ledger(listing, old, number).write.parquet(f"{run}/ledger")
    ledger = spark.read.schema(LEDGER).parquet(f"{run}/ledger")
    sign = ["path", "size", "modified", "origin", "run"]
    out, into = old.join(ledger, sign, "left_anti"), ledger.join(old, sign, "left_anti")
    if out.isEmpty() and into.isEmpty() and snapshots.newest(spark, path) is not None:
        snapshots.remove(spark, run)
        return False

    changed = ledger.where(F.col("run") == number).select("path", "size")
    # the lines that can hold usage are written, so that logs are read once, and a line is parsed by the provider it can be of
    scan_usage(spark, listing=changed).drop("lines").where("value IS NOT NULL").write.parquet(f"{run}/lines")
    lines = spark.read.schema(LINES).parquet(f"{run}/lines")
    usage = usage_lines(parsed(lines.where(usage_prefilter(F.col("value"))))).withColumns({"ord": F.struct("ord.block", "ord.line"), "account": F.lit(""), "provider": F.lit("claude")})
    bucket = F.pmod(F.xxhash64("r", "m", F.when(F.col("o").isNotNull(), F.struct("file", "o"))), F.lit(BUCKETS)).cast("int")
    own = states(usage, "file").withColumn("bucket", bucket)
    events = rollout_usage(rollout_events(parsed(lines.where(rollout_prefilter(F.col("value"))))).drop("limits").withColumn("account", F.lit("")), keep_file=True)
    before = ledger.where(F.col("run") != number)
    all_live = before.select("run").distinct().count() >= MOST_RUNS
    if all_live:
        # all live states go into this run
        own = own.unionByName(_runs(spark, path, "usage", before, own.schema).select(*own.columns))
        events = events.unionByName(_runs(spark, path, "rollouts", before, events.schema).select(*events.columns))
        ledger.withColumn("run", F.lit(number)).write.parquet(f"{run}/all")
        ledger = spark.read.schema(LEDGER).parquet(f"{run}/all")
    # by bucket within a file, which readers of some buckets skip by; a file for each bucket and task would be thousands
    own.sortWithinPartitions("bucket").write.parquet(f"{run}/usage")
    events.write.parquet(f"{run}/rollouts")
    for done in ("lines", "listing"):
        snapshots.remove(spark, f"{run}/{done}")

    mine = spark.read.schema(own.schema).parquet(f"{run}/usage")
    if all_live:  # of these only what was read now
        mine = mine.join(into.where(F.col("run") == number).select(F.col("path").alias("file")), "file", "left_semi")
    touched = {r["bucket"] for r in mine.select("bucket").distinct().collect()}
    for some in (out, into.where(F.col("run") != number)):  # changed, removed and moved files
        rows = _runs(spark, path, "usage", some, own.schema) if len(touched) < BUCKETS else None
        touched |= {r["bucket"] for r in rows.select("bucket").distinct().collect()} if rows is not None else set()
    merged = _merged(spark, path, ledger, sorted(touched), claude_roots, own.schema)
    merged.sortWithinPartitions("bucket").write.mode("overwrite").parquet(f"{path}/facts/gen={number}")
    held = snapshots.current(spark, path)
    gens = {r["bucket"]: r["gen"] for r in spark.read.parquet(f"{held}/buckets").collect()} if held else {}
    gens |= {b: number for b in touched}

    def write(to: str) -> None:
        tag_accounts(tag_accounts(ledger, F.col("path"), codex_roots, "codex").withColumnRenamed("account", "codex_account"), F.col("path"), claude_roots, "claude").write.parquet(f"{to}/ledger")
        spark.createDataFrame(sorted(gens.items()), "bucket int, gen int").coalesce(1).write.parquet(f"{to}/buckets")

    snapshots.publish(spark, path, write)
    return True


def _merged(spark: SparkSession, path: str, ledger: DataFrame, buckets: list[int], roots: DataFrame, schema: StructType) -> DataFrame:
    """Facts of buckets by all live states, with each file's path and account as they are now."""
    rows = _runs(spark, path, "usage", tag_accounts(ledger, F.col("path"), roots, "claude"), schema, "account")
    rows = spark.createDataFrame([], schema).withColumns({"path": F.lit(""), "run": F.lit(0), "account": F.lit("")}) if rows is None else rows
    live = rows.where(F.col("bucket").isin(buckets))
    place = lambda c: F.struct(F.col("path").alias("file"), F.col(f"{c}.block").alias("block"), F.col(f"{c}.line").alias("line"))
    first = F.struct("first.ts", "first.model_raw", "account", "first.provider", place("first.ord").alias("ord"))
    placed = live.withColumns({"o": F.when(F.col("o").isNotNull(), place("o")), "ord": place("ord"), "first": F.when(F.col("dated"), first)})
    keyed = combined(placed, "bucket")
    dealt = keyed.select(F.struct("r", "bucket").alias("r"), "m", "o", "dated", "ord", "first", *COUNTERS)
    return state_facts(dealt, keep_key=True).select(*FACTS, "request_id.bucket")


def facts(spark: SparkSession, path: str) -> DataFrame:
    """The facts of the newest version."""
    held = snapshots.current(spark, path)
    if held is None:
        raise ValueError(f"nothing has been refreshed in {path}")
    rows = _rollouts(spark, path, held)
    by_gen: dict[int, list[int]] = {}
    for r in spark.read.parquet(f"{held}/buckets").collect():
        by_gen.setdefault(r["gen"], []).append(r["bucket"])
    for gen, buckets in sorted(by_gen.items()):
        merged = spark.read.schema(f"{FACT_TYPES}, bucket int").parquet(f"{path}/facts/gen={gen}")
        rows = rows.unionByName(merged.where(F.col("bucket").isin(buckets)).select(*FACTS))
    return rows


def _rollouts(spark: SparkSession, path: str, held: str) -> DataFrame:
    ledger = spark.read.parquet(f"{held}/ledger").drop("account").withColumnRenamed("codex_account", "account")
    rows = _runs(spark, path, "rollouts", ledger, f"file string, {FACT_TYPES}".replace("account string, ", ""), "account")
    return spark.createDataFrame([], FACT_TYPES) if rows is None else rows.select(*FACTS)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Removes all but the newest ``keep`` versions, and the runs and buckets that only removed ones needed."""
    snapshots.vacuum(spark, path, keep)
    runs, gens = set(), set()
    for name in snapshots.names(spark, path):
        if name.startswith("version="):
            runs |= {r["run"] for r in spark.read.parquet(f"{path}/{name}/ledger").select("run").distinct().collect()}
            gens |= {r["gen"] for r in spark.read.parquet(f"{path}/{name}/buckets").collect()}
    for kind, held in (("runs/run=", runs), ("facts/gen=", gens)):
        folder, prefix = kind.split("/")
        for name in snapshots.names(spark, f"{path}/{folder}"):
            if int(name.removeprefix(prefix)) not in held:
                snapshots.remove(spark, f"{path}/{folder}/{name}")
