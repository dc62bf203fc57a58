"""Dimensions and stores: price files, facts, limits, the file ledger and fingerprints."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterglass.operators.limits import is_object, number, part, text
from meterglass.operators.pricing import RATE_NAMES
from meterglass.sources import snapshots


def price_file(spark: SparkSession, path: str) -> DataFrame:
    """The price table of a JSON file ({"models": {name: rates}}).

    Numbers may be written as text; rows without input or output are dropped, and unreadable optional rates are null.
    An unreadable file gives no rows.
    """
    body = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("j"))
    models = body.where(is_object(part(F.col("j"), "$.models"))).select(F.explode(F.try_variant_get("j", "$.models", "map<string,variant>")).alias("model", "r")).where(is_object(F.col("r")))
    rate = lambda n: F.coalesce(number(part(F.col("r"), f"$.{n}")), F.try_to_number(text(part(F.col("r"), f"$.{n}")), F.lit("S9999999999.999999")).cast("double"), text(part(F.col("r"), f"$.{n}")).try_cast("double")).alias(n)
    return models.select(F.lower(F.trim("model")).alias("model"), *[rate(n) for n in RATE_NAMES]).where("input IS NOT NULL AND output IS NOT NULL")


def write_facts(facts: DataFrame, path: str) -> None:
    """Merged facts without prices, by provider and day, as a new version; prices are joined when they are read, so they may change."""
    snapshots.publish(facts.sparkSession, path, lambda to: _put_facts(facts, f"{to}/facts"))
    snapshots.vacuum(facts.sparkSession, path)


def _put_facts(facts: DataFrame, to: str) -> None:
    facts.withColumn("event_date", F.to_date("ts")).write.partitionBy("provider", "event_date").parquet(to)


def _whole(spark: SparkSession, path: str) -> str:
    """The folder of the newest version, which must be there."""
    held = snapshots.current(spark, path)
    if held is None:
        raise ValueError(f"no version is whole in {path}")
    return held


def read_facts(spark: SparkSession, path: str, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
    """The newest whole version of stored facts; days outside the range are not read."""
    facts = spark.read.parquet(f"{_whole(spark, path)}/facts")
    if first_day:
        facts = facts.where(F.col("event_date") >= F.lit(first_day).cast("date"))
    if last_day:
        facts = facts.where(F.col("event_date") <= F.lit(last_day).cast("date"))
    return facts.drop("event_date")


def fingerprint(*dims: DataFrame) -> DataFrame:
    """One digest per dimension, in order; it changes when any row does, not with their order. Dimensions are small."""
    out = None
    for k, dim in enumerate(dims):
        row = dim.select(F.sha2(F.to_json(F.struct(*sorted(dim.columns)), {"ignoreNullFields": "false"}), 256).alias("h")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ","), 256).alias("digest")).select(F.lit(k).alias("dim"), "digest")
        out = row if out is None else out.unionByName(row)
    return out


#: How the halves of a row's digest are added up.
_HALF = "decimal(20,0)"
_MODULUS = str(1 << 64)


def set_digest(rows: DataFrame, *by: str) -> DataFrame:
    """(``by``, n, high, low): the number of rows and the sums of both halves of their md5 digests modulo 2**64.

    The rows' order and partitioning do not matter, equal rows count as often as they occur, and digests of parts add up
    (`added_digests`), so tasks reduce before anything is shuffled, and one row in or out needs no other row.
    """
    body = F.md5(F.to_json(F.struct(*[c for c in sorted(rows.columns) if c not in by]), {"ignoreNullFields": "false"}))
    half = lambda at: F.conv(F.substring(body, at, 16), 16, 10).cast(_HALF)
    return added_digests(rows.select(*by, F.lit(1).cast("long").alias("n"), half(1).alias("high"), half(17).alias("low")), *by)


def added_digests(some: DataFrame, *by: str) -> DataFrame:
    """The digest of all rows by those of parts. Counts may be negative, with the digests of rows that are taken out."""
    side = F.when(F.col("n") < 0, F.lit(-1)).otherwise(F.lit(1))
    total = lambda c: F.pmod(F.coalesce(F.sum(F.col(c) * side), F.lit(0).cast(_HALF)), F.lit(_MODULUS).cast("decimal(38,0)")).cast(_HALF).alias(c)
    return some.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), total("high"), total("low"))


def refresh_facts(make: Callable[[], DataFrame], path: str, *dims: DataFrame) -> bool:
    """Makes a new version of the facts in ``path`` unless the newest was made with dimensions of the same digests; whether it did.

    Facts and digests are parts of one version, which is there whole or not at all.
    """
    spark = dims[0].sparkSession
    now = [(k, *map(str, set_digest(dim).first())) for k, dim in enumerate(dims)]
    held = snapshots.current(spark, path)
    if held and sorted(map(tuple, spark.read.parquet(f"{held}/dims").collect())) == now:
        return False

    def write(to: str) -> None:
        _put_facts(make(), f"{to}/facts")
        spark.createDataFrame(now, "dim int, n string, high string, low string").coalesce(1).write.parquet(f"{to}/dims")

    snapshots.publish(spark, path, write)
    snapshots.vacuum(spark, path)
    return True


def write_limits(rows: DataFrame, path: str) -> None:
    """A new version of the stored limit captures (`limit_store`)."""
    snapshots.publish(rows.sparkSession, path, lambda to: limit_store(rows).write.parquet(to))
    snapshots.vacuum(rows.sparkSession, path)


def read_limits(spark: SparkSession, path: str) -> DataFrame:
    """The newest whole version of the stored limit captures."""
    return spark.read.parquet(_whole(spark, path))


def limit_store(rows: DataFrame) -> DataFrame:
    """What a store of limit captures keeps: entries (name, capture) of the two providers."""
    return rows.where(F.col("name").rlike("^(claude|codex):") & F.col("capture").isNotNull())


def few_listing_tasks(spark: SparkSession) -> None:
    """From here on the session lists many folders in some tasks for each core, not in one task for each folder."""
    spark.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", 4 * spark.sparkContext.defaultParallelism)


def file_listing(spark: SparkSession, *paths: str, pattern: str = "*.jsonl") -> DataFrame:
    """(path, size, modified) of all files whose names fit ``pattern``; their content is not read. Empty files are not listed."""
    few_listing_tasks(spark)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(list(paths))
    return found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


#: Files that a scan task lists, at most. Spark counts 4 MB for each, and so has a task for every 32, if it reads none of their content.
LISTED_FILES = 10_000


@contextmanager
def files_unread(spark: SparkSession) -> Iterator[None]:
    """Scans that start within it read no content of their files: tasks have equal numbers of them, whatever their sizes."""
    settings = {"spark.sql.files.openCostInBytes": 1 << 30, "spark.sql.files.maxPartitionBytes": LISTED_FILES << 30}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def changed_files(listing: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files to read again, with what became of them: new, grown, truncated or touched. Unchanged ones are left out."""
    old = ledger.select("path", F.col("size").alias("old_size"), F.col("modified").alias("old_modified"))
    both = listing.join(old, "path", "left").where(F.col("old_size").isNull() | (F.col("size") != F.col("old_size")) | (F.col("modified") != F.col("old_modified")))
    change = F.when(F.col("old_size").isNull(), "new").when(F.col("size") > F.col("old_size"), "grown").when(F.col("size") < F.col("old_size"), "truncated").otherwise("touched")
    return both.select("path", "size", "modified", change.alias("change"))


def moved_files(listing: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files of the ledger that are gone: (path, new_path, rebuild).

    A gone log whose name is found at exactly one new path, at least as long, has moved; any other means a rebuild.
    """
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    gone = ledger.join(listing.select("path"), "path", "left_anti").select("path", F.col("size").alias("old_size"), name(F.col("path")).alias("name"))
    new = listing.join(ledger.select("path"), "path", "left_anti").select(F.col("path").alias("new_path"), "size", name(F.col("path")).alias("name"))
    found = new.groupBy("name").agg(F.count("*").alias("n"), F.min("new_path").alias("new_path"), F.min("size").alias("size"))
    fits = F.coalesce(F.col("name").startswith("rollout-") & (F.col("n") == 1) & (F.col("size") >= F.col("old_size")), F.lit(False))
    return gone.join(found, "name", "left").select("path", F.when(fits, F.col("new_path")).alias("new_path"), (~fits).alias("rebuild"))
