"""Log lines from directories of JSONL files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterglass.operators.limits import is_object, once
from meterglass.sources.blocks import BLOCK_BYTES, SCHEMA, TASK_BYTES, LogBlocks, LogFiles, listed_rows

#: Files of a listing that a task reads, at most.
TASK_FILES = 1000


def _blocks(spark: SparkSession, paths: tuple[str, ...], pattern: str, block: int, candidates: bool) -> DataFrame:
    spark.dataSource.register(LogBlocks)
    reader = spark.read.format(LogBlocks.name()).option("paths", "\n".join(paths)).option("pattern", pattern)
    return reader.option("block", block).option("candidates", candidates).load().withColumn("ord", F.struct("file", "block", "line"))


def _listed_blocks(listing: DataFrame, block: int) -> DataFrame:
    """Candidates of the files (path, size) of a listing. Tasks take the files from it, so that the driver holds no list of them."""
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(block).cast("long"))).alias("start")
    cut = listing.where("size > 0").select("path", "size", start).withColumn("end", F.least("size", F.col("start") + block))
    most = cut.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("bytes")).first()
    tasks = max(-(-most["bytes"] // TASK_BYTES), -(-most["n"] // TASK_FILES), min(most["n"], 2 * listing.sparkSession.sparkContext.defaultParallelism), 1)
    return cut.repartition(tasks).mapInArrow(listed_rows, SCHEMA).withColumn("ord", F.struct("file", "block", "line"))


def scan_lines(spark: SparkSession, *paths: str, pattern: str = "*.jsonl", block: int = BLOCK_BYTES) -> DataFrame:
    """Lines (value, file, file_size, ord) of all files under the paths whose names fit ``pattern``.

    ``ord`` follows file path, block and line. Blank lines are left out, and so is a last line that is not ended yet:
    the task that reads a file's end sees it and holds it back, so every byte is read once and nothing runs beforehand.
    """
    return _blocks(spark, paths, pattern, block, False).select("value", "file", "file_size", "ord")


def scan_usage(spark: SparkSession, *paths: str, pattern: str = "*.jsonl", block: int = BLOCK_BYTES, listing: DataFrame | None = None) -> DataFrame:
    """Of `scan_lines` those that can hold usage (`prefilter`), and for each block with lines a row without value and with their number as ``lines``.

    ``listing`` has files (path, size) instead of ``paths``, each of which is read up to its size there.
    """
    rows = _blocks(spark, paths, pattern, block, True) if listing is None else _listed_blocks(listing, block)
    return rows.select("value", "file", "file_size", "ord", F.when(F.col("value").isNull(), F.col("line")).alias("lines"))


def write_files(rows: DataFrame, folder: str) -> None:
    """Writes lines (path, ord, value) as files ``path`` below ``folder``, each with its lines in order."""
    rows.sparkSession.dataSource.register(LogFiles)
    lines = rows.repartition("path").sortWithinPartitions("path", "ord").select("path", F.concat("value", F.lit("\n")).alias("value"))
    lines.write.format(LogFiles.name()).mode("append").option("folder", folder).save()


def prefilter(value: Column) -> Column:
    """Whether a line can hold usage, before its JSON is parsed."""
    return usage_prefilter(value) | rollout_prefilter(value)


def usage_prefilter(value: Column) -> Column:
    """As `prefilter`, for lines of the first provider."""
    return value.contains('"usage"') & value.contains("assistant")


def rollout_prefilter(value: Column) -> Column:
    """As `prefilter`, for lines of the second provider."""
    return value.contains('"token_count"') | value.contains('"turn_context"')


#: A string, a number that JSON does not have, or what stands between these.
TOKENS = r'''("(?:[^"\\]++|\\.)*+"|-?Infinity|NaN|[^"NI\-]++|.)'''


def without_odd_numbers(value: Column) -> Column:
    """A line with null for NaN and infinities, which some writers put out and JSON does not have; texts keep theirs."""
    tokens = F.regexp_extract_all(value, F.lit(TOKENS), F.lit(1))
    return F.array_join(F.transform(tokens, lambda t: F.when(t.isin("NaN", "Infinity", "-Infinity"), "null").otherwise(t)), "")


def parsed(lines: DataFrame) -> DataFrame:
    """Adds ``j`` (variant), ``malformed`` and ``is_object``. Wrapping in brackets rejects text after the object.

    A line is parsed once, whatever uses these.

    A line that does not parse and has NaN or an infinity is tried again with null for these.
    Repeated names in an object need spark.sql.variant.allowDuplicateKeys, which makes the last one win.
    """
    wrapped = lambda c: F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    odd = F.when(F.col("value").contains("NaN") | F.col("value").contains("Infinity"), wrapped(without_odd_numbers(F.col("value"))))
    listed = once(lines, F.coalesce(wrapped(F.col("value")), odd), "_list")
    bad = F.col("_list").isNull() | F.try_variant_get("_list", "$[1]", "variant").isNotNull()
    out = once(listed.withColumn("malformed", bad), F.when(~F.col("malformed"), F.try_variant_get("_list", "$[0]", "variant")), "j").drop("_list")
    return out.withColumn("is_object", is_object(F.col("j")))


def ingest_quality(lines: DataFrame, **more: Column) -> DataFrame:
    """Per file: its lines, those that can hold usage, those of these that are malformed or objects, and objects read (no markers).

    ``lines`` are those of `scan_lines` or `scan_usage`. ``more`` are aggregates of the same parsed lines.
    """
    number = F.coalesce("lines", F.lit(0)) if "lines" in lines.columns else F.lit(1)
    seen = parsed(lines.withColumn("candidate", F.coalesce(prefilter(F.col("value")), F.lit(False))).withColumn("_n", number))
    held = F.col("candidate") & F.col("is_object")
    marker = F.coalesce(F.try_variant_get("j", "$.type", "string") == "turn_context", F.lit(False))
    return seen.groupBy("file").agg(
        F.sum("_n").cast("long").alias("lines"), F.count_if("candidate").alias("candidates"), F.count_if(F.col("candidate") & F.col("malformed")).alias("malformed"),
        F.count_if(held).alias("objects"), F.count_if(held & ~marker).alias("lines_read"), *[c.alias(n) for n, c in more.items()],
    )
