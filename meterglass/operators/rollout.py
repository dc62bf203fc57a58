"""Facts from event logs with cumulative counters and separate model markers.

What a line needs from earlier ones (the last counter, the latest marker) is found by a carry scan, so that a file of any
length is dealt over many tasks: files are cut in chunks of consecutive lines, every chunk gives one row with its last
values, a scan over these rows says what each chunk begins with, and the rest is looked up within the chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

UNATTRIBUTED = "codex-unattributed"
#: Lines of a chunk, by the numbers of ``ord``; numbers that are left out make it shorter.
CHUNK_LINES = 10_000


def chunk_of(events: DataFrame) -> Column:
    """The chunk of a line within its file; it never falls as ``ord``, a number or a struct that ends with one, rises."""
    kind = events.schema["ord"].dataType
    if not isinstance(kind, StructType):
        return F.floor(F.col("ord") / CHUNK_LINES)
    *outer, last = kind.names
    return F.struct(*[F.col(f"ord.{n}").alias(n) for n in outer], F.floor(F.col(f"ord.{last}") / CHUNK_LINES).alias("part"))


def carry_scan(events: DataFrame, before: dict[str, Column] | None = None, upto: dict[str, Column] | None = None, first: dict[str, Column] | None = None) -> DataFrame:
    """``events`` (file, ord, ...) with, by name, the last value that is not null before each line or up to it, or the first of its file.

    Lines are dealt by chunk once. Of a chunk one row goes on, so the windows over files see a row for each chunk only.
    """
    before, upto, first = before or {}, upto or {}, first or {}
    named = events.withColumns({f"_{n}": c for n, c in {**before, **upto, **first}.items()})
    # a line in an array of one, which column pruning does not enter: both uses of the dealt lines are the same, so they are dealt once
    dealt = named.select(F.struct("file", chunk_of(events).alias("part")).alias("_chunk"), F.array(F.struct(*named.columns)).alias("_line")).repartition("_chunk")
    lines = dealt.select("_chunk", F.element_at("_line", 1).alias("_line"))
    held = lambda n: F.when(F.col(f"_line._{n}").isNotNull(), F.col("_line.ord"))
    ends = lines.groupBy("_chunk").agg(*[F.max_by(F.col(f"_line._{n}"), held(n)).alias(n) for n in {**before, **upto}], *[F.min_by(F.col(f"_line._{n}"), held(n)).alias(n) for n in first])
    earlier = Window.partitionBy("_chunk.file").orderBy("_chunk.part").rowsBetween(Window.unboundedPreceding, -1)
    every = earlier.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    begins = ends.select("_chunk", *[F.last(n, ignorenulls=True).over(earlier).alias(f"_begin_{n}") for n in {**before, **upto}], *[F.first(n, ignorenulls=True).over(every).alias(f"_begin_{n}") for n in first])
    within = Window.partitionBy("_chunk").orderBy("ord")
    past, now = within.rowsBetween(Window.unboundedPreceding, -1), within.rowsBetween(Window.unboundedPreceding, 0)
    found = {n: F.coalesce(F.last(f"_{n}", ignorenulls=True).over(past), F.col(f"_begin_{n}")) for n in before}
    found |= {n: F.coalesce(F.last(f"_{n}", ignorenulls=True).over(now), F.col(f"_begin_{n}")) for n in upto}
    found |= {n: F.col(f"_begin_{n}") for n in first}
    return lines.select("_chunk", "_line.*").join(begins, "_chunk").select(*events.columns, *[c.alias(n) for n, c in found.items()])


def _total() -> Column:
    """The counters of a line that may move them: those of a token event with a timestamp."""
    return F.when(F.col("is_token") & F.col("ts").isNotNull(), F.col("total"))


def counter_delta(events: DataFrame) -> DataFrame:
    """Usage of token events (file, ord, ts, is_token, total and last, structs of input, cached and output, or null).

    ``last`` wins; else the usage is what the counters have grown since the file's last non-null total, each at least
    0. Events without a timestamp neither count nor move the counters. Cached input is at most the input and taken
    out of it. Events without input and output are dropped after that.
    """
    return _grown(carry_scan(events, before={"previous": _total()}))


def _grown(seen: DataFrame) -> DataFrame:
    timed = seen.where("is_token AND ts IS NOT NULL")
    grown = lambda c: F.greatest(F.lit(0).cast("long"), F.col(f"total.{c}") - F.coalesce(f"previous.{c}", F.lit(0)))
    value = lambda c: F.when(F.col("last").isNotNull(), F.col(f"last.{c}")).when(F.col("total").isNotNull(), grown(c))
    used = timed.where("last IS NOT NULL OR total IS NOT NULL").withColumns({"raw_input": value("input"), "output_tokens": value("output"), "cached": value("cached")})
    used = used.where("raw_input <> 0 OR output_tokens <> 0").withColumn("cache_read", F.least("raw_input", "cached"))
    return used.withColumn("input_tokens", F.col("raw_input") - F.col("cache_read")).drop("raw_input", "cached", "previous")


def _named(seen: DataFrame) -> DataFrame:
    return seen.withColumn("model_raw", F.coalesce("_latest", "_first", F.lit(UNATTRIBUTED))).drop("_latest", "_first")


def attribute_models(events: DataFrame, marker: Column) -> DataFrame:
    """``events`` with ``model_raw``: the file's latest marker so far, else its first later one, else `UNATTRIBUTED`.

    Before a file's first marker the first later one is that first marker.
    """
    return _named(carry_scan(events, upto={"_latest": marker}, first={"_first": marker}))


def rollout_usage(events: DataFrame, keep_file: bool = False) -> DataFrame:
    """Facts of a log: models attributed over all lines, usage of the token events; one carry scan finds both.

    ``keep_file`` adds the file.
    """
    seen = carry_scan(events, before={"previous": _total()}, upto={"_latest": F.col("marker")}, first={"_first": F.col("marker")})
    used = _grown(_named(seen))
    zero = F.lit(0).cast("long")
    return used.select(*["file"] if keep_file else [], "ts", "model_raw", "account", F.lit("codex").alias("provider"), "ord", "input_tokens", "output_tokens", "cache_read", zero.alias("cache_creation"), zero.alias("eph_5m"), zero.alias("eph_1h"))
