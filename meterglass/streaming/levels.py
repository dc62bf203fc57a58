"""A log of batches in levels of runs.

Batch N of a stream is run N of level 0. As soon as `FAN` runs of a level are there, they become one run of the next, so
all batches so far are a few runs (at most ``FAN - 1`` of each level), and every row is written once for each level: the
work of a batch grows with its own rows and the logarithm of the batches. Which runs make up the first N batches follows
from N alone (its digits), so a batch that runs again writes the same folders, and readers need only the number of whole
batches, which is marked last. Runs that went into a greater one are removed a batch later.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meterglass.sources import snapshots

FAN = 8


def runs_of(batches: int, fan: int = FAN) -> list[tuple[int, int]]:
    """(level, number) of the runs that make up the first ``batches`` batches, oldest first."""
    out, level = [], 0
    while batches:
        digit = batches % fan
        out += [(level, batches - k) for k in range(1, digit + 1)]
        batches, level = batches // fan, level + 1
    return out[::-1]


def place(path: str, level: int, number: int) -> str:
    return f"{path}/level={level}/run={number}"


def merges_of(number: int, fan: int = FAN) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(level, number, its parts) of the runs that become whole with batch ``number``, lowest level first."""
    out, level, count = [], 1, number + 1
    while count % fan == 0:
        count //= fan
        out.append((level, count - 1, [(level - 1, k) for k in range((count - 1) * fan, count * fan)]))
        level += 1
    return out


def add_run(rows: DataFrame, path: str, number: int, combine: Callable[[DataFrame], DataFrame], by: list[str] | None = None, fan: int = FAN) -> None:
    """Writes batch ``number``, merges what is due, and marks the batch as whole.

    ``combine`` makes one run of several; ``by`` names columns that partition the folders. An empty batch is a run, too.
    """
    spark = rows.sparkSession

    def write(df: DataFrame, to: str) -> None:
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*by) if by else writer).parquet(to)

    if number:
        for _, _, parts in merges_of(number - 1, fan):
            for part in parts:
                snapshots.remove(spark, place(path, *part))
    write(rows, place(path, 0, number))
    for level, at, parts in merges_of(number, fan):
        write(combine(_read(spark, rows, path, parts)), place(path, level, at))
    snapshots.mark(spark, path, number + 1)


def _read(spark: SparkSession, like: DataFrame, path: str, parts: list[tuple[int, int]]) -> DataFrame:
    """The rows of runs, with the columns of ``like``. Each run is a table of its own, so the folders of levels are no columns."""
    tables = [spark.read.schema(like.schema).option("basePath", place(path, *p)).parquet(place(path, *p)) for p in parts]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def batches(spark: SparkSession, path: str) -> int:
    """How many batches are whole."""
    return snapshots.newest(spark, path) or 0


def read_runs(spark: SparkSession, path: str, like: DataFrame | None = None, upto: int | None = None, fan: int = FAN) -> DataFrame:
    """The runs of all whole batches, or of the first ``upto``; ``like`` has their columns, else those of the newest run count."""
    count = batches(spark, path) if upto is None else upto
    if not count:
        raise ValueError(f"no batch is whole in {path}")
    parts = runs_of(count, fan)
    return _read(spark, spark.read.parquet(place(path, *parts[-1])) if like is None else like, path, parts)
