"""Versions of a stored table that readers see whole or not at all.

A version is a folder, and a marker file of its number that is made last. Readers take the newest version that has a
marker, so a writer that stops at any step leaves the version before it readable, and the next writer replaces what it
left behind. Old versions stay until `vacuum`, so a running reader keeps its files. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

MARKERS = "_versions"


def files(spark: SparkSession, path: str):
    """Hadoop's file system of ``path``, and ``path`` in it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if it is not there."""
    system, where = files(spark, path)
    return sorted(f.getPath().getName() for f in system.listStatus(where)) if system.exists(where) else []


def remove(spark: SparkSession, path: str) -> None:
    system, where = files(spark, path)
    system.delete(where, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    system, where = files(spark, path)
    system.rename(where, files(spark, to)[1])


def mark(spark: SparkSession, path: str, number: int) -> None:
    """Makes version ``number`` the newest one; a file is there or is not."""
    system, where = files(spark, f"{path}/{MARKERS}/{number:010d}")
    system.create(where, True).close()


def newest(spark: SparkSession, path: str) -> int | None:
    """The number of the newest whole version."""
    found = [int(n) for n in names(spark, f"{path}/{MARKERS}") if n.isdigit()]
    return max(found, default=None)


def folder(path: str, number: int) -> str:
    return f"{path}/version={number:010d}"


def publish(spark: SparkSession, path: str, write: Callable[[str], None]) -> int:
    """Has ``write`` fill the folder of the next version, and then makes it the newest; its number."""
    number = (newest(spark, path) or 0) + 1
    remove(spark, folder(path, number))  # of a writer that stopped
    write(folder(path, number))
    mark(spark, path, number)
    return number


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the newest whole version; None if there is none."""
    number = newest(spark, path)
    return None if number is None else folder(path, number)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Removes all but the newest ``keep`` versions, marker first."""
    held = sorted(int(n) for n in names(spark, f"{path}/{MARKERS}") if n.isdigit())
    for number in held[: max(0, len(held) - keep)]:
        remove(spark, f"{path}/{MARKERS}/{number:010d}")
        remove(spark, folder(path, number))
