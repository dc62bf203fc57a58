"""Account roots: labels, enabled ones, and the account of a file."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterglass.functions.text import root_label

#: Roots are declared by hand; the operators that broadcast them refuse more than this.
MOST_ROOTS = 10_000
#: How a local file's path begins where its scheme is written.
LOCAL = "^file:/+"


def account_roots(declared: DataFrame, prefix: str, reserved: list[str]) -> DataFrame:
    """Roots (path, label or null, source, enabled or null, rank) with one row per path and labels that differ.

    The first root of a path stays. A label that is taken, or reserved, gets the next free number as suffix. The list
    is small and bounded by `MOST_ROOTS`; labels depend on all earlier ones, so they are given on the driver.
    """
    first = declared.withColumn("nth", F.row_number().over(Window.partitionBy("path").orderBy("rank"))).where("nth = 1").drop("nth")
    named = first.withColumn("label", F.coalesce(F.nullif(F.col("label"), F.lit("")), root_label(F.col("path"), prefix)))
    rows = named.orderBy("rank").limit(MOST_ROOTS + 1).collect()
    if len(rows) > MOST_ROOTS:
        raise ValueError(f"more than {MOST_ROOTS} account roots")
    used, out = set(reserved), []
    for r in rows:
        label, n = r["label"], 2
        while label in used:
            label, n = f"{r['label']}-{n}", n + 1
        used.add(label)
        out.append((label, r["path"], r["source"], r["enabled"] is not False, r["rank"]))
    return declared.sparkSession.createDataFrame(out, "label string, path string, source string, enabled boolean, root_rank int")


def tag_accounts(files: DataFrame, path: Column, roots: DataFrame, default: str) -> DataFrame:
    """``files`` with the account of the first enabled root that contains the path, else ``default``.

    Roots are few (`MOST_ROOTS`). Those of one depth are looked up together by the path's beginning of that depth, in
    one broadcast hash join for each depth that occurs: no shuffle, and no comparison of every path with every root.
    Local paths may be written with or without their scheme.
    """
    rows = roots.where("enabled").orderBy("root_rank").limit(MOST_ROOTS + 1).collect()
    if len(rows) > MOST_ROOTS:
        raise ValueError(f"more than {MOST_ROOTS} account roots")
    by_depth: dict[int, dict[str, tuple[int, str]]] = {}
    for r in rows:
        folder = re.sub(LOCAL, "/", r["path"]).rstrip("/")
        by_depth.setdefault(folder.count("/") + 1, {}).setdefault(folder, (r["root_rank"], r["label"]))
    out, hits = files.withColumn("_path", F.regexp_replace(path, LOCAL, "/")), []
    for depth, held in sorted(by_depth.items()):
        hits.append(f"_hit{depth}")
        table = files.sparkSession.createDataFrame([(folder + "/", hit) for folder, hit in held.items()], f"_folder{depth} string, {hits[-1]} struct<rank: int, label: string>")
        begins = F.concat(F.substring_index("_path", "/", depth), F.lit("/"))
        inside = F.col("_path").startswith(F.col(f"_folder{depth}"))
        out = out.join(F.broadcast(table), (begins == F.col(f"_folder{depth}")) & inside, "left").drop(f"_folder{depth}")
    first = F.array_min(F.array_compact(F.array(*hits)))["label"] if hits else F.lit(None)
    return out.withColumn("account", F.coalesce(first, F.lit(default))).drop("_path", *hits)
