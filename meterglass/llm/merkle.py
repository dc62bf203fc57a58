"""Merkle manifests by time-forward processing.

A tree's leaves are the rows of one group (of `documents`: a language) in order. While multiple nodes remain, every 8
consecutive ones become their parent. The groups' roots are the leaves of a last tree, whose root names the dataset.

Time-forward processing sends values along the edges of a graph whose nodes have labels in topological order: a node is
processed when its label is the least in a priority queue, takes the messages waiting there for it, and sends its own to
later labels. Here children send digests to parents; then, in a reversed sweep, parents send to each child the part of a
proof that lies above it, and the child puts its own siblings before it. The queue is external: within a block of 4096
leaves (4 levels) it is a heap in a task; what leaves a block goes through Spark's shuffle, which sorts and spills, to the
task of the block above. So no task holds more than a block, whatever the size of a group, and the rounds grow with the
logarithm of the rows, each with a 4096th of the last one's.

A leaf's place in its group comes from a range partitioning by (group, order, digest), so a group with most of the rows
is many partitions, plus the counts of each partition. Rows of equal order are put by digest; rows that are equal in both
are interchangeable. Texts are digested where they are read and never shuffled. Every round is a checkpoint in the shared
folder. The rows of an empty table give no rows. A null group comes first, then groups bytewise; a null order comes first
in its group. Nulls in digested columns are `-`, an empty text is `0:`. Key columns travel in a struct, so no name can clash.
"""

from __future__ import annotations

import hashlib
import heapq
import string

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterglass.llm.common import MOST_IDS, checkpointed, table

FAN = 8
#: Levels that a task climbs at a time, and the leaves of such a block.
LEVELS = 4
BLOCK = FAN**LEVELS
#: A label is a node's level, then its place there.
PLACES = 1 << 40

_INDEX = (1 << 33) - 1


def digest_of(*columns: Column) -> Column:
    """The lower-case hex sha256 of values as text: `-` if null, else byte count, colon and value."""
    parts = []
    for c in columns:
        value = c.cast("string")
        parts.append(F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts), 256)


def joined_hash(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height(size: int) -> int:
    """Levels above ``size`` leaves."""
    up = 0
    while size > 1:
        size, up = -(-size // FAN), up + 1
    return up


def climb(digests: list[str], levels: int) -> dict[int, str]:
    """The digests of all nodes of a block by label, its leaves' included: the sweep that sends digests to parents."""
    nodes = dict(enumerate(digests))
    queue = [(PLACES + place // FAN, place, value) for place, value in enumerate(digests)] if levels else []
    heapq.heapify(queue)
    while queue:
        label, waiting = queue[0][0], []
        while queue and queue[0][0] == label:
            waiting.append(heapq.heappop(queue)[2])
        nodes[label] = joined_hash(waiting)
        level, place = divmod(label, PLACES)
        if level < levels:
            heapq.heappush(queue, ((level + 1) * PLACES + place // FAN, place, nodes[label]))
    return nodes


def descend(nodes: dict[int, str], leaves: int, levels: int, above: tuple) -> list[tuple]:
    """For each leaf of a block its proof as pairs of what stands before and behind it, from its own level to the root.

    ``above`` is the part that lies above the block. The reversed sweep: the queue has the greatest label first.
    """
    width = [leaves]
    for _ in range(levels):
        width.append(-(-width[-1] // FAN))
    proofs: list[tuple] = [()] * leaves
    queue = [(-levels * PLACES, above)]
    while queue:
        label, suffix = heapq.heappop(queue)
        level, place = divmod(-label, PLACES)
        if level == 0:
            proofs[place] = suffix
            continue
        base = (level - 1) * PLACES
        run = range(place * FAN, min((place + 1) * FAN, width[level - 1]))
        values = [nodes[base + k] for k in run]
        for k in run:
            at = k - run.start
            heapq.heappush(queue, (-(base + k), (("".join(values[:at]), "".join(values[at + 1 :])), *suffix)))
    return proofs


def fold(digest: str, proof: tuple) -> str:
    for before, behind in proof:
        digest = joined_hash([before, digest, behind])
    return digest


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` (tree, order, digest, ...) with ``place`` in their tree, from 0, and the tree's ``size``; a checkpoint."""
    numbered = checkpointed(rows.withColumn("_tie", F.monotonically_increasing_id()))
    dealt = numbered.repartitionByRange("tree", "order", "digest", "_tie").sortWithinPartitions("tree", "order", "digest", "_tie").drop("_tie")
    dealt = dealt.withColumn("_at", F.monotonically_increasing_id())
    dealt = checkpointed(dealt.withColumns({"_part": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit(_INDEX))}))
    counts = dealt.groupBy("tree", "_part").agg(F.count("*").alias("n"), F.min("_at").alias("first"))
    # a row for each partition that a tree touches
    before, whole = Window.partitionBy("tree").orderBy("_part"), Window.partitionBy("tree")
    starts = checkpointed(counts.select("tree", "_part", (F.sum("n").over(before) - F.col("n") - F.col("first")).alias("_start"), F.sum("n").over(whole).alias("size")))
    small = starts.count() <= MOST_IDS // 16
    return dealt.join(F.broadcast(starts) if small else starts, ["tree", "_part"]).withColumn("place", F.col("_start") + F.col("_at")).drop("_part", "_at", "_start", "order")


def roots_of_blocks(rows: DataFrame) -> DataFrame:
    """One round up: the roots of the blocks of ``rows`` (tree, place, size, digest), in the same form."""

    def up(block: pa.Table) -> pa.Table:
        block = block.sort_by("place")
        size, place = block["size"][0].as_py(), block["place"][0].as_py()
        levels = min(LEVELS, height(size))
        root = climb(block["digest"].to_pylist(), levels)[levels * PLACES]
        return pa.table({"tree": [block["tree"][0].as_py()], "place": pa.array([place // BLOCK], pa.int64()), "size": pa.array([-(-size // BLOCK)], pa.int64()), "digest": [root]})

    of = rows.select("tree", "place", "size", "digest", F.floor(F.col("place") / BLOCK).alias("block"))
    return checkpointed(of.groupBy("tree", "block").applyInArrow(up, "tree string, place long, size long, digest string"))


def rounds_of(rows: DataFrame) -> list[DataFrame]:
    """``rows`` and the roots of blocks above them, round by round, to one row for each tree."""
    rounds = [rows]
    most = rows.agg(F.max("size")).first()[0] or 1
    while most > 1:
        rounds.append(roots_of_blocks(rounds[-1]))
        most = -(-most // BLOCK)
    return rounds


PROOF = "array<struct<before:string,behind:string>>"


def proofs_of_round(rows: DataFrame, above: DataFrame, claimed: bool = False) -> DataFrame:
    """One round down: the proof of each of ``rows``, given those of the roots of their blocks (tree, block, above, subroot, root).

    With ``claimed``, rows have keys and a claimed digest, and the result has the proof as text and what the claim folds to.
    """
    kind = f"keys {rows.schema['keys'].dataType.simpleString()}, leaf string, subroot string, root string, proof string, folded_root string" if claimed else f"tree string, place long, above {PROOF}"

    def down(block: pa.Table, given: pa.Table) -> pa.Table:
        if not block.num_rows or not given.num_rows:
            raise ValueError("a block and the proof of its root come together")
        block = block.sort_by("place")
        digests, levels = block["digest"].to_pylist(), min(LEVELS, height(block["size"][0].as_py()))
        upper = tuple((x["before"], x["behind"]) for x in given["above"][0].as_py())
        proofs = descend(climb(digests, levels), len(digests), levels, upper)
        if not claimed:
            steps = pa.array([[{"before": a, "behind": b} for a, b in p] for p in proofs], given.schema.field("above").type)
            return pa.table({"tree": block["tree"], "place": block["place"], "above": steps})
        folded = [fold(c, p) for c, p in zip(block["claimed"].to_pylist(), proofs, strict=True)]
        same = lambda name: pa.array([given[name][0].as_py()] * len(digests), pa.string())
        return pa.table({"keys": block["keys"], "leaf": block["digest"], "subroot": same("subroot"), "root": same("root"), "proof": pa.array(["".join(a + b for a, b in p) for p in proofs], pa.string()), "folded_root": folded})

    blocks = rows.withColumn("block", F.floor(F.col("place") / BLOCK)).groupBy("tree", "block")
    return blocks.cogroup(above.groupBy("tree", "block")).applyInArrow(down, kind)


def manifest(df: DataFrame, group: Column, order: Column, leaf: Column, claimed: Column, *keys: str) -> DataFrame:
    """Per row: ``keys``, ``leaf``, ``subroot``, ``root``, ``proof`` (all siblings to the root as text) and ``folded_root``.

    ``leaf`` is the row's digest, ``claimed`` the digest that is folded with the proof: the row is as the manifest says
    where ``folded_root`` equals ``root``.
    """
    value = group.cast("string")
    tree = F.when(value.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), value))
    rows = df.select(F.struct(*[df[f"`{k}`"] for k in keys]).alias("keys"), tree.alias("tree"), order.alias("order"), leaf.alias("digest"), claimed.alias("claimed"))
    lower = rounds_of(placed(rows))
    subroots = lower[-1].select(F.lit("").alias("tree"), F.col("tree").alias("order"), F.col("tree").alias("group"), "digest")
    upper = rounds_of(checkpointed(placed(subroots)))
    # from the root down to the subroots, whose proofs go on down their own trees
    above = upper[-1].select("tree", F.col("place").alias("block"), F.array().cast(PROOF).alias("above"))
    for rows_of in reversed(upper[:-1]):
        above = checkpointed(proofs_of_round(rows_of, above)).withColumnRenamed("place", "block")
    # of one row
    root = upper[-1].select(F.col("digest").alias("root"))
    tops = upper[0].select("group", F.col("place").alias("block"), F.col("digest").alias("subroot")).join(above.drop("tree"), "block").crossJoin(F.broadcast(root))
    tops = checkpointed(tops.select(F.col("group").alias("tree"), F.lit(0).cast("long").alias("block"), "above", "subroot", "root"))
    names = tops.select("tree", "subroot", "root")
    above = tops
    for rows_of in reversed(lower[1:-1]):
        above = checkpointed(proofs_of_round(rows_of, above).withColumnRenamed("place", "block").join(names, "tree"))
    found = proofs_of_round(lower[0], above, claimed=True)
    return found.select("keys.*", "leaf", "subroot", "root", "proof", "folded_root")


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """All documents, held against a copy in which every third text, by the crc32 of its id, has lost its capitals; a null id is no such one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    digest = lambda text: digest_of(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], text)
    lowered = F.translate(F.col("text"), string.ascii_uppercase, string.ascii_lowercase)
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    leaf = digest(F.col("text"))
    found = manifest(docs, F.col("lang"), F.col("doc_id"), leaf, F.when(hit, digest(lowered)).otherwise(leaf), "doc_id")
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def manifest_sql(levels: int = 8) -> str:
    """SQL for `op12_merkle_manifest`, for trees of at most so many levels."""
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR END"
    leaf = lambda text: f"sha256({' || '.join([*map(part, ('doc_id', 'source', 'lang', 'n_chars')), part(text)])})"
    crc = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))"""
    lowered = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    steps = [f"""docs AS (SELECT doc_id, coalesce('1' || lang, '0') AS g, {leaf('text')} AS d, CASE WHEN coalesce(xor({crc}, 4294967295) % 3 = 0, false) THEN {leaf(lowered)} ELSE {leaf('text')} END AS c FROM documents)""",
             "placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM docs)"]

    def tree(name: str, first: str) -> str:
        """CTEs of a tree's levels, each with the siblings of its nodes; the name of the last one."""
        now = first
        for k in range(levels):
            steps.append(f"{name}_runs{k} AS (SELECT g, i // 8 AS p, n, list(d ORDER BY i) AS a FROM {now} GROUP BY g, i // 8, n)")
            steps.append(f"{name}_at{k} AS (SELECT x.g, x.i, x.n, x.i // 8 AS p, CASE WHEN x.n > 1 THEN array_to_string(a[1:x.i % 8], '') ELSE '' END AS l, CASE WHEN x.n > 1 THEN array_to_string(a[x.i % 8 + 2:], '') ELSE '' END AS r FROM {now} x JOIN {name}_runs{k} y ON x.g = y.g AND x.i // 8 = y.p)")
            steps.append(f"{name}{k + 1} AS (SELECT g, p AS i, (n + 7) // 8 AS n, CASE WHEN n > 1 THEN sha256(array_to_string(a, '')) ELSE a[1] END AS d FROM {name}_runs{k})")
            now = f"{name}{k + 1}"
        return now

    low = tree("low", "placed")
    steps.append(f"subroots AS (SELECT '' AS g, g AS lang, d, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM {low})")
    high = tree("high", "subroots")
    folded, proof, joins = "placed.c", [], []
    at = "placed.i"
    for k in range(levels):
        joins.append(f"JOIN low_at{k} a{k} ON a{k}.g = placed.g AND a{k}.i = {at}")
        at = f"a{k}.p"
    joins.append("JOIN subroots s ON s.lang = placed.g")
    at = "s.i"
    for k in range(levels):
        joins.append(f"JOIN high_at{k} b{k} ON b{k}.i = {at}")
        at = f"b{k}.p"
    select = "placed.doc_id, placed.d AS leaf, s.d AS subroot, t.d AS root, placed.c AS f"
    names = [f"a{k}" for k in range(levels)] + [f"b{k}" for k in range(levels)]
    cols = ", ".join(f"{x}.l AS l_{x}, {x}.r AS r_{x}, {x}.n AS n_{x}" for x in names)
    steps.append(f"paths AS (SELECT {select}, {cols} FROM placed {' '.join(joins)} CROSS JOIN {high} t)")
    now = "paths"
    for k, x in enumerate(names):
        steps.append(f"fold{k} AS (SELECT * REPLACE (CASE WHEN n_{x} > 1 THEN sha256(l_{x} || f || r_{x}) ELSE f END AS f) FROM {now})")
        now = f"fold{k}"
    proof = " || ".join(f"l_{x} || r_{x}" for x in names)
    return f"WITH {', '.join(steps)} SELECT doc_id, leaf, subroot, root, sha256({proof}) AS proof_sha256, f AS folded_root, f = root AS verified FROM {now}"
