"""Near-duplicate vectors by randomised-rotation binary codes with correction factors.

Vectors of one label are normalised and rotated at random; the signs of the rotated coordinates are a vector's code,
and the inner product of code and vector, its correction factor, is stored with it. The inner product of any vector y
with the code of x, divided by x's factor, is an unbiased estimate of their cosine; its error has a bound that holds
with known confidence. Only pairs whose upper bound reaches the threshold are computed exactly, in double precision.

Which pairs are estimated at all is decided by the codes too: bands of code bits are keys, and pairs that share one are
candidates. The bits of a band grow with the logarithm of the rows, so buckets keep their size, and the number of bands
follows from the bits so that a pair at the threshold shares a band with probability `RECALL` whatever the size.
Equal vectors are one class beforehand, so copies cost nothing. A bucket is compared in blocks of bounded size; a
block yields counts of links per vector and a spanning set of links, never its pairs.

Vectors that are null, empty, zero or hold a null or non-finite number link with nothing, nor do those of a null label
or of another length; each is its own component. A null vec_id has a null component and is kept. Repeated rows count
as different vectors. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterglass.llm.common import checkpointed, map_batches, table
from meterglass.llm.graph import components

COSINE = 0.98
#: Chance that a pair at the threshold becomes a candidate.
RECALL = 0.9995
#: Deviations of the estimate's error that its bound allows for.
DEVIATIONS = 4.0
#: Classes in a block; a group has two blocks at most.
BLOCK = 1024
#: Groups up to this size list their pairs; larger ones multiply matrices.
SMALL_GROUP = 64
#: Rows that a task gathers, and pairs that it estimates at once.
ROWS_AT_ONCE, PAIRS_AT_ONCE = 8192, 131_072


@functools.cache
def rotation(size: int, turn: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng([size, turn]).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; each is first divided by its greatest component, so that no square over- or underflows."""
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def plan(rows: int, cosine: float, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a band, bands): 2**bits follows the rows, and the bands hold the recall."""
    bits = min(40, max(8, math.ceil(math.log2(max(2, rows)))))
    shared = (1 - math.acos(min(1.0, cosine)) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - shared)))


def band_keys(rows: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """A key per vector and band: bits of rotated coordinates. Further rotations follow when one has no bits left."""
    size = rows.shape[1]
    per = max(1, size // bits) if bits <= size else 1
    keys = np.zeros((len(rows), bands), np.int64)
    turned = None
    for band in range(bands):
        if band % per == 0:
            turned = np.concatenate([rows @ rotation(size, 1 + band // per * math.ceil(bits / size) + k) for k in range(math.ceil(bits / size))], axis=1) > 0
        part = turned[:, (band % per) * bits : (band % per + 1) * bits]
        keys[:, band] = (part @ (1 << np.arange(bits, dtype=np.int64))) * 1024 + band
    return keys


def encoded(df: DataFrame, bits: int, bands: int) -> DataFrame:
    """(rep, label, copies, vector, keys) with unit vectors in double precision."""

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            vectors = batch.column("vector")
            sizes = vectors.value_lengths().to_numpy()
            flat = vectors.flatten().to_numpy()
            starts = np.cumsum(sizes) - sizes
            units: list = [None] * len(sizes)
            keys: list = [None] * len(sizes)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                rows = unit(flat[starts[at][:, None] + np.arange(size)])
                for k, u, key in zip(at, rows, band_keys(rows, bits, bands), strict=True):
                    units[k], keys[k] = u, key
            return pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("label"), batch.column("copies"), pa.array(units, pa.list_(pa.float64())), pa.array(keys, pa.list_(pa.int64()))], ["rep", "label", "copies", "vector", "keys"])

        return apply

    return map_batches(df, make, "rep long, label string, copies long, vector array<double>, keys array<long>")


def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated unit vectors, their binary codes as unit vectors, and the correction factors."""
    turned = x.astype(np.float32) @ rotation(x.shape[1], 0).astype(np.float32)
    signs = np.where(turned > 0, 1, -1).astype(np.float32) / np.float32(math.sqrt(x.shape[1]))
    return turned, signs, np.maximum(1e-3, np.einsum("ij,ij->i", signs, turned))


def error_bound(factor: np.ndarray, size: int, deviations: float = DEVIATIONS) -> np.ndarray:
    """What the estimated cosine of a vector with another may miss at that many deviations."""
    return deviations * np.sqrt(np.maximum(0, 1 - factor**2)) / factor / math.sqrt(max(1, size - 1))


def candidates(x: np.ndarray, side: np.ndarray, starts: np.ndarray, ends: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group whose upper bound reaches the threshold.

    ``side`` is 0 for rows that are compared with each other, else 1 and 2 for those compared across.
    """
    turned, signs, factor = codes(x)
    reach = cosine - error_bound(factor, x.shape[1])
    lefts, rights = [], []
    small = (ends - starts <= SMALL_GROUP) & (side[starts] == 0)
    last = np.repeat(ends, ends - starts)
    rows = np.flatnonzero(np.repeat(small, ends - starts))
    later = last[rows] - 1 - rows
    for part in np.array_split(np.arange(len(rows)), max(1, int(later.sum()) // PAIRS_AT_ONCE)):
        left = np.repeat(rows[part], later[part])
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(later[part]) - later[part], later[part])
        maybe = np.einsum("ij,ij->i", signs[left], turned[right]) / factor[left] >= reach[left]
        lefts.append(left[maybe])
        rights.append(right[maybe])
    for start, end in zip(starts[~small], ends[~small], strict=True):
        here = np.arange(start, end)
        one, two = (here, here) if side[start] == 0 else (here[side[start:end] == 1], here[side[start:end] == 2])
        maybe = (signs[one] @ turned[two].T) / factor[one][:, None] >= reach[one][:, None]
        left, right = np.nonzero(maybe)
        keep = (one[left] < two[right]) | (side[start] != 0)
        lefts.append(one[left[keep]])
        rights.append(two[right[keep]])
    return np.concatenate(lefts), np.concatenate(rights)


def stars(left: np.ndarray, right: np.ndarray, size: int) -> np.ndarray:
    """For each of ``size`` nodes the least one that the links reach."""
    label = np.arange(size)
    while True:
        least = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, least)
        np.minimum.at(label, right, least)
        label = label[label]
        if (label == before).all():
            return label


def links_of(rows: dict[str, np.ndarray], cosine: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(u, v, n) of whole groups of one vector length: links counted per vector, with v = u, and links that join."""
    starts = np.flatnonzero(np.concatenate([[True], rows["group"][1:] != rows["group"][:-1]]))
    left, right = candidates(rows["vector"], rows["side"], starts, np.append(starts[1:], len(rows["group"])), cosine)
    linked = []
    for k in range(0, len(left), PAIRS_AT_ONCE):
        a, b = left[k : k + PAIRS_AT_ONCE], right[k : k + PAIRS_AT_ONCE]
        exact = np.einsum("ij,ij->i", rows["vector"][a], rows["vector"][b]) >= cosine
        # a pair counts in the first band that it shares
        same = rows["keys"][a[exact]] == rows["keys"][b[exact]]
        exact[exact] = same.argmax(axis=1) == rows["band"][a[exact]]
        linked.append(exact)
    if not linked:
        return []
    keep = np.concatenate(linked)
    left, right = left[keep], right[keep]
    ids, place = np.unique(rows["rep"], return_inverse=True)
    counts = np.bincount(place[left], rows["copies"][right], len(ids)) + np.bincount(place[right], rows["copies"][left], len(ids))
    some = np.flatnonzero(counts)
    label = stars(place[left], place[right], len(ids))
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return [(ids[some], ids[some], counts[some].astype(np.int64)), (ids[moved], ids[label[moved]], np.zeros(len(moved), np.int64))]


def compared(groups: DataFrame, cosine: float) -> DataFrame:
    """(u, v, n) of all groups, which arrive sorted; a group that a batch cuts waits for its rest."""
    order = ["label", "size", "key", "i", "j"]

    def run(batches):
        held: list[pa.RecordBatch] = []
        names = ["u", "v", "n"]

        def done(table: pa.Table):
            sizes = table["size"].to_numpy()
            group = np.zeros(len(sizes), bool)
            for name in order:
                column = table[name].combine_chunks()
                values = column.dictionary_encode().indices.to_numpy() if name == "label" else column.to_numpy()
                group[1:] |= values[1:] != values[:-1]
            group = np.cumsum(group)
            for size in np.unique(sizes):
                part = table.filter(pa.array(sizes == size))
                array = lambda name: part[name].combine_chunks().flatten().to_numpy().reshape(part.num_rows, -1)
                own, i, j = (part[n].to_numpy() for n in ("own", "i", "j"))
                rows = {n: part[n].to_numpy() for n in ("rep", "copies", "band")} | {"vector": array("vector"), "keys": array("keys")}
                rows |= {"group": group[sizes == size], "side": np.where(i == j, 0, np.where(own == i, 1, 2))}
                for u, v, n in links_of(rows, cosine):
                    if len(u):
                        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(n, pa.int64())], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < ROWS_AT_ONCE:
                continue
            table = pa.Table.from_batches(held)
            last = {n: table[n][-1].as_py() for n in order}
            tail = np.ones(table.num_rows, bool)
            for name, value in last.items():
                tail &= pc.equal(table[name], value).to_numpy()
            if not tail.all():
                yield from done(table.filter(pa.array(~tail)))
                held = table.filter(pa.array(tail)).to_batches()
        if held:
            yield from done(pa.Table.from_batches(held))

    return groups.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, "u long, v long, n long")


def near_vectors(df: DataFrame, vec_id: Column, vector: Column, label: Column, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``df``."""
    rows = df.select(vec_id.cast("long").alias("vec_id"), vector.cast("array<double>").alias("vector"), label.cast("string").alias("label"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists("vector", lambda v: v != 0)
    usable = F.coalesce(F.col("label").isNotNull() & finite & F.col("vec_id").isNotNull(), F.lit(False))
    # adding zero makes -0.0 equal to 0.0
    classes = rows.where(usable).withColumn("vector", F.transform("vector", lambda v: v + F.lit(0.0))).groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = checkpointed(classes.select("rep", "label", "copies", "vector"))
    bits, bands = plan(classes.count(), cosine)

    coded = checkpointed(encoded(classes, bits, bands))
    where = coded.select("rep", "label", F.size("vector").alias("size"), F.posexplode("keys").alias("band", "key"))
    buckets = where.groupBy("label", "size", "key").agg(F.count("*").alias("members")).where("members > 1")
    dealt = where.join(buckets, ["label", "size", "key"]).withColumn("blocks", F.ceil(F.col("members") / BLOCK)).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("rep", "label", "size", "band", "key", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    found = checkpointed(compared(dealt.join(coded.select("rep", "copies", "vector", "keys"), "rep"), cosine))

    counts = found.groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("others"))
    joined = components(found.where("u <> v").select("u", "v")).withColumnRenamed("node", "rep")
    known = classes.join(counts, "rep", "left").join(joined, "rep", "left")
    known = known.select("label", "vector", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("found"))
    keyed = rows.select("vec_id", "label", F.when(usable, F.transform("vector", lambda v: v + F.lit(0.0))).alias("vector"))
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("found", "vec_id"))
    out = keyed.join(known, ["label", "vector"], "left")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def op8_rotated_codes(spark, sf_dir: str) -> DataFrame:
    """Near duplicates among all vectors of a label."""
    vectors = table(spark, sf_dir, "embeddings")
    return near_vectors(vectors, F.col("vec_id"), F.col("embedding"), F.col("label"))
