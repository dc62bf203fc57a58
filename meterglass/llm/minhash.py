"""Near-duplicate documents: fast similarity sketches, banding, and verification on full shingle sets.

1. Every whole text becomes a set of 64-bit shingle numbers, its sketch, and one key per band (`shingles`). Documents
   of equal sets form a class with its least doc_id as representative; only representatives go on, so exact copies
   cost nothing from here on.
2. Representatives that share a band key form a bucket. Two pivots of each bucket (the least id and the greatest) are
   compared with its members on full sets, and the links give first components.
3. What a bucket of more than three still holds of different components is compared too, so that no candidate pair goes
   untested unless it is known to be connected: in blocks of bounded size, where an inverted index counts the
   intersections and only a spanning set of links leaves the task.
4. The components of all links, and of the classes, are the result.

Two texts of similarity 0.75 share one of 32 bands of 4 rows with probability 1 - 5e-6. Links are exact:
100 * intersection >= 75 * union, by default.

Rows of null or wordless text have an empty set and stand alone. A null doc_id has no identity to link: its row has a
null component and is kept. Rows with the same doc_id count as one document, whichever of their texts links: all have
one component. Repeated rows come out as often as they come in. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterglass.llm.common import checkpointed, map_batches, matched, table, text_chunks
from meterglass.llm.graph import components, contracted, directed, nearest
from meterglass.llm.shingles import WORDS, band_keys, shingle_sets, sketches

PERCENT = 75
#: Shingles and documents in a block of a large bucket, about; a task holds two blocks.
BLOCK_SHINGLES, BLOCK_DOCUMENTS = 1 << 19, 4096


def sketch_documents(df: DataFrame, doc_id: Column, text: Column, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, set_id, keys): the digest of each document's shingle set and its band keys (null if empty)."""

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, digests, keys = [], [], []
            for _, texts in text_chunks(batch.column("text").to_pylist()):
                sets = shingle_sets(texts, words)
                counts += map(len, sets)
                digests += [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                keys += [k if len(s) else None for k, s in zip(band_keys(sketches(sets)), sets, strict=True)]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_id", "keys"])

        return apply

    return map_batches(df.select(doc_id.cast("long").alias("doc_id"), text.cast("string").alias("text")), make, "doc_id long, n_shingles long, set_id binary, keys array<long>")


def document_sets(df: DataFrame, words: int = WORDS) -> DataFrame:
    """(rep, shingles): full sets of the texts of ``df`` (rep, text)."""

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets: list[np.ndarray] = []
            for _, texts in text_chunks(batch.column("text").to_pylist()):
                sets += [s.view(np.int64) for s in shingle_sets(texts, words)]
            return pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(sets, pa.list_(pa.int64()))], ["rep", "shingles"])

        return apply

    return map_batches(df.select("rep", "text"), make, "rep long, shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that link. Sets meet in two joins, whose skewed keys adaptive execution splits."""
    left = pairs.join(sets.select(F.col("rep").alias("u"), F.col("shingles").alias("a")), "u")
    both = left.join(sets.select(F.col("rep").alias("v"), F.col("shingles").alias("b")), "v")
    both = both.select("u", "v", F.size("a").alias("n"), F.size("b").alias("m"), F.size(F.array_intersect("a", "b")).alias("common"))
    return both.where(100 * F.col("common") >= percent * (F.col("n") + F.col("m") - F.col("common"))).select("u", "v")


def block_links(percent: int):
    """Links between different components in a block: enough to join whatever can be joined, no more."""

    def link(rows: pa.Table) -> pa.Table:
        comp, reps = rows["comp"].to_numpy(), rows["rep"].to_numpy()
        shingles = rows["shingles"].combine_chunks()
        sizes = shingles.value_lengths().to_numpy()
        numbers, ends = shingles.flatten().to_numpy(), np.cumsum(sizes)
        order = np.argsort(numbers, kind="stable")
        flat, owner = numbers[order], np.repeat(np.arange(len(sizes)), sizes)[order]
        names, label = np.unique(comp, return_inverse=True)
        parent = list(range(len(names)))

        def root(c: int) -> int:
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        found: list[tuple[int, int]] = []
        # pairs within the largest component need no test
        for k in np.flatnonzero(label != np.bincount(label).argmax()):
            own = numbers[ends[k] - sizes[k] : ends[k]]
            a, b = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
            runs = b - a
            at = np.repeat(a - np.concatenate([[0], np.cumsum(runs)[:-1]]), runs) + np.arange(runs.sum())
            common = np.bincount(owner[at], minlength=len(sizes))
            for j in np.flatnonzero((100 * common >= percent * (sizes + sizes[k] - common)) & (label != label[k])):
                x, y = root(label[k]), root(label[j])
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    found.append((reps[k], reps[j]))
        return pa.table({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())})

    return link


def near_duplicates(df: DataFrame, doc_id: Column, text: Column, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``df``."""
    texts = df.select(doc_id.cast("long").alias("doc_id"), text.cast("string").alias("text"))
    documents = checkpointed(sketch_documents(texts, F.col("doc_id"), F.col("text"), words))
    known = documents.where("doc_id IS NOT NULL AND set_id IS NOT NULL")
    # equal sets have equal keys, so any row's will do
    classes = known.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"))
    bands = classes.select("rep", "n_shingles", F.explode("keys").alias("key"))

    # most keys are of one document: they are only counted, and pivots sought among the rest
    # (what is aggregated by key becomes a checkpoint before it is joined, or adaptive execution could not split hot keys)
    shared = checkpointed(bands.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    mates = checkpointed(bands.join(shared, "key"))
    pivots = checkpointed(mates.groupBy("key").agg(F.sum("n_shingles").alias("shingles"), F.min("rep").alias("p0"), F.max("rep").alias("p1")))
    members = mates.join(pivots, "key")
    alike = checkpointed(mates.select("rep").distinct())
    sets = checkpointed(document_sets(matched(texts.withColumnRenamed("doc_id", "rep"), "rep", alike, "left_semi"), words).distinct())

    stars = members.select("rep", F.explode(F.array("p0", "p1")).alias("pivot")).where("rep <> pivot")
    links = checkpointed(verified(stars.select(F.greatest("rep", "pivot").alias("u"), F.least("rep", "pivot").alias("v")).distinct(), sets, percent))

    # all pairs of a bucket of up to three have been compared with that
    closer = contracted(contracted(directed(links)))
    first = nearest(closer).select(F.col("u").alias("rep"), F.col("m").alias("component"))
    large = members.where(F.col("size") > 3).select("key", "rep", "size", "shingles").join(first, "rep", "left")
    placed = checkpointed(large.withColumn("comp", F.coalesce("component", "rep")).drop("component"))
    open_keys = checkpointed(placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key"))
    left = placed.join(open_keys, "key", "left_semi")
    blocks = F.greatest(F.ceil(F.col("shingles") / BLOCK_SHINGLES), F.ceil(F.col("size") / BLOCK_DOCUMENTS))
    owned = left.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    dealt = owned.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("key", "rep", "comp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    rest = dealt.join(sets, "rep").groupBy("key", "i", "j").applyInArrow(block_links(percent), "u long, v long")

    final = components(closer.select("u", "v").unionByName(rest).unionByName(same_ids(known, classes))).withColumnRenamed("node", "rep")
    placed_classes = classes.select("set_id", "rep").join(final, "rep", "left").select("set_id", F.coalesce("component", "rep").alias("found"))
    out = documents.drop("keys").join(placed_classes, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def same_ids(known: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (u, v) between a doc_id that occurs with several sets and the representative of each."""
    several = known.groupBy("doc_id").agg(F.min("set_id").alias("low"), F.max("set_id").alias("high")).where("low <> high").select("doc_id")
    rows = known.select("doc_id", "set_id").join(several, "doc_id", "left_semi")
    return rows.join(classes.select("set_id", "rep"), "set_id").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))


def keep_one(df: DataFrame, doc_id: Column, text: Column, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``df`` that are kept: one document of each component, and all without a doc_id.

    Where rows repeat a doc_id, all of them stay.
    """
    gone = near_duplicates(df, doc_id, text, words, percent).where(~F.col("kept")).select(F.col("doc_id").alias("own_id")).distinct()
    packed = df.select(doc_id.cast("long").alias("own_id"), F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"))
    return matched(packed, "own_id", checkpointed(gone), "left_anti").select("row.*")


def op10_minhash(spark, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, F.col("doc_id"), F.col("text"))
