"""Token counts of flat token files without an index, by a scan for separators.

A file is nothing but little-endian ids, documents one after another, each ended by a separator id. Files are written
to a folder that the whole cluster shares, and read back as bytes in blocks. Blocks of a file are scanned at once: a vectorised comparison finds the separators of a block. The length of a document that spans
blocks is stitched by a prefix scan over the blocks' tails: tokens after the last separator of a block, and of all
blocks before it without one, are carried into the next. The scan runs over one small row per block (and per group of
blocks in turn), never over tokens.

A block of null or no bytes has no tokens. Bytes that end within an id are an error. Tokens after the last separator
are a document that is not ended. Blocks of a file must differ in number; repeated files count as often as their blocks
do. An empty table gives an empty result. Null and empty texts have no tokens but a separator; repeated rows, and null
keys, are written and counted as often as they occur.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterglass.llm.bpe import VOCABULARY
from meterglass.llm.common import checkpointed, map_batches, shared_folder, table
from meterglass.llm.packing import library_encoder
from meterglass.sources import snapshots

#: Id that ends a document, as in the packing contract.
SEPARATOR = 1
#: An id in a written file: the vocabulary has fewer than 2**16 - 2.
TOKEN = np.dtype("<u2")
#: Bytes of a written file (or one text's, if that is longer), tokens in a block of it, and blocks in a group of the prefix scan.
FILE_BYTES, BLOCK_TOKENS, GROUP_BLOCKS = 32 << 20, 32_768, 4_096


def scan_blocks(df: DataFrame, file: Column, block: Column, data: Column, separator: int = SEPARATOR, width: int = 4) -> DataFrame:
    """Per block: file, block, tokens, cuts (where its documents end, separators included) and tail (tokens after the last)."""
    source = df.select(file.cast("string").alias("file"), block.cast("long").alias("block"), data.cast("binary").alias("data"))

    def make():
        kind = np.dtype(f"<u{width}")

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            tokens, cuts = [], []
            for raw in batch.column("data"):
                held = raw.as_buffer() if raw.is_valid else b""
                if len(held) % width:
                    raise ValueError("a block ends within an id")
                ids = np.frombuffer(held or b"", kind)
                tokens.append(len(ids))
                cuts.append(np.flatnonzero(ids == separator) + 1)
            tail = [n - int(c[-1]) if len(c) else n for n, c in zip(tokens, cuts, strict=True)]
            arrays = [batch.column("file"), batch.column("block"), pa.array(tokens, pa.int64()), pa.array(cuts, pa.list_(pa.int64())), pa.array(tail, pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, ["file", "block", "tokens", "cuts", "tail"])

        return apply

    return map_batches(source, make, "file string, block long, tokens long, cuts array<long>, tail long")


def _open_before(rows: DataFrame, keys: list[str], order: str) -> Column:
    """Tokens of the unended document before each row of ``keys``: the tails since the last row with a separator."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    total = F.coalesce(F.sum("tail").over(before), F.lit(0))
    # all tails up to the last row with a separator are closed; its own tail stays open
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    closed = F.when(F.col("ended"), F.sum("tail").over(upto) - F.col("tail"))
    return total - F.coalesce(F.last(closed, ignorenulls=True).over(before), F.lit(0))


def _sum_before(column: str, keys: list[str], order: str) -> Column:
    return F.coalesce(F.sum(column).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def document_lengths(blocks: DataFrame) -> DataFrame:
    """(file, start, n_tokens, ended) of every document, its separator included; ``start`` is its first token in the file.

    ``blocks`` is the result of `scan_blocks`, and read several times. The prefix scan has two levels, so a file of
    very many blocks is dealt over its groups of blocks. A file without a name is a file like any other.
    """
    # in a struct, as the joins below must find the file whose name is null too
    rows = blocks.withColumn("file", F.struct("file")).withColumn("ended", F.size("cuts") > 0).withColumn("group", F.floor(F.col("block") / GROUP_BLOCKS))
    own = ["file", "group"]
    any_before = F.max("ended").over(Window.partitionBy(*own).orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    inside = rows.withColumns({"open_here": _open_before(rows, own, "block"), "at_here": _sum_before("tokens", own, "block"), "ended_here": F.coalesce(any_before, F.lit(False))})

    last = rows.groupBy(*own).agg(F.max("ended").alias("ended"), F.sum("tokens").alias("tokens"), F.max(F.when(F.col("ended"), F.col("block"))).alias("last"))
    open_rows = rows.select(*own, "block", F.col("tail").alias("t")).join(last, own).where(F.col("last").isNull() | (F.col("block") >= F.col("last")))
    groups = open_rows.groupBy(*own, "ended", "tokens").agg(F.sum("t").alias("tail"))
    outer = groups.select(*own, _open_before(groups, ["file"], "group").alias("open_before"), _sum_before("tokens", ["file"], "group").alias("at_before"))

    placed = inside.join(outer, own).where("ended").select("file", "cuts", (F.col("at_before") + F.col("at_here")).alias("at"), F.when(F.col("ended_here"), F.col("open_here")).otherwise(F.col("open_before") + F.col("open_here")).alias("open"))
    begins = F.concat(F.array(-F.col("open")), F.slice("cuts", F.lit(1), F.size("cuts") - 1))
    spans = placed.select("file", "at", F.explode(F.arrays_zip(begins.alias("begin"), F.col("cuts").alias("end"))).alias("d"))
    ended = spans.select("file", (F.col("at") + F.col("d.begin")).alias("start"), (F.col("d.end") - F.col("d.begin")).alias("n_tokens"), F.lit(True).alias("ended"))

    # what follows the last separator of a file
    files = rows.groupBy("file").agg(F.sum("tokens").alias("all"))
    newest = groups.where("ended").groupBy("file").agg(F.max("group").alias("newest"))
    rest = groups.join(newest, "file", "left").where(F.col("newest").isNull() | (F.col("group") >= F.col("newest"))).groupBy("file").agg(F.sum("tail").alias("n_tokens"))
    rest = rest.where("n_tokens > 0").join(files, "file").select("file", (F.col("all") - F.col("n_tokens")).alias("start"), "n_tokens", F.lit(False).alias("ended"))
    return ended.unionByName(rest).withColumn("file", F.col("file.file"))


def write_token_files(df: DataFrame, text: Column, folder: str, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Writes texts as flat token files: nothing but their ids, each text's ended by `SEPARATOR`.

    Every task writes its rows in their order, and begins a new file before one would have more than ``file_bytes``; a
    file's folder has the numbers of the task and of the file in it. All ids are two higher than the vocabulary's, so no
    text holds the separator, which the writer puts after each row as its line end.
    """

    def make():
        encoder, task = library_encoder(path), TaskContext.get().partitionId()
        number, size = 0, 0

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal number, size
            values, names = [], []
            for t in batch.column("text"):
                value = (encoder.ids(t.as_py() or "") + np.uint32(2)).astype(TOKEN).tobytes()
                grown = len(value) + TOKEN.itemsize
                if size and size + grown > file_bytes:
                    number, size = number + 1, 0
                size += grown
                values.append(value)
                names.append(f"{task:010d}-{number:010d}")
            return pa.RecordBatch.from_arrays([pa.array(values, pa.binary()), pa.array(names, pa.string())], ["value", "file"])

        return apply

    tokens = map_batches(df.select(text.cast("string").alias("text")), make, "value binary, file string")
    ending = np.array([SEPARATOR], TOKEN).tobytes().decode("ascii")
    tokens.select(F.col("value").cast("string"), "file").write.option("lineSep", ending).partitionBy("file").text(folder)


def token_blocks(spark: SparkSession, folder: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, data): the bytes of flat token files, cut in blocks wherever they fall.

    A file, which is bounded by bytes but for a single longer text, is read as a whole by one task.
    """
    size = block_tokens * TOKEN.itemsize
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.regexp_extract("path", r"/file=([^/]+)/[^/]+$", 1)
    starts = F.when(F.col("length") > 0, F.sequence(F.lit(0).cast("long"), (F.col("length") - 1).cast("long"), F.lit(size).cast("long")))
    parts = F.transform(starts, lambda at: F.substring("content", (at + 1).cast("int"), F.lit(size)))
    return files.select(name.alias("file"), F.posexplode(parts).alias("block", "data"))


def placed_texts(df: DataFrame, key: Column) -> DataFrame:
    """(key, task, row): the place of each row of ``df``, which must give its rows as when `write_token_files` read them, as tables do."""
    number = F.monotonically_increasing_id()
    return df.select(key.alias("key"), F.shiftright(number, 33).alias("task"), number.bitwiseAND(F.lit((1 << 33) - 1)).alias("row"))


def counted_texts(places: DataFrame, lengths: DataFrame) -> DataFrame:
    """(key, n_tokens, ended): the tokens of each text, without its separator, by its place among those of its task.

    A place without a document, or a document without a place, is an error.
    """
    inside = F.row_number().over(Window.partitionBy("file").orderBy("start")) - 1
    files = lengths.groupBy("file").agg(F.count("*").alias("n"))
    task = F.split("file", "-").getItem(0).cast("long").alias("task")
    # a row for each file of a task
    before = F.sum("n").over(Window.partitionBy("task").orderBy("file")) - F.col("n")
    firsts = files.select("file", task, "n").select("file", "task", before.alias("first"))
    found = lengths.withColumn("inside", inside.cast("long")).join(firsts, "file").select("task", (F.col("first") + F.col("inside")).alias("row"), "n_tokens", "ended")
    both = places.withColumn("placed", F.lit(True)).join(found, ["task", "row"], "full_outer")
    fits = F.col("placed") & F.col("ended")
    tokens = F.when(F.coalesce(fits, F.lit(False)), F.col("n_tokens") - 1).otherwise(F.raise_error(F.concat(F.lit("texts and documents differ in task "), F.col("task").cast("string"))).cast("long"))
    return both.select("key", tokens.alias("n_tokens"), "ended")


@contextmanager
def same_splits(spark: SparkSession) -> Iterator[None]:
    """Within it tables are split alike each time they are read, also when executors come or go in between."""
    name = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(name, None)
    spark.conf.set(name, before or spark.sparkContext.defaultParallelism)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)


def op3_separator_scan(spark, sf_dir: str) -> DataFrame:
    """All documents written as flat token files, and the tokens of each found by scanning them for separators."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    with same_splits(spark):
        # once for texts, and once for their ids alone
        write_token_files(docs, F.col("text"), folder, public_tokenizers.path(VOCABULARY))
        places = checkpointed(placed_texts(docs, F.col("doc_id")))
    scanned = checkpointed(scan_blocks(token_blocks(spark, folder), F.col("file"), F.col("block"), F.col("data"), width=TOKEN.itemsize))
    snapshots.remove(spark, folder)
    counted = counted_texts(places, document_lengths(scanned))
    return counted.select(F.col("key").alias("doc_id"), "n_tokens", "ended")
