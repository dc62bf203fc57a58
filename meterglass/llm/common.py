"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a batch that Spark hands to Python; documents are long, and a worker holds a few batches.
BATCH_ROWS = 1000
#: Ids that a join broadcasts at most (32 MB).
MOST_IDS = 1 << 22
#: Bytes of a batch that a Python function gets at a time; a longer row stands alone.
SLICE_BYTES = 64 << 20
#: Bytes of text that a Python task turns into numpy arrays at a time.
CHUNK_BYTES = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """The rows that no model learns from: crc32 of the id as text leaves 2 modulo 4; false where the id is null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, which ``spark.checkpoint.dir`` names.

    Only a session within one machine and without that setting, as in tests, gets a temporary folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the cluster's shared checkpoint folder, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def matched(df: DataFrame, key: str, ids: DataFrame, how: str) -> DataFrame:
    """``df`` semi-joined or anti-joined (``how``) with ``ids``, whose only column is ``key``.

    Up to `MOST_IDS` ids are broadcast, so that the rows of ``df``, which hold texts, need not be shuffled; for more of
    them both sides are. ``ids`` is counted, so it should be a checkpoint.
    """
    return df.join(F.broadcast(ids) if ids.count() <= MOST_IDS else ids, key, how)


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def least_hashed(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The ``rows`` rows with the least hash of ``key``, which is not null and does not repeat.

    A threshold that about four times as many rows pass comes first, so what tasks send on is bounded too.
    """
    spread = 1 << 40
    hashed = df.withColumn("_h", F.pmod(F.xxhash64(key), F.lit(spread)))
    most = -(-spread * 4 * rows // max(1, df.select(key).count()))
    return hashed.where(F.col("_h") < most).orderBy("_h", key).limit(rows).drop("_h")


def text_chunks(values: list[str | None], most: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as UTF-8) in runs of about ``most`` bytes; null counts as empty. A longer text stands alone."""
    first, held, size = 0, [], 0
    for row, value in enumerate(values):
        raw = (value or "").encode("utf-8", "surrogatepass")
        if held and size + len(raw) > most:
            yield first, held
            first, held, size = row, [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield first, held


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """Applies a function to each Arrow batch; ``make`` builds it once in every task, so its tables are not rebuilt per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            for part in bounded(batch):
                yield apply(part)

    return in_small_batches(df).mapInArrow(run, schema)


def bounded(batch: pa.RecordBatch, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most ``most`` bytes (by default `SLICE_BYTES`) or one row, in order; none of no rows."""
    if batch.num_rows > 1 and batch.nbytes > (SLICE_BYTES if most is None else most):
        half = batch.num_rows // 2
        yield from bounded(batch.slice(0, half), most)
        yield from bounded(batch.slice(half), most)
    elif batch.num_rows:
        yield batch


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``; from here on the session's batches for Python have at most `BATCH_ROWS` rows."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) not in range(1, BATCH_ROWS + 1):
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return df


def filter_batches(df: DataFrame, columns: dict[str, Column], make: Callable[[], Callable[[pa.RecordBatch], list[bool]]]) -> DataFrame:
    """The rows of ``df``, with all its columns, for which the batch function says True.

    ``columns`` names what the function reads; they travel beside the row in a struct, so no column name can clash.
    """
    packed = df.select(F.struct(*[c.alias(n) for n, c in columns.items()]).alias("seen"), F.struct(*[df[f"`{n}`"] for n in df.columns]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = make()
        for whole in batches:
            for batch in bounded(whole):
                yield batch.select(["row"]).filter(pa.array(judge(pa.RecordBatch.from_struct_array(batch.column("seen"))), pa.bool_()))

    return in_small_batches(packed).mapInArrow(run, packed.select("row").schema).select("row.*")
