"""Vector bin packing of token sequences by the dot-product heuristic.

Every sequence has three limits at once: tokens, segments (pieces) and loss-bearing tokens. A piece's demand is the
vector of the three. The open sequence takes, of all waiting pieces that fit, the one whose demand has the greatest
dot product with what is still free, each dimension weighed by how scarce it is among the waiting pieces. When no
whole piece fits, the piece of greatest dot product is cut at what is free, so sequences are filled to the last token
unless another limit is reached; the rest of that piece waits on.

Documents are packed as they are read, in each partition by itself: no shuffle, no group, and a pool of bounded size
per task. A partition leaves at most a few sequences that are not full. The same partitions give the same sequences,
so a task that runs again repeats them. A hot source changes nothing, and a long document is simply cut more often.

Text of any length is encoded, also a million characters of white space. A null or empty text is the closing id alone. A row whose ids are null has no piece. Repeated rows are packed as often
as they occur; the order of equal pieces is that of the rows.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterglass.llm.bpe import SPACE, VOCABULARY, byte_letters, shared_encoder
from meterglass.llm.common import in_small_batches, table

MAX_TOKENS = 2048
#: For documents; on average a piece may then be as short as four tokens.
MAX_SEGMENTS = 512
#: Pieces that wait in a task's pool.
POOL = 512
#: The id that closes a document.
CLOSING = np.array([1], "<u4")
#: Characters of white space in a row that are not left to the library's pattern.
LONG_RUN = 50_000
#: Only a run's beginning is tried, so that shorter runs cost no more than their length.
LONG_SPACE = regex.compile(rf"(?<![{SPACE}])[{SPACE}]{{{LONG_RUN},}}")
#: Rows of a batch that a task returns.
ROWS_AT_ONCE = 2000


class Packer:
    """Takes documents one at a time and yields the pieces of each sequence that is done."""

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, pool: int = POOL) -> None:
        if min(max_tokens, max_segments, max_loss) < 1:
            raise ValueError("every limit must be at least 1")
        self.limits = np.array([max_tokens, max_segments, max_loss], float)
        self.pool = pool
        self.size = np.zeros((2 * pool, 3))
        self.waiting: list[tuple] = []  # key, ids of the whole document, loss-bearing ones before each id, start
        self.sequences = 0

    def demand(self, ids: np.ndarray, losses: np.ndarray, start: int) -> tuple[int, int, int]:
        """Of the ids from ``start`` on."""
        return len(ids) - start, 1, int(losses[-1] - losses[start])

    def add(self, key: object, ids: np.ndarray, mask: np.ndarray) -> Iterator[list[tuple]]:
        if not len(ids):
            return
        if len(self.waiting) == len(self.size):
            self.size = np.concatenate([self.size, np.zeros_like(self.size)])
        losses = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(mask, out=losses[1:])
        self.size[len(self.waiting)] = self.demand(ids, losses, 0)
        self.waiting.append((key, ids, losses, 0))
        while len(self.waiting) > self.pool:
            yield self.fill()

    def rest(self) -> Iterator[list[tuple]]:
        while self.waiting:
            yield self.fill()

    def drop(self, at: int) -> None:
        last = len(self.waiting) - 1
        self.waiting[at], self.size[at] = self.waiting[last], self.size[last]
        self.waiting.pop()

    def fill(self) -> list[tuple]:
        """One sequence: (key, start, ids, offset) of its pieces."""
        free = self.limits.copy()
        placed: list[tuple] = []
        while self.waiting and free.min() >= 0 and free[0] > 0 and free[1] > 0:
            sizes = self.size[: len(self.waiting)]
            weights = free / self.limits * sizes.mean(axis=0) / self.limits
            gain = sizes @ (weights / self.limits)
            fits = (sizes <= free).all(axis=1)
            if fits.any():
                at = int(np.argmax(np.where(fits, gain, -1.0)))
                key, ids, losses, start = self.waiting[at]
                end = len(ids)
            else:
                at = int(np.argmax(gain))
                key, ids, losses, start = self.waiting[at]
                # as many tokens as are free and hold no more loss-bearing ones than are free
                end = min(start + int(free[0]), int(np.searchsorted(losses, losses[start] + int(free[2]), side="right")) - 1)
                if end == start:
                    break
            placed.append((key, start, ids[start:end], int(self.limits[0] - free[0])))
            free -= (end - start, 1, int(losses[end] - losses[start]))
            if end == len(ids):
                self.drop(at)
            else:
                self.waiting[at] = (key, ids, losses, end)
                self.size[at] = self.demand(ids, losses, end)
        self.sequences += 1
        return placed


def pack(df: DataFrame, ids: Column, *keys: str, loss: Column | None = None, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_TOKENS) -> DataFrame:
    """One row per piece: ``keys``, ``start``, ``length``, ``ids``, ``doc_tokens``, ``sequence_id`` and ``offset``.

    ``ids`` is binary, little-endian unsigned 32-bit. ``loss``, binary, has a byte for each id, not 0 where the id bears
    loss; by default all do but the first, which nothing precedes. ``sequence_id`` is the partition's number times
    2**40 plus a count.
    """
    source = df.select(F.struct(*[df[f"`{k}`"] for k in keys]).alias("keys"), ids.alias("ids"), (F.lit(None).cast("binary") if loss is None else loss).alias("loss"))

    def read(batch: pa.RecordBatch) -> Iterator[tuple]:
        for key, raw, bears in zip(batch.column("keys"), batch.column("ids"), batch.column("loss"), strict=True):
            if raw.is_valid:
                numbers = np.frombuffer(raw.as_py(), "<u4")
                mask = np.frombuffer(bears.as_py(), np.uint8) != 0 if bears.is_valid else np.arange(len(numbers)) > 0
                if len(mask) != len(numbers):
                    raise ValueError("a row has as many loss bytes as ids")
                yield key.as_py(), numbers, mask

    return _packed(source, lambda: read, max_tokens, max_segments, max_loss)


class LibraryEncoder:
    """A public library's encoder of a vocabulary file, whose ids are in the order of its merges.

    The library's pattern fails on white space of about a million characters. Such runs are cut out, which is exact as
    white space always begins a piece, and operator 9 encodes them.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters, special = byte_letters(), {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): n for token, n in spec["model"]["vocab"].items() if token not in special}
        self.path, self.special = path, tuple(special)
        self.encoding = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.sizes = np.zeros(1 + max([*ranks.values(), *special.values()]), np.int64)
        for token, n in [*ranks.items(), *((t.encode(), n) for t, n in special.items())]:
            self.sizes[n] = len(token)

    def ids(self, text: str) -> np.ndarray:
        """The token ids of a whole text, as `<u4`."""
        parts, at = [], 0
        for run in LONG_SPACE.finditer(text) if len(text) >= LONG_RUN else ():
            end = run.end()
            # its last character belongs to what follows, unless that is a special token
            if end < len(text) and not text.startswith(self.special, end):
                end -= 1
            parts += [self.plain(text[at : run.start()]), np.array(shared_encoder(self.path).tree(text[run.start() : end].encode()), "<u4")]
            at = end
        last = self.plain(text[at:])
        return np.concatenate([*parts, last]) if parts else last

    def plain(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)

    def after(self, ids: np.ndarray, bytes_before: int) -> np.ndarray:
        """Which ids begin at or behind so many bytes of their text."""
        sizes = self.sizes[ids]
        return np.cumsum(sizes) - sizes >= bytes_before


@functools.cache
def library_encoder(path: str) -> LibraryEncoder:
    """The encoder of a Python worker, which its tasks use one after another."""
    return LibraryEncoder(path)


def pack_texts(df: DataFrame, text: Column, *keys: str, path: str, prompt: Column | None = None, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_TOKENS) -> DataFrame:
    """`pack` of texts: each one's token ids and the closing id, encoded in the task that packs them.

    ``prompt`` is the characters at a text's beginning that bear no loss, as the instruction before an answer (null: 0);
    a token bears loss that begins behind them, as does the closing id. The first id never does.
    """
    first = F.lit(0) if prompt is None else F.octet_length(F.left(text.cast("string"), prompt.cast("int")))
    source = df.select(F.struct(*[df[f"`{k}`"] for k in keys]).alias("keys"), text.cast("string").alias("text"), F.coalesce(first, F.lit(0)).cast("long").alias("prompt"))

    def reader():
        encoder = library_encoder(path)

        def read(batch: pa.RecordBatch) -> Iterator[tuple]:
            for key, value, before in zip(batch.column("keys"), batch.column("text"), batch.column("prompt").to_pylist(), strict=True):
                ids = encoder.ids(value.as_py() or "")
                numbers = np.append(ids, CLOSING).astype("<u4", copy=False)
                mask = np.append(encoder.after(ids, before), True) if before else np.ones(len(numbers), bool)
                mask[0] = False
                yield key.as_py(), numbers, mask

        return read

    return _packed(source, reader, max_tokens, max_segments, max_loss)


def _packed(source: DataFrame, reader: Callable[[], Callable[[pa.RecordBatch], Iterator[tuple]]], max_tokens: int, max_segments: int, max_loss: int) -> DataFrame:
    names = ["keys", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, read = Packer(max_tokens, max_segments, max_loss), reader()
        base = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        kind = None

        def put(sequence: list[tuple]) -> None:
            number = base + packer.sequences - 1
            rows.extend((k, start, len(part), part.tobytes(), total, number, offset) for (k, total), start, part, offset in sequence)

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            kinds = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        for part in batches:
            kind = part.column("keys").type
            for key, numbers, mask in read(part):
                for sequence in packer.add((key, len(numbers)), numbers, mask):
                    put(sequence)
                if len(rows) >= ROWS_AT_ONCE:
                    yield batch()
        for sequence in packer.rest():
            put(sequence)
        if rows:
            yield batch()

    schema = f"keys {source.schema['keys'].dataType.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return in_small_batches(source).mapInArrow(run, schema).select("keys.*", *names[1:])


def digest(pieces: DataFrame) -> DataFrame:
    """Pieces with the crc32 of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_vector_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens; ids_crc32 is of the little-endian ids of a piece."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(pack_texts(docs, F.col("text"), "doc_id", path=public_tokenizers.path(VOCABULARY)))
