"""A data source of log lines that reads every byte once and knows which line is not ended yet, and one that writes files.

Files are cut in blocks of bytes, and a task reads its blocks in order: a line belongs to the block that its first byte
lies in, wherever it ends. A line that the file's end cuts off is held back, which only its own task has to see. Files
are listed, and their ends known, when the scan is planned; bytes that come later are left for the next scan.

Paths are those of pyarrow's file systems: local ones, hdfs, viewfs, s3 (s3a), gs and abfs. A task holds one piece of a
block and the longest line. Bytes that are no UTF-8 go on as they are, as in Spark's text source.
"""

from __future__ import annotations

import fnmatch
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes of a block, of the files that a task reads together, and read at a time.
BLOCK_BYTES, TASK_BYTES, READ_BYTES = 32 << 20, 32 << 20, 4 << 20
#: Rows of short files that go on together.
BATCH_ROWS = 10_000
COLUMNS = ["value", "file", "file_size", "block", "line"]
SCHEMA = "value string, file string, file_size long, block long, line long"
ENDS = "file string, size long, modified timestamp, head string, ended boolean, ended_size long"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    scheme, rest = path.split(":", 1)
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(("s3:" if scheme in ("s3a", "s3n") else f"{scheme}:") + rest)


def shown(path: str, inner: str) -> str:
    """The URI of a file below ``path``, as Spark's file sources show it."""
    if "://" not in path and not path.startswith("file:"):
        return f"file:{inner}"
    scheme, rest = path.split(":", 1)
    if scheme == "file":
        return f"file:{inner}"
    host = rest[2:].split("/", 1)[0]
    return f"{scheme}://{host}/{inner.removeprefix(host).lstrip('/')}" if scheme in ("s3", "s3a", "s3n", "gs") else f"{scheme}://{host}{inner}"


@dataclass
class File:
    shown: str
    root: str
    inner: str
    size: int
    modified: float


def listed(paths: list[str], pattern: str) -> list[File]:
    """The files below ``paths`` whose names fit, by their shown path; hidden ones (`_` or `.` first, in any folder) are left out."""
    found: dict[str, File] = {}
    for path in paths:
        system, inner = opened(path.rstrip("/"))
        info = system.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        infos = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True))
        for f in infos:
            below = f.path.removeprefix(inner).strip("/").split("/") if f.path != inner else [f.base_name]
            if f.type == fs.FileType.File and f.size and fnmatch.fnmatchcase(f.base_name, pattern) and not any(p.startswith(("_", ".")) and "=" not in p for p in below):
                name = shown(path, f.path)
                found[name] = File(name, path, f.path, f.size, f.mtime.timestamp() if f.mtime else 0.0)
    return [found[n] for n in sorted(found)]


@dataclass
class Part(InputPartition):
    """(file, first byte, end) of the blocks that a task reads."""

    blocks: list[tuple[File, int, int]]

    def __init__(self, blocks: list[tuple[File, int, int]]) -> None:
        super().__init__(None)
        self.blocks = blocks


def parts(files: list[File], block: int = BLOCK_BYTES, together: int = TASK_BYTES) -> list[Part]:
    out: list[Part] = []
    held: list[tuple[File, int, int]] = []
    size = 0
    for f in files:
        for start in range(0, f.size, block):
            end = min(start + block, f.size)
            if held and size + end - start > together:
                out.append(Part(held))
                held, size = [], 0
            held.append((f, start, end))
            size += end - start
    return [*out, Part(held)] if held else out


def line_starts(stream, start: int) -> int:
    """The first byte of the first line that begins at ``start`` or behind it; -1 if none does."""
    if start == 0:
        return 0
    stream.seek(start - 1)
    at = start - 1
    while piece := stream.read(READ_BYTES):
        cut = piece.find(b"\n")
        if cut >= 0:
            return at + cut + 1
        at += len(piece)
    return -1


def pieces(stream, start: int, end: int, size: int) -> Iterator[bytes]:
    """Whole lines, in pieces, of the lines that begin in the bytes from ``start`` to ``end``; none that the file's end cuts off."""
    at = line_starts(stream, start)
    if at < 0 or at >= end:
        return
    stream.seek(at)
    held: list[bytes] = []  # the beginning of the next line
    while at < size:
        piece = stream.read(min(READ_BYTES, size - at))
        if not piece:
            return
        # the line that holds the block's last byte is the last one
        final = piece.find(b"\n", max(0, end - 1 - at)) if at + len(piece) >= end else -1
        cut = final if final >= 0 else piece.rfind(b"\n")
        at += len(piece)
        if cut < 0:
            held.append(piece)
            continue
        yield b"".join([*held, piece[: cut + 1]])
        if final >= 0:
            return
        held = [piece[cut + 1 :]]


def lines_of(data: bytes) -> pa.Array:
    """The lines of whole lines, without their ends."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return pc.binary_slice(whole, 0, -1)


def candidates(values: pa.Array) -> pa.Array:
    """Which lines can hold usage, as `lines.prefilter` says of columns."""
    has = lambda text: pc.match_substring(values, text)
    return pc.or_(pc.and_(has('"usage"'), has("assistant")), pc.or_(has('"token_count"'), has('"turn_context"')))


def filled(values: pa.Array) -> pa.Array:
    """Which lines are not blank."""
    return pc.greater(pc.binary_length(pc.ascii_trim(values, " \t\r\f\v")), 0)


class BlockReader(DataSourceReader):
    def __init__(self, paths: list[str], pattern: str, block: int, together: int, candidates: bool = False) -> None:
        self.paths, self.pattern, self.block, self.together, self.candidates = paths, pattern, block, together, candidates

    def partitions(self) -> list[Part]:
        return parts(listed(self.paths, self.pattern), self.block, self.together)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return together(rows_of(partition.blocks if partition is not None and hasattr(partition, "blocks") else [], self.candidates))


def rows_of(blocks: Iterable[tuple[File, int, int]], only_candidates: bool) -> Iterator[pa.RecordBatch]:
    """The lines of blocks; with ``only_candidates`` those that can hold usage, and a row for each block with lines."""
    for f, start, end in blocks:
        number = lines = 0
        with opened(f.root)[0].open_input_file(f.inner) as stream:
            for data in pieces(stream, start, end, f.size):
                values = _text(lines_of(data))
                numbers = pa.array(np.arange(number, number + len(values), dtype=np.int64))
                number += len(values)
                keep = filled(values)
                lines += pc.sum(keep).as_py() or 0
                if only_candidates:
                    keep = pc.and_(keep, candidates(values))
                yield from _batch(f, start, values.filter(keep), numbers.filter(keep))
        if only_candidates and lines:
            yield from _batch(f, start, pa.nulls(1, pa.large_string()), pa.array([lines], pa.int64()))


def _batch(f: File, start: int, values: pa.Array, numbers: pa.Array) -> Iterator[pa.RecordBatch]:
    n = len(values)
    if n:
        same = lambda x, kind: pa.repeat(pa.scalar(x, kind), n)
        yield pa.RecordBatch.from_arrays([values.cast(pa.string()), same(f.shown, pa.string()), same(f.size, pa.int64()), same(start, pa.int64()), numbers], COLUMNS)


def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in fewer batches: those of short files go on together, up to `BATCH_ROWS` or the bytes of a piece."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        if held and (rows + batch.num_rows > BATCH_ROWS or size + batch.nbytes > READ_BYTES):
            yield pa.concat_batches(held)
            held, rows, size = [], 0, 0
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
    if held:
        yield pa.concat_batches(held)


def listed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates, as `rows_of` gives them, of the blocks (path, size, start, end) of a listing."""
    blocks = ((File(r["path"], r["path"], opened(r["path"])[1], r["size"], 0.0), r["start"], r["end"]) for batch in batches for r in batch.to_pylist())
    return together(rows_of(blocks, True))


def _text(values: pa.Array) -> pa.Array:
    """Bytes as text, whether they are UTF-8 or not."""
    return pa.Array.from_buffers(pa.large_string(), len(values), values.buffers(), offset=values.offset)


class LogBlocks(DataSource):
    """Options: ``paths`` (one per line), ``pattern``, ``block`` and ``together`` (bytes), ``candidates``.

    Blank lines are left out. With ``candidates`` only lines that can hold usage go on, and for each block that has lines
    a row whose value is null and whose ``line`` is their number.
    """

    @classmethod
    def name(cls) -> str:
        return "log_blocks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BlockReader:
        given = self.options
        return BlockReader(given["paths"].split("\n"), given.get("pattern", "*"), int(given.get("block", BLOCK_BYTES)), int(given.get("together", TASK_BYTES)), given.get("candidates", "false") == "true")


class FileWriter(DataSourceArrowWriter):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, inner = opened(self.folder)
        now = hidden = stream = None
        made: set[str] = set()
        try:
            for batch in iterator:
                values = batch.column("value").cast(pa.large_binary())
                data = values.buffers()[2] or pa.py_buffer(b"")
                ends = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
                runs, start = pc.run_end_encode(batch.column("path")), 0
                for path, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                    if path != now:
                        if stream is not None:
                            stream.close()
                            system.move(hidden, f"{inner}/{now}")
                        parent, _, name = f"{inner}/{path}".rpartition("/")
                        if parent not in made:
                            system.create_dir(parent, recursive=True)
                            made.add(parent)
                        now, hidden = path, f"{parent}/.{name}.{uuid.uuid4().hex}"
                        stream = system.open_output_stream(hidden)
                    stream.write(data[ends[start] : ends[end]])
                    start = end
            if stream is not None:
                stream.close()
                system.move(hidden, f"{inner}/{now}")
        except BaseException:
            if stream is not None and not stream.closed:
                stream.close()
                system.delete_file(hidden)
            raise
        return WriterCommitMessage()


class LogFiles(DataSource):
    """Writes rows (path, value) as files below the option ``folder``: a file is the values of its path, as they are.

    Rows must be dealt and sorted by path. A task has one file open, and gives it its name when it is whole, so a task that
    runs again replaces whole files by the same ones, and readers, which leave out hidden files, see no others. Nothing is
    renamed at the end of the job, so many small files cost what writing them costs.
    """

    @classmethod
    def name(cls) -> str:
        return "log_files"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["folder"].rstrip("/"))
