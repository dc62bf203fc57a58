import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meterglass.llm import separators
from meterglass.llm.bpe import VOCABULARY


def brute(ids):
    out, start = [], 0
    for k, n in enumerate(ids):
        if n == 1:
            out.append((start, k + 1 - start, True))
            start = k + 1
    return out + ([(start, len(ids) - start, False)] if start < len(ids) else [])


@pytest.mark.parametrize("group", [2, 3, 4096])
def test_lengths_equal_one_token_after_another(spark, monkeypatch, group):
    monkeypatch.setattr(separators, "GROUP_BLOCKS", group)
    rng = np.random.default_rng(0)
    files = {f"f{k}": rng.choice([1, 2, 3], n, p=[p, (1 - p) / 2, (1 - p) / 2]).astype("<u4") for k, (n, p) in enumerate([(200, 0.1), (157, 0.01), (90, 0.5), (40, 0.0), (64, 1.0), (8, 0.1), (0, 0.1)])}
    rows = [(name, k // 8, bytearray(ids[k : k + 8].tobytes())) for name, ids in files.items() for k in range(0, max(1, len(ids)), 8)]
    df = spark.createDataFrame(rows, "file string, block long, data binary").repartition(4)
    scanned = separators.scan_blocks(df, F.col("file"), F.col("block"), F.col("data"))
    got = separators.document_lengths(scanned).collect()
    for name, ids in files.items():
        assert sorted((r.start, r.n_tokens, r.ended) for r in got if r.file == name) == brute(ids.tolist()), name


def test_blocks_of_odd_rows(spark):
    rows = [("a", 0, None), ("a", 1, bytearray()), ("a", 2, bytearray(b"\2\0\0\0\1\0\0\0"))]
    df = spark.createDataFrame(rows, "file string, block long, data binary")
    got = separators.document_lengths(separators.scan_blocks(df, F.col("file"), F.col("block"), F.col("data"))).collect()
    assert [(r.start, r.n_tokens, r.ended) for r in got] == [(0, 2, True)]
    assert separators.document_lengths(separators.scan_blocks(df.limit(0), F.col("file"), F.col("block"), F.col("data"))).count() == 0
    with pytest.raises(Exception, match="within an id"):
        separators.scan_blocks(spark.createDataFrame([("a", 0, bytearray(b"\1\0"))], "file string, block long, data binary"), F.col("file"), F.col("block"), F.col("data")).collect()


def test_written_files_hold_every_text(spark, tmp_path, odd_documents, no_documents):
    path, folder = public_tokenizers.path(VOCABULARY), str(tmp_path / "tokens")
    library = Tokenizer.from_file(path)
    ids = lambda text: library.encode(text or "", add_special_tokens=False).ids
    odd_documents.repartition(3).write.parquet(str(tmp_path / "table"))
    df = spark.read.parquet(str(tmp_path / "table"))
    separators.write_token_files(df, F.col("text"), folder, path, file_bytes=40)
    found = {f.parent.name.removeprefix("file="): np.frombuffer(f.read_bytes(), "<u2").tolist() for f in sorted((tmp_path / "tokens").glob("file=*/part-*"))}
    files = list(found.values())
    # a file is at most as long as asked, or has one text
    assert len(files) > 3 and all(len(f) * 2 <= 40 or f.count(1) == 1 for f in files) and max(f.count(1) for f in files) > 1
    assert sum(files, []).count(1) == odd_documents.count() and sum(len(f) for f in files) == sum(len(ids(r.text)) + 1 for r in odd_documents.collect())
    # block boundaries fall within documents, and between the bytes that a block has
    blocks = separators.token_blocks(spark, folder, block_tokens=5)
    assert {r.file for r in blocks.select("file").distinct().collect()} == set(found)
    lengths = separators.document_lengths(separators.scan_blocks(blocks, F.col("file"), F.col("block"), F.col("data"), width=2))
    by_file = sorted(sorted((r.start, r.n_tokens, r.ended) for r in lengths.collect() if r.file == name) for name in {r.file for r in lengths.select("file").distinct().collect()})
    assert by_file == sorted(brute(f) for f in files if f)
    got = separators.counted_texts(separators.placed_texts(df, F.struct("doc_id", "text")), lengths).collect()
    assert sorted((str(r.key.doc_id), r.n_tokens, r.ended) for r in got) == sorted((str(r.doc_id), len(ids(r.text)), True) for r in odd_documents.collect())
    with pytest.raises(Exception, match="differ in task"):
        separators.counted_texts(separators.placed_texts(df.limit(4), F.col("doc_id")), lengths).collect()
    separators.write_token_files(no_documents, F.col("text"), str(tmp_path / "none"), path)
    assert separators.token_blocks(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("group", [2, 4096])
def test_a_file_without_a_name_keeps_its_texts(spark, monkeypatch, group):
    monkeypatch.setattr(separators, "GROUP_BLOCKS", group)
    rng = np.random.default_rng(1)
    ids = rng.choice([1, 2, 3], 150, p=[0.1, 0.5, 0.4]).astype("<u4")
    rows = [(name, k // 16, bytearray(ids[k : k + 16].tobytes())) for name in ("a", None, "b") for k in range(0, 150, 16)]
    df = spark.createDataFrame(rows, "file string, block long, data binary").repartition(4)
    got = separators.document_lengths(separators.scan_blocks(df, F.col("file"), F.col("block"), F.col("data"))).collect()
    for name in ("a", None, "b"):
        assert sorted((r.start, r.n_tokens, r.ended) for r in got if r.file == name) == brute(ids.tolist())
    uncut = separators.document_lengths(separators.scan_blocks(df, F.col("file"), F.col("block"), F.col("data"), separator=0)).collect()
    assert sorted((r.file or "", r.start, r.n_tokens, r.ended) for r in uncut) == [("", 0, 150, False), ("a", 0, 150, False), ("b", 0, 150, False)]
