import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meterglass.llm import bpe, packing

PATH = public_tokenizers.path(bpe.VOCABULARY)
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = bpe.Encoder(PATH)
#: Halves of a few bytes and windows of a token, so that joins are many and must grow.
SMALL = bpe.Encoder(PATH, leaf_bytes=3, window=1)


def ids(text: str) -> list[int]:
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab eTh'sl1é\n\t\xa0漢🙂$-_<|endoftext>\x85\x1c　​")), max_size=60))
def test_any_text_is_encoded_and_decoded_as_by_the_library(text):
    for encoder in (ENCODER, SMALL):
        got = encoder.encode_all(pa.array([text]))[0].tolist()
        assert got == ids(text)
        assert encoder.decode(got) == LIBRARY.decode(got, skip_special_tokens=False)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["the", "ing", "tion", "a", "zq", "==", "é", "漢"]), min_size=50, max_size=400))
def test_long_unsplit_text(parts):
    text = "".join(parts)
    assert ENCODER.tree(text.encode()) == SMALL.tree(text.encode()) if text.isalpha() else True
    assert SMALL.encode_all(pa.array([text]))[0].tolist() == ids(text)


@pytest.mark.parametrize("text", ["a" * 5000, " " * 3000 + "x", "ab" * 2000, "=-" * 2000, "\n" * 999, "the end<|endoftext|>the<|endoftext|>", "one two\nthree four."])
def test_runs(text):
    assert ENCODER.encode_all(pa.array([text, None, text]))[2].tolist() == ids(text)
    assert SMALL.encode_all(pa.array([text]))[0].tolist() == ids(text)


def test_a_small_cache_changes_nothing():
    texts = [f"word{k} other{k % 7} and{k % 3}, more." for k in range(400)]
    encoder = bpe.Encoder(PATH, cache_words=5)
    assert [x.tolist() for x in encoder.encode_all(pa.array(texts))] == [ids(t) for t in texts]


def test_invalid_bytes_decode_as_in_the_library():
    some = [ENCODER.of_byte[0xFF], ENCODER.of_byte[0xE6], ENCODER.of_byte[65]]
    assert ENCODER.decode(some) == LIBRARY.decode(some, skip_special_tokens=False)


def test_encode_and_decode_odd_documents(odd_documents, no_documents):
    encoded = bpe.encode_texts(odd_documents, F.col("text"), "doc_id", path=PATH)
    got = bpe.decode_ids(encoded, F.col("ids"), "doc_id", path=PATH).collect()
    for r, t in zip(got, odd_documents.collect(), strict=True):
        assert (r.doc_id, r.n_tokens, r.text) == (t.doc_id, len(ids(t.text or "")), t.text or "")
    assert bpe.encode_texts(no_documents, F.col("text"), "doc_id", path=PATH).count() == 0


def check_packing(pieces, documents, limit):
    """Every id in exactly one piece, sequences without gaps; the tokens in each sequence."""
    for key, numbers in documents.items():
        own = sorted((p.start, p.length, bytes(p.ids)) for p in pieces if p.doc_id == key)
        assert b"".join(x[2] for x in own) == numbers.tobytes()
        assert [x[0] for x in own] == np.concatenate([[0], np.cumsum([x[1] for x in own])[:-1]]).astype(int).tolist()
    sums = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == sums.get(p.sequence_id, 0)
        sums[p.sequence_id] = p.offset + p.length
    assert max(sums.values()) <= limit
    return sums


def test_packing_meets_all_limits_and_leaves_little(spark):
    rng = np.random.default_rng(1)
    documents = {k: rng.integers(0, 50_000, n).astype("<u4") for k, n in enumerate(rng.integers(1, 900, 120))}
    df = spark.createDataFrame([(k, bytearray(v.tobytes())) for k, v in documents.items()], "doc_id long, ids binary").coalesce(1)
    pieces = packing.pack(df, F.col("ids"), "doc_id", max_tokens=256, max_segments=6, max_loss=256).collect()
    sums = check_packing(pieces, documents, 256)
    assert sum(sums.values()) > 0.99 * 256 * (len(sums) - 1)
    segments = {}
    for p in pieces:
        segments[p.sequence_id] = segments.get(p.sequence_id, 0) + 1
    assert max(segments.values()) <= 6


def test_loss_limit(spark):
    documents = {k: np.full(40, k, "<u4") for k in range(50)}
    masks = {k: np.array([0] * 20 + [1] * 20 if k % 2 else [1] * 40, np.uint8) for k in documents}
    df = spark.createDataFrame([(k, bytearray(documents[k].tobytes()), bytearray(masks[k].tobytes())) for k in documents], "doc_id long, ids binary, loss binary").coalesce(1)
    pieces = packing.pack(df, F.col("ids"), "doc_id", loss=F.col("loss"), max_tokens=128, max_segments=8, max_loss=64).collect()
    check_packing(pieces, documents, 128)
    loss = {}
    for p in pieces:
        loss[p.sequence_id] = loss.get(p.sequence_id, 0) + int(masks[p.doc_id][p.start : p.start + p.length].sum())
    assert max(loss.values()) <= 64


def test_many_tiny_documents_meet_the_segment_limit(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit(bytearray(b"\1\0\0\0")).alias("ids")).coalesce(1)
    pieces = packing.pack(df, F.col("ids"), "doc_id", max_tokens=64, max_segments=10).collect()
    assert len(pieces) == 1000 and len({p.sequence_id for p in pieces}) == 100


def test_pack_odd_documents(odd_documents, no_documents):
    got = packing.digest(packing.pack_texts(odd_documents.repartition(3), F.col("text"), "doc_id", path=PATH)).collect()
    assert sum(r.length for r in got) == sum(len(ids(t.text or "")) + 1 for t in odd_documents.collect())
    empty = [r for r in got if r.doc_id == 2]
    assert [(r.start, r.length, r.ids_crc32, r.doc_tokens) for r in empty] == [(0, 1, zlib.crc32(b"\1\0\0\0"), 1)]
    assert packing.pack_texts(no_documents, F.col("text"), "doc_id", path=PATH).count() == 0


@pytest.mark.parametrize("run", [" ", "\n", " \n\t\u3000", "\u2003"])
@pytest.mark.parametrize("form", ["{}", "word {} word", "{}<|endoftext|>{}x", "a{}", "{}  (b", "x {}y{} "])
def test_very_long_white_space(run, form):
    text = form.replace("{}", run * (1_000_000 // len(run)))
    encoder = packing.library_encoder(PATH)
    assert encoder.ids(text).tolist() == ids(text)


def test_a_text_of_white_space_is_packed(spark):
    texts = [" " * 1_000_000, "word " + "\n" * 1_000_000 + " word", "short"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    pieces = packing.pack_texts(df, F.col("text"), "doc_id", path=PATH).collect()
    check_packing(pieces, {k: np.array([*ids(t), 1], "<u4") for k, t in enumerate(texts)}, packing.MAX_TOKENS)


def test_prompts_bear_no_loss_and_the_loss_limit_binds(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(80):
        question, answer = (" ".join(rng.choice(["one", "zwei", "été", "harbour", "🙂"], n)) for n in rng.integers(5, 60, 2))
        rows.append((k, question + " " + answer, len(question) + 1))
    df = spark.createDataFrame(rows, "doc_id long, text string, prompt int").coalesce(1)
    pieces = packing.pack_texts(df, F.col("text"), "doc_id", path=PATH, prompt=F.col("prompt"), max_tokens=256, max_segments=8, max_loss=100).collect()
    check_packing(pieces, {k: np.array([*ids(t), 1], "<u4") for k, t, _ in rows}, 256)
    masks = {}
    for k, text, before in rows:
        masks[k], at = [], 0
        for n in ids(text):
            masks[k].append(at >= len(text[:before].encode()))
            at += len(ENCODER.bytes_of[n])
        masks[k] = np.array([False, *masks[k][1:], True])
    loss = {}
    for p in pieces:
        loss[p.sequence_id] = loss.get(p.sequence_id, 0) + int(masks[p.doc_id][p.start : p.start + p.length].sum())
    tokens = {}
    for p in pieces:
        tokens[p.sequence_id] = tokens.get(p.sequence_id, 0) + p.length
    assert max(loss.values()) == 100 and sum(n == 100 and tokens[s] < 256 for s, n in loss.items()) > len(loss) / 4


@pytest.mark.parametrize("size", [100, 5_000, 20_000, 49_999, 50_000, 50_001])
def test_many_runs_of_white_space_are_quick(size):
    for unit in (" " * size + "x", "\n" * size + " x", ("\t " * size)[:size] + "x"):
        text = unit * (200_000 // len(unit) + 1)
        encoder = packing.library_encoder(PATH)
        encoder.ids("warm")
        start = time.perf_counter()
        got = encoder.ids(text)
        assert time.perf_counter() - start < 1
        assert got.tolist() == ids(text)


def test_a_very_long_document_is_packed_in_linear_time():
    many = np.arange(8_000_000, dtype="<u4")
    packer = packing.Packer(2048, 512, 2048)
    start = time.perf_counter()
    pieces = [p for sequence in [*packer.add("k", many, many % 3 > 0), *packer.rest()] for p in sequence]
    assert time.perf_counter() - start < 6
    assert (np.concatenate([p[2] for p in pieces]) == many).all()


def plain_packing(documents, limits, pool):
    """The same heuristic with lists: each document (ids, bears loss); the pieces (document, start, ids) of each sequence."""
    out, waiting, left = [], [], list(enumerate(documents))

    def size(piece):
        _, ids, mask, _ = piece
        return [len(ids), 1, sum(mask)]

    def fill():
        free, placed = list(limits), []
        while waiting and min(free) >= 0 and free[0] > 0 and free[1] > 0:
            sizes = [size(p) for p in waiting]
            weight = [free[d] / limits[d] * (sum(s[d] for s in sizes) / len(sizes)) / limits[d] / limits[d] for d in range(3)]
            gain = [sum(s[d] * weight[d] for d in range(3)) for s in sizes]
            fits = [k for k, s in enumerate(sizes) if all(s[d] <= free[d] for d in range(3))]
            at = max(fits or range(len(waiting)), key=lambda k: (round(gain[k], 9), -k))
            key, ids, mask, start = waiting[at]
            take = len(ids) if fits else max(t for t in range(min(len(ids), free[0]) + 1) if sum(mask[:t]) <= free[2])
            if not take:
                break
            placed.append((key, start, ids[:take]))
            free = [free[0] - take, free[1] - 1, free[2] - sum(mask[:take])]
            if take == len(ids):
                waiting[at] = waiting[-1]
                waiting.pop()
            else:
                waiting[at] = (key, ids[take:], mask[take:], start + take)
        out.append(placed)

    for key, (ids, mask) in left:
        if ids:
            waiting.append((key, ids, mask, 0))
            while len(waiting) > pool:
                fill()
    while waiting:
        fill()
    return out


def test_packing_equals_plain_loops():
    rng = np.random.default_rng(4)
    for _ in range(40):
        limits = [int(x) for x in (rng.integers(8, 64), rng.integers(1, 8), rng.integers(4, 64))]
        documents = [(list(map(int, rng.integers(0, 99, n))), [int(x) for x in rng.integers(0, 2, n)]) for n in rng.integers(0, 90, 40)]
        packer = packing.Packer(*limits, pool=7)
        got = []
        for key, (numbers, mask) in enumerate(documents):
            got += list(packer.add(key, np.array(numbers, "<u4"), np.array(mask, bool)))
        got += list(packer.rest())
        assert [[(k, s, list(map(int, part))) for k, s, part, _ in sequence] for sequence in got] == plain_packing(documents, limits, 7)
