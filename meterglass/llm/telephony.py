"""Telephony audio columns: G.711 and IMA ADPCM in WAV containers, decoded with numpy and stored as resampled PCM.

A row's bytes are stored without loss as the 8-bit samples of a WAV file (`store_audio`). `decode_audio` parses the
stored file again and expands the samples: mu-law and A-law by 256-entry tables, ADPCM by stepping through the
nibbles of all blocks of a batch at once. The linear samples are resampled from 8 to 16 kHz.

Null bytes or text count as empty; a payload is padded with spaces to a positive multiple of `BLOCK`, so the empty
one is 192 spaces. Equal payloads give equal files and features. A null id stays null; repeated rows give repeated
rows; a stored file that is null or not such a WAV file gives null features.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterglass.llm.common import map_batches, table

BLOCK = 192
RATE = 8000
#: WAV format tags.
TAGS = {"alaw": 6, "mulaw": 7, "adpcm": 17, "pcm": 1}
#: Bytes of payload that are decoded at a time; a longer one is decoded alone.
DECODE_BYTES = 1_500_000

# The step sizes and index changes of IMA ADPCM.
STEPS = [
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
    7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
]
INDEX_CHANGES = [-1, -1, -1, -1, 2, 4, 6, 8]


def mulaw_table() -> np.ndarray:
    """The linear sample of each mu-law byte."""
    code = ~np.arange(256) & 0xFF
    size = ((((code & 0x0F) << 3) + 0x84) << ((code & 0x70) >> 4)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """The linear sample of each A-law byte."""
    code = np.arange(256) ^ 0x55
    part, segment = (code & 0x0F) << 4, (code & 0x70) >> 4
    size = np.where(segment == 0, part + 8, (part + 0x108) << np.maximum(segment - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


def adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """For state 16 * index + nibble: the change of the sample, and 16 * the next index."""
    index, nibble = np.divmod(np.arange(len(STEPS) * 16), 16)
    step = np.array(STEPS)[index]
    change = (step >> 3) + np.where(nibble & 4, step, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 1, step >> 2, 0)
    after = np.clip(index + np.array(INDEX_CHANGES)[nibble & 7], 0, len(STEPS) - 1)
    return np.where(nibble & 8, -change, change).astype(np.int32), (after * 16).astype(np.int16)


MULAW, ALAW = mulaw_table(), alaw_table()
ADPCM_CHANGE, ADPCM_NEXT = adpcm_tables()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples of mono IMA ADPCM blocks (one a row: sample, index, reserved, nibbles low first); all blocks advance together."""
    sample = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    state = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int16) * np.int16(16)
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((1 + 2 * len(codes), len(blocks)), np.int16)
    out[0] = sample
    for k, code in enumerate(codes):
        for half, nibble in enumerate((code & 15, code >> 4)):
            state += nibble
            sample += ADPCM_CHANGE[state]
            np.clip(sample, -32768, 32767, out=sample)
            out[1 + 2 * k + half] = sample
            state = ADPCM_NEXT[state]
    return np.ascontiguousarray(out.T)


def upsample(samples: np.ndarray) -> np.ndarray:
    """Twice the rate: samples of `samples` in between come from a symmetric 4-tap filter, with its edges repeated."""
    x = samples.astype(np.int32)
    padded = np.concatenate([x[:1], x, x[-1:], x[-1:]])
    middle = (9 * (padded[1:-2] + padded[2:-1]) - padded[:-3] - padded[3:] + 8) >> 4
    out = np.empty(2 * len(x), np.int16)
    out[0::2] = x
    out[1::2] = np.clip(middle, -32768, 32767)
    return out


def write_wav(payload: bytes, codec: str, rate: int = RATE) -> bytes:
    """A mono WAV file whose data chunk is ``payload``."""
    align, bits = {"adpcm": (BLOCK, 4), "pcm": (2, 16)}.get(codec, (1, 8))
    count = len(payload) // BLOCK * (1 + 2 * (BLOCK - 4)) if codec == "adpcm" else len(payload) // align
    extra = struct.pack("<H", 1 + 2 * (BLOCK - 4)) if codec == "adpcm" else b""
    speed = rate * BLOCK // (1 + 2 * (BLOCK - 4)) if codec == "adpcm" else rate * align
    form = struct.pack("<HHIIHHH", TAGS[codec], 1, rate, speed, align, bits, len(extra)) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, count) + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes | None) -> tuple[str, bytes] | None:
    """(codec, payload) of a WAV file; None if it is none."""
    if not media or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, tag = 12, None
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            tag = struct.unpack_from("<H", media, at + 8)[0]
        if name == b"data":
            codec = next((k for k, v in TAGS.items() if v == tag), None)
            return (codec, media[at + 8 : at + 8 + size]) if codec else None
        at += 8 + size + size % 2
    return None


def padded(raw: bytes) -> bytes:
    """``raw`` with spaces up to a positive multiple of `BLOCK`."""
    return raw + b" " * (-len(raw) % BLOCK if raw else BLOCK)


def store_audio(df: DataFrame, data: Column, *keys: str, codec: str = "mulaw") -> DataFrame:
    """Columns ``keys``, ``n_bytes`` and ``media``: the bytes (or UTF-8 text) of ``data`` as the samples of a WAV file."""
    keep = [df[f"`{k}`"] for k in keys]
    source = df.select(F.struct(*keep).alias("keys"), F.coalesce(data.cast("binary"), F.lit(b"")).alias("raw"))

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            raw = batch.column("raw").to_pylist()
            media = pa.array([write_wav(padded(x), codec) for x in raw], pa.binary())
            return pa.RecordBatch.from_arrays([batch.column("keys"), pa.array([len(x) for x in raw], pa.int64()), media], ["keys", "n_bytes", "media"])

        return apply

    return map_batches(source, make, f"keys {source.schema['keys'].dataType.simpleString()}, n_bytes long, media binary").select("keys.*", "n_bytes", "media")


def _measures(samples: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Energy, peak and sign changes of each run of samples, as exact integers."""
    wide = samples.astype(np.int64)
    turns = np.empty(len(wide), np.int64)
    turns[0], turns[1:] = 0, (samples[1:] < 0) != (samples[:-1] < 0)
    turns[starts] = 0
    return np.stack([np.add.reduceat(wide * wide, starts), np.maximum.reduceat(np.abs(wide), starts), np.add.reduceat(turns, starts)])


def features(payloads: list[bytes]) -> tuple[list[str], list[bytes]]:
    """For each payload a digest of its three decodings, and the mu-law samples at 16 kHz as little-endian 16-bit PCM."""
    sizes = np.array([len(x) for x in payloads])
    flat = np.frombuffer(b"".join(payloads), np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    linear = MULAW[flat]
    adpcm = decode_adpcm(flat.reshape(-1, BLOCK))
    found = np.concatenate([_measures(linear, starts), _measures(ALAW[flat], starts), _measures(adpcm.reshape(-1), starts // BLOCK * adpcm.shape[1])])
    pcm = [upsample(linear[a : a + n]).astype("<i2").tobytes() for a, n in zip(starts, sizes, strict=True)]
    said = ["mulaw:{}/{}/{} alaw:{}/{}/{} adpcm:{}/{}/{}".format(*row) + f" pcm16k:{zlib.crc32(x):08x}" for row, x in zip(found.T.tolist(), pcm, strict=True)]
    return said, pcm


def decode_audio(df: DataFrame, media: Column, *keys: str, keep_pcm: bool = True) -> DataFrame:
    """Reads stored files back: ``keys``, payload digests, file digests, ``feature``, and ``pcm``, a WAV file at 16 kHz.

    Without ``keep_pcm`` the resampled samples only enter ``feature``.
    """
    keep = [df[f"`{k}`"] for k in keys]
    source = df.select(F.struct(*keep).alias("keys"), media.alias("media"))

    def one_run(files: list[bytes | None]) -> list[tuple]:
        parsed = [read_wav(x) for x in files]
        read = [(k, p[1]) for k, p in enumerate(parsed) if p and p[1] and len(p[1]) % BLOCK == 0]
        said, pcm = features([p for _, p in read]) if read else ([], [])
        rows: list[tuple] = [(None,) * 7] * len(files)
        for (k, payload), text, samples in zip(read, said, pcm, strict=True):
            whole = files[k]
            rows[k] = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(whole), hashlib.sha256(whole).hexdigest(), text, write_wav(samples, "pcm", 2 * RATE) if keep_pcm else None)
        return rows

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, held, size = [], [], 0
            for x in batch.column("media").to_pylist():
                if held and size + len(x or b"") > DECODE_BYTES:
                    rows += one_run(held)
                    held, size = [], 0
                held.append(x)
                size += len(x or b"")
            columns = list(zip(*(rows + one_run(held)), strict=True))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm"]
            return pa.RecordBatch.from_arrays([batch.column("keys"), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], ["keys", *names])

        return apply

    schema = f"keys {source.schema['keys'].dataType.simpleString()}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm binary"
    out = map_batches(source, make, schema)
    return out.select("keys.*", *out.columns[1:] if keep_pcm else out.columns[1:-1])


def op2_telephony_audio(spark, sf_dir: str) -> DataFrame:
    """Every document's bytes stored as mu-law WAV files, read back, decoded and stored as resampled PCM (``pcm``)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = store_audio(docs, F.col("text"), "doc_id", codec="mulaw")
    return decode_audio(stored, F.col("media"), "doc_id", "n_bytes")
