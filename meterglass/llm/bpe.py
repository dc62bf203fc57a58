"""Byte-level BPE encoding and decoding, with tree concatenation for long unsplit text.

A text is cut at special tokens and then into pieces by the tokenizer's pattern. Short pieces are merged directly and
remembered. A long piece (no white space, or a run of it) is halved until its leaves are short; the leaves are
encoded independently of each other, and each join re-encodes a window around the cut that doubles until its first
and last tokens are those that the halves have there. Neighbours inside the window then stem from one encoding, those
at its edges from the encoding of a half, so the joined tokens are exactly those of the whole.

Null text counts as empty and has no tokens. Nothing is truncated: memory per task is a batch of texts and a cache
of bounded size. Equal texts give equal ids; repeated rows give repeated rows.
"""

from __future__ import annotations

import functools
import hashlib
import json

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterglass.llm.common import map_batches, table

VOCABULARY = "byte_bpe_50k.json"
#: Pieces up to so many bytes are leaves, solved directly; those of longer ones are joined in pairs.
LEAF_BYTES = 48
#: Tokens on each side of a join that are encoded again first.
FIRST_WINDOW = 4
#: Signs that are neither letter, number nor white space.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Texts that are encoded at once.
TEXTS_AT_ONCE = 512
#: Bytes of text whose words are looked up together.
RUN_BYTES = 2_000_000
#: Words that a worker remembers since it last forgot some, and as many from before that.
CACHE_WORDS = 200_000

# The splitting pattern of the vocabulary, with Unicode's white space spelled out.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable bytes for themselves, others from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}


class _Words(dict):
    """Token ids, as little-endian bytes, of words. One that begins with a line break follows it, others follow a space."""

    def __init__(self, encoder: Encoder) -> None:
        self.encoder = encoder
        self.older: dict[str, bytes] = {}

    def age(self) -> None:
        """Words that nobody asks for again before the next time are forgotten."""
        self.older = dict(self)
        self.clear()

    def __missing__(self, word: str) -> bytes:
        encoder = self.encoder
        if (ids := self.older.get(word)) is not None:
            pass
        elif word[0] == "\n":
            ids = encoder.line_break + encoder.pieces(word[1:])
        elif (core := word.rstrip(MARKS)) != word and core.isalpha():
            ids = self[core] + encoder.marks[word[len(core) :]]
        else:
            ids = encoder.pieces(" " + word)
        self[word] = ids
        return ids


class _Marks(dict):
    """Token ids of runs of `MARKS`, each a piece of its own after letters."""

    def __init__(self, encoder: Encoder) -> None:
        self.encoder = encoder

    def __missing__(self, marks: str) -> bytes:
        self[marks] = ids = np.array(self.encoder.tree(marks.encode()), "<u4").tobytes()
        return ids


class Encoder:
    """Encodes and decodes as the vocabulary's library does, without truncation and padding."""

    def __init__(self, path: str, leaf_bytes: int = LEAF_BYTES, window: int = FIRST_WINDOW, cache_words: int = CACHE_WORDS) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        vocabulary = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.bytes_of: list[bytes] = [b""] * (1 + max([*vocabulary.values(), *self.special.values()]))
        for token, n in vocabulary.items():
            self.bytes_of[n] = bytes(letters[c] for c in token)
        for token, n in self.special.items():
            self.bytes_of[n] = token.encode()
        self.decimal = [b"%d" % n for n in range(len(self.bytes_of))]
        self.of_byte = [0] * 256
        for n, token in enumerate(self.bytes_of):
            if len(token) == 1:
                self.of_byte[token[0]] = n
        # pair of ids -> (rank << 20 | merged id), so that the least value is the next merge
        self.merge: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merge[vocabulary[left] << 20 | vocabulary[right]] = rank << 20 | vocabulary[left + right]
        self.pattern = regex.compile(PATTERN)
        self.leaf_bytes, self.window, self.cache_words = leaf_bytes, window, cache_words
        self.id_of = {token: n for n, token in enumerate(self.bytes_of) if token and n not in set(self.special.values())}
        self.longest = max(map(len, self.id_of))
        self.prefixes = ahocorasick.Automaton()
        for token in self.id_of:
            self.prefixes.add_word(token.decode("latin-1"), 1)
        self.agree: dict[int, bool] = {}
        self.words, self.marks = _Words(self), _Marks(self)
        self.line_break = np.array([self.of_byte[10]], "<u4").tobytes()
        unusual = ["[\\x85\\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]", "^[ \\n]", "[ \\n]$", "[ \\n][ \\n]", "^$"]
        self.unusual = "|".join([*unusual, "[\\t\\r\\f\\v]", *map(regex.escape, self.special)])

    def merged(self, raw: bytes) -> list[int]:
        """The tokens of a short piece: the pair of least rank merges, leftmost first, until none can."""
        ids = [self.of_byte[b] for b in raw]
        merge, none = self.merge, 1 << 60
        ranks = [merge.get(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == none:
                break
            at = ranks.index(least)
            ids[at : at + 2] = [least & 0xFFFFF]
            del ranks[at]
            if at:
                ranks[at - 1] = merge.get(ids[at - 1] << 20 | ids[at], none)
            if at < len(ranks):
                ranks[at] = merge.get(ids[at] << 20 | ids[at + 1], none)
        return ids

    def fits(self, a: int, b: int) -> bool:
        """Whether the two tokens stay as they are when their bytes are encoded together."""
        key = a << 20 | b
        known = self.agree.get(key)
        if known is None:
            if len(self.agree) >= self.cache_words:
                self.agree.clear()
            known = self.agree[key] = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def short(self, raw: bytes) -> list[int]:
        """The tokens of a piece, by the rule that a sequence in which all neighbours fit is the encoding.

        The longest token that fits its neighbour is tried first; a dead end goes back one token. What fits up to a place
        is the only encoding up to there, so no place is left twice and the work grows with the length.
        """
        get, reach, size, agree, longest = self.id_of.get, self.prefixes.longest_prefix, len(raw), self.agree, self.longest
        letters = raw.decode("latin-1")
        ids: list[int] = []
        ends: list[int] = []
        dead: set[int] = set()
        at, end = 0, reach(letters[:longest])
        while at < size:
            while end > at:
                n = get(raw[at:end])
                if n is not None and end not in dead:
                    if not ids:
                        break
                    fits = agree.get(ids[-1] << 20 | n)
                    if self.fits(ids[-1], n) if fits is None else fits:
                        break
                end -= 1
            if end > at:
                ids.append(n)
                ends.append(end)
                at = end
                end = at + reach(letters[at : at + longest])
            else:
                dead.add(at)
                ids.pop()
                end = ends.pop() - 1
                at = ends[-1] if ends else 0
        return ids

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The tokens of two neighbouring texts together, from the tokens of each."""
        size = self.window
        while True:
            a, b = max(0, len(left) - size), min(len(right), size)
            inner = self.short(b"".join([self.bytes_of[n] for n in left[a:] + right[:b]]))
            if (a == 0 or inner[0] == left[a]) and (b == len(right) or inner[-1] == right[b - 1]):
                return left[:a] + inner + right[b:]
            size *= 2

    def tree(self, raw: bytes) -> list[int]:
        """The tokens of a piece of any length."""
        # bottom up: all leaves, and then all joins of a level, are independent of each other
        level = [self.short(raw[k : k + self.leaf_bytes]) for k in range(0, len(raw), self.leaf_bytes)]
        while len(level) > 1:
            level = [self.joined(*level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
        return level[0] if level else []

    def pieces(self, text: str) -> bytes:
        """Ids of text without special tokens."""
        if text[text[:1] == " " :].isalpha():
            return np.array(self.tree(text.encode("utf-8")), "<u4").tobytes()
        ids: list[int] = []
        for piece in self.pattern.findall(text):
            ids += self.tree(piece.encode("utf-8"))
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """The token ids of a whole text, as little-endian bytes."""
        if not text:
            return b""
        if self.cut is None:
            return self.pieces(text)
        out, at = [], 0
        for found in self.cut.finditer(text):
            out += [self.pieces(text[at : found.start()]), np.array([self.special[found[0]]], "<u4").tobytes()]
            at = found.end()
        return b"".join([*out, self.pieces(text[at:])])

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """The token ids of each text.

        Where white space is only single spaces and line breaks between words, a word with what stands before it can
        be encoded by itself, so each different word of a run of texts is looked up once and its ids are gathered.
        In other texts the pattern runs over the whole.
        """
        texts = pc.fill_null(texts, "")
        special = pc.match_substring_regex(texts, self.unusual).to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = [np.frombuffer(self.encode(texts[k].as_py()), "<u4") if s else None for k, s in enumerate(special)]
        usual = np.flatnonzero(~special)
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)[usual]
        runs = np.cumsum(sizes) // RUN_BYTES
        for run in np.split(usual, np.flatnonzero(np.diff(runs)) + 1):
            if len(run):
                for k, ids in zip(run, self._gathered(texts.take(pa.array(run))), strict=True):
                    out[k] = ids
        return out

    def _gathered(self, texts: pa.Array) -> list[np.ndarray]:
        if len(self.words) > self.cache_words:
            self.words.age()
            self.marks.clear()
        marked = pc.binary_join_element_wise("\n", pc.replace_substring(texts, "\n", " \n"), "")
        split = pc.split_pattern(marked, " ")
        coded = split.flatten().dictionary_encode()
        known = list(map(self.words.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False).tolist()))
        ids = np.frombuffer(b"".join(known), "<u4")
        length = np.fromiter(map(len, known), np.int64, len(known)) // 4
        first = np.cumsum(length) - length
        words = coded.indices.to_numpy()
        counts = length[words]
        ends = np.cumsum(counts)
        flat = ids[np.repeat(first[words] - (ends - counts), counts) + np.arange(ends[-1])]
        bounds = np.concatenate([[0], ends])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        # the line break that was put before each text goes
        return [flat[a + 1 : b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def decode(self, ids: list[int]) -> str:
        """The text of token ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@functools.cache
def shared_encoder(path: str) -> Encoder:
    """The encoder of a Python worker, which its tasks use one after another."""
    return Encoder(path)


def encode_texts(df: DataFrame, text: Column, *keys: str, path: str) -> DataFrame:
    """Columns ``keys`` and ``ids``: the token ids as little-endian unsigned 32-bit integers."""
    source = df.select(F.struct(*[df[f"`{k}`"] for k in keys]).alias("keys"), text.cast("string").alias("text"))

    def make():
        encoder = shared_encoder(path)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            parts = []
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                parts.append(pa.array([x.tobytes() for x in encoder.encode_all(batch.column("text").slice(at, TEXTS_AT_ONCE))], pa.binary()))
            return pa.RecordBatch.from_arrays([batch.column("keys"), pa.concat_arrays(parts)], ["keys", "ids"])

        return apply

    return map_batches(source, make, f"keys {source.schema['keys'].dataType.simpleString()}, ids binary").select("keys.*", "ids")


def decode_ids(df: DataFrame, ids: Column, *keys: str, path: str) -> DataFrame:
    """Columns ``keys``, ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by commas) and the decoded ``text``."""
    source = df.select(F.struct(*[df[f"`{k}`"] for k in keys]).alias("keys"), ids.alias("ids"))

    def make():
        encoder = shared_encoder(path)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, digests, texts = [], [], []
            for raw in batch.column("ids").to_pylist():
                numbers = np.frombuffer(raw or b"", "<u4").tolist()
                counts.append(len(numbers))
                digests.append(hashlib.sha256(b",".join(map(encoder.decimal.__getitem__, numbers))).hexdigest())
                texts.append(encoder.decode(numbers))
            return pa.RecordBatch.from_arrays([batch.column("keys"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())], ["keys", "n_tokens", "ids_sha256", "text"])

        return apply

    return map_batches(source, make, f"keys {source.schema['keys'].dataType.simpleString()}, n_tokens long, ids_sha256 string, text string").select("keys.*", "n_tokens", "ids_sha256", "text")


def op9_bpe_tree(spark, sf_dir: str) -> DataFrame:
    """Every document encoded, and decoded again from its ids."""
    path = public_tokenizers.path(VOCABULARY)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = encode_texts(docs, F.col("text"), "doc_id", path=path)
    decoded = decode_ids(encoded, F.col("ids"), "doc_id", path=path)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
