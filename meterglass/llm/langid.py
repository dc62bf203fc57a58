"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent layers read the UTF-8 bytes of a window in both directions; a softmax over both states labels
every byte with language probabilities, and a document's probabilities are the mean over all its bytes. The network
is trained in numpy by backpropagation through time on windows of the whole texts of a bounded sample of labelled
documents, which tasks cut. A text is
cut in windows without gaps, so all of it counts however long it is, and windows of many texts step together.

A text that is null, empty or without a letter is `UND` with score 0. Without any labelled row every text is `UND`.
A score is the mean probability of the predicted language; ties go to the first language in order. Repeated rows give
repeated rows, and null ids stay null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterglass.llm.common import checkpointed, filter_batches, held_out, map_batches, table, text_chunks
from meterglass.llm.shingles import mix

UND = "und"
#: Labelled documents that the network is fitted on, at most; those with the least hash of their ids.
TRAIN_ROWS = 1500
#: Windows of these documents that reach the driver, at most, and their bytes. They may lie anywhere in a text.
TRAIN_WINDOWS, TRAIN_BYTES = 60_000, 64
UNITS = 12
STEPS, BATCH, RATE = 220, 256, 0.02
#: Bytes of a window, and windows that step together.
WINDOW, TOGETHER = 128, 2048
#: `keep_known` lets a document go whose score is not this share of the way from an even guess to certainty.
LEAST_SHARE = 1 / 15


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Gated:
    """One direction. Gates of all units are rows and windows are columns; `into` has a column of gate inputs per byte."""

    def __init__(self, units: int, rng: np.random.Generator) -> None:
        self.units = units
        self.into = rng.normal(0, 0.3, (3 * units, 256)).astype(np.float32)
        self.across = (rng.normal(0, 1, (3 * units, units)) / np.sqrt(units)).astype(np.float32)

    def run(self, codes: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States for codes[time, window]; with ``keep``, also what the way back needs."""
        u = self.units
        state = np.zeros((u, codes.shape[1]), np.float32)
        states = np.empty((len(codes), u, codes.shape[1]), np.float32)
        kept = []
        for t, row in enumerate(codes):
            fed = np.take(self.into, row, axis=1)
            past = self.across @ state
            gates = _sigmoid(fed[: 2 * u] + past[: 2 * u])
            hold, reset = gates[:u], gates[u:]
            fresh = np.tanh(fed[2 * u :] + reset * past[2 * u :])
            if keep:
                kept.append((state, gates, fresh, past[2 * u :]))
            state = fresh + hold * (state - fresh)
            states[t] = state
        return states, kept

    def back(self, codes: np.ndarray, kept: list, upper: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of `into` and `across` from those of the states."""
        u = self.units
        into, across = np.zeros_like(self.into), np.zeros_like(self.across)
        later = np.zeros_like(upper[0])
        for t in range(len(codes) - 1, -1, -1):
            before, gates, fresh, past = kept[t]
            hold, reset = gates[:u], gates[u:]
            slope = upper[t] + later
            d_fresh = slope * (1 - hold) * (1 - fresh * fresh)
            d_hold = slope * (before - fresh) * hold * (1 - hold)
            d_reset = d_fresh * past * reset * (1 - reset)
            d_fed = np.concatenate([d_hold, d_reset, d_fresh])
            d_past = np.concatenate([d_hold, d_reset, d_fresh * reset])
            np.add.at(into.T, codes[t], d_fed.T)
            across += d_past @ before.T
            later = slope * hold + self.across.T @ d_past
        return into, across


class Network:
    """Both directions and the softmax."""

    def __init__(self, languages: list[str], units: int = UNITS, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.ways = [Gated(units, rng), Gated(units, rng)]
        self.out = rng.normal(0, 0.2, (len(languages), 2 * units)).astype(np.float32)
        self.bias = np.zeros((len(languages), 1), np.float32)

    def labels(self, states: np.ndarray) -> np.ndarray:
        """Probabilities [time, language, window]."""
        x = self.out @ states + self.bias
        x -= x.max(axis=1, keepdims=True)
        np.exp(x, out=x)
        x /= x.sum(axis=1, keepdims=True)
        return x

    def states(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.ways[0].run(codes)[0], self.ways[1].run(codes[::-1])[0][::-1]], axis=1)

    def step(self, codes: np.ndarray, wanted: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over all positions, and the gradients in the order of `weights`."""
        ahead, kept_ahead = self.ways[0].run(codes, keep=True)
        behind, kept_behind = self.ways[1].run(codes[::-1], keep=True)
        states = np.concatenate([ahead, behind[::-1]], axis=1)
        found = self.labels(states)
        columns = np.arange(codes.shape[1])
        loss = -float(np.log(found[:, wanted, columns] + 1e-9).mean())
        found[:, wanted, columns] -= 1
        found /= codes.size
        out = np.einsum("tkn,tun->ku", found, states, optimize=True)
        upper = self.out.T @ found
        units = self.ways[0].units
        first = self.ways[0].back(codes, kept_ahead, upper[:, :units])
        second = self.ways[1].back(codes[::-1], kept_behind, upper[::-1, units:])
        return loss, [*first, *second, out, found.sum(axis=(0, 2))[:, None]]

    def weights(self) -> list[np.ndarray]:
        return [self.ways[0].into, self.ways[0].across, self.ways[1].into, self.ways[1].across, self.out, self.bias]

    def fit(self, windows: np.ndarray, wanted: np.ndarray, owners: np.ndarray | None = None, steps: int = STEPS, seed: int = 11) -> float:
        """Trains on windows[row, time] by Adam with clipped gradients; the last loss.

        A step draws documents, each as likely as any other, and of each one of its windows; ``owners`` is the document
        of each window, in rising order (by default every window is one of its own).
        """
        rng = np.random.default_rng(seed)
        first = np.arange(len(windows)) if owners is None else np.flatnonzero(np.diff(owners, prepend=owners[0] - 1))
        count = np.diff(first, append=len(windows))
        weights = self.weights()
        mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        loss = 0.0
        for n in range(1, steps + 1):
            drawn = rng.integers(0, len(first), BATCH)
            pick = first[drawn] + rng.integers(0, count[drawn])
            loss, slopes = self.step(np.ascontiguousarray(windows[pick].T), wanted[pick])
            size = np.sqrt(sum(float((g * g).sum()) for g in slopes))
            rate = RATE * min(1.0, 2 - 2 * n / (steps + 1))
            for w, g, m, s in zip(weights, slopes, mean, square, strict=True):
                g = g * min(1.0, 1 / (size + 1e-9))
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                w -= (rate * (m / (1 - 0.9**n)) / (np.sqrt(s / (1 - 0.99**n)) + 1e-6)).astype(np.float32)
        return loss

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities over all bytes of each text; zeros for an empty one."""
        counts = np.array([-(-len(t) // WINDOW) for t in texts])
        total = np.zeros((len(texts), len(self.languages)))
        if not counts.sum():
            return total
        flat = np.frombuffer(b"".join(t + b" " * (-len(t) % WINDOW) for t in texts), np.uint8).reshape(-1, WINDOW)
        owner = np.repeat(np.arange(len(texts)), counts)
        length = np.full(len(flat), WINDOW)
        sizes = np.array([len(t) for t in texts])
        last = np.cumsum(counts)[counts > 0] - 1
        length[last] = sizes[counts > 0] - (counts[counts > 0] - 1) * WINDOW
        for a in range(0, len(flat), TOGETHER):
            part = slice(a, a + TOGETHER)
            found = self.labels(self.states(np.ascontiguousarray(flat[part].T)))
            found *= (np.arange(WINDOW)[:, None] < length[part])[:, None, :]
            np.add.at(total, owner[part], found.sum(axis=0, dtype=np.float64).T)
        return total / np.maximum(sizes, 1)[:, None]


def training_documents(df: DataFrame, doc_id: Column, text: Column, lang: Column, rows: int = TRAIN_ROWS) -> DataFrame | None:
    """(doc_id, text, lang) of at most ``rows`` labelled documents that are not held out; None if there is none.

    Every language has an equal part of the rows, those with the least hash of their ids, so that rare ones are learned
    too, up to one language for each row. Rows whose id is null are left out; of several languages or texts of an id the least counts.
    """
    sample = df.select(doc_id.alias("doc_id"), F.coalesce(text.cast("string"), F.lit("")).alias("text"), lang.cast("string").alias("lang"))
    known = sample.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("lang").alias("lang"))
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(rows).collect()
    if not counts:
        return None
    each, spread = max(1, rows // len(counts)), 1 << 40
    # a threshold that about four times as many rows pass bounds what tasks send
    most = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], -(-spread * 4 * each // r["n"]))])
    near = known.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(spread))).where(F.col("h") < most[F.col("lang")])
    chosen: dict[str, list] = {}
    for r in near.orderBy("h", "doc_id").limit(8 * rows).collect():
        chosen.setdefault(r["lang"], []).append((r["doc_id"], r["lang"]))
    picked = df.sparkSession.createDataFrame([x for found in chosen.values() for x in found[:each]], known.schema)
    return checkpointed(sample.drop("lang").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "lang").agg(F.min("text").alias("text")))


def training_windows(documents: DataFrame, windows: int = TRAIN_WINDOWS) -> DataFrame:
    """(key, at, lang, bytes) of the windows of whole texts: all of them, or the ``windows`` with the least hash."""

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            owner, at, parts, hashes = [], [], [], []
            for k, (key, text) in enumerate(zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                raw = text.encode("utf-8", "surrogatepass")
                n = -(-len(raw) // TRAIN_BYTES)
                padded = raw.ljust(n * TRAIN_BYTES)
                owner += [k] * n
                at += range(n)
                parts += [padded[i * TRAIN_BYTES : (i + 1) * TRAIN_BYTES] for i in range(n)]
                hashes.append((mix(np.arange(n, dtype=np.uint64) + mix(np.array([key]).view(np.uint64))) >> np.uint64(24)).astype(np.int64))
            taken = batch.select(["key", "lang"]).take(pa.array(owner, pa.int64()))
            return pa.RecordBatch.from_arrays([*taken.columns, pa.array(at, pa.int64()), pa.array(parts, pa.binary()), pa.array(np.concatenate(hashes))], ["key", "lang", "at", "bytes", "h"])

        return apply

    total = documents.agg(F.sum(F.ceil(F.octet_length("text") / TRAIN_BYTES))).first()[0] or 0
    cut = map_batches(documents.select(F.xxhash64("doc_id").alias("key"), "lang", "text"), make, "key long, lang string, at long, bytes binary, h long")
    if total > windows:
        cut = cut.where(F.col("h") < -(-(1 << 40) * 2 * windows // total)).orderBy("h", "key", "at").limit(windows)
    return cut.drop("h")


def train(df: DataFrame, doc_id: Column, text: Column, lang: Column, rows: int = TRAIN_ROWS) -> Network | None:
    """A network fitted on windows of at most ``rows`` labelled documents that are not held out; None if there is none."""
    documents = training_documents(df, doc_id, text, lang, rows)
    known = sorted(training_windows(documents).collect(), key=lambda r: (r["key"], r["at"])) if documents is not None else []
    if not known:
        return None
    languages = sorted({r["lang"] for r in known})
    network = Network(languages)
    owners = np.unique([r["key"] for r in known], return_inverse=True)[1]
    network.fit(np.frombuffer(b"".join(r["bytes"] for r in known), np.uint8).reshape(-1, TRAIN_BYTES), np.array([languages.index(r["lang"]) for r in known]), owners)
    return network


def predictions(network: Network | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    names, scores = [], []
    for first, raw in text_chunks(texts):
        found = network.documents(raw) if network else np.zeros((len(raw), 1))
        for k, row in enumerate(found):
            text = texts[first + k]
            lettered = bool(network) and text is not None and any(map(str.isalpha, text))
            names.append(network.languages[int(row.argmax())] if lettered else UND)
            scores.append(min(1.0, float(row.max())) if lettered else 0.0)
    return names, scores


def identify(df: DataFrame, text: Column, network: Network | None, *keys: str) -> DataFrame:
    """Columns ``keys``, ``lang_pred`` and ``score`` for every row."""
    source = df.select(F.struct(*[df[f"`{k}`"] for k in keys]).alias("keys"), text.cast("string").alias("text"))

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            names, scores = predictions(network, batch.column("text").to_pylist())
            return pa.RecordBatch.from_arrays([batch.column("keys"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["keys", "lang_pred", "score"])

        return apply

    return map_batches(source, make, f"keys {source.schema['keys'].dataType.simpleString()}, lang_pred string, score double").select("keys.*", "lang_pred", "score")


def least_score(network: Network, share: float = LEAST_SHARE) -> float:
    """The score that `keep_known` asks for, by the number of languages that the network tells apart."""
    even = 1 / len(network.languages)
    return even + share * (1 - even) if len(network.languages) > 1 else 0.0


def keep_known(df: DataFrame, text: Column, network: Network | None, share: float = LEAST_SHARE) -> DataFrame:
    """The rows of ``df`` whose text has a letter and a language with at least `least_score`.

    Without a network nothing is known of languages, and all texts with a letter stay.
    """
    least = least_score(network, share) if network else 0.0

    def make():
        def judge(batch: pa.RecordBatch) -> list[bool]:
            texts = batch.column("text").to_pylist()
            if network is None:
                return [text is not None and any(map(str.isalpha, text)) for text in texts]
            names, scores = predictions(network, texts)
            return [n != UND and s >= least for n, s in zip(names, scores, strict=True)]

        return judge

    return filter_batches(df, {"text": text.cast("string")}, make)


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    network = train(docs, F.col("doc_id"), F.col("text"), F.col("lang"))
    found = identify(docs.select("doc_id", "text"), F.col("text"), network, "doc_id")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
