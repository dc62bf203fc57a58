"""Runs: maximal stretches of words with a period, by Lyndon roots.

Phase one of a grouping suffix sorter puts the suffixes of a sequence into groups by their longest Lyndon prefix. Groups
are worked off from the greatest to the least: the suffixes of a group are done, and the nearest suffix before each that
is not done yet has its prefix prolonged by theirs, so it moves to a group of its own above its old one. When it ends,
the prefixes' lengths are the Lyndon array, without any sorting of suffixes. Done under the order of the words and under
the reversed one, it gives a Lyndon root of every run, as each run has one that is the longest Lyndon word at its place
under one of the two. Each root is extended to both sides by longest common extensions, which compare exact names of
stretches of powers of two.

Only runs of at least three periods and 24 words are asked for, and this is used before phase one, without loss: every 9
words in a row within such a run occur in it a second time. Words that are in no such repeated nine are cut out, again
and again until nothing goes; each run lies whole in what stays between the cuts. Prose loses nearly all, and phase one
works on what can hold a run, in time and memory that grow with its length and its logarithm.

Each row is worked off by itself in the task that reads it, without shuffle, in batches of bounded bytes; a very long
text is one row (about 200 bytes for each word while it is split, and 4 times log2 n bytes for each word of a repeating
stretch). Null and empty texts have no words, no run and an empty collapsed text. Repeated rows give repeated rows, an
empty table none. Keys travel in a struct, so no name can clash. Words that are equal are one symbol; runs of the same
place and length differ in period, and ties of exponents go to the least start, then period.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterglass.llm.common import map_batches, table

#: A run has at least so many words and so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: With L words and period q, every so many words in a row within a run occur in it again, as L - GRAM + 1 >= 2 * q.
GRAM = LEAST_WORDS - 2 * (LEAST_WORDS // LEAST_PERIODS) + 1
SPACES = r"[\x20\x09-\x0D]+"

_STEP = np.uint64(0xD1342543DE82EF95)


def repeated_grams(ids: np.ndarray) -> np.ndarray:
    """Whether the `GRAM` words from each place on occur a second time; now and then wrongly true, which costs time only."""
    n = len(ids) - GRAM + 1
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    value = np.zeros(n, np.uint64)
    for k in range(GRAM):
        value = value * _STEP + mixed[k : k + n]
    order = np.argsort(value, kind="stable")
    same = value[order[1:]] == value[order[:-1]]
    out = np.zeros(n, bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def stretches(ids: np.ndarray, first: int = 0) -> list[tuple[int, int]]:
    """The parts (start, end) of a sequence that may hold a run, each run whole in one; the rest holds none."""
    out: list[tuple[int, int]] = []
    waiting = [(first, first + len(ids))]
    while waiting:
        start, end = waiting.pop()
        if end - start < LEAST_WORDS:
            continue
        seen = repeated_grams(ids[start - first : end - first])
        edges = np.flatnonzero(np.diff(np.concatenate([[False], seen, [False]]).astype(np.int8)))
        parts = [(start + int(a), start + int(b) + GRAM - 1) for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a > LEAST_WORDS - GRAM]
        if parts == [(start, end)]:
            out.append((start, end))
        else:
            waiting += parts
    return sorted(out)


def lyndon_lengths(word: list[int]) -> list[int]:
    """The length of the longest Lyndon word that begins at each place, by the first phase of a grouping suffix sorter."""
    n = len(word)
    places: dict[int, list[int]] = {}
    for k, symbol in enumerate(word):
        places.setdefault(symbol, []).append(k)
    symbols = sorted(places)
    members = [places[s] for s in symbols]
    length = [1] * len(symbols)
    lower = list(range(-1, len(symbols) - 1))
    upper = [*range(1, len(symbols)), -1]
    rank = {s: g for g, s in enumerate(symbols)}
    group = [rank[s] for s in word]
    done, back, out = bytearray(n), [0] * n, [0] * n
    top = len(symbols) - 1
    while top >= 0:
        size, counts = length[top], {}
        for s in members[top]:
            if group[s] != top:  # has moved on
                continue
            p = s - 1
            while p >= 0 and done[p]:
                q = back[p]
                if q >= 0 and done[q]:
                    q = back[p] = back[q]
                p = q
            done[s], back[s], out[s] = 1, p, size
            if p >= 0:
                counts[p] = counts.get(p, 0) + 1
        split: dict[tuple[int, int], list[int]] = {}
        for p, times in counts.items():
            split.setdefault((group[p], times), []).append(p)
        old, below = -1, -1
        for (g, times), moved in sorted(split.items()) if len(split) > 1 else split.items():
            if g != old:
                old = below = g
            new = len(members)
            members.append(moved)
            length.append(length[g] + times * size)
            above = upper[below]
            lower.append(below)
            upper.append(above)
            upper[below] = new
            if above >= 0:
                lower[above] = new
            for p in moved:
                group[p] = new
            below = new
        members[top] = []
        top = lower[top]
    return out


class Extensions:
    """Longest common extensions by exact names of all stretches of 1, 2, 4, ... symbols."""

    def __init__(self, ids: np.ndarray) -> None:
        self.n = len(ids)
        self.names = [np.unique(ids, return_inverse=True)[1].astype(np.int32)]
        step = 1
        while 2 * step <= self.n:
            a, b = self.names[-1][:-step].astype(np.int64), self.names[-1][step:].astype(np.int64)
            self.names.append(np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1].astype(np.int32))
            step *= 2

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols from a and from b on are the same; a < b."""
        found = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            names, step = self.names[k], 1 << k
            fits = np.flatnonzero(b + found + step <= self.n)
            same = fits[names[a[fits] + found[fits]] == names[b[fits] + found[fits]]]
            found[same] += step
        return found

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols before a and before b are the same; a < b."""
        found = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            names, step = self.names[k], 1 << k
            fits = np.flatnonzero(a - found - step >= 0)
            same = fits[names[a[fits] - found[fits] - step] == names[b[fits] - found[fits] - step]]
            found[same] += step
        return found


def runs_within(ids: np.ndarray) -> set[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence that are long enough: Lyndon roots of both orders, extended."""
    shared, found = Extensions(ids), set()
    for sign in (1, -1):
        root = np.array(lyndon_lengths((sign * ids).tolist()), np.int64)
        start = np.flatnonzero(np.arange(len(ids)) + root < len(ids))
        period = root[start]
        before, behind = shared.backward(start, start + period), shared.forward(start, start + period)
        length = before + period + behind
        fit = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
        found.update(zip((start - before)[fit].tolist(), length[fit].tolist(), period[fit].tolist(), strict=True))
    return found


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of at least 24 words and three periods, by start, then period."""
    found = [(start + s, length, period) for start, end in stretches(ids) for s, length, period in runs_within(ids[start:end])]
    return sorted(found, key=lambda r: (r[0], r[2]))


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each distinct word."""
    number: dict[bytes, int] = {}
    return np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run has behind its first period, joined by spaces."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    keep = np.cumsum(change[:-1]) == 0
    return b" ".join([words[k] for k in np.flatnonzero(keep)])


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest exponent; ties by start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def find_runs(df: DataFrame, text: Column, *keys: str) -> DataFrame:
    """Per row: ``keys``, ``runs`` (start, length, period) in order, the ``strongest`` of them or null, and the ``collapsed`` text."""
    source = df.select(F.struct(*[df[f"`{k}`"] for k in keys]).alias("keys"), text.cast("string").alias("text"))
    run = "struct<start:bigint,length:bigint,period:bigint>"
    kind = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            every, best, texts = [], [], []
            named = lambda r: dict(zip(("start", "length", "period"), r, strict=True))
            for value in batch.column("text"):
                words = (value.as_py() or "").encode("utf-8", "surrogatepass").split()  # splits at the six bytes of white space
                runs = runs_of(numbered(words)) if len(words) >= LEAST_WORDS else []
                top = strongest(runs)
                every.append([named(r) for r in runs])
                best.append(named(top) if top else None)
                texts.append(collapsed(words, runs))
            columns = [batch.column("keys"), pa.array(every, pa.list_(kind)), pa.array(best, kind), pa.array(texts, pa.binary()).cast(pa.string())]
            return pa.RecordBatch.from_arrays(columns, ["keys", "runs", "strongest", "collapsed"])

        return apply

    schema = f"keys {source.schema['keys'].dataType.simpleString()}, runs array<{run}>, strongest {run}, collapsed string"
    return map_batches(source, make, schema).select("keys.*", "runs", "strongest", "collapsed")


def with_periodic_end(text: Column, doc_id: Column) -> Column:
    """``text`` as the query changes it: in a tenth of the documents, by the crc32 of the id, the words from some place on repeat a period."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def changed(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, at(i).cast("int"))), " "))

    words = F.array_remove(F.split(text, SPACES), "")
    return F.when(h % 10 == 0, F.coalesce(F.get(F.transform(F.array(words), changed), F.lit(0)), text)).otherwise(text)


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """All documents, a tenth of them with a periodic end: the number of runs, the strongest one, and digests of all and of the collapsed text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_runs(docs, with_periodic_end(F.col("text"), F.col("doc_id")), "doc_id")
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    top = F.col("strongest")
    exact = F.expr("(1000 * strongest.length) div strongest.period")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), top["start"].alias("start"), top["length"].alias("length"), top["period"].alias("period"), exact.alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
