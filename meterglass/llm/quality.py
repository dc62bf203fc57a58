"""Quality scores of documents by Bradley-Terry ranking.

Surface features of a whole text (word shapes, symbols, case, repetition) get weights such that a text marked good
beats one marked bad in as many pairs as possible: logistic loss on the differences of their features. A document's
strength is the weighted sum; the strength at the quantile of the bad share among the fitted texts is the threshold,
which the score, a logistic of the strength, shows as `THRESHOLD`.

All labelled texts that are not held out count (`train`): features, their means and deviations, the pairs, in which each text
has at least one opponent, and the threshold are made on the executors, and a pass over the pairs gives sums of whole
numbers, so neither size nor order of the rows matters. `Ranking` itself fits rows that are at hand, for small ones.

Null and empty texts have features like any other (all zero) and so a score. Without labels of both kinds every score
is 0. Equal texts have equal scores; repeated rows give repeated rows, and null ids stay null. Of several labels of an id 1
counts, of several texts that with the least features, so the model does not depend on how rows are dealt.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterglass.llm.common import MOST_IDS, checkpointed, filter_batches, held_out, in_small_batches, map_batches, table
from meterglass.llm.labelled import known_labels, labelled_sample

#: Preference pairs, at least as far as there are so many, and passes over the pairs by plain gradient.
PAIRS, PASSES = 20_000, 300
#: Weight of the squared weights, Newton steps at most, and the parts of one that sums are rounded to.
RIDGE, STEPS, PARTS = 1e-3, 30, float(1 << 30)
#: Bins of a pass that looks for a rank.
BINS = 1024
#: The score at the threshold.
THRESHOLD = 0.7

_KIND = np.full(256, 5, np.uint8)  # other, mostly parts of letters beyond ASCII
_KIND[48:58] = 0
_KIND[65:91] = 1
_KIND[97:123] = 2
_KIND[[9, 10, 11, 12, 13, 32]] = 3
_KIND[[ord(c) for c in ".,;:'\"-()?"]] = 4
_KIND[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 6
FEATURES = ("digits", "capitals", "plain marks", "symbols", "bangs", "bars", "word length", "new words", "top word", "echoes", "line repeats", "marked words", "log words", "one-letter words")


def features(text: str) -> list[float]:
    """The features of one text, each scaled to about one."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    of = np.bincount(raw, minlength=256)
    kind = np.bincount(_KIND, weights=of, minlength=7)
    letters, shown, n = kind[1] + kind[2] + kind[5] / 2 + 1, kind.sum() - kind[3] + 1, len(words)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x]
    return [
        kind[0] / shown, kind[1] / letters, kind[4] / n, kind[6] / shown, of[33] / n, of[124] / n,
        (shown - 1) / n / 8, len(counts) / n, max(counts.values()) / n, sum(a == b for a, b in zip(words, words[1:])) / n,
        1 - len(set(lines)) / max(1, len(lines)), sum(not w[-1].isalnum() and not w[-2:-1].isalnum() for w in words) / n,
        np.log1p(n) / 6, sum(len(w) == 1 for w in words) / n,
    ]


class Ranking:
    """Weights of standardised features, and the strength at the threshold."""

    def __init__(self, rows: np.ndarray, good: np.ndarray, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.middle, self.spread = rows.mean(axis=0), rows.std(axis=0) + 1e-6
        x = self.standard(rows)
        better, worse = rng.choice(np.flatnonzero(good == 1), PAIRS), rng.choice(np.flatnonzero(good == 0), PAIRS)
        difference = x[better] - x[worse]
        self.weights = np.zeros(x.shape[1])
        speed = np.zeros_like(self.weights)
        for n in range(PASSES):
            lost = 1 / (1 + np.exp(np.clip(difference @ self.weights, -30, 30)))
            slope = difference.T @ lost / PAIRS - 1e-3 * self.weights
            speed = 0.9 * speed + 0.5 * slope
            self.weights += speed
        # the middle of the gap at the quantile of the bad share
        self.threshold = float(np.quantile(x @ self.weights, (good == 0).mean(), method="midpoint"))

    def standard(self, rows: np.ndarray) -> np.ndarray:
        """Standardised and cut at eight deviations, so that no single feature decides alone."""
        return np.clip((rows - self.middle) / self.spread, -8, 8)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        strength = self.standard(rows) @ self.weights - self.threshold
        return 1 / (1 + np.exp(-np.clip(strength + np.log(THRESHOLD / (1 - THRESHOLD)), -500, 500)))


def train(docs: DataFrame, doc_id: Column, text: Column, labels: DataFrame, label_id: Column, label: Column, rows: int | None = None) -> Ranking | None:
    """Weights fitted on all labelled texts that are not held out (on a sample of ``rows``, if given); None without both kinds."""
    if rows is not None:
        found = with_features(labelled_sample(docs, doc_id, text, labels, label_id, label, rows), "label")
    else:
        known = checkpointed(known_labels(labels, label_id, label))
        texts = docs.select(doc_id.cast("long").alias("doc_id"), F.coalesce(text.cast("string"), F.lit("")).alias("text")).where("doc_id IS NOT NULL")
        # texts are not shuffled: their features are
        small = known.count() <= MOST_IDS
        found = with_features(texts.join(F.broadcast(known), "doc_id"), "label") if small else with_features(texts).join(known, "doc_id")
    return fitted(checkpointed(found.groupBy("doc_id", "label").agg(F.min("x").alias("x"))))


def with_features(texts: DataFrame, *keys: str) -> DataFrame:
    """(doc_id, ``keys``, x) of rows with a text, which is not null."""

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [features(t) for t in batch.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays([*[batch.column(k) for k in ("doc_id", *keys)], pa.array(found, pa.list_(pa.float64()))], ["doc_id", *keys, "x"])

        return apply

    return map_batches(texts, make, f"doc_id long, {''.join(f'{k} int, ' for k in keys)}x array<double>")


def fitted(rows: DataFrame) -> Ranking | None:
    """The ranking of all rows (doc_id, label, x), a checkpoint; None without both kinds."""
    width = len(FEATURES)
    exact = lambda c: F.coalesce(F.sum(c.cast("decimal(38,12)")), F.lit(0)).cast("string")
    x = [F.col("x")[k] for k in range(width)]
    seen = rows.agg(F.count("*").alias("n"), F.count_if(F.col("label") == 0).alias("bad"), F.array(*[exact(c) for c in x]).alias("sums"), F.array(*[exact(c * c) for c in x]).alias("squares")).first()
    if not 0 < seen.bad < seen.n:
        return None
    out = Ranking.__new__(Ranking)
    means = [Fraction(s) / seen.n for s in seen["sums"]]
    out.middle = np.array([float(m) for m in means])
    out.spread = np.array([float(max(Fraction(s) / seen.n - m * m, 0)) ** 0.5 for s, m in zip(seen["squares"], means)]) + 1e-6
    differences = checkpointed(pairs(rows, out, seen.bad, seen.n - seen.bad))
    out.weights = newton(differences, width)

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(strengths(out.standard(vectors(batch.column("x"))), out.weights))], ["s"])

        return apply

    # the middle of the gap: as many texts lie below it as are bad
    out.threshold = sum(at_rank(checkpointed(map_batches(rows.select("x"), make, "s double")), seen.bad)) / 2
    return out


def vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def strengths(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """``x @ weights``, a row's sum the same whatever rows stand beside it."""
    out = np.zeros(len(x))
    for column, weight in zip(x.T, weights, strict=True):
        out += column * weight
    return out


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (label, x) with their ``place`` among those of their label, from 0, by the hash of the id; no task has a label whole."""
    order = ["label", "_h", "doc_id"]
    dealt = rows.withColumn("_h", F.xxhash64("doc_id")).repartitionByRange(*order).sortWithinPartitions(*order)
    held = checkpointed(dealt.select("label", "x", F.monotonically_increasing_id().alias("_at")).withColumn("_part", F.shiftright("_at", 33)))
    counts = held.groupBy("label", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_from"))
    # a row for each partition
    earlier = Window.partitionBy("label").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.withColumn("_begin", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    return held.join(F.broadcast(begins), ["label", "_part"]).select("label", "x", (F.col("_begin") + F.col("_at") - F.col("_from")).alias("place"))


def pairs(rows: DataFrame, scale: Ranking, bad: int, good: int) -> DataFrame:
    """Differences ``d`` of standardised features, the better text's less the worse one's.

    Each text of the more frequent kind meets one of the other, in turn; where that gives less than `PAIRS`, the next ones, too.
    """
    few = min(bad, good)
    rounds = min(few, -(-PAIRS // max(bad, good)))
    placed = numbered(rows)
    kind = lambda label: placed.where(F.col("label") == label)
    more, less = (kind(1), kind(0)) if good >= bad else (kind(0), kind(1))
    turns = more.select(F.col("x").alias("a"), "place", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("turn"))
    more = turns.select("a", ((F.col("place") + F.col("turn")) % few).alias("place"))
    met = more.join(less.select("place", F.col("x").alias("b")), "place")
    sign = 1.0 if good >= bad else -1.0

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            a, b = (scale.standard(vectors(batch.column(n))) for n in ("a", "b"))
            return pa.RecordBatch.from_arrays([pa.array(list(sign * (a - b)), pa.list_(pa.float64()))], ["d"])

        return apply

    return map_batches(met.select("a", "b"), make, "d array<double>")


def newton(differences: DataFrame, width: int) -> np.ndarray:
    """Weights of least logistic loss, with `RIDGE`. A pass gives a row of sums for each task; terms are rounded, so their order does not matter."""
    above = np.triu_indices(width)

    def sums(weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(2 + width + len(above[0]), np.int64)
            for batch in batches:
                if batch.num_rows:
                    d = vectors(batch.column("d"))
                    s = strengths(d, weights)
                    lost = 1 / (1 + np.exp(np.clip(s, -500, 500)))
                    terms = [np.logaddexp(0, -s)[:, None], lost[:, None] * d, (lost * (1 - lost))[:, None] * d[:, above[0]] * d[:, above[1]]]
                    total[0] += len(d)
                    total[1:] += np.rint(np.hstack(terms) * PARTS).astype(np.int64).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], ["sums"])

        found = [sum(c) for c in zip(*[r["sums"] for r in in_small_batches(differences).mapInArrow(run, "sums array<long>").collect()], strict=True)]
        means = np.array([c / found[0] / PARTS for c in found[1:]])
        curve = np.zeros((width, width))
        curve[above] = means[1 + width :]
        curve = curve + np.triu(curve, 1).T + RIDGE * np.eye(width)
        return means[0] + RIDGE / 2 * weights @ weights, means[1 : 1 + width] - RIDGE * weights, curve

    weights = np.zeros(width)
    loss, slope, curve = sums(weights)
    for _ in range(STEPS):
        step = np.linalg.solve(curve, slope)
        if np.abs(step).max() < 1e-6:
            break
        found = sums(weights + step)
        while found[0] > loss and np.abs(step).max() >= 1e-6:  # too far
            step = step / 2
            found = sums(weights + step)
        weights, (loss, slope, curve) = weights + step, found
    return weights


def at_rank(values: DataFrame, rank: int) -> tuple[float, float]:
    """The values (column ``s``, a checkpoint) of ``rank``, from 1, and of the next one, exactly: bins of bins, each pass with their counts and ends."""
    low, high, below = *values.agg(F.min("s"), F.max("s")).first(), 0
    while True:
        if low == high:
            return low, high
        of = F.width_bucket(F.col("s"), F.lit(low), F.lit(high), F.lit(BINS))
        bins = sorted(values.where(F.col("s").between(low, high)).groupBy(of.alias("bin")).agg(F.count("*").alias("n"), F.min("s").alias("low"), F.max("s").alias("high")).collect())
        for k, r in enumerate(bins):
            if below + r.n >= rank:
                break
            below += r.n
        if below + r.n == rank:
            return r.high, bins[k + 1].low
        low, high = r.low, r.high


def text_scores(ranking: Ranking | None, texts: list[str | None]) -> np.ndarray:
    if ranking is None:
        return np.zeros(len(texts))
    return ranking.scores(np.array([features(t or "") for t in texts]))


def score_quality(df: DataFrame, text: Column, ranking: Ranking | None, *keys: str) -> DataFrame:
    """Columns ``keys``, ``score`` and ``predicted`` for every row."""
    source = df.select(F.struct(*[df[f"`{k}`"] for k in keys]).alias("keys"), text.cast("string").alias("text"))

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores = text_scores(ranking, batch.column("text").to_pylist())
            return pa.RecordBatch.from_arrays([batch.column("keys"), pa.array(scores, pa.float64())], ["keys", "score"])

        return apply

    scored = map_batches(source, make, f"keys {source.schema['keys'].dataType.simpleString()}, score double")
    return scored.select("keys.*", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(df: DataFrame, text: Column, ranking: Ranking | None) -> DataFrame:
    """The rows of ``df`` whose text scores at least the threshold; all of them without a ranking."""

    def make():
        def judge(batch: pa.RecordBatch) -> list[bool]:
            if ranking is None:
                return [True] * batch.num_rows
            return (text_scores(ranking, batch.column("text").to_pylist()) >= THRESHOLD).tolist()

        return judge

    return filter_batches(df, {"text": text.cast("string")}, make)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    """The quality of every document."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    ranking = train(docs, F.col("doc_id"), F.col("text"), labels, F.col("doc_id"), F.col("quality"))
    scored = score_quality(docs, F.col("text"), ranking, "doc_id")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
