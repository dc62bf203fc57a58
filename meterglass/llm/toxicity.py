"""Toxicity scores by gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon is learned: words and word beginnings that labelled toxic texts hold far more often than clean ones. The
features are its densities, hits near a second-person word, capitals, punctuation, and rates of obfuscation (digits
or signs inside words, stretched letters) with the lexicon's hits once that is undone. Trees are grown in numpy on
binned features; the calibration is fitted on labelled rows that the trees have not seen.

Null and empty texts have all-zero features and a score like any other. Without labels of both kinds every score is 0.
Equal texts have equal scores; repeated rows give repeated rows, and null ids stay null. Repeated or conflicting labels and
texts of an id are settled by rule (`labelled_sample`), so the model does not depend on how rows are dealt.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterglass.llm.common import checkpointed, held_out, map_batches, table
from meterglass.llm.labelled import labelled_sample

#: Labelled documents that everything here is fitted on, at most; every fourth only calibrates.
TRAIN_ROWS = 6000
#: Entries of the lexicon, at most, and how much likelier they are in toxic texts.
ENTRIES, LIKELIER = 400, 20.0
#: Toxic texts that hold an entry, at least: so many, and this share of them, so that copies of one text make no entry.
SEEN, SEEN_SHARE = 4, 0.02
#: Lengths of word beginnings that may be entries, and the different words that must share one.
BEGINNINGS, VARIETY = (4, 5, 6), 5
FOLLOWERS = 8
TREES, DEPTH, RATE, BINS, LEAST_LEAF = 60, 3, 0.2, 32, 8
NEAR = 5
THRESHOLD = 0.3
#: Words that a task remembers.
CACHE_WORDS = 500_000

SECOND_PERSON = frozenset("you your yours yourself you're youre u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deinen deiner ihr euch euer usted ustedes tú ti tus vosotros".split())
# Digits and signs that are written for letters.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "*": None, ".": None, "-": None, "_": None, "​": None})
_EDGE = "\"'()[]{}<>.,;:!?…«»„“”|#$%&*+-=/\\^_`~@"
_INNER = re.compile(r"[^\W\d_][\d@$!*_.\-​]+[^\W\d_]")
_STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
LEXICON, BEGINNING, PERSON, OBFUSCATED, UNDONE, SHOUTED = (1 << k for k in range(6))
FEATURES = ("lexicon", "beginnings", "undone", "any hit", "distinct hits", "near person", "person", "obfuscated", "shouted", "capitals", "marks", "bangs", "digits", "log words")


def plain(word: str) -> str:
    return word.strip(_EDGE).lower()


def entries_of(core: str) -> set[str]:
    """What the lexicon may hold of a plain word: itself, and its beginnings (marked by a final hyphen)."""
    return {core, *(core[:k] + "-" for k in BEGINNINGS if len(core) > k)} if len(core) > 3 else set()


def learned_lexicon(sample: DataFrame) -> frozenset[str]:
    """Entries by how much likelier a toxic text of ``sample`` (text, label) holds them than a clean one.

    All counts are made by Spark; only entries that pass come to the driver, `ENTRIES` at most.
    """

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            entries, words, pairs = [], [], []
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                cores = list(map(plain, text.split()))
                entries.append(sorted(set().union(*map(entries_of, set(cores)))))
                words.append(sorted(set(cores)) if toxic else [])
                pairs.append([{"word": w, "follower": f} for w, f in sorted(set(zip(cores, [*cores[1:], ""])))] if toxic else [])
            kinds = [pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.struct([("word", pa.string()), ("follower", pa.string())]))]
            return pa.RecordBatch.from_arrays([batch.column("label"), *[pa.array(x, k) for x, k in zip((entries, words, pairs), kinds, strict=True)]], ["label", "entries", "words", "pairs"])

        return apply

    split = checkpointed(map_batches(sample.select("text", "label"), make, "label int, entries array<string>, words array<string>, pairs array<struct<word: string, follower: string>>"))
    totals = split.agg(F.sum("label").alias("toxic"), F.count("*").alias("all")).first()
    n = max(1, totals["toxic"] or 0)
    m = max(1, totals["all"] - n)
    seen = split.select("label", F.explode("entries").alias("entry")).groupBy("entry").agg(F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good"))
    seen = seen.withColumn("ratio", F.col("bad") / n / ((F.col("good") + 0.5) / m)).where((F.col("bad") >= max(SEEN, SEEN_SHARE * n)) & (F.col("ratio") >= LIKELIER))
    # a beginning counts for itself only where many words share it and none of them has half of its texts
    words = split.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("c"))
    starts = F.array_compact(F.array(*[F.when(F.length("word") > k, F.concat(F.left("word", F.lit(k)), F.lit("-"))) for k in BEGINNINGS]))
    shared = words.select(F.explode(starts).alias("entry"), "c").groupBy("entry").agg(F.count("*").alias("kinds"), F.max("c").alias("most"))
    # and a word only where different ones follow it, in half of its texts or `FOLLOWERS`, unlike in copies of one text
    after = split.select(F.inline("pairs")).groupBy(F.col("word").alias("entry")).agg(F.countDistinct("follower").alias("followers"))
    both = seen.join(shared, "entry", "left").join(after, "entry", "left")
    own = F.when(F.col("entry").endswith("-"), (F.col("kinds") >= VARIETY) & (2 * F.col("most") < F.col("bad"))).otherwise(F.col("followers") >= F.least(F.lit(FOLLOWERS), F.col("bad") / 2))
    return frozenset(r["entry"] for r in both.where(own).orderBy(F.desc("ratio"), "entry").limit(ENTRIES).collect())


class _Marks(dict):
    """The marks of a word, remembered."""

    def __init__(self, lexicon: frozenset[str]) -> None:
        self.lexicon = lexicon

    def __missing__(self, word: str) -> int:
        core, lexicon = plain(word), self.lexicon
        hit = lambda w: (LEXICON * (w in lexicon)) | (BEGINNING * any(w[:k] + "-" in lexicon for k in BEGINNINGS if len(w) > k))
        marks = hit(core) | PERSON * (core in SECOND_PERSON) | SHOUTED * (len(core) > 2 and word.isupper())
        inner, stretched = _INNER.search(word), _STRETCHED.search(core)
        if inner or stretched:
            undone = word.lower().translate(LEET).strip(_EDGE)
            short = _STRETCHED.sub(r"\1", undone)
            marks |= OBFUSCATED | UNDONE * bool(not marks & (LEXICON | BEGINNING) and (hit(undone) or hit(short)))
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = marks
        return marks


def features(text: str, marks: _Marks) -> list[float]:
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n = len(words)
    found = np.fromiter(map(marks.__getitem__, words), np.uint8, n)
    hits = np.flatnonzero(found & (LEXICON | BEGINNING | UNDONE))
    people = np.flatnonzero(found & PERSON)
    near = 0
    if len(hits) and len(people):
        at = np.searchsorted(people, hits)
        gap = np.minimum(np.abs(people[np.minimum(at, len(people) - 1)] - hits), np.abs(hits - people[np.maximum(at - 1, 0)]))
        near = int((gap <= NEAR).sum())
    of = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=128)
    capitals, lower = of[65:91].sum(), of[97:123].sum()
    marked = of[33:48].sum() + of[58:65].sum() + of[91:97].sum() + of[123:127].sum()
    share = lambda bit: np.count_nonzero(found & bit) / n
    return [
        share(LEXICON), share(BEGINNING), share(UNDONE), len(hits) / n, float(len({plain(words[k]) for k in hits})), near / n, len(people) / n,
        share(OBFUSCATED), share(SHOUTED), capitals / (capitals + lower + 1), marked / n, of[33] / n, of[48:58].sum() / n, float(np.log1p(n)),
    ]


class Trees:
    """Boosted regression trees for the logistic loss; a tree is complete, and a node without a good split sends all left."""

    def __init__(self, rows: np.ndarray, wanted: np.ndarray) -> None:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in rows.T]
        # zero parts the texts without a hit from all others
        self.edges = [np.unique(np.concatenate([[0.0], e])) for e in self.edges]
        codes = self.codes(rows)
        share = np.clip(wanted.mean(), 1e-6, 1 - 1e-6)
        self.start = float(np.log(share / (1 - share)))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        total = np.full(len(rows), self.start)
        for _ in range(TREES):
            chance = 1 / (1 + np.exp(-total))
            tree = self.grow(codes, wanted - chance, chance * (1 - chance))
            self.trees.append(tree)
            total += self.values(codes, tree)

    def codes(self, rows: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, rows.T, strict=True)], axis=1)

    def grow(self, codes: np.ndarray, slope: np.ndarray, curve: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        width = BINS + 2
        feature, cut = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, width)
        node = np.zeros(len(codes), np.int64)
        for level in range(DEPTH):
            first, count = 2**level - 1, 2**level
            best = np.full(count, 1e-9)
            for f in range(codes.shape[1]):
                cell = (node - first) * width + codes[:, f]
                g, h, n = (np.bincount(cell, w, count * width).reshape(count, width).cumsum(axis=1) for w in (slope, curve, None))
                gt, ht, nt = g[:, -1:], h[:, -1:], n[:, -1:]
                gain = g**2 / (h + 1) + (gt - g) ** 2 / (ht - h + 1) - gt**2 / (ht + 1)
                gain[(n < LEAST_LEAF) | (nt - n < LEAST_LEAF)] = 0
                at = gain.argmax(axis=1)
                found = gain[np.arange(count), at]
                better = found > best
                best[better], feature[first : first + count][better], cut[first : first + count][better] = found[better], f, at[better]
            node = 2 * node + 1 + (codes[np.arange(len(codes)), feature[node]] > cut[node])
        leaf = node - (2**DEPTH - 1)
        value = RATE * np.bincount(leaf, slope, 2**DEPTH) / (np.bincount(leaf, curve, 2**DEPTH) + 1)
        return feature, cut, value

    def values(self, codes: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        feature, cut, value = tree
        node, rows = np.zeros(len(codes), np.int64), np.arange(len(codes))
        for _ in range(DEPTH):
            node = 2 * node + 1 + (codes[rows, feature[node]] > cut[node])
        return value[node - (2**DEPTH - 1)]

    def raw(self, rows: np.ndarray) -> np.ndarray:
        codes = self.codes(rows)
        return self.start + sum(self.values(codes, t) for t in self.trees)


def isotonic(raw: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising steps through (raw, wanted) by pooling neighbours that fall; their centres and heights."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # sum of raw, sum of wanted, count
    for x, y in zip(raw[order].tolist(), wanted[order].tolist(), strict=True):
        blocks.append([x, y, 1.0])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            x2, y2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + x2, blocks[-1][1] + y2, blocks[-1][2] + n2]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


class Toxicity:
    """The trees over ``rows`` (features) of the texts that are ``fitted``, calibrated on the others."""

    def __init__(self, lexicon: frozenset[str], rows: np.ndarray, toxic: np.ndarray, fitted: np.ndarray) -> None:
        self.lexicon = lexicon
        self.trees = Trees(rows[fitted], toxic[fitted])
        other = ~fitted if (~fitted).any() else fitted
        self.steps = isotonic(self.trees.raw(rows[other]), toxic[other].astype(float))

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return np.interp(self.trees.raw(rows), *self.steps)

    def text_scores(self, texts: list[str], marks: _Marks) -> np.ndarray:
        return self.scores(np.array([features(t, marks) for t in texts]))


def fit(sample: DataFrame) -> Toxicity | None:
    """A model of ``sample`` (doc_id, text, label), of which every fourth row by hash only calibrates; None without both kinds."""
    split = sample.withColumn("fitted", F.pmod(F.xxhash64("doc_id", F.lit("fitted")), F.lit(4)) < 3)
    kinds = {(r.fitted, r.label) for r in split.select("fitted", "label").distinct().collect()}
    if len({y for _, y in kinds}) < 2:
        return None
    if len(kinds) < 4:
        split = split.withColumn("fitted", F.lit(True))
    lexicon = learned_lexicon(split.where("fitted"))

    def make():
        marks = _Marks(lexicon)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [features(t, marks) for t in batch.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(n) for n in ("doc_id", "label", "fitted")] + [pa.array(found, pa.list_(pa.float64()))], ["doc_id", "label", "fitted", "x"])

        return apply

    known = sorted(map_batches(split, make, "doc_id long, label int, fitted boolean, x array<double>").collect())
    return Toxicity(lexicon, np.array([r.x for r in known]), np.array([r.label for r in known]), np.array([r.fitted for r in known]))


def train(docs: DataFrame, doc_id: Column, text: Column, labels: DataFrame, label_id: Column, label: Column, rows: int = TRAIN_ROWS) -> Toxicity | None:
    """A model fitted on a bounded sample of labels; None without both kinds."""
    return fit(labelled_sample(docs, doc_id, text, labels, label_id, label, rows))


def score_toxicity(df: DataFrame, text: Column, model: Toxicity | None, *keys: str) -> DataFrame:
    """Columns ``keys``, ``score`` and ``predicted`` for every row."""
    source = df.select(F.struct(*[df[f"`{k}`"] for k in keys]).alias("keys"), text.cast("string").alias("text"))

    def make():
        marks = _Marks(model.lexicon) if model else None

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            scores = model.text_scores(texts, marks) if model else np.zeros(len(texts))
            return pa.RecordBatch.from_arrays([batch.column("keys"), pa.array(scores, pa.float64())], ["keys", "score"])

        return apply

    scored = map_batches(source, make, f"keys {source.schema['keys'].dataType.simpleString()}, score double")
    return scored.select("keys.*", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """The toxicity of every document."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = train(docs, F.col("doc_id"), F.col("text"), labels, F.col("doc_id"), F.col("toxic"))
    scored = score_toxicity(docs, F.col("text"), model, "doc_id")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
