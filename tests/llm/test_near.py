import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterglass.llm import common, graph, minhash, rabitq, shingles


def components_of(nodes, edges):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for u, v in edges:
            low = min(label[u], label[v])
            changed |= label[u] != low or label[v] != low
            label[u] = label[v] = low
    return label


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (120, 2))] + [(k, k + 1) for k in range(300, 340)] + [(500, 500)]
    nodes = {n for e in edges for n in e} - {500}
    got = {r.node: r.component for r in graph.components(spark.createDataFrame([*edges, (None, 1)], "u long, v long")).collect()}
    want = components_of(nodes, [e for e in edges if e[0] != e[1]])
    assert got == {n: want[n] for n in got} and {n for n in nodes if want[n] != n} <= set(got)
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def word_set(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def test_shingle_numbers_stand_for_shingles():
    texts = ["", " \n", "one two", "One  TWO", "a b c d e", "a b c d e f a b c d e", "É é Ä", "x\x0by\x0cz", "a\xa0b c d e f", "w " * 3000]
    sets = shingles.shingle_sets([t.encode() for t in texts])
    assert [len(s) for s in sets] == [len(word_set(t)) for t in texts]
    for (a, s), (b, t) in itertools.combinations(zip(texts, sets, strict=True), 2):
        assert len(np.intersect1d(s, t)) == len(word_set(a) & word_set(b))
    assert [len(s) for s in shingles.shingle_sets([b"a"])] == [1] and shingles.shingle_sets([b" "])[0].tolist() == []


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 400).astype(np.uint64)
    sets = [np.unique(x) for x in (base, np.concatenate([base[:300], rng.integers(0, 2**63, 100).astype(np.uint64)]), base[:1], base[:5], base[:0])]
    rows = shingles.sketches(sets)
    assert (rows[:4] != np.uint64(2**64 - 1)).all() and (rows[4] == np.uint64(2**64 - 1)).all()
    wide = shingles.sketches(sets[:2], bins=1024)
    assert (wide[0] == wide[1]).mean() == pytest.approx(300 / 500, abs=0.06)
    assert (shingles.sketches([sets[3]])[0] == rows[3]).all()


def documents(seed=4):
    rng = np.random.default_rng(seed)
    vocabulary = np.array([f"w{k}" for k in range(4000)])
    texts = []
    for group in range(12):
        base = rng.choice(vocabulary, rng.integers(6, 160)).tolist()
        for copy in range(int(rng.integers(1, 40 if group == 0 else 6))):
            words = list(base)
            for at in rng.integers(0, len(words), rng.integers(0, 1 + len(words) // 40 * 3)):
                words[at] = str(rng.choice(vocabulary))
            texts.append(" ".join(words))
    texts += [texts[0]] * 5 + ["one", "one", "One", None, "", " ", None, "alpha beta gamma", "alpha beta gamma delta"]
    return texts


def wanted(texts):
    sets = [word_set(t) for t in texts]
    edges = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return sets, components_of(range(len(texts)), edges)


@pytest.mark.parametrize("block", [minhash.BLOCK_SHINGLES, 600])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block):
    """With blocks as usual, and with blocks of few shingles; ids are joined by broadcast or by shuffle."""
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", block)
    monkeypatch.setattr(common, "MOST_IDS", common.MOST_IDS if block > 600 else 0)
    texts = documents()
    sets, label = wanted(texts)
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, rep string, key int").repartition(5)
    got = {r.doc_id: r for r in minhash.near_duplicates(df, F.col("doc_id"), F.col("text")).collect()}
    assert len(got) == len(texts)
    for k in range(len(texts)):
        assert (got[k].n_shingles, got[k].component_id, got[k].kept) == (len(sets[k]), label[k], label[k] == k)
    kept = minhash.keep_one(df, F.col("doc_id"), F.col("text"))
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {k for k in range(len(texts)) if label[k] == k}


def test_near_duplicates_of_odd_rows(spark, odd_documents, no_documents):
    got = minhash.near_duplicates(odd_documents, F.col("doc_id"), F.col("text")).collect()
    assert len(got) == odd_documents.count()
    assert all(r.kept for r in got) and [r.component_id for r in got if r.doc_id is None] == [None]
    assert minhash.near_duplicates(no_documents, F.col("doc_id"), F.col("text")).count() == 0
    assert minhash.keep_one(odd_documents, F.col("doc_id"), F.col("text")).count() == odd_documents.count()


def test_near_duplicates_join_all_rows_of_a_doc_id(spark):
    words = [f"w{k}" for k in range(60)]
    a, b, c = " ".join(words[:40]), " ".join(words[20:]), " ".join(reversed(words))
    near = " ".join([*words[20:59], "other"])
    rows = [(5, a), (5, b), (2, b), (9, c), (7, c), (7, near), (5, a), (5, None), (11, "alone in here")]
    edges = [(x, y) for (x, s), (y, t) in itertools.combinations(rows, 2) if s and t and 100 * len(word_set(s) & word_set(t)) >= 75 * len(word_set(s) | word_set(t))]
    label = components_of({k for k, _ in rows}, edges)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), F.col("doc_id"), F.col("text")).collect()
    assert len(got) == len(rows) and label[5] == label[9] == 2
    # a row without words stands alone, whatever other rows have its id
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got if r.n_shingles) == sorted((k, label[k], label[k] == k) for k, t in rows if t)


def vectors(seed=6):
    rng = np.random.default_rng(seed)
    rows = []
    for label in (0, 1, None):
        centre = rng.normal(size=16)
        for spread, n in ((0.02, 40), (0.06, 60), (1.0, 60)):
            rows += [(list(map(float, centre + rng.normal(size=16) * spread)), label) for _ in range(n)]
        rows += [(list(map(float, centre)), label)] * 4
    rows += [(None, 0), ([], 0), ([0.0] * 16, 0), ([float("nan")] + [1.0] * 15, 0), ([float("inf")] + [1.0] * 15, 0), ([None] + [1.0] * 15, 0), ([1.0, 0.0], 0), ([2.0, 0.0], 0), ([-0.0, 3.0], 0), ([0.0, 3.0], 0)]
    return rows


@pytest.mark.parametrize("block", [1024, 16])
def test_near_vectors_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(rabitq, "BLOCK", block)
    monkeypatch.setattr(rabitq, "SMALL_GROUP", 8)
    rows = vectors()
    usable = {k: np.array(v, float) for k, (v, label) in enumerate(rows) if v and label is not None and None not in v and np.isfinite(v).all() and any(v)}
    edges = []
    for a, b in itertools.combinations(usable, 2):
        x, y = usable[a], usable[b]
        if rows[a][1] == rows[b][1] and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
            edges.append((a, b))
    label = components_of(range(len(rows)), edges)
    df = spark.createDataFrame([(k, v, n, "x") for k, (v, n) in enumerate(rows)], "vec_id long, embedding array<double>, label int, rep string").repartition(4)
    got = {r.vec_id: r for r in rabitq.near_vectors(df, F.col("vec_id"), F.col("embedding"), F.col("label")).collect()}
    assert len(got) == len(rows)
    links = {k: sum(k in e for e in edges) for k in range(len(rows))}
    assert sum(r.n_links for r in got.values()) >= 0.999 * sum(links.values()) and all(got[k].n_links <= links[k] for k in links)
    assert {k: r.component_id for k, r in got.items()} == label and all(r.kept == (r.component_id == k) for k, r in got.items())
    assert rabitq.near_vectors(df.limit(0), F.col("vec_id"), F.col("embedding"), F.col("label")).count() == 0


@pytest.mark.parametrize("scale", [1.0, 1e200, 1e308, 1e-200, 1e-308, 1e-322])
def test_vectors_of_any_scale_link(spark, scale):
    base = np.random.default_rng(9).integers(1, 9, 8) / 9
    rows = [(0, (base * scale).tolist()), (1, (base * [1.01, *[1] * 7] * scale).tolist()), (2, (-base * scale).tolist()), (3, base.tolist())]
    df = spark.createDataFrame([(k, v, 0) for k, v in rows], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in rabitq.near_vectors(df, F.col("vec_id"), F.col("embedding"), F.col("label")).collect()}
    assert got == {0: (2, 0), 1: (2, 0), 2: (0, 2), 3: (2, 0)}


def test_estimates_are_unbiased_within_their_bounds():
    rng = np.random.default_rng(8)
    x = rabitq.unit(rng.normal(size=(400, 64)))
    turned, signs, factor = rabitq.codes(x)
    near = signs @ turned.T / factor[:, None]
    exact, off = x @ x.T, ~np.eye(400, dtype=bool)
    missed = (near - exact)[off]
    assert abs(missed.mean()) < 0.01
    assert (np.abs(near - exact) <= rabitq.error_bound(factor, 64)[:, None])[off].mean() > 0.999
