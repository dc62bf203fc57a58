"""Periodic runs, Merkle manifests and license scans against plain loops and SQL, and their edge cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterglass.llm import licenses, merkle, periodic

# --- runs -------------------------------------------------------------------------------------------------------------


def plain_lyndon(word):
    """By definition: the longest prefix of each suffix that is less than all of its own proper suffixes."""
    return [max(k for k in range(1, len(word) - i + 1) if all(word[i : i + k] < word[i + s : i + k] for s in range(1, k))) for i in range(len(word))]


def plain_runs(word):
    """For every period the maximal stretches that have it, unless a lesser period has them too."""
    found = {}
    n = len(word)
    for q in range(1, n // 3 + 1):
        at = 0
        while at + q < n:
            if word[at] != word[at + q]:
                at += 1
                continue
            end = at
            while end + q < n and word[end] == word[end + q]:
                end += 1
            if end + q - at >= max(24, 3 * q):
                found.setdefault((at, end + q - at), q)
            at = end
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def periodic_words(rng, size, letters):
    word = []
    while len(word) < size:
        part = [rng.randrange(letters) for _ in range(rng.randint(1, 14))]
        word += (part * rng.randint(1, 9))[: rng.randint(1, 90)]
        word += [rng.randrange(letters + 20) for _ in range(rng.randint(0, 9))]
    return word[:size]


def test_lyndon_lengths_are_those_of_the_definition():
    rng = random.Random(3)
    for _ in range(300):
        word = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(0, 40))]
        assert periodic.lyndon_lengths(word) == plain_lyndon(word)


def test_runs_equal_plain_loops():
    rng = random.Random(5)
    for k in range(150):
        word = periodic_words(rng, rng.randint(0, 400), 1 + k % 4)
        want = plain_runs(word)
        assert periodic.runs_of(np.array(word, np.int64)) == want
        # without the screening too
        if word:
            assert sorted(periodic.runs_within(np.array(word, np.int64)), key=lambda r: (r[0], r[2])) == want


def test_long_repeating_words():
    for word in ([7] * 30_000, [1, 2] * 20_000, [int(b) for b in "0110100110010110" * 2_000]):
        found = periodic.runs_of(np.array(word, np.int64))
        assert max(r[1] for r in found) == len(word)
    a, b = [0], [0, 1]
    while len(b) < 30_000:
        a, b = b, b + a
    assert periodic.runs_of(np.array(b, np.int64))  # a Fibonacci word


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    text = b" ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text).hexdigest())


def test_periodic_runs_query_equals_plain_loops(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("length(text) < 6000").collect()
    got = {r["doc_id"]: tuple(r) for r in periodic.op13_periodic_runs(spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert [got[r["doc_id"]] for r in docs] == [plain_row(*r) for r in docs]
    assert any(got[r["doc_id"]][1] for r in docs)


def test_runs_of_odd_documents(odd_documents, no_documents):
    found = periodic.find_runs(odd_documents, F.col("text"), "doc_id", "keys", "row").collect()
    assert len(found) == odd_documents.count()
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[4]["strongest"]["length"] == 40_000 and by_id[4]["collapsed"] == "palabra larga"
    assert by_id[2]["runs"] == [] and by_id[2]["collapsed"] == "" and by_id[2]["strongest"] is None
    assert by_id[5]["collapsed"] == ""
    assert periodic.find_runs(no_documents, F.col("text"), "doc_id").count() == 0


# --- trees ------------------------------------------------------------------------------------------------------------


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(digests):
    """Its root and every leaf's siblings, as pairs by level."""
    proofs, at, now = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(now) > 1:
        for leaf, k in enumerate(at):
            run = now[k // 8 * 8 : k // 8 * 8 + 8]
            proofs[leaf].append(("".join(run[: k % 8]), "".join(run[k % 8 + 1 :])))
            at[leaf] = k // 8
        now = [h(*now[k : k + 8]) for k in range(0, len(now), 8)]
    return now[0], proofs


def plain_manifest(rows):
    """rows (doc_id, group, digest, claimed)"""
    groups = {}
    for r in rows:
        groups.setdefault((r[1] is not None, (r[1] or "").encode()), []).append(r)
    ordered = sorted(groups)
    trees = {}
    for g in ordered:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        trees[g] = plain_tree([r[2] for r in groups[g]])
    root, above = plain_tree([trees[g][0] for g in ordered])
    out = []
    for g, upper in zip(ordered, above):
        for r, proof in zip(groups[g], trees[g][1]):
            steps, folded = proof + upper, r[3]
            for before, behind in steps:
                folded = h(before, folded, behind)
            out.append((r[0], r[2], trees[g][0], root, "".join(a + b for a, b in steps), folded))
    return out


def test_sweeps_equal_plain_tree():
    for n in (1, 2, 8, 9, 64, 65, 700, 4096):
        digests = [h(str(k)) for k in range(n)]
        levels = merkle.height(n)
        nodes = merkle.climb(digests, levels)
        root, proofs = plain_tree(digests)
        assert nodes[levels * merkle.PLACES] == root
        assert merkle.descend(nodes, n, levels, ()) == [tuple(p) for p in proofs]
        assert all(merkle.fold(d, tuple(p)) == root for d, p in zip(digests[:20], proofs))


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 9, "b": 1, None: 3}, {"a": 5000, "b": 4096, "ä": 70, None: 1}, {f"g{k}": 1 + k % 3 for k in range(75)}])
def test_manifest_equals_plain_tree(spark, sizes):
    rows = [(k, g, h(f"{g}{k}"), h(f"{g}{k}") if k % 3 else h("other")) for g, n in sizes.items() for k in range(n)]
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "tree long, keys string, digest string, place string").repartition(7)
    found = merkle.manifest(df, F.col("keys"), F.col("tree"), F.col("digest"), F.col("place"), "tree")
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, found.collect()), key=key) == sorted(plain_manifest(rows), key=key)


def test_manifest_of_three_rounds(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    rows = [(k, g, h(f"{g}{k}"), h(f"{g}{k}")) for g, n in (("a", 600), ("b", 65), (None, 8)) for k in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, digest string, claimed string")
    levels = merkle.LEVELS, merkle.BLOCK
    assert levels == (1, 8)
    found = merkle.manifest(df, F.col("lang"), F.col("doc_id"), F.col("digest"), F.col("claimed"), "doc_id")
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, found.collect()), key=key) == sorted(plain_manifest(rows), key=key)


def test_tampered_rows_do_not_verify(spark, sf):
    assert {r["verified"] for r in merkle.op12_merkle_manifest(spark, sf).collect()} == {True, False}


def test_manifest_of_odd_documents(odd_documents, no_documents):
    leaf = merkle.digest_of(F.col("doc_id"), F.col("lang"), F.col("text"))
    found = merkle.manifest(odd_documents, F.col("lang"), F.col("doc_id"), leaf, leaf, "doc_id", "keys", "row")
    rows = found.collect()
    assert len(rows) == odd_documents.count() and len({r["root"] for r in rows}) == 1
    assert all(r["folded_root"] == r["root"] for r in rows)
    assert {r["leaf"] for r in rows if r["doc_id"] == 2} == {h("1:2--")}
    assert merkle.manifest(no_documents, F.col("lang"), F.col("doc_id"), leaf, leaf, "doc_id").count() == 0


# --- licenses ---------------------------------------------------------------------------------------------------------


def plain_links(words, templates):
    out = {}
    for t in templates:
        for s in range(0, len(words), t.size_class):
            both = len(set(words[s : s + 2 * t.size_class]) & set(t.words))
            if both >= t.needed:
                out[t.number] = max(out.get(t.number, 0), both / len(t.words))
    return sorted(out.items())


def test_license_query_finds_labels(spark, sf):
    assert {r["labels"] for r in licenses.op11_license_scan(spark, sf).collect()} > {"", "mit"}


def test_license_plan_has_no_python(spark, sf):
    plan = licenses.op11_license_scan(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(n in plan for n in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"))


def test_links_equal_plain_loops(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(60)]
    given = [(" ".join(rng.choices(words, k=rng.choice([1, 3, 8, 16, 17, 40]))), f"l{k % 5}") for k in range(30)]
    texts = [" ".join(rng.choices(words + [f"x{k}" for k in range(n)], k=rng.choice([0, 1, 20, 200]))) + " " + rng.choice(given)[0] for n in range(60)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "digest long, block string")
    for held in (0.5, 0.8, 1.0):
        known = licenses.templates_of(given, held)
        rows = licenses.scan_licenses(df, F.col("block"), "digest", templates=given, held=held).collect()
        got = {r["digest"]: [(x["template"], x["held"]) for x in r["links"]] for r in rows}
        assert got == {k: plain_links(t.split(), known) for k, t in enumerate(texts)}


def test_places_of_phrases(spark):
    df = spark.createDataFrame([(1, "MIT License mit-license"), (2, "license mit"), (3, "x GENERAL public\x00LICENSE ünd"), (4, "apache license mit license")], "n long, text string")
    rows = {r["n"]: r for r in licenses.scan_licenses(df, F.col("text"), "n", templates=[]).collect()}
    assert [(p["label"], p["word"]) for p in rows[1]["places"]] == [("mit", 0), ("mit", 2)]
    assert rows[2]["places"] == [] and rows[3]["n_words"] == 5
    assert [(p["label"], p["word"]) for p in rows[3]["places"]] == [("gpl", 1)]
    assert [(p["label"], p["word"]) for p in rows[4]["places"]] == [("apache", 0), ("mit", 2)]


def test_licenses_of_odd_documents(spark, odd_documents, no_documents):
    rows = licenses.scan_licenses(odd_documents, F.col("text"), "doc_id", "keys", "row").collect()
    assert len(rows) == odd_documents.count()
    assert {r["n_words"] for r in rows if r["doc_id"] in (2, 3, 5)} == {0}
    assert licenses.scan_licenses(no_documents, F.col("text"), "doc_id").count() == 0
    with pytest.raises(ValueError):
        licenses.templates_of([("a", "b")] * 1001)
