import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterglass.llm import common, langid, quality, toxicity
from meterglass.llm.labelled import labelled_sample

WORDS = {"en": "the of and house garden with that from this have", "de": "der die und nicht ein größer schön über mit für", "es": "el la los niño año que con para más está"}


@pytest.fixture(scope="module")
def network():
    rng = np.random.default_rng(0)
    names = sorted(WORDS)
    texts = [(k, " ".join(rng.choice(WORDS[names[k]].split(), 30)).encode()[:64].ljust(64)) for k in rng.integers(0, 3, 400)]
    net = langid.Network(names, units=6)
    net.fit(np.array([np.frombuffer(t, np.uint8) for _, t in texts]), np.array([k for k, _ in texts]), steps=200)
    return net


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    net = langid.Network(["a", "b", "c"], units=4)
    for way in net.ways:
        way.into, way.across = way.into.astype(float), way.across.astype(float)
    codes, wanted = rng.integers(0, 256, (6, 5)).astype(np.uint8), rng.integers(0, 3, 5)
    _, slopes = net.step(codes, wanted)
    for weights, slope in zip(net.weights(), slopes, strict=True):
        at = np.unravel_index(np.abs(slope).argmax(), slope.shape)
        was, e = weights[at], 1e-3
        weights[at] = was + e
        above = net.step(codes, wanted)[0]
        weights[at] = was - e
        below = net.step(codes, wanted)[0]
        weights[at] = was
        assert slope[at] == pytest.approx((above - below) / (2 * e), rel=0.03)


def test_languages_and_odd_documents(network, odd_documents, no_documents):
    names, scores = langid.predictions(network, [WORDS[k] for k in sorted(WORDS)])
    assert names == sorted(WORDS) and min(scores) > 0.6
    got = langid.identify(odd_documents, F.col("text"), network, "doc_id").collect()
    assert [r.lang_pred == "und" for r in got] == [t.text is None or not any(map(str.isalpha, t.text)) for t in odd_documents.collect()]
    assert all(0 <= r.score <= 1 for r in got) and got[0].lang_pred == "de" and got[0] == got[1]
    assert langid.identify(no_documents, F.col("text"), network, "doc_id").count() == 0
    kept = langid.keep_known(odd_documents, F.col("text"), network)
    assert kept.columns == odd_documents.columns and kept.where("doc_id = 1").count() == 2 and kept.where("text IS NULL OR doc_id = 6").count() == 0


def test_a_text_counts_to_its_end(network):
    both = (WORDS["en"] + " ") * 3 + (WORDS["de"] + " ") * 40
    assert langid.predictions(network, [both])[0] == ["de"]
    rows = network.documents([WORDS["de"].encode(), b"", (WORDS["de"] + " ").encode() * 20])
    assert rows[1].sum() == 0 and rows[0].sum() == pytest.approx(1, abs=1e-5) and rows[2].sum() == pytest.approx(1, abs=1e-5)


def test_without_labels(spark, no_documents):
    assert langid.train(no_documents, F.col("doc_id"), F.col("text"), F.col("lang")) is None
    assert langid.predictions(None, ["text", None]) == (["und", "und"], [0.0, 0.0])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.train(no_documents, F.col("doc_id"), F.col("text"), labels, F.col("doc_id"), F.col("quality")) is None
    assert toxicity.train(no_documents, F.col("doc_id"), F.col("text"), labels, F.col("doc_id"), F.col("toxic")) is None


def test_without_a_network_the_language_stage_keeps_all_texts_with_letters(odd_documents):
    kept = langid.keep_known(odd_documents, F.col("text"), None)
    assert kept.columns == odd_documents.columns
    lettered = [t.doc_id for t in odd_documents.collect() if any(map(str.isalpha, t.text or ""))]
    assert [r.doc_id for r in kept.collect()] == lettered == [1, 1, 4, None, 7]


def test_nothing_is_learned_from_held_out_rows(spark):
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    held = {r.doc_id for r in df.where(common.held_out(F.col("doc_id"))).collect()}
    assert 60 < len(held) < 140
    sample = labelled_sample(df, F.col("doc_id"), F.col("text"), df, F.col("doc_id"), F.col("doc_id") % 2, 1000).collect()
    assert {r.doc_id: (r.text, r.label) for r in sample} == {k: (f"text {k}", k % 2) for k in set(range(400)) - held}
    assert labelled_sample(df, F.col("doc_id"), F.col("text"), df, F.col("doc_id"), F.lit(1), 25).count() == 25
    documents = langid.training_documents(df, F.col("doc_id"), F.col("text"), F.col("lang")).collect()
    assert {r.doc_id for r in documents} == set(range(400)) - held


def test_samples_do_not_depend_on_how_rows_are_dealt(spark):
    """Repeated ids with conflicting labels, languages and texts, and ids that most rows share."""
    rng = np.random.default_rng(4)
    rows = [(int(k) if k < 380 else None, f"{rng.choice(['good', 'bad', 'odd'])} text {rng.integers(0, 3)}", str(rng.choice(["en", "de"])), int(rng.integers(0, 2))) for k in [*rng.integers(0, 400, 900), *[7] * 900, *[8] * 400, *[399] * 100]]
    found = []
    for df in (spark.createDataFrame(rows, "doc_id long, text string, lang string, label int").repartition(7), spark.createDataFrame(rows[::-1], "doc_id long, text string, lang string, label int").coalesce(1)):
        sample = labelled_sample(df, F.col("doc_id"), F.col("text"), df, F.col("doc_id"), F.col("label"), 100)
        documents = langid.training_documents(df, F.col("doc_id"), F.col("text"), F.col("lang"), 80)
        windows = langid.training_windows(documents, 50)
        found.append([sorted(map(tuple, d.collect())) for d in (sample, documents, windows)])
        network = langid.train(df, F.col("doc_id"), F.col("text"), F.col("lang"), 80)
        ranking = quality.train(df, F.col("doc_id"), F.col("text"), df, F.col("doc_id"), F.col("label"), 100)
        found[-1] += [network.documents([b"good text"]).tolist(), ranking.weights.tolist()]
    assert found[0] == found[1]
    assert len(found[0][0]) == len({r[0] for r in found[0][0]}) == 100 and len(found[0][1]) == 80 and len(found[0][2]) == 50


def test_windows_cover_whole_texts(spark):
    texts = ["a" * 64 * 700 + "the end", "short", "", "é" * 100]
    df = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {}
    for r in sorted(langid.training_windows(df).collect(), key=lambda r: (r["key"], r["at"])):
        got[r["key"]] = got.get(r["key"], b"") + bytes(r["bytes"])
    assert sorted(x.rstrip(b" ") for x in got.values()) == sorted(t.encode() for t in texts if t)


def test_rare_languages_are_learned(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.when(F.col("id") % 800 == 0, "rare").otherwise("usual").alias("lang"))
    langs = [r.lang for r in langid.training_documents(df, F.col("doc_id"), F.col("text"), F.col("lang"), 100).collect()]
    assert langs.count("usual") == 50 and langs.count("rare") >= 2


def test_network_equals_one_position_after_another():
    rng = np.random.default_rng(8)
    net = langid.Network(["a", "b", "c"], units=3)
    texts = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (1, 5, langid.WINDOW, langid.WINDOW + 7)]
    sigmoid = lambda x: 1 / (1 + math.exp(-x))

    def walk(way, codes):
        u, state, out = way.units, [0.0] * way.units, []
        for code in codes:
            past = [sum(float(way.across[g, j]) * state[j] for j in range(u)) for g in range(3 * u)]
            fed = [float(way.into[g, code]) for g in range(3 * u)]
            hold, reset = ([sigmoid(fed[k * u + j] + past[k * u + j]) for j in range(u)] for k in (0, 1))
            fresh = [math.tanh(fed[2 * u + j] + reset[j] * past[2 * u + j]) for j in range(u)]
            state = [hold[j] * state[j] + (1 - hold[j]) * fresh[j] for j in range(u)]
            out.append(state)
        return out

    for text, row in zip(texts, net.documents(texts), strict=True):
        total = [0.0] * 3
        for at in range(0, len(text), langid.WINDOW):
            codes = list(text[at : at + langid.WINDOW].ljust(langid.WINDOW))
            ahead, behind = walk(net.ways[0], codes), walk(net.ways[1], codes[::-1])[::-1]
            for t in range(len(text[at : at + langid.WINDOW])):
                state = ahead[t] + behind[t]
                raised = [math.exp(sum(float(net.out[k, j]) * state[j] for j in range(6)) + float(net.bias[k, 0])) for k in range(3)]
                total = [a + b / sum(raised) for a, b in zip(total, raised, strict=True)]
        assert row == pytest.approx([x / len(text) for x in total], abs=1e-4)


def test_ranking_equals_a_plain_gradient_loop(monkeypatch):
    monkeypatch.setattr(quality, "PAIRS", 40)
    monkeypatch.setattr(quality, "PASSES", 25)
    rng = np.random.default_rng(6)
    rows, good = rng.normal(size=(30, 3)) + [1, 2, 3], np.array([0, 1, 1] * 10)
    ranking = quality.Ranking(rows, good)
    columns = list(zip(*rows.tolist(), strict=True))
    middle = [sum(c) / 30 for c in columns]
    spread = [math.sqrt(sum((x - m) ** 2 for x in c) / 30) + 1e-6 for c, m in zip(columns, middle, strict=True)]
    x = [[max(-8, min(8, (r[j] - middle[j]) / spread[j])) for j in range(3)] for r in rows.tolist()]
    draw = np.random.default_rng(5)
    better, worse = draw.choice(np.flatnonzero(good == 1), 40).tolist(), draw.choice(np.flatnonzero(good == 0), 40).tolist()
    weights, speed = [0.0] * 3, [0.0] * 3
    for _ in range(25):
        slope = [-1e-3 * w for w in weights]
        for a, b in zip(better, worse, strict=True):
            lost = 1 / (1 + math.exp(sum(w * (p - q) for w, p, q in zip(weights, x[a], x[b], strict=True))))
            slope = [s + lost * (p - q) / 40 for s, p, q in zip(slope, x[a], x[b], strict=True)]
        speed = [0.9 * v + 0.5 * s for v, s in zip(speed, slope, strict=True)]
        weights = [w + v for w, v in zip(weights, speed, strict=True)]
    assert ranking.weights == pytest.approx(weights, rel=1e-9)
    strength = sorted(sum(w * v for w, v in zip(weights, r, strict=True)) for r in x)
    assert strength[9] <= ranking.threshold <= strength[10]


def test_trees_equal_an_exhaustive_search(monkeypatch):
    rng = np.random.default_rng(7)
    rows = rng.integers(0, 6, (120, 4)).astype(float)
    wanted = ((rows[:, 1] > 2) & (rows[:, 3] < 4) | (rng.random(120) < 0.1)).astype(float)
    monkeypatch.setattr(toxicity, "TREES", 3)
    trees = toxicity.Trees(rows, wanted)
    codes = trees.codes(rows).tolist()
    total = [trees.start] * 120

    def grow(members, slope, curve, depth):
        """The value of each row by trying every feature and every cut at every node."""
        g, h = sum(slope[k] for k in members), sum(curve[k] for k in members)
        if depth == toxicity.DEPTH:
            return {k: toxicity.RATE * g / (h + 1) for k in members}
        best, chosen = 1e-9, None
        for f in range(4):
            for cut in range(toxicity.BINS + 2):
                left = [k for k in members if codes[k][f] <= cut]
                if min(len(left), len(members) - len(left)) < toxicity.LEAST_LEAF:
                    continue
                gl, hl = sum(slope[k] for k in left), sum(curve[k] for k in left)
                gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                if gain > best + 1e-12:
                    best, chosen = gain, (f, cut)
        if chosen is None:
            return grow(members, slope, curve, depth + 1) if members else {}
        left = [k for k in members if codes[k][chosen[0]] <= chosen[1]]
        right = [k for k in members if codes[k][chosen[0]] > chosen[1]]
        return grow(left, slope, curve, depth + 1) | grow(right, slope, curve, depth + 1)

    for _ in range(3):
        chance = [1 / (1 + math.exp(-t)) for t in total]
        values = grow(list(range(120)), [w - c for w, c in zip(wanted.tolist(), chance, strict=True)], [c * (1 - c) for c in chance], 0)
        total = [t + values[k] for k, t in enumerate(total)]
    assert trees.raw(rows) == pytest.approx(total, rel=1e-9)


def slow_lexicon(texts, toxic):
    """Counts in plain dictionaries, one text after another."""
    n, m = sum(toxic), len(toxic) - sum(toxic)
    cores = [[toxicity.plain(w) for w in t.split()] for t in texts]
    parts = [{e for w in c for e in toxicity.entries_of(w)} for c in cores]
    out = []
    for entry in set().union(*parts):
        bad, good = (sum(entry in p for p, y in zip(parts, toxic, strict=True) if y == side) for side in (1, 0))
        ratio = bad / n / ((good + 0.5) / m)
        if bad < max(toxicity.SEEN, toxicity.SEEN_SHARE * n) or ratio < toxicity.LIKELIER:
            continue
        if entry.endswith("-"):
            held = {w: sum(w in c for c, y in zip(cores, toxic, strict=True) if y) for w in {w for c in cores for w in c if w.startswith(entry[:-1]) and len(w) >= len(entry)}}
            held = {w: c for w, c in held.items() if c}
            own = len(held) >= toxicity.VARIETY and 2 * max(held.values()) < bad
        else:
            own = len({f for c, y in zip(cores, toxic, strict=True) if y for w, f in zip(c, [*c[1:], ""], strict=True) if w == entry}) >= min(toxicity.FOLLOWERS, bad / 2)
        if own:
            out.append((-ratio, entry))
    return frozenset(e for _, e in sorted(out)[: toxicity.ENTRIES])


def sentences(rng, n):
    return " ".join(rng.choice(WORDS["en"].split(), n)) + "."


@pytest.fixture(scope="module")
def rated():
    rng = np.random.default_rng(2)
    good = [sentences(rng, rng.integers(5, 80)) for _ in range(150)]
    bad = [" ".join(w + rng.choice(["$$$", "%%%"]) for w in sentences(rng, 20).split()) for _ in range(25)] + [sentences(rng, 20).upper().replace(" ", "!! ") for _ in range(25)]
    return good, bad


def test_quality_ranks_and_parts(rated, odd_documents, no_documents):
    good, bad = rated
    texts, marks = good + bad, np.array([1] * len(good) + [0] * len(bad))
    ranking = quality.Ranking(np.array([quality.features(t) for t in texts[::2]]), marks[::2])
    scores = quality.text_scores(ranking, texts[1::2])
    assert ((scores >= quality.THRESHOLD) == marks[1::2]).mean() > 0.97
    got = quality.score_quality(odd_documents, F.col("text"), ranking, "doc_id").collect()
    assert len(got) == odd_documents.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert got[2].score == got[3].score == got[6].score
    assert quality.score_quality(no_documents, F.col("text"), ranking, "doc_id").count() == 0
    assert quality.keep_good(odd_documents, F.col("text"), None).count() == odd_documents.count()


def test_toxicity(spark, odd_documents, no_documents):
    rng = np.random.default_rng(3)
    insults = ["grumblo", "snarkit", "blechhead"]
    clean = [sentences(rng, rng.integers(10, 80)) for _ in range(400)]
    toxic = []
    for _ in range(80):
        words = sentences(rng, rng.integers(10, 60)).split()
        for k in rng.integers(0, len(words), 3):
            words[k] = rng.choice(insults)
        toxic.append(" ".join(words))
    order = rng.permutation(len(clean) + len(toxic))
    texts, marks = [(clean + toxic)[k] for k in order], np.array([int(k >= len(clean)) for k in order])
    known = spark.createDataFrame([(k, t, int(y)) for k, (t, y) in enumerate(zip(texts[:320], marks[:320], strict=True))], "doc_id long, text string, label int")
    assert toxicity.learned_lexicon(known) == slow_lexicon(texts[:320], marks[:320].tolist())
    model = toxicity.fit(known.repartition(5))
    assert set(insults) <= model.lexicon
    assert toxicity.fit(known.where("label = 1")) is None
    scores = model.text_scores(texts[320:], toxicity._Marks(model.lexicon))
    assert ((scores >= toxicity.THRESHOLD) == marks[320:]).mean() > 0.97 and scores.min() >= 0 and scores.max() <= 1
    got = toxicity.score_toxicity(odd_documents, F.col("text"), model, "doc_id").collect()
    assert len(got) == odd_documents.count() and got[2].score == got[3].score and got[0] == got[1]
    assert toxicity.score_toxicity(no_documents, F.col("text"), model, "doc_id").count() == 0


def test_undoing_obfuscation():
    marks = toxicity._Marks(frozenset({"grumblo", "abcd-"}))
    assert marks["Gr0mbl0"] & toxicity.OBFUSCATED and not marks["Gr0mbl0"] & toxicity.UNDONE
    assert marks["grum8lo"] & toxicity.UNDONE and marks["g.r.u.m.b.l.o"] & toxicity.UNDONE and marks["grumbloooo"] & toxicity.UNDONE
    assert marks["grumblo!!"] & toxicity.LEXICON and marks["abcdef"] & toxicity.BEGINNING and marks["You"] & toxicity.PERSON and not marks["abc"]


def test_isotonic_rises_and_keeps_the_mean():
    rng = np.random.default_rng(5)
    raw = rng.normal(size=300)
    wanted = (rng.random(300) < 1 / (1 + np.exp(-2 * raw))).astype(float)
    centres, heights = toxicity.isotonic(raw, wanted)
    assert (np.diff(heights) > 0).all() and (np.diff(centres) >= 0).all() and 0 <= heights.min() and heights.max() <= 1


def test_all_labelled_texts_count_for_quality(spark, rated, monkeypatch):
    """More labels than any sample; the threshold is the gap at the bad share of all of them, whatever the bins."""
    monkeypatch.setattr(quality, "PAIRS", 300)
    monkeypatch.setattr(quality, "BINS", 4)
    good, bad = rated
    rows = [(k, f"{(good if k % 10 else bad)[k % 50]} n{k}" if k % 10 else f"{bad[k % 50]} n{k}", int(k % 10 > 0)) for k in range(7000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    learned = {r.doc_id for r in df.where(~common.held_out(F.col("doc_id"))).collect()}
    assert len(learned) > 4000
    ranking = quality.train(df, F.col("doc_id"), F.col("text"), df, F.col("doc_id"), F.col("label"))
    kept = [r for r in rows if r[0] in learned]
    x = np.array([quality.features(t) for _, t, _ in kept])
    assert ranking.middle == pytest.approx(x.mean(axis=0)) and ranking.spread == pytest.approx(x.std(axis=0) + 1e-6, abs=2e-6)
    strength = np.sort(quality.strengths(ranking.standard(x), ranking.weights))
    share = sum(not r[2] for r in kept)
    assert ranking.threshold == pytest.approx((strength[share - 1] + strength[share]) / 2)
    scores = quality.text_scores(ranking, [t for _, t, _ in rows])
    assert ((scores >= quality.THRESHOLD) == [r[2] for r in rows]).mean() > 0.97
    labelled = spark.createDataFrame([(r[0], r[2], list(map(float, quality.features(r[1])))) for r in kept], "doc_id long, label int, x array<double>")
    places = quality.numbered(common.checkpointed(labelled.repartition(5))).select("label", "place").collect()
    assert sorted(map(tuple, places)) == [(k, p) for k in (0, 1) for p in range([share, len(kept) - share][k])]
