import hashlib
import math
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meterglass.llm import common, html_text, telephony


def slow_adpcm(block: bytes) -> list[int]:
    """One nibble after another, as the format describes it."""
    sample, index = int.from_bytes(block[:2], "little", signed=True), min(88, block[2])
    out = [sample]
    for byte in block[4:]:
        for nibble in (byte & 15, byte >> 4):
            step = telephony.STEPS[index]
            change = step >> 3
            for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                change += part if nibble & bit else 0
            sample = max(-32768, min(32767, sample - change if nibble & 8 else sample + change))
            index = max(0, min(88, index + telephony.INDEX_CHANGES[nibble & 7]))
            out.append(sample)
    return out


def test_adpcm_equals_one_nibble_after_another():
    rng = np.random.default_rng(0)
    blocks = rng.integers(0, 256, (20, telephony.BLOCK), dtype=np.uint8)
    got = telephony.decode_adpcm(blocks)
    assert [row.tolist() for row in got] == [slow_adpcm(b.tobytes()) for b in blocks]


def test_expansion_tables():
    mu, a = telephony.MULAW, telephony.ALAW
    assert (mu[0xFF], mu[0x7F], mu[0x00], mu[0x80]) == (0, 0, -32124, 32124)
    assert (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)
    # both codes are odd around zero and rise with the code
    assert sorted(set(mu.tolist())) == sorted({-x for x in mu.tolist()}) and len(set(a.tolist())) == 256


@pytest.mark.parametrize("codec", ["mulaw", "alaw", "adpcm", "pcm"])
def test_files_give_their_bytes_back(codec):
    for raw in (b"", b"a", bytes(range(256)) * 7):
        payload = telephony.padded(raw)
        assert telephony.read_wav(telephony.write_wav(payload, codec)) == (codec, payload)
        assert len(payload) % telephony.BLOCK == 0 and payload.startswith(raw)
    assert telephony.read_wav(b"RIFFxxxx") is None and telephony.read_wav(None) is None


def test_upsampling_keeps_samples_and_constants():
    x = np.array([5, 5, 5, 5], np.int16)
    assert telephony.upsample(x).tolist() == [5] * 8
    ramp = np.arange(-1000, 1000, 10, dtype=np.int16)
    assert telephony.upsample(ramp)[0::2].tolist() == ramp.tolist() and abs(int(telephony.upsample(ramp)[101]) - (int(ramp[50]) + 5)) <= 1


def test_audio_of_odd_documents(spark, odd_documents, no_documents):
    stored = telephony.store_audio(odd_documents, F.col("text"), "doc_id", "keys")
    got = telephony.decode_audio(stored, F.col("media"), "doc_id", "n_bytes").collect()
    assert len(got) == odd_documents.count()
    for r, t in zip(got, odd_documents.collect(), strict=True):
        raw = (t.text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (t.doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        codec, samples = telephony.read_wav(r.pcm)
        assert codec == "pcm" and len(samples) == 4 * len(payload) and r.feature.endswith(f"pcm16k:{zlib.crc32(samples):08x}")
    assert got[0].feature == got[1].feature and got[0].media_sha256 == got[1].media_sha256
    assert telephony.decode_audio(telephony.store_audio(no_documents, F.col("text"), "doc_id"), F.col("media"), "doc_id").count() == 0
    broken = spark.createDataFrame([(1, None), (2, b"no file")], "doc_id long, media binary")
    assert [r.feature for r in telephony.decode_audio(broken, F.col("media"), "doc_id").collect()] == [None, None]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x = "</p><p>not text";</script></head><body>
<header class="site-header"><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site to please you.</div><div class="ad">Buy now and save a lot of money today</div>
<article><header><h1>Head&amp;line</h1></header><p>First   paragraph with <b>bo</b>ld and &eacute;.<br>It goes on
for a while, as paragraphs do.<p>Short.<p>Another paragraph that is long enough to be content, surely it is.</p>
<form><p>Your e-mail address</p><input name=a></form><aside>Read this too, it is very good and interesting</aside></article>
<section id="comments"><p>I am a reader and I have a long opinion about all of this, as readers do.</p></section>
<footer>&copy; nobody &middot; all rights reserved</footer></body></html>"""


def test_main_text():
    want = "Head&line First paragraph with bold and é. It goes on for a while, as paragraphs do. Short. Another paragraph that is long enough to be content, surely it is."
    assert html_text.main_text(PAGE) == want


@pytest.mark.parametrize(("html", "text"), [(None, ""), ("", ""), ("no markup at all", "no markup at all"), ("<p>a</p><p>b", "a b"), ("<html><body></body></html>", ""), ("<article><p>cut off &amp; open <b>wo", "cut off & open wo"), ("<div><p>x</p></div></div></p></span>", "x")])
def test_small_pages(html, text):
    assert html_text.main_text(html) == text


def test_a_page_without_semantic_elements():
    body = "".join(f"<p>Paragraph {k} of the story has quite some words in it, and they all count here.</p>" for k in range(6))
    page = f'<body><div id="top"><a href=a>One</a> <a href=b>Two</a> <a href=c>Three</a></div><div id="story">{body}</div><div id="end"><ul><li><a href=a>x</a><li><a href=b>y</a><li><a href=c>z</a></ul></div></body>'
    assert html_text.main_text(page) == " ".join(f"Paragraph {k} of the story has quite some words in it, and they all count here." for k in range(6))


def test_names_of_surroundings_do_not_hide_content():
    page = '<div class="layout has-sidebar"><div class="post"><div class="post-header"><h1>Title</h1></div><p>Text of the story, long enough to count for something.</p></div><div class="sidebar-left">Other things that are not part of it at all</div></div>'
    assert html_text.main_text(page) == "Title Text of the story, long enough to count for something."
    assert html_text.main_text('<div class="widget"><p>All that there is.</p></div>') == "All that there is."
    short = "<div><p>A long line of text that stands outside of it all, and says a lot about other things than the story.</p></div><article><h1>Hi</h1><p>Short one, but ours.</p></article>"
    assert html_text.main_text(short) == "Hi Short one, but ours."


def story(name, n):
    return [f"{name} {k} of the story has quite some words in it, and they all count here." for k in range(n)]


@pytest.mark.parametrize("outer", ["article", "main", "div"])
@pytest.mark.parametrize(("begin", "end"), [("<div class=body>", "</div>"), ("<section>", "</section>"), ("<blockquote>", "</blockquote>"), ("<table><tr><td>", "</td></tr></table>"), ("<div><section><div>", "</div></section></div>")])
def test_an_inner_container_is_not_the_whole_article(outer, begin, end):
    long, last = story("Long paragraph", 7), story("Last section", 3)
    p = lambda texts: "".join(f"<p>{t}</p>" for t in texts)
    links = "".join(f'<p><a href="/{k}">Other page {k}</a></p>' for k in range(4))
    page = f"<body><div>{links}</div><{outer}><h1>Title</h1><p>A lead of a few words.</p>{begin}{p(long)}{end}<section>{p(last)}</section></{outer}><div>{links}</div></body>"
    assert html_text.main_text(page) == " ".join(["Title", "A lead of a few words.", *long, *last])


def test_an_article_within_an_article_and_main():
    long, rest = story("Cited post", 8), story("Own words", 2)
    page = f"<main><p>Elsewhere: <a href=a>one thing</a></p><article><h1>Title</h1><p>{rest[0]}</p><article><p>{'</p><p>'.join(long)}</p></article><p>{rest[1]}</p></article></main>"
    assert html_text.main_text(page) == " ".join(["Title", rest[0], *long, rest[1]])


def test_a_region_does_not_grow_by_links():
    long = story("Paragraph", 8)
    side = "".join(f'<p>See <a href="/{k}">another page that we have, number {k}</a></p>' for k in range(4))
    assert html_text.main_text(f"<body><div><div>{side}</div><div><p>{'</p><p>'.join(long)}</p></div></div></body>") == " ".join(long)


def test_names_within_an_article_do_not_hide_its_text():
    text, refs = story("Paragraph", 3), [f"Reference {k}" for k in range(4)]
    links = "".join(f'<li><a href="/{k}">{t}</a></li>' for k, t in enumerate(refs))
    parts = [
        '<h2 id="related-work">Related work</h2>', f'<section id="search"><p>{text[0]}</p></section>', '<h2 class="share-prices">Share prices</h2>',
        f'<div class="elementor-widget-text-editor"><p>{text[1]}</p></div>', f'<div id="login"><p>{text[2]}</p>', "</div>", f"<h2>References</h2><ol>{links}</ol>",
    ]
    gone = [
        '<div class="share"><p>Tell your friends about it</p></div>', f'<div class="related-posts"><ul>{links}</ul></div>', '<div id="comments"><p>I am a reader and I have an opinion.</p></div>',
        f'<div class="comment-list"><p>{text[0]}</p></div>', f'<nav><ul>{links}</ul></nav>',
    ]
    page = f"<body><article><h1>Title</h1>{''.join(parts)}{''.join(gone)}</article></body>"
    assert html_text.main_text(page) == " ".join(["Title", "Related work", text[0], "Share prices", text[1], text[2], "References", *refs])
    cut = f'<main><p>{text[0]}</p><div class="post-related"><p><a href="/a">Another page'
    assert html_text.main_text(cut) == text[0]


def slow_main_text(page):
    """Ratios, smoothing, threshold, votes and growth by plain loops over lines and their chains of containers."""
    for hints in (True, False):
        parser = html_text.Lines(hints)
        parser.feed(page)
        parser.close()
        parser.finish()
        if parser.lines:
            break
    else:
        return ""
    lines, kinds = parser.lines, parser.kinds
    chains = []
    for line in lines:
        chain, c = [], line.container
        while c:
            chain.insert(0, c)
            c = parser.parents[c]
        chains.append(chain)
    plain = [max(0, len(n.text) - n.links) for n in lines]
    raw = [p / max(1, n.tags) for p, n in zip(plain, lines, strict=True)]
    ratios = []
    for k in range(len(raw)):
        near = [(math.exp(-0.5 * (d / html_text.SIGMA) ** 2), raw[k + d]) for d in range(-3, 4) if 0 <= k + d < len(raw)]
        ratios.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
    mean = sum(ratios) / len(ratios)
    bound = html_text.SPREADS * math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios))
    upper = [r >= bound and p > 0 for r, p in zip(ratios, plain, strict=True)]
    if not any(upper):
        upper = [True] * len(lines)
    link = [n.links >= 0.9 * len(n.text) for n in lines]
    menu = [any(all(0 <= j < len(lines) and link[j] for j in range(k - s, k - s + 3)) for s in range(3)) for k in range(len(lines))]
    weight = [(max(p, 1) * (html_text.ARTICLE_WEIGHT if n.inside else 1)) * u for p, n, u in zip(plain, lines, upper, strict=True)]
    votes = {c: sum(w for w, chain in zip(weight, chains, strict=True) if c in chain) for c in range(1, len(kinds))}
    depth = {c: next((chain.index(c) for chain in chains if c in chain), 0) for c in votes}
    held = [c for c in votes if votes[c] >= html_text.REGION_SHARE * sum(weight)]
    region = next((min((c for c in held if kinds[c] == kind), key=depth.get) for kind in ("article", "main") if any(kinds[c] == kind for c in held)), None)
    if region is None and held:
        region = max(held, key=lambda c: (depth[c], votes[c]))
        if not any(n.inside and region in chain for n, chain in zip(lines, chains, strict=True)):
            while parser.parents[region]:
                parent = parser.parents[region]
                added = [k for k, chain in enumerate(chains) if parent in chain and region not in chain and not menu[k]]
                if sum(plain[k] for k in added if upper[k]) < html_text.ADDED_SHARE * sum(len(lines[k].text) for k in added):
                    break
                region = parent
    whole = region is not None and kinds[region] in ("article", "main")
    return " ".join(n.text for n, chain, out in zip(lines, chains, menu, strict=True) if (whole or not out) and (region is None or region in chain))


def random_page(rng):
    out, open_tags = [], []
    for _ in range(rng.integers(5, 120)):
        kind = rng.integers(0, 10)
        if kind < 3:
            tag = str(rng.choice(["div", "section", "p", "article", "main", "ul", "li", "table", "td", "blockquote", "nav", "aside", "h2", "b", "span"], p=[0.2, 0.1, 0.15, 0.03, 0.02, 0.05, 0.1, 0.05, 0.05, 0.05, 0.03, 0.02, 0.05, 0.05, 0.05]))
            out.append(f"<{tag}{rng.choice(['', ' class=share', ' id=story', ' class=related-posts'], p=[0.85, 0.05, 0.05, 0.05])}>")
            open_tags.append(tag)
        elif kind < 5 and open_tags:
            out.append(f"</{open_tags.pop(int(rng.integers(0, len(open_tags)))) if rng.random() < 0.1 else open_tags.pop()}>")
        elif kind < 7:
            out.append(" ".join(["word"] * int(rng.integers(1, 40))))
        else:
            out.append(f"<p><a href=x>{' '.join(['link'] * int(rng.integers(1, 5)))}</a></p>" if rng.random() < 0.5 else f"<p>{' '.join(['text'] * int(rng.integers(1, 60)))}</p>")
    return "".join(out)


def test_random_pages_equal_plain_loops():
    rng = np.random.default_rng(11)
    pages = [random_page(rng) for _ in range(600)]
    assert sum(bool(html_text.main_text(p)) for p in pages) > 500
    for page in [*pages, PAGE]:
        assert html_text.main_text(page) == slow_main_text(html_text.whole_markup(page))


@pytest.mark.parametrize(("html", "text"), [
    ("<p>a</p><![foo[bar]]><p>b</p>", "a b"), ("<![endif]--><p>b</p>", "b"), ("<p>a</p><![if !IE]><p>b</p><![endif]>", "a b"), ("<p>a</p><![CDATA[x", "a"), ("<p>a<![", "a"),
    ("<p>a</p><!-- x", "a"), ("<p>a</p><!-- x --><p>b</p><!-- <p>c</p>", "a b"), ("<p>a</p><b", "a"), ("<p>a < b", "a < b"), ("<p>1 &lt; 2</p></", "1 < 2"),
    ('<!DOCTYPE html [<!ENTITY x "y">]><p>a</p>', "a"), ("<!DOCTYPE html><p>a</p>", "a"), ("<p>a</p><?php x", "a"),
])
def test_broken_markup(html, text):
    assert html_text.main_text(html) == text


@pytest.mark.parametrize("part", ["<div>", "<div><p>", "<b>", "<div class=share>", "<article>", "<p><li><b><h2>", "<ul><li>x", "</i>", "<", "<!", "<![x[", "&", "<a href='", "x<br>", "<a>"])
def test_long_pages_of_one_part(part):
    page = "<article><p>Some text.</p>" + "<b>" * 20_000 + part * (1_000_000 // len(part))
    start = time.process_time()
    got = html_text.main_text(page)
    assert got.startswith("Some text.") and time.process_time() - start < 12


def test_a_megabyte_of_open_elements_is_quick():
    for part in ("<div>", "<div><p>"):
        start = time.process_time()
        assert html_text.main_text("<p>a</p>" + part * (1_000_000 // len(part)) + "b") == "a b"
        assert time.process_time() - start < 8


def test_pages_operator(spark):
    schema = "page_id long, url string, html string, text string, keys string, n_chars long"
    rows = [(1, "u", PAGE, "x", "k", 5), (1, "u", PAGE, "x", "k", 5), (2, None, None, None, None, None), (None, "v", "", "y", "", 1)]
    df = spark.createDataFrame(rows, schema)
    got = html_text.extract_main_text(df, F.col("html"), "page_id", "url").collect()
    assert [(r.page_id, r.url, r.n_chars) for r in got] == [(1, "u", len(got[0].text)), (1, "u", len(got[0].text)), (2, None, 0), (None, "v", 0)] and got[2].text == got[3].text == ""
    assert html_text.extract_main_text(df, F.col("html"), "page_id", "keys").columns == ["page_id", "keys", "text", "n_chars"]
    assert html_text.extract_main_text(df.limit(0), F.col("html"), "page_id").count() == 0


ARTICLE = "<html><body><nav><a href=x>menu</a></nav><article><h1>Title</h1>" + "".join(f"<p>Sentence number {k} of the story.</p>" for k in range(20)) + "</article></body></html>"


@pytest.mark.parametrize("begin", ['<script>var x="<!--";</script>', '<p title="<!-- x">', "<!-- a --!>", "<style>/* <!-- */</style>", "<textarea><!-- </textarea>", "<title><!-- x</title>", "<!-->", "<!--->", "<script><!--\nf();\n</script>"])
def test_comments_begin_only_in_text(begin):
    want = html_text.main_text(ARTICLE)
    assert want.startswith("Title Sentence number 0") and want.endswith("19 of the story.")
    assert html_text.main_text(ARTICLE.replace("<body>", f"<body>{begin}")) == want
    assert html_text.main_text(ARTICLE.replace("<h1>", f"{begin}<h1>")) == want


def test_formulas_and_hidden_parts_of_an_article_stay():
    page = ARTICLE.replace("number 3", 'energy is <math><mi>E</mi><annotation encoding="TeX">E</annotation></math> <span hidden>indeed</span>')
    assert "energy is E indeed of the story" in html_text.main_text(page)
    assert html_text.main_text(ARTICLE.replace("<article>", '<div style="display:none">gone</div><article>')) == html_text.main_text(ARTICLE)


def test_many_open_titles_are_quick():
    start = time.perf_counter()
    html_text.main_text("<title>" * 100_000 + "<textarea>" * 50_000 + "<!--" * 100_000)
    assert time.perf_counter() - start < 15


def test_batches_are_bounded_by_bytes(spark, monkeypatch):
    batch = pa.RecordBatch.from_pydict({"n": list(range(1000)), "t": ["x" * (k % 90) for k in range(1000)]})
    parts = list(common.bounded(batch, 500))
    assert len(parts) > 100 and all(p.nbytes <= 500 or p.num_rows == 1 for p in parts)
    assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()
    assert list(common.bounded(batch.slice(0, 0), 500)) == [] and list(common.bounded(batch)) == [batch]
    # 1,000 texts whose samples are beyond the bound
    monkeypatch.setattr(common, "SLICE_BYTES", 2000)
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab "), (F.col("id") % 90).cast("int")).alias("text"))
    docs.write.mode("overwrite").parquet(f"{common.shared_folder(spark)}/bounded/documents.parquet")
    small = telephony.op2_telephony_audio(spark, f"{common.shared_folder(spark)}/bounded").select("doc_id", "media_sha256", F.md5("pcm"), "n_bytes").collect()
    monkeypatch.undo()
    whole = telephony.op2_telephony_audio(spark, f"{common.shared_folder(spark)}/bounded").select("doc_id", "media_sha256", F.md5("pcm"), "n_bytes").collect()
    assert sorted(small) == sorted(whole) and len(small) == 1000
