"""Small tables with every edge, each operator against a plain restatement in Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lapframe.llm import components, decontaminate, exact_dedup, html_text, minhash, packing, phrase_dedup, quality, sst, store, suffix_dedup, tokens, toxicity

SPACE = re.compile(r"[\x20\x09-\x0D]")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
KIND = "doc_id long, text string, score double, h long, key string"


def corpus() -> list[tuple]:
    rng = random.Random(5)
    vocab = ["a", "b", "Ç", "é", "the", "of", "ZZ", "x1", "-", "über", "naïve", "日本"] + [f"w{i}" for i in range(40)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage = " ".join(f"p{i % 37}q{i}" for i in range(80))
    base = prose(120)
    texts = [base, base, base + " ", base.replace(" ", "\n", 3), None, "", " \t ", "one", "ONE", "one two three", passage, prose(30) + " " + passage + " " + prose(20), passage.upper(), prose(3000), "x " * 400, "x " * 300 + "tail"]
    for i in range(60):  # near copies of one text
        words = base.split()
        for _ in range(i % 7):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10_000)}"
        texts.append(" ".join(words))
    for _ in range(20):
        texts.append(prose(rng.randrange(1, 200)))
    texts += ["a\x00b c", "tab\tsep\x0bvert\x0cform", "don't it's 1234 $$$ <|endoftext|> é×ß"]
    rows = [(i * 3 % 1009, t, 1.0, 7, "k") for i, t in enumerate(texts)]
    return rows + [(None, "a null id " + base, None, None, None), rows[0], rows[5]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), KIND).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


def words(text, lower=False):
    text = (text or "").translate(LOWER) if lower else text or ""
    return [w for w in SPACE.split(text) if w]


def shingles(text):
    w = words(text, True)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_expected(rows):
    sets = {}
    for d, t, *_ in rows:
        if d is not None:
            sets.setdefault(d, shingles(t))
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize("hot", [50, 3])
def test_near_duplicates(docs, monkeypatch, hot):
    monkeypatch.setattr(minhash, "HOT_LIST", hot)
    monkeypatch.setattr(minhash, "BLOCK_SETS", 7)
    monkeypatch.setattr(store, "HOT_ROWS", hot)
    want = near_expected(corpus())
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(corpus())
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.component_id == r.doc_id)


@pytest.mark.parametrize("order", ["adverse", "random"])
def test_near_duplicates_of_a_long_chain(spark, order):
    rng = random.Random(11)
    story = [f"s{rng.randrange(10**9)}" for _ in range(24 * 299 + 204)]
    ids = list(range(2, 301)) + [1] if order == "adverse" else rng.sample(range(1, 301), 300)
    rows = [(d, " ".join(story[24 * i : 24 * i + 204])) for i, d in enumerate(ids)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 300 and {r.component_id for r in got} == {1} and [r.doc_id for r in got if r.kept] == [1]
    edges = list(zip(ids, ids[1:], strict=False)) + [(1000, 1001), (1003, 1002), (1003, 1000), (2000, 2001)]
    labels = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.v: r.label for r in labels} == dict.fromkeys(ids, 1) | dict.fromkeys(range(1000, 1004), 1000) | {2000: 2000, 2001: 2000}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def removal_expected(rows):
    first = {}
    for d, t, *_ in rows:
        w = words(t)
        if d is not None:
            for i in range(len(w) - 49):
                k = tuple(w[i : i + 50])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, t, *_ in rows:
        w = words(t)
        gone = set()
        if d is not None:
            for i in range(len(w) - 49):
                if first[tuple(w[i : i + 50])] < d:
                    gone.update(range(i, i + 50))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("run", [suffix_dedup.remove_repeated_passages, phrase_dedup.remove_repeated_phrases])
def test_repeated_passages(docs, run, monkeypatch):
    monkeypatch.setattr(phrase_dedup, "SHARD_WORDS", 60)
    monkeypatch.setattr(phrase_dedup, "BUNDLE_WORDS", 70)
    monkeypatch.setattr(store, "HOT_ROWS", 1)
    monkeypatch.setattr(store, "HOT_SHARE", 50)
    monkeypatch.setattr(suffix_dedup, "WAITING", 2)
    monkeypatch.setattr(phrase_dedup, "GROUP_WORDS", 500)
    assert sorted((tuple(r) for r in run(docs).collect()), key=str) == removal_expected(corpus())


def test_exact(docs, monkeypatch):
    for hot in (256, 1):
        monkeypatch.setattr(exact_dedup, "HOT_ROWS", hot)
        groups = {}
        for d, t, *_ in corpus():
            groups.setdefault(SPACE.sub("", t or ""), []).append((-len(t or ""), d is None, d))
        got = exact_dedup.exact_dedup(docs).collect()
        assert len(got) == len(corpus())
        by_sha = {hashlib.sha256(n.encode()).hexdigest(): sorted(g, key=lambda x: x[:2] + (x[2] or 0,)) for n, g in groups.items()}
        for r in got:
            g = by_sha[r.text_sha256]
            assert r.group_size == len(g) and r.keep_id == g[0][2] and r.kept == (r.doc_id == g[0][2])


ITEMS = [(1, " ".join(f"p{i % 37}q{i}" for i in range(20))), (2, "one two"), (3, None), (4, "  "), (5, "w1 w2 w3"), (None, "one two three"), (1, "one two")]


def test_decontaminate(docs, spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    cut = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    toks = lambda t: cut.findall((t or "").translate(LOWER))
    windows = {}
    for i, t in ITEMS:
        w = toks(t)
        for j in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[j : j + 13]), set()).update({str(i)} if i is not None else set())
    want = []
    for d, t, *_ in corpus():
        w, hit, names = toks(t), set(), set()
        for k, ids in windows.items():
            for j in range(len(w) - len(k) + 1):
                if tuple(w[j : j + len(k)]) == k:
                    hit.update(range(j, j + len(k)))
                    names |= ids
        want.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    got = [tuple(r) for r in decontaminate.decontaminate(docs, items).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    none = decontaminate.decontaminate(docs, items.limit(0)).collect()
    assert len(none) == len(want) and not any(r.contaminated for r in none)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_whole_texts(name):
    texts = [t for _, t, *_ in corpus()] + ["  two  spaces\n\n\nlines \n x", " lead", "trail  ", "\n", "'S 'LL don't", "ÀÉÎ xÉy café's", "a\tb\r\nc  \t d", "１２ ª º ǅ ﬁ İ"]
    enc = tokens.Encoder(public_tokenizers.path(name))
    got = [ids[a:b].tolist() for _, ids, at in enc.encode(pa.array(texts)) for a, b in zip(at, at[1:], strict=False)]
    assert got == [enc.whole(t or "").tolist() for t in texts]


def test_shards(docs, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    monkeypatch.setattr(sst, "BLOCK_BYTES", 400)
    manifest = sst.write_shards(docs, path)
    got = sorted(sst.read_shards(manifest).collect(), key=lambda r: r.start)
    enc = tokens.Encoder(path)
    want = {}
    for d, t, *_ in corpus():
        want.setdefault(d, []).append(np.append(enc.whole(t or ""), 0).astype("<u4").tobytes())
    assert len(got) == len(corpus()) and [r.doc_id is None for r in got][0]
    ids = [r.doc_id for r in got if r.doc_id is not None]
    assert ids == sorted(ids)
    at = 0
    for r in got:
        assert r.start == at and bytes(r.ids) in want[r.doc_id] and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    for d in list(want)[:12]:
        assert sst.lookup(manifest, d).astype("<u4").tobytes() in want[d]
    assert sst.lookup(manifest, 10**9) is None and sst.lookup(manifest, 1) is None


def test_packing(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack_documents(docs, path, capacity=256, keep_ids=True, group_size=20).collect()
    enc = tokens.Encoder(path)
    whole = sorted(np.append(enc.whole(t or ""), 0).astype("<u4").tobytes() for _, t, *_ in corpus())
    seqs, parts = {}, {}
    for r in got:
        assert 0 < r.length <= 256 and zlib.crc32(r.ids) == r.ids_crc32 and r.start == 256 * r.piece
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        parts.setdefault(r.doc_id, []).append(r)
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 256
    tokens_in = sum(len(w) // 4 for w in whole)
    assert sum(r.length for r in got) == tokens_in and len(seqs) <= 1.05 * -(-tokens_in // 256) + 1
    assert [b"".join(bytes(r.ids) for r in sorted(parts[0], key=lambda r: r.piece) if True)] and len(got) >= len(corpus())


def test_sum_of_squares_places_where_the_sum_is_smallest():
    sizes = np.array([5, 5, 3, 7, 2, 5, 8, 3, 1, 1, 6, 4])
    bins, offsets, fills = packing.sum_of_squares(sizes, 10)
    gaps: list[int] = []
    for s, b in zip(sizes.tolist(), bins.tolist(), strict=True):
        def total(g):
            return sum(g.count(x) ** 2 for x in set(g) if 0 < x < 10)

        options = {i: total(gaps[:i] + [g - s] + gaps[i + 1 :]) for i, g in enumerate(gaps) if g >= s} | {len(gaps): total(gaps + [10 - s])}
        assert options[b] == min(options.values())
        if b == len(gaps):
            gaps.append(10)
        gaps[b] -= s
    assert (10 - np.array(gaps) == fills).all() and offsets.min() == 0


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site-header"><a href="/">Home</a></header><nav><ul><li><a href="/a">menu</a></li></ul></nav><!-- ad --><div class="ad">Buy now</div>
<div id="cookie-notice">We use cookies on this site, please agree to all of them.</div>
<article><header><h1>Title &amp; more</h1></header><p><b>First   line<br>goes on.<p>Second&nbsp;para with a <a href="/x">link</a> inside and enough words to count.</p>
<ul><li>one item</li><li>two item</ul><form><input name=q>Search</form><script>x()</script>
<table><tr><td>a</td><td>b</td></tr></table><p>Last &copy; words of the article stand here.</p></article>
<aside>Related things to read</aside><div class="comments"><p>A reader says something long about all of this text.</p></div>
<footer>&copy; all rights</footer></body></html>"""


def test_html(spark):
    rows = [(1, "u", PAGE, 0), (2, "u", None, 0), (3, None, "", 0), (4, "u", "just text &lt; no markup", 0), (5, "u", "<p>open <b>tags <i>only", 0), (1, "u", PAGE, 0), (6, "u", "<" * 50 + "<!-- never closed", 0)]
    got = html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 7 and by[2].text == by[3].text == "" and by[4].text == "just text < no markup" and by[5].text == "open tags only"
    assert by[1].text == "Title & more\nFirst line goes on.\nSecond para with a link inside and enough words to count.\none item\ntwo item\na b\nLast © words of the article stand here."
    assert all(r.n_chars == len(r.text) for r in got)


def test_html_keeps_what_only_sounds_like_other_parts():
    said = [f"Sentence {i} of the article goes on with enough plain words to count as text." for i in range(8)]
    refs = "".join(f'<li><a href="/r{i}">Reference number {i} by its author</a></li>' for i in range(4))
    page = '<html><body><div class="{}"><div class="sidebar">Other pages and offers.</div><article><h2 id="related-work">Related work</h2><p>{}</p><h2 id="search-algorithms">Search</h2><section id="legal"><p id="share">{}</p></section><ul>{}</ul><div class="share-buttons">Tell friends</div></article></div></body></html>'
    want = ["Related work", " ".join(said[:4]), "Search", " ".join(said[4:])] + [f"Reference number {i} by its author" for i in range(4)]
    for wrapper in ("plain", "elementor-widget elementor-widget-text", "page right-sidebar", "widget"):
        assert html_text.main_text(page.format(wrapper, " ".join(said[:4]), " ".join(said[4:]), refs)) == "\n".join(want)


def labelled(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        w = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(20, 90))]
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["Vile", "vilest,", "horrid"])
        low = i % 7 == 0
        rows.append((i, " ".join(x + "%%%" if low else x for x in w)))
        labels.append((i, int(not low), int(bad)))
    rows += [(900, None), (901, ""), (None, "w1 vile"), (0, rows[0][1])]
    labels += [(None, 1, 1), (5, None, None), (0, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {a: (b, c) for a, b, c in labels if a is not None and a not in (0, 5)}


def test_toxicity(spark):
    d, y, truth = labelled(spark)
    got = toxicity.toxicity(d, y).collect()
    assert len(got) == 604 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [r for r in got if r.doc_id in truth and r.held_out]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in held)
    assert np.mean([r.predicted == truth[r.doc_id][1] for r in held]) > 0.95
    kept = toxicity.without_toxic(d, toxicity.train(d, y))
    assert kept.columns == d.columns and 450 < kept.count() < 560
    assert all(r.score < 1e-9 for r in toxicity.toxicity(d, y.limit(0)).collect())


def test_quality(spark):
    d, y, truth = labelled(spark)
    got = quality.quality(d, y).collect()
    held = [r for r in got if r.doc_id in truth and r.held_out]
    assert len(got) == 604 and held and np.mean([r.predicted == truth[r.doc_id][0] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert {r.score for r in quality.quality(d, y.limit(0)).collect()} == {0.5}


def test_quality_gradient():
    rng = np.random.default_rng(0)
    p = {k: rng.normal(0, 0.3, s) for k, s in quality._SHAPES.items() if k not in ("mean", "sd")}
    x, at, y, share = rng.normal(0, 1, (9, quality.N_FEATURES)), np.array([0, 4, 9]), np.array([1, 0]), np.array([0.5, 0.5])
    loss = lambda: float(-(share * (y * np.log(s := quality._forward(p, x, at)[0]) + (1 - y) * np.log(1 - s))).sum())
    grads = quality._gradient(p, x, at, y, share)
    for k, v in p.items():
        i = tuple(rng.integers(0, n) for n in v.shape)
        keep = v[i]
        v[i] = keep + 1e-6
        up = loss()
        v[i] = keep - 1e-6
        down = loss()
        v[i] = keep
        assert grads[k][i] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_empty_tables(empty, spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert minhash.near_duplicates(empty).count() == 0
    assert suffix_dedup.remove_repeated_passages(empty).count() == 0
    assert phrase_dedup.remove_repeated_phrases(empty).count() == 0
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert decontaminate.decontaminate(empty, items).count() == 0
    assert packing.pack_documents(empty, path).count() == 0
    assert sst.read_shards(sst.write_shards(empty, path)).count() == 0
    assert toxicity.toxicity(empty, labels).count() == 0
    assert quality.quality(empty, labels).count() == 0
    assert html_text.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline_runs_its_stages(docs, spark, tmp_path):
    import corpus_pipeline

    d, y, _ = labelled(spark)
    docs.select("doc_id", "text").dropna(subset=["doc_id"]).withColumn("doc_id", F.col("doc_id") + 5000).unionByName(d.select("doc_id", "text")).withColumn("lang", F.lit("en")).write.parquet(f"{tmp_path}/documents.parquet")
    y.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    ids = {r.doc_id for r in got.select("doc_id").distinct().collect()}
    assert 5006 in ids and not ids & {5000, 5003, 5009}  # copies of one text: the longest stays
    assert not ids & {i for i in range(0, 600, 5) if i % 7 and i} or len(ids & set(range(0, 600, 5))) < 12


def test_rows_that_share_an_id_are_documents_of_their_own(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(17)
    prose = lambda n: " ".join(f"u{rng.randrange(10**6)}" for _ in range(n))
    a, b, c, d = prose(90), prose(80), prose(70), prose(60)
    near = a.rsplit(" ", 2)[0] + " other end"
    bad = "p0q0 p1q1 p2q2"
    rows = [(7, a), (7, b), (None, c), (None, d), (None, d), (None, d + " "), (8, b + " "), (9, near), (None, bad), (10, bad + " " + prose(40)), (10, prose(50)), (11, None), (11, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame([(1, bad)], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    for stage in (corpus_pipeline.drop_exact_copies, corpus_pipeline.drop_near_copies, corpus_pipeline.reject_contaminated):
        docs = stage(spark, docs, str(tmp_path))
    got = sorted((r.doc_id or 0, r.text or "") for r in docs.collect())
    assert got == sorted([(7, a), (0, c), (0, d + " "), (8, b + " "), (10, rows[10][1]), (11, "")])
    # Links of either text of an id count, and none is false.
    got = minhash.near_duplicates(spark.createDataFrame([(1, a), (2, b), (7, near), (7, b + " end"), (8, c), (7, d)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == sorted([(1, 86, 1, True), (2, 76, 2, True), (7, 86, 1, False), (7, 77, 2, False), (8, 66, 8, True), (7, 56, 7, True)])


def test_blocks_hold_every_link_between_components(spark):
    rng = random.Random(23)
    sets, rows = {}, []
    for i in range(240):  # a family of three sizes: linked, close and far sets
        base = [(i % 6) * 1000 + k for k in range(60 if i % 3 else 90)]
        own = set(rng.sample(base, len(base) - rng.randrange(0, 9))) | {10_000 + rng.randrange(3) for _ in range(2)}
        sets[i] = own
        rows.append((i, 0, i if i >= 100 else 0, len(own)))  # a large component, and members of their own
    member = minhash._in_blocks(spark.createDataFrame(rows, "id long, family long, label long, n int")).collect()
    pairs = {tuple(sorted(p)) for p in minhash._block_pairs(spark.createDataFrame(member)).collect()}
    block, label = {r.id: r.blk for r in member}, {r[0]: r[2] for r in rows}
    assert len(member) == 240
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and label[a] != label[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                assert tuple(sorted((block[a], block[b]))) in pairs


def test_decontamination_of_documents_full_of_hits(spark):
    """A long document of one word, and one that repeats an item throughout: time grows with length, results are exact."""
    import time

    item = " ".join(f"q{i}" for i in range(20))
    items = spark.createDataFrame([("same", "word " * 14), ("seq", item), ("short", "alpha beta")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "word " * 60_000), (2, (item + " ") * 4_000), (3, "x " * 50 + "alpha beta"), (4, "word " * 12)], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.decontaminate(docs, items).collect()}
    assert got == {1: (60_000, 60_000, 1, True), 2: (80_000, 80_000, 1, True), 3: (52, 2, 1, False), 4: (12, 0, 0, False)}
    assert time.time() - began < 120


def test_suffixes_of_a_periodic_text_wait_in_bounds(spark, monkeypatch):
    """Equal suffixes of one document beyond the bound: the same rows as with any other bound."""
    periodic = "a b c d e f g h i j " * 400
    rows = [(1, periodic), (2, "x " * 10 + periodic[:1200]), (3, "one " * 900), (4, "one " * 300), (5, "y " + "one " * 60 + "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = {}
    for bound in (3, 100_000):
        monkeypatch.setattr(suffix_dedup, "WAITING", bound)
        seen[bound] = sorted(map(tuple, suffix_dedup.remove_repeated_passages(docs).collect()))
    assert seen[3] == seen[100_000] == sorted(map(tuple, phrase_dedup.remove_repeated_phrases(docs).collect()))
