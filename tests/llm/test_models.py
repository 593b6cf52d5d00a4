"""Features and models against plain restatements."""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lapframe.llm import quality, sst, toxicity
from lapframe.llm.words import mix, pieces, word_hashes

TEXTS = ["One two three, two!", "", "Ça va bien? Überall", "a\tb  c\n\nlonger-words here123 WORDS", "x " * 150]
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def hash_of(word: bytes) -> int:
    data = np.frombuffer(word, np.uint8)
    return int(word_hashes(data, np.array([0]), np.array([len(word)]), True)[0])


def mixed(x: int) -> int:
    return int(mix(np.array([x % 2**64], np.uint64))[0])


def test_toxicity_features_one_by_one():
    for first, data, offsets in pieces(pa.array(TEXTS)):
        row, feat = toxicity._features(data, offsets)
        for i, text in enumerate(TEXTS[first : first + len(offsets) - 1]):
            words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", text.encode())
            want = [hash_of(w) for w in words]
            for gap, salt in ((1, 0x51), (2, 0xA7)):
                want += [mixed(hash_of(a) * (2 * salt + 1) + (hash_of(b) ^ salt)) for a, b in zip(words, words[gap:], strict=False)]
            want += [mixed(hash_of(w[:k]) + k) for k in toxicity.STEMS for w in words if len(w) > k]
            assert sorted(feat[row == i].tolist()) == sorted(x >> (64 - toxicity.BITS) for x in want)


def test_ftrl_one_coordinate_at_a_time():
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 40, 6)) for _ in range(80)]
    labels = np.array([int(3 in r or 5 in r) for r in rows])
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= toxicity.L1:
            return 0.0
        return -(z[i] - math.copysign(toxicity.L1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(3):
        for r, y in zip(rows, labels.tolist(), strict=True):
            at = [*r.tolist(), "bias"]
            w = {i: weight(i) for i in at}
            p = 1 / (1 + math.exp(-sum(w.values())))
            g = (p - y) * (toxicity.POSITIVE_WEIGHT if y else 1)
            for i in at:
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / toxicity.ALPHA * w[i]
                n[i] = old + g * g
    got, bias = toxicity.ftrl(rows, labels, 3)
    assert bias == pytest.approx(weight("bias"))
    assert [got[i] for i in range(40)] == pytest.approx([weight(i) for i in range(40)])
    assert np.count_nonzero(got[40:]) == 0 and 0 < np.count_nonzero(got) < 40


def test_cut_costs_least():
    rng = np.random.default_rng(5)
    for _ in range(50):
        n = int(rng.integers(2, 30))
        x, y = rng.integers(-5, 6, n).astype(float), rng.integers(0, 2, n)
        cut = toxicity.cut_between(x, y)
        if len(set(y.tolist())) < 2:
            assert cut is None
            continue
        cost = lambda c: toxicity.POSITIVE_WEIGHT * int(((x < c) & (y == 1)).sum()) + int(((x >= c) & (y == 0)).sum())  # noqa: B023, E731
        assert cost(cut) == min(cost(c) for c in [*(x - 0.5), *(x + 0.5)])


def test_quality_features_one_passage_at_a_time():
    kinds = lambda b: "a" if 97 <= b < 123 else "A" if 65 <= b < 91 else "0" if 48 <= b < 58 else "é" if b >= 128 else " " if b in b" \t" else "n" if b in b"\n\x0b\x0c\r" else "." if b in b".,;:!?'\"()-" else "%"
    for first, data, offsets in pieces(pa.array(TEXTS)):
        x, at = quality.passage_features(data, offsets)
        for i, text in enumerate(TEXTS[first : first + len(offsets) - 1]):
            raw = text.encode()
            spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
            assert at[i + 1] - at[i] == max(1, -(-len(spans) // quality.PASSAGE))
            for k in range(at[i + 1] - at[i]):
                own = spans[k * quality.PASSAGE : (k + 1) * quality.PASSAGE]
                rest = spans[(k + 1) * quality.PASSAGE :]
                part = raw[own[0][0] if own else 0 : rest[0][0] if rest else len(raw)]
                words, m = [raw[a:b] for a, b in own], max(len(own), 1)
                got = x[at[i] + k]
                assert got[:8] == pytest.approx([sum(kinds(b) == c for b in part) / max(len(part), 1) for c in "aA0 n.%é"], abs=1e-5)
                lengths = [len(w) for w in words] or [0]
                assert got[8:10] == pytest.approx([np.mean(lengths) / 10, np.std(lengths) / 10], abs=1e-4)
                assert got[10:13] == pytest.approx([sum(kinds(w[0]) == "A" for w in words) / m, sum(kinds(w[0]) in ".%" for w in words) / m, sum(kinds(w[-1]) == "%" for w in words) / m], abs=1e-5)
                assert got[13:16] == pytest.approx([math.log1p(len(words)) / 5, len({w.translate(LOWER) for w in words}) / m, math.log1p(len(spans)) / 10], abs=1e-5)
                bits = [mixed(hash_of(w)) for w in words]
                assert got[16:] == pytest.approx([sum(1 if b >> s & 1 else -1 for b in bits) / m for s in range(quality.SIGNS)], abs=1e-5)


def test_attention_one_bag_at_a_time():
    rng = np.random.default_rng(1)
    p = {k: rng.normal(0, 0.4, s) for k, s in quality._SHAPES.items()}
    x, at = rng.normal(0, 1, (7, quality.N_FEATURES)), [0, 3, 4, 7]
    sig = lambda v: 1 / (1 + math.exp(-v))
    for i, (a, b) in enumerate(zip(at, at[1:], strict=False)):
        codes = [np.maximum(row @ p["E"] + p["e"], 0) for row in x[a:b]]
        raw = [math.exp(sum(math.tanh(h @ p["V"][:, j]) * sig(h @ p["U"][:, j]) * p["w"][j] for j in range(quality.GATE))) for h in codes]
        z = sum(r / sum(raw) * h for r, h in zip(raw, codes, strict=True))
        assert quality._forward(p, x, np.array(at))[0][i] == pytest.approx(sig(z @ p["c"] + p["b"][0]))


def test_a_shard_is_bounded_by_documents_too(spark, monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(sst, "SHARD_DOCS", 1000)
    docs = spark.range(5000).selectExpr("id AS doc_id", "'' AS text").repartition(2)
    manifest = sst.write_shards(docs, public_tokenizers.path("byte_bpe_50k.json"))
    assert manifest.agg({"n_docs": "max"}).first()[0] == 1000 and manifest.count() >= 5
    got = sst.read_shards(manifest).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens) for r in got) == [(i, i, 1) for i in range(5000)]
    assert sst.lookup(manifest, 4321).tolist() == [0] and sst.lookup(manifest, 5000) is None


def test_the_filter_of_a_million_empty_documents():
    class Sink:
        size = 0

        def write(self, raw):
            self.size += len(raw)

    out = Sink()
    writer = sst.ShardWriter(out)
    for i in range(1_000_000):
        writer.add(sst.key_of(i), np.zeros(1, np.uint32))
    assert writer.close() == (1_000_000, 1_000_000, out.size)
    assert zlib.crc32(b"") == 0 and sst.file_store("file:///tmp/x")[1] == "/tmp/x"
