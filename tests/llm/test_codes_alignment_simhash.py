"""Vector codes, token alignment and SimHash groups against plain restatements."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tests.llm.test_operators import KIND, corpus, words

from lapframe.llm import alignment, simhash, vector_codes

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def docs(spark):
    long = " ".join(f"word{i % 977}" for i in range(90_000))  # over PIECE_BYTES
    more = [(5000, long, 0.5, 1, "k"), (5001, long + " end", 0.5, 1, "k"), (5002, "literal ▁ mark", 0.5, 1, "k"), (5003, "<s> </s> <0x41> <unk> 😀 　 ½", 0.5, 1, "k"), (None, None, None, None, None)]
    return spark.createDataFrame(corpus() + more, KIND).repartition(3).cache()


# Vector codes


def plain_codes(rows):
    kept = sorted(((i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    wide = -(-len(kept[0][1]) // 4)
    floor = lambda x: int(x) * 1024 if abs(x) >= 2**52 else math.floor(x * 1024)
    q = [[floor(x) for x in v] + [0] * (4 * wide - len(v)) for _, v, _ in kept]
    parts = [[row[p * wide : (p + 1) * wide] for p in range(4)] for row in q]
    books = [[row[p] for row in parts[:256]] for p in range(4)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(books[p]))

    for _ in range(4):
        for p in range(4):
            held = {}
            for row in parts:
                held.setdefault(near(p, row[p])[1], []).append(row[p])
            for e, xs in held.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)] if wide else []
    found = [[near(p, row[p]) for p in range(4)] for row in parts]
    errors, by_label = [min(vector_codes.MOST, sum(d for d, _ in f)) for f in found], Counter()
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] += e
    digest = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    return [(i, "".join(f"{e:02x}" for _, e in f), err, min(vector_codes.MOST, by_label[label]), digest) for (i, _, label), f, err in zip(kept, found, errors, strict=True)]


@pytest.mark.parametrize("wide,huge,n", [(8, 0.0, 700), (12, 1e6, 300), (10, 3e38, 60), (0, 0.0, 3), (4, 0.0, 40), (68, 0.0, 280)])
def test_vector_codes(spark, wide, huge, n):
    rng = random.Random(wide)
    rows = []
    for i in range(n):
        v = [float(np.float32(rng.choice([rng.gauss(0, 1), 0.0, 0.5, rng.gauss(0, 0.01)]))) for _ in range(wide)]
        if huge and i % 17 == 3:
            v[0] = -float(np.float32(huge))
        rows.append((i * 7 % 1009, v, rng.choice([None, 1, 2, 3])))
    rows += [rows[0], (2000, None, 1), (None, rows[1][1], None), (2003, [0.5] * (wide + 1), 1)]
    if wide:
        rows += [(2001, [None] * wide, 1), (2002, [float("nan")] + [0.0] * (wide - 1), 1), (-1, [float("inf")] * wide, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("code", F.lit("clash")).repartition(3)
    got = vector_codes.compress(df)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert Counter(map(tuple, got.collect())) == Counter(plain_codes(rows))


def test_vector_codes_of_no_rows(spark):
    empty = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")
    assert vector_codes.compress(empty).collect() == vector_codes.compress(empty.limit(0)).collect() == []


def test_walsh_functions_are_in_order_and_keep_distances():
    for p in (1, 2, 8, 64):
        h = vector_codes.walsh(np.eye(p, dtype=np.int64)).T
        assert [int((np.diff(row) != 0).sum()) for row in h] == list(range(p))
    x = np.random.default_rng(1).integers(-50, 50, (20, 11))
    w = vector_codes.walsh(x)
    assert (((w[:, None] - w[None]) ** 2).sum(2) == 16 * ((x[:, None] - x[None]) ** 2).sum(2)).all()


# Alignment


def plain_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    ta, tb = Tokenizer.from_file(public_tokenizers.path(A)), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(B))
    ta.encode_special_tokens = True
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    byte = {chr(b if b in own else next(rest)): b for b in range(256)}
    out, counts = [], Counter()
    for doc_id, text in rows:
        groups, links = [], []
        if text:
            a = [(i, bytes(byte[c] for c in t)) for e in [ta.encode(" " + text, add_special_tokens=False)] for i, t in zip(e.ids, e.tokens, strict=True)]
            b = []
            for i in tb.encode(text):
                piece = tb.id_to_piece(i)
                m = re.fullmatch("<0x(..)>", piece)
                b.append((i, bytes([int(m[1], 16)]) if m else piece.replace("▁", " ").encode()))
            if b"".join(t for _, t in a) == b"".join(t for _, t in b) == (" " + text).encode():
                i = j = at = bt = 0
                group = ([], [])
                while i < len(a) or j < len(b):
                    if at <= bt and i < len(a):
                        group[0].append(a[i][0])
                        at += len(a[i][1])
                        i += 1
                    else:
                        group[1].append(b[j][0])
                        bt += len(b[j][1])
                        j += 1
                    if at == bt:
                        links.append((group[0][-1], group[1][-1]))
                        groups.append(group)
                        group = ([], [])
        counts.update(links)
        out.append((doc_id, groups, links))
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    line = lambda gs: ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in gs)
    return Counter(
        (d, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(ls), sum(counts[p] == most[p[1]] for p in ls), sum(counts[p] for p in ls), hashlib.sha256(line(g).encode()).hexdigest() if g else "") for d, g, ls in out
    )


def test_alignment(docs):
    got = alignment.alignment(docs, public_tokenizers.path(A), public_tokenizers.path(B))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = plain_alignment(rows)
    assert Counter(map(tuple, got.collect())) == want
    assert sum(1 for r in want if r[0] == 5002 and r[1] == 0) == 1  # a mark that one side gives back as a blank
    assert alignment.alignment(docs.limit(0), public_tokenizers.path(A), public_tokenizers.path(B)).collect() == []


def test_groups_and_overlaps():
    """Random tilings: groups are what lies between common ends, overlaps are all pairs with a common byte."""
    rng = np.random.default_rng(3)
    for _ in range(50):
        n = int(rng.integers(1, 60))
        ends = [np.append(np.flatnonzero(rng.random(n - 1) < 0.4) + 1, n) for _ in range(2)]
        starts = [np.append(0, e[:-1]) for e in ends]
        group = alignment.coalesce(np.concatenate(starts), np.concatenate(ends))
        common = np.intersect1d(*ends)
        assert group.tolist() == np.searchsorted(common, np.concatenate(ends)).tolist()
        i, j = alignment.overlaps(starts[0], ends[0], starts[1], ends[1])
        every = {(x, y) for x in range(len(ends[0])) for y in range(len(ends[1])) if starts[0][x] < ends[1][y] and starts[1][y] < ends[0][x]}
        assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted(every)
        assert len(i) == len(ends[0]) + len(ends[1]) - len(common)


def test_pairs_are_bounded_by_the_vocabularies():
    assert alignment.pair_bound(public_tokenizers.path(A), public_tokenizers.path(B)) < 2_000_000


# SimHash


def plain_print(text):
    w = words(text, True)
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots_of(prints):
    fp = np.array(prints, np.uint64)
    root = list(range(len(fp)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fp)):
        for j in np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= 4).tolist():
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fp))]


def test_simhash(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    prints = [plain_print(t) for _, t in rows]
    roots = roots_of(prints)
    least = {}
    for (d, _), r in zip(rows, roots, strict=True):
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    got = simhash.near_duplicates(docs)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert Counter(map(tuple, got.collect())) == Counter((d, f"{p:016x}", least[r]) for (d, _), p, r in zip(rows, prints, roots, strict=True))
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


@pytest.mark.parametrize("shard,visitors,levels", [(8192, 1 << 17, 0), (64, 1 << 17, 5), (50, 100, 2)])
def test_simhash_trees_lose_no_link(spark, monkeypatch, shard, visitors, levels):
    """Random prints, chains of prints, one dense cloud and prints that share a band, in many shards and cut ones."""
    monkeypatch.setattr(simhash, "SHARD", shard)
    monkeypatch.setattr(simhash, "VISITORS", visitors)
    monkeypatch.setattr(simhash, "TREE_SAMPLE", 512)
    monkeypatch.setattr(simhash, "LEVELS", levels)
    rng = np.random.default_rng(11)
    flip = lambda x, n: x ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, n, replace=False).astype(np.uint64))
    prints = rng.integers(0, 2**64, 600, dtype=np.uint64).tolist()
    for k in range(40):
        x = np.uint64(prints[k])
        for _ in range(rng.integers(1, 8)):
            x = flip(x, int(rng.integers(1, 7)))
            prints.append(int(x))
    prints += [int(flip(np.uint64(12345), int(rng.integers(1, 6)))) for _ in range(400)]
    prints += [int(x) << 21 | 77 for x in rng.integers(0, 2**43, 400).tolist()]
    prints = sorted(set(prints))
    classes = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long").repartition(4).cache()
    links = [(int(np.int64(r.a).view(np.uint64)), int(np.int64(r.b).view(np.uint64))) for r in simhash.links(classes).collect()]
    assert all((a ^ b).bit_count() for a, b in links)
    roots = roots_of(prints)
    where = {p: i for i, p in enumerate(prints)}
    got = list(range(len(prints)))

    def find(i):
        while got[i] != i:
            i = got[i]
        return i

    for a, b in links:
        x, y = find(where[a]), find(where[b])
        got[max(x, y)] = min(x, y)
    assert [find(i) for i in range(len(prints))] == roots
