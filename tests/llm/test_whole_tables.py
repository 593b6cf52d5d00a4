"""Near duplicates of a whole table of the test data against all pairs; skipped where the data isn't there."""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tests.llm.test_codes_alignment_simhash import plain_print, roots_of
from tests.llm.test_operators import shingles
from tokenizers import Tokenizer

from lapframe.llm import minhash, simhash, toxicity

TABLE = "/root/testdata/sf0.01/documents.parquet"
pytestmark = pytest.mark.skipif(not os.path.exists(TABLE), reason="no test data")


@pytest.fixture(scope="module")
def rows():
    t = pq.read_table(TABLE, columns=["doc_id", "text"])
    return list(zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist(), strict=True))


def smallest(ids, roots):
    least = {}
    for d, r in zip(ids, roots, strict=True):
        least[r] = min(least.get(r, d), d)
    return [least[r] for r in roots]


def test_minhash_loses_no_link(spark, rows):
    sets = [shingles(t) for _, t in rows]
    lists = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            lists[x].append(i)
    both = defaultdict(int)
    for ids in lists.values():
        for k, j in enumerate(ids):
            for i in ids[:k]:
                both[i, j] += 1
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, j), n in both.items():
        if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    want = smallest([d for d, _ in rows], [find(i) for i in range(len(rows))])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.read.parquet(TABLE)).collect()}
    assert got == {d: (len(s), c) for (d, _), s, c in zip(rows, sets, want, strict=True)}


def test_simhash_loses_no_link(spark, rows):
    prints = [plain_print(t) for _, t in rows]
    want = smallest([d for d, _ in rows], roots_of(prints))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(spark.read.parquet(TABLE)).collect()}
    assert got == {d: (f"{p:016x}", c) for (d, _), p, c in zip(rows, prints, want, strict=True)}
    assert len(np.unique(prints)) > 100


SMALL = "/root/testdata/sf0.001"


def plain_kept(rows, toxic, items):
    """doc_id and text of what each stage of the pipeline keeps, one stage after the other."""
    rows = [(d, t or "") for d, t in rows if d not in toxic]
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), d))
    exact = {min(g)[1] for g in groups.values()}
    rows = [(d, t) for d, t in rows if d in exact]
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            both = len(a & b)
            if both and 100 * both >= 75 * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = smallest([d for d, _ in rows], [find(i) for i in range(len(rows))])
    rows = [r for r, c in zip(rows, least, strict=True) if r[0] == c]
    lower = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    windows = {tuple(w[i : i + 13]) for w in map(cut, items) if w for i in range(max(1, len(w) - 12))}
    sizes = {len(w) for w in windows}
    kept = []
    for d, t in rows:
        w = cut(t)
        hit = {p for n in sizes for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for p in range(i, i + n)}
        if not hit or 20 * len(hit) < len(w):
            kept.append((d, t))
    return kept


@pytest.mark.skipif(not os.path.exists(SMALL), reason="no test data")
def test_pipeline_against_plain_stages(spark):
    import corpus_pipeline

    t = pq.read_table(f"{SMALL}/documents.parquet", columns=["doc_id", "text"])
    rows = list(zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist(), strict=True))
    scored = toxicity.toxicity(spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet"))
    toxic = {r.doc_id for r in scored.filter("predicted = 1").collect()}
    items = pq.read_table(f"{SMALL}/benchmark.parquet", columns=["text"]).column("text").to_pylist()
    kept = plain_kept(rows, toxic, items)
    assert 0 < len(kept) < len(rows)
    got = corpus_pipeline.run(spark, SMALL).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, places = {}, defaultdict(list)
    for d, text in kept:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], "<u4")
            want[d, piece] = (at, len(part), zlib.crc32(part.tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        ends = np.cumsum([n for _, n in sorted(own)])
        assert [o for o, _ in sorted(own)] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048


def test_pipeline_of_empty_tables_and_clashing_columns(spark, tmp_path):
    import corpus_pipeline

    kind = "doc_id long, text string, lang string, source string, n_chars long, key string, kept boolean, _id string, _key int, id string, none int, label string, score string, sequence_id string"
    rows = [(1, "some clean text of a few words"), (2, "some  clean text of a few words"), (3, None), (4, ""), (None, "text without an id"), (5, "word " * 3000)]
    full = spark.createDataFrame([(*r, "en", "s", 1, "k", True, "i", 2, "d", 3, "l", "x", "q") for r in rows], kind)
    labels = spark.createDataFrame([(1, 0, 0), (9, 1, 1)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([("i", "nothing like it in there")], "item_id string, text string")
    for name, docs, y, b in (("full", full, labels, items), ("nothing", full.limit(0), labels.limit(0), items.limit(0))):
        folder = str(tmp_path / name)
        docs.write.parquet(f"{folder}/documents.parquet")
        y.write.parquet(f"{folder}/labels.parquet")
        b.write.parquet(f"{folder}/benchmark.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        assert {r.doc_id for r in got} == ({2, 3, None, 5} if name == "full" else set())
        for stage_name, stage in corpus_pipeline.STAGES[:-1] if name == "full" else ():
            assert stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).columns == docs.columns, stage_name
