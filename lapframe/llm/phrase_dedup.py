"""Repeated passages by automata over recurring phrases.

Passages are confirmed first: windows of WINDOW words that more than one document has, each
with the earliest document that has it; a passage is an unbroken run of such windows in that
document. Any window in a passage holds one of the passage's blocks of BLOCK words whole, so
the blocks are the phrases of an Aho-Corasick automaton over the numbers of a shard's words.

Passages are dealt to shards by bundles of at most BUNDLE_WORDS of one document, a shard
having about SHARD_WORDS. Documents are streamed whole: each one through every shard of whose
passages it has the beginning of a selected suffix (HEAD words at a place that content selects,
see windows.py). A document without any has none of the passages. A shard's documents are dealt
to groups of about GROUP_WORDS, so a passage that a third of all documents share is
searched by as many tasks as it needs. Only what the automaton hits is looked at: every hit
is extended left and right to the windows around it, which are compared with the passages' own
by two 64-bit hashes, and the words of those that an earlier document has are removed.

Edge cases: null and empty texts have no words; texts under 50 words keep all; a null
``doc_id`` takes no part and loses nothing; rows that repeat a ``doc_id`` never count as earlier
than each other, and other texts under one ``doc_id`` are cut on their own; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import salted_join, stored
from .windows import HEAD, WINDOW, _lists, classes, hashed, keyed, only, outline, selected_places, texts_with_recurring_heads, without_spans
from .words import phrase_hashes, pieces

BLOCK = 25
#: Of the second hash of a window.
SEED = 0x2545F491
#: Words of one document's passages that stay together, of passages in one automaton, and of documents that one task streams through it.
BUNDLE_WORDS, SHARD_WORDS, GROUP_WORDS = 20_000, 1_000_000, 2_000_000


def candidate_windows(texts: DataFrame) -> DataFrame:
    """Windows (two hashes, doc_id, key, place) that select a place with a wanted head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            want, doc_ids, keys = b.column("wanted"), b.column("doc_id").to_numpy(), b.column("key").to_numpy()
            for row, data, offsets in pieces(b.column("text")):
                h, _, _, first = hashed(data, offsets)
                at, place = selected_places(h, first)
                heads = phrase_hashes(h, HEAD).view(np.int64)
                w, check = phrase_hashes(h, WINDOW).view(np.int64), phrase_hashes(h, WINDOW, SEED).view(np.int64)
                bounds, picked, owner = np.searchsorted(at, first), [], []
                for i in range(len(offsets) - 1):
                    own = slice(bounds[i], bounds[i + 1])
                    pick = at[own][np.isin(heads[place[own]], np.asarray(want[row + i].values))]
                    picked.append(pick)
                    owner.append(np.full(len(pick), i))
                pick, i = np.concatenate(picked), np.concatenate(owner)
                cols = [pa.array(w[pick]), pa.array(check[pick]), pa.array(doc_ids[row + i]), pa.array(keys[row + i]), pa.array(pick - first[i], pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, names=["w", "check", "doc_id", "key", "place"])

    return texts.select("doc_id", "key", "text", "wanted").mapInArrow(run, "w long, check long, doc_id long, key long, place int")


def owners(windows: DataFrame) -> DataFrame:
    """Of windows that more than one document has, where the earliest document has them first: doc_id, key, place."""
    found = windows.groupBy("w", "check").agg(F.min(F.struct("doc_id", "key", "place")).alias("x"), F.max("doc_id").alias("last"))
    return found.filter("x.doc_id < last").select("x.*")


def _runs(places: np.ndarray) -> list[tuple[int, int]]:
    """(first word, end) of unbroken runs of windows."""
    places = np.sort(places)
    breaks = np.flatnonzero(np.diff(places) > 1)
    return list(zip(places[np.append(0, breaks + 1)].tolist(), (places[np.append(breaks, len(places) - 1)] + WINDOW).tolist(), strict=True))


def passages(docs: DataFrame, owned: DataFrame) -> DataFrame:
    """Passages, their words joined by single blanks: owner, key, bundle, n (words), the heads in them, text.

    A run longer than BUNDLE_WORDS is several passages that overlap by a window less a word.
    """
    places = stored(owned.groupBy("key").agg(F.collect_list("place").alias("places")), "owner_places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, key, text, at in zip(b.column("doc_id").to_pylist(), b.column("key").to_pylist(), b.column("text").to_pylist(), b.column("places"), strict=True):
                words, done = text.encode().split(), 0
                for s, e in _runs(np.asarray(at.values)):
                    for a in range(s, e - WINDOW + 1, BUNDLE_WORDS):
                        z = min(e, a + BUNDLE_WORDS + WINDOW - 1)
                        out.append((doc_id, key, done // BUNDLE_WORDS, z - a, b" ".join(words[a:z]).decode()))
                        done += z - a
            texts, heads = pa.array([x[4] for x in out], pa.string()), []
            for _, data, offsets in pieces(texts):
                h, _, _, first = hashed(data, offsets)
                at, place = selected_places(h, first)
                hashes, bounds = phrase_hashes(h, HEAD).view(np.int64), np.searchsorted(at, first)
                heads += [np.unique(hashes[np.unique(place[i:j])]) for i, j in zip(bounds, bounds[1:], strict=False)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64())
            cols = [pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*cols, _lists(heads), texts], names=["owner", "key", "bundle", "n", "heads", "text"])

    texts = only(keyed(docs), places.select("key")).dropDuplicates(["key"]).join(places, "key").select("doc_id", "key", "text", "places")
    return texts.mapInArrow(run, "owner long, key long, bundle long, n long, heads array<long>, text string")


class PassageAutomaton:
    """The automaton over the blocks of passages, and the passages' windows.

    Words are numbered, and a number is a character; a word that no passage has is the character 1.
    Of more than MOST words several would share a number: that gives hits which the windows refuse.
    """

    MOST = 0x10FFFF - 0x800 - 2

    def __init__(self, owners: list[int], texts: list[str]):
        import ahocorasick

        parts = []
        for first, data, offsets in pieces(pa.array(texts, pa.string())):
            h, _, _, words = hashed(data, offsets)
            parts += [(owners[first + k], h[a:b]) for k, (a, b) in enumerate(zip(words[:-1].tolist(), words[1:].tolist(), strict=True))]
        self.words = np.unique(np.concatenate([h for _, h in parts])) if parts else np.zeros(0, np.uint64)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for _, h in parts:
            text = self._text(h)
            for at in range(0, len(text) - BLOCK + 1, BLOCK):
                self.automaton.add_word(text[at : at + BLOCK])
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()
        w, check = (np.concatenate([phrase_hashes(h, WINDOW, seed) for _, h in parts]) if parts else np.zeros(0, np.uint64) for seed in (0, SEED))
        owner = np.concatenate([np.full(max(0, len(h) - WINDOW + 1), d, np.int64) for d, h in parts]) if parts else np.zeros(0, np.int64)
        order = np.argsort(w, kind="stable")
        self.windows, self.checks, self.owners = w[order], check[order], owner[order]

    def _text(self, h: np.ndarray) -> str:
        i = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        number = np.where(self.words[i] == h, 2 + i % self.MOST, 1)
        return (number + 0x800 * (number >= 0xD800)).astype("<u4").tobytes().decode("utf-32-le")

    def held(self, h: np.ndarray, first: np.ndarray, doc_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of a piece of documents (word hashes, first words, ids) the windows that a passage of an earlier one has, and their rows."""
        none = np.zeros(0, np.int64)
        n = len(h) - WINDOW + 1
        if self.empty or n <= 0:
            return none, none
        at = np.fromiter((end for end, _ in self.automaton.iter(self._text(h))), np.int64) - BLOCK + 1
        if not len(at):
            return none, none
        # A passage's window that holds the block whole begins at most WINDOW - BLOCK words before it.
        near = np.zeros(len(h) + 1, np.int64)
        np.add.at(near, np.maximum(at - (WINDOW - BLOCK), 0), 1)
        np.add.at(near, at + 1, -1)
        near = np.flatnonzero(np.cumsum(near)[:n] > 0)
        row = np.searchsorted(first, near, side="right") - 1
        inside = near + WINDOW <= first[row + 1]
        near, row = near[inside], row[inside]
        w, check = phrase_hashes(h, WINDOW)[near], phrase_hashes(h, WINDOW, SEED)[near]
        i = np.minimum(np.searchsorted(self.windows, w), len(self.windows) - 1)
        same = (self.windows[i] == w) & (self.checks[i] == check) & (self.owners[i] < doc_ids[row])
        return near[same], row[same]


def passage_spans(docs: DataFrame, same: DataFrame, found: DataFrame) -> DataFrame:
    """Of each document (key), the words that repeat a passage of an earlier one, found by the automata."""
    shards = max(1, -(-(found.agg(F.sum("n")).first()[0] or 0) // SHARD_WORDS))
    found = found.withColumn("shard", F.pmod(F.xxhash64("key", "bundle"), F.lit(shards)).cast("int"))
    # A head's shards in one row: it meets a document's heads by a join whose hot keys are dealt out.
    near = found.select("shard", "owner", F.explode("heads").alias("head")).groupBy("head", "shard").agg(F.min("owner").alias("owner"))
    near = stored(near.groupBy("head").agg(F.collect_list(F.struct("shard", "owner")).alias("shards")), "passage_heads")
    met = salted_join(same.select("key", "doc_id", F.explode("heads").alias("head")), near, "head").select("key", "doc_id", F.explode("shards").alias("s"))
    routes = met.filter(F.col("s.owner") < F.col("doc_id")).select("key", F.col("s.shard").alias("shard")).distinct()
    routes = stored(routes.join(same.select("key", "n_words"), "key"), "routes")
    load = routes.groupBy("shard").agg((F.floor(F.sum("n_words") / GROUP_WORDS) + 1).cast("int").alias("groups"))
    routes = routes.join(load, "shard").select("key", "shard", F.pmod(F.xxhash64("key"), F.col("groups")).cast("int").alias("grp"))
    dealt = found.join(load, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("grp"), "owner", F.col("text").alias("passage"))
    keys = stored(routes.select("key").distinct(), "route_keys")
    texts = only(keyed(docs), keys).dropDuplicates(["key"]).join(routes, "key").select("shard", "grp", "doc_id", "key", "text")

    def stream(own: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        automaton = PassageAutomaton(parts["owner"].tolist(), parts["passage"].tolist())
        keys, starts_, ends_ = [], [], []
        doc_ids, own_keys = own["doc_id"].to_numpy(), own["key"].tolist()
        for row, data, offsets in pieces(pa.array(own["text"], pa.large_string())):
            h, _, _, first = hashed(data, offsets)
            at, i = automaton.held(h, first, doc_ids[row : row + len(offsets) - 1])
            for k in np.unique(i).tolist():
                runs = _runs(at[i == k] - first[k])
                keys.append(own_keys[row + k])
                starts_.append([s for s, _ in runs])
                ends_.append([e for _, e in runs])
        return pd.DataFrame({"key": pd.Series(keys, dtype="int64"), "starts": pd.Series(starts_, dtype=object), "ends": pd.Series(ends_, dtype=object)})

    spans = texts.groupBy("shard", "grp").cogroup(dealt.groupBy("shard", "grp")).applyInPandas(stream, "key long, starts array<int>, ends array<int>")
    return spans.groupBy("key").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))


def remove_repeated_phrases(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of ``docs`` (doc_id, text)."""
    rows = stored(outline(docs), "outline")
    same = stored(classes(rows), "classes")
    windows = candidate_windows(texts_with_recurring_heads(docs, same))
    found = stored(passages(docs, stored(owners(windows), "owners")), "passages")
    return without_spans(docs, rows, same, passage_spans(docs, same, found))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM s),
own AS (SELECT h, min(doc_id) AS owner FROM win GROUP BY h),
cut AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p
  FROM (SELECT win.doc_id, win.i FROM win JOIN own ON win.h = own.h WHERE own.owner < win.doc_id)),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS kept
  FROM words LEFT JOIN cut ON words.doc_id = cut.doc_id AND words.p = cut.p WHERE cut.p IS NULL GROUP BY words.doc_id),
gone AS (SELECT doc_id, count(*) AS n FROM cut GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(gone.n, 0) AS n_removed, sha256(coalesce(kept.kept, '')) AS kept_sha256
FROM d LEFT JOIN gone ON d.doc_id = gone.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
