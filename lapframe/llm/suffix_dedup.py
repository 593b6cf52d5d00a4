"""Repeated passages by sparse suffix arrays.

Suffixes are retained only at places that content selects (see windows.py). A retained suffix
carries the WINDOW words from its place on, its body, and the LEFT words before. Suffixes
whose first HEAD words no other document has can't match and are left out. The rest are
range-partitioned by splitters on their text, sorted by body, then by the words before, then
by document, and each is compared with its neighbours in one scan:

* one that equals the first of its neighbours on both sides, which is in an earlier document,
  is a match of all its words: they are a repeated span;
* of others, the words in common with the nearer neighbour bound how far to the right a match
  can reach. Each is extended left and right to the windows that select its place and end
  within that bound. The windows are range-partitioned by two hashes of their words and sorted
  by document, and neighbours compared again: one that an earlier document has is a repeat.

Neighbours that a partition's border separates are never lost: at the border a suffix counts as
matching to its full length, and a window that begins a partition is compared with the last of
the partitions before. So a passage may fill any number of partitions, and no group is held.

Edge cases: null and empty texts have no words; texts under 50 words keep all; a null
``doc_id`` takes no part and loses nothing; rows that repeat a ``doc_id`` never count as earlier
than each other, and other texts under one ``doc_id`` are cut on their own; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored
from .windows import HEAD, LEFT, WINDOW, classes, hashed, outline, selected_places, texts_with_recurring_heads, without_spans
from .words import phrase_hashes, pieces

#: Characters of a suffix that splitters see.
SPLIT_CHARS = 64
#: Suffixes with one beginning of SPLIT_CHARS that wait for their last neighbour; more count as matching to their full length.
WAITING = 1000
#: Of the second hash of a window.
SEED = 0x2545F491

SUFFIX = "doc_id long, key long, place int, least int, most int, body string, before string"
MATCH = "doc_id long, key long, start int, end int, w long, check long"


def suffixes(texts: DataFrame) -> DataFrame:
    """Retained suffixes with wanted heads; the windows that select one start ``least`` to ``most`` words before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc_ids, keys, want, texts = b.column("doc_id").to_pylist(), b.column("key").to_pylist(), b.column("wanted"), b.column("text")
            for row, data, offsets in pieces(texts):
                h, _, _, first = hashed(data, offsets)
                at, place = selected_places(h, first)
                heads, bounds = phrase_hashes(h, HEAD).view(np.int64), np.searchsorted(at, first)
                out = []
                for i in range(len(offsets) - 1):
                    own, zero = slice(bounds[i], bounds[i + 1]), int(first[i])
                    # The windows that select one place follow each other.
                    places, start, count = np.unique(place[own], return_index=True, return_counts=True)
                    if not len(places):
                        continue
                    begin = at[own][start]
                    known = np.flatnonzero(np.isin(heads[places], np.asarray(want[row + i].values)))
                    words = data[offsets[i] : offsets[i + 1]].tobytes().split() if len(known) else []
                    for p, s, c in zip(places[known].tolist(), begin[known].tolist(), count[known].tolist(), strict=True):
                        q = p - zero
                        out.append((doc_ids[row + i], keys[row + i], q, p - s - c + 1, p - s, b" ".join(words[q : q + WINDOW]).decode(), b" ".join(words[max(0, q - LEFT) : q]).decode()))
                if out:
                    cols = zip(*out, strict=True)
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "key", "place", "least", "most", "body", "before"])

    return texts.select("doc_id", "key", "text", "wanted").mapInArrow(run, SUFFIX)


def common_words(a: list[str], b: list[str]) -> int:
    """Words that two texts have in common from their beginnings on."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n - 1  # the first word that differs is among them
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid + 1, hi) if a[lo : mid + 1] == b[lo : mid + 1] else (lo, mid)
    return lo


def _windows(found: list[list]) -> pa.RecordBatch | None:
    """Windows of suffixes (doc_id, key, place, least, most, body, before, words in common with a neighbour)."""
    found = [x for x in found if x[7] >= HEAD and max(x[3], WINDOW - x[7]) <= x[4]]
    if not found:
        return None
    texts = pc.binary_join_element_wise(pa.array([x[6] for x in found]), pa.array([x[5] for x in found]), " ")
    cols: list[list[np.ndarray]] = [[], [], [], [], []]
    for row, data, offsets in pieces(texts):
        h, _, _, first = hashed(data, offsets)
        w, check = phrase_hashes(h, WINDOW).view(np.int64), phrase_hashes(h, WINDOW, SEED).view(np.int64)
        own = found[row : row + len(offsets) - 1]
        n_before = np.array([min(x[2], LEFT) for x in own])
        low, high = np.array([max(x[3], WINDOW - x[7]) for x in own]), np.array([x[4] for x in own])
        n = high - low + 1
        i = np.repeat(np.arange(len(own)), n)
        o = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + low[i]
        at = first[i] + n_before[i] - o
        for c, v in zip(cols, (np.array([x[0] for x in own])[i], np.array([x[1] for x in own])[i], np.array([x[2] for x in own])[i] - o, w[at], check[at]), strict=True):
            c.append(v)
    doc_id, key, start, w, check = (np.concatenate(c) for c in cols)
    return pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), pa.array(key, pa.int64()), pa.array(start, pa.int32()), pa.array(start + WINDOW, pa.int32()), pa.array(w, pa.int64()), pa.array(check, pa.int64())], names=["doc_id", "key", "start", "end", "w", "check"])


def compare_suffixes(sparse: DataFrame) -> DataFrame:
    """Sort the suffixes and compare neighbours: repeated spans (without w), and windows that may repeat."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_body = last_before = last_head = None
        last_words: list[str] = []
        owner, border, waiting, spans = None, False, [], []
        run_from = 0  # of the waiting ones, the first with the last context

        def release(full: bool):
            for x in waiting if full else ():
                x[7] = WINDOW
            batch = _windows(waiting)
            waiting.clear()
            return batch

        for b in batches:
            cols = [b.column(k).to_pylist() for k in ("doc_id", "key", "place", "least", "most", "body", "before")]
            for doc_id, key, place, least, most, body, before in zip(*cols, strict=True):
                if body == last_body and before == last_before:
                    if doc_id > owner:
                        n = len(last_words)
                        spans.append((doc_id, key, place - min(place, LEFT), place + n))
                    else:
                        # A periodic text has as many equal suffixes as words: they don't wait without bound.
                        if len(waiting) >= WAITING:
                            run_from = 0
                            if batch := release(True):
                                yield batch
                        waiting.append([doc_id, key, place, least, most, body, before, waiting[-1][7] if waiting else WINDOW])
                    continue
                words, head = body.split(" "), body[:SPLIT_CHARS]
                both = common_words(last_words, words)
                for x in waiting[run_from:]:
                    x[7] = max(x[7], both)
                if head != last_head:
                    if waiting and (batch := release(border)):
                        yield batch
                    border = last_head is None  # of the partition's first beginning other partitions may have more
                elif len(waiting) >= WAITING and (batch := release(True)):
                    yield batch
                last_body, last_before, last_words, last_head, owner, run_from = body, before, words, head, doc_id, len(waiting)
                waiting.append([doc_id, key, place, least, most, body, before, both])
            if spans:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
                arrays = [pa.array(c, k) for c, k in zip(zip(*spans, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.nulls(len(spans), pa.int64()), pa.nulls(len(spans), pa.int64())], names=["doc_id", "key", "start", "end", "w", "check"])
                spans = []
        if waiting and (batch := release(True)):
            yield batch

    split = sparse.withColumn("_head", F.substring("body", 1, SPLIT_CHARS)).withColumn("_context", F.xxhash64("body", "before"))
    ranged = split.repartitionByRange("_head", "_context", "doc_id").sortWithinPartitions("body", "before", "doc_id", "place")
    return ranged.drop("_head", "_context").mapInArrow(scan, MATCH)


def compare_windows(windows: DataFrame) -> DataFrame:
    """Windows (key, start, end) whose words an earlier document has."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w0 = check0 = owner = None
        first_run = True
        for b in batches:
            w, check, doc_id = (b.column(k).to_numpy() for k in ("w", "check", "doc_id"))
            if not len(w):
                continue
            new = np.ones(len(w), bool)
            new[1:] = (w[1:] != w[:-1]) | (check[1:] != check[:-1])
            new[0] = w0 is None or w[0] != w0 or check[0] != check0
            run = np.cumsum(new)  # 0 goes on with the run of the batch before
            owners = np.concatenate([[owner if owner is not None else 0], doc_id[new]])
            later = doc_id > owners[run]
            # In a partition's first run an owner may itself repeat a partition before.
            open_ = ~later & (run == (0 if first_run and w0 is not None else 1 if first_run else -1))
            first_run = first_run and int(run[-1]) == (0 if w0 is not None else 1)
            w0, check0, owner = w[-1], check[-1], owners[run[-1]]
            pick = np.flatnonzero(later | open_)
            part, undecided, none = b.take(pa.array(pick)), pa.array(open_[pick]), pa.scalar(None, pa.int64())
            cols = [part.column(k) for k in ("doc_id", "key", "start", "end")] + [pc.if_else(undecided, part.column(k), none) for k in ("w", "check")]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "key", "start", "end", "w", "check"])
        if w0 is not None:
            yield pa.RecordBatch.from_arrays([pa.array([int(owner)]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int32()), pa.array([int(w0)]), pa.array([int(check0)])], names=["doc_id", "key", "start", "end", "w", "check"])

    ranged = windows.repartitionByRange("w", "check", "doc_id").sortWithinPartitions("w", "check", "doc_id", "start")
    found = stored(ranged.mapInArrow(scan, MATCH), "window_matches")
    # One row for each partition, and of a partition's first run the places in one document.
    ends = found.filter(F.col("key").isNull()).groupBy("w", "check").agg(F.min("doc_id").alias("earliest"))
    across = found.filter(F.col("key").isNotNull() & F.col("w").isNotNull()).join(F.broadcast(ends), ["w", "check"]).filter(F.col("doc_id") > F.col("earliest"))
    return found.filter(F.col("key").isNotNull() & F.col("w").isNull()).select("key", "start", "end").unionByName(across.select("key", "start", "end"))


def remove_repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of ``docs`` (doc_id, text)."""
    rows = stored(outline(docs), "outline")
    same = stored(classes(rows), "classes")
    matches = stored(compare_suffixes(suffixes(texts_with_recurring_heads(docs, same))), "suffix_matches")
    whole = matches.filter(F.col("w").isNull()).select("key", "start", "end")
    spans = whole.unionByName(compare_windows(matches.filter(F.col("w").isNotNull())))
    # A document has no more of them than words.
    cut = spans.groupBy("key").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    return without_spans(docs, rows, same, cut)
