"""What the two passage operators share: retained places, repeated windows, and removal of words.

A window is WINDOW consecutive words of one document. Of its first LEFT + PHRASE words it
selects one place by content: where the PHRASE-word phrase with the smallest hash begins (the
leftmost of equals). Equal windows select the same place, one place serves about ten windows
in a row, and the HEAD words from there on are in the window. So a window can repeat across
documents only if the HEAD words at its place do. Documents with one sequence of words are one
class: the row with the smallest ``doc_id`` stands for it, and the others repeat it as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import salted_join, stored, text_batches
from .words import _MUL_WORD, _power_tables, mix, phrase_hashes, pieces, split, word_hashes

WINDOW = 50
PHRASE = 8
#: A selected place is at most so many words after its window's start.
LEFT = 18
HEAD = WINDOW - LEFT
#: Keys (8 bytes) that are broadcast to prune a read of the documents; more are joined by shuffle.
BROADCAST_KEYS = 1_000_000
#: A phrase's hash and place are compared as one number: 32 bits for each.
_PLACE = np.uint64((1 << 32) - 1)
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null is empty) and a key of the two."""
    text_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return own.withColumn("key", F.xxhash64("doc_id", "text"))


def only(docs: DataFrame, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of ``docs`` whose key is (not) in ``keys``: by broadcast while they are few."""
    return docs.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, "key", how)


def hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, starts, ends and first words of a piece of text."""
    starts, ends, first = split(data, offsets)
    return word_hashes(data, starts, ends, False), starts, ends, first


def selected_places(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows (their first words) and the place that each selects."""
    n = len(h) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a = phrase_hashes(h, PHRASE)
    least, have, span = (a & ~_PLACE) | np.arange(len(a), dtype=np.uint64), 1, LEFT + 1
    while 2 * have <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    least = np.minimum(least[:n], least[span - have : span - have + n])
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(row[:n] == row[WINDOW - 1 :])
    return at, (least[at] & _PLACE).astype(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64()))


def outline(docs: DataFrame) -> DataFrame:
    """doc_id, key, n_words, fingerprint (f1, f2) and the distinct hashes of the heads at selected places, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, data, offsets in pieces(b.column("text")):
                h, _, _, first = hashed(data, offsets)
                n = len(offsets) - 1
                prints = []
                for salt in (0, 0x5BD1):
                    x = mix(h + np.uint64(salt))
                    power, inverse = _power_tables(_MUL_WORD, len(x) + 1)
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * power[: len(x)], dtype=np.uint64)])
                    prints.append(mix((total[first[1:]] - total[first[:-1]]) * inverse[first[:-1]]).view(np.int64))
                at, place = selected_places(h, first)
                heads = phrase_hashes(h, HEAD).view(np.int64)
                bounds = np.searchsorted(at, first)
                lists = [np.unique(heads[np.unique(place[i:j])]) for i, j in zip(bounds, bounds[1:], strict=False)]
                cols = [b.column("doc_id").slice(row, n), b.column("key").slice(row, n), pa.array(np.diff(first), pa.int64()), pa.array(prints[0]), pa.array(prints[1]), _lists(lists)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "key", "n_words", "f1", "f2", "heads"])

    return keyed(docs).mapInArrow(run, "doc_id long, key long, n_words long, f1 long, f2 long, heads array<long>")


def classes(rows: DataFrame) -> DataFrame:
    """One row for each distinct sequence of at least WINDOW words: its fingerprint, its smallest doc_id, key and heads."""
    long = rows.filter((F.col("n_words") >= WINDOW) & F.col("doc_id").isNotNull())
    same = long.groupBy("n_words", "f1", "f2").agg(F.min(F.struct("doc_id", "key")).alias("x"), F.first("heads").alias("heads"))
    return same.select("n_words", "f1", "f2", F.col("x.doc_id").alias("doc_id"), F.col("x.key").alias("key"), "heads")


def texts_with_recurring_heads(docs: DataFrame, same: DataFrame) -> DataFrame:
    """doc_id, key, text and the hashes ``wanted`` of those heads that more than one class has, of classes with any."""
    heads = same.select("key", F.explode("heads").alias("head"))
    recurring = stored(heads.groupBy("head").count().filter(F.col("count") > 1).select("head"), "recurring")
    wanted = salted_join(heads, recurring, "head").groupBy("key").agg(F.collect_list("head").alias("wanted"))
    wanted = stored(wanted, "wanted")
    return only(keyed(docs), wanted.select("key")).dropDuplicates(["key"]).join(wanted, "key")


def without_spans(docs: DataFrame, rows: DataFrame, same: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of ``docs``.

    ``spans`` has, for keys of rows that stand for a class, the words to remove as arrays of
    ``starts`` and ``ends``. Rows that repeat an earlier row as a whole lose every word.
    """
    long = rows.filter(F.col("n_words") >= WINDOW).select("key", "doc_id", "n_words", "f1", "f2")
    copies = salted_join(long, same.select("n_words", "f1", "f2", F.col("doc_id").alias("earliest")), "n_words", "f1", "f2")
    copies = stored(copies.filter(F.col("doc_id") > F.col("earliest")).select("key", "doc_id", "n_words"), "copies")
    cut = stored(spans, "spans")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            with_spans = "starts" in b.schema.names
            doc_ids, out = b.column("doc_id"), []
            for i, text in enumerate(b.column("text").to_pylist()):
                words = text.encode().split()
                n = removed = len(words)
                if with_spans:
                    keep, last = [], 0
                    for s, e in sorted(zip(b.column("starts")[i].as_py(), b.column("ends")[i].as_py(), strict=True)):
                        if s > last:
                            keep += words[last:s]
                        last = max(last, e)
                    words = keep + words[last:]
                removed = n - len(words)
                out.append((n, removed, hashlib.sha256(b" ".join(words)).hexdigest()))
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    touched = stored(cut.select("key").union(copies.select("key")).distinct(), "touched")
    plain = only(keyed(docs), touched, "left_anti").select("doc_id", "text").mapInArrow(run, schema)
    some = only(keyed(docs), cut.select("key")).join(cut, "key").select("doc_id", "text", "starts", "ends").mapInArrow(run, schema)
    whole = copies.select("doc_id", "n_words", F.col("n_words").alias("n_removed"), F.lit(EMPTY_SHA256).alias("kept_sha256"))
    return plain.unionByName(some).unionByName(whole)
