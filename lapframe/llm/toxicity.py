"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are lower-cased (A-Z) runs of letters and digits. Features are words, their beginnings
of a few lengths (so that inflected forms share a feature), pairs of neighbours and pairs
with one word between, hashed to 2**20 places; a feature is there or not, however often.
Per-coordinate learning rates and an L1 penalty leave a few thousand weights, which travel
with the tasks that score (4 MB if none were zero).

Training takes at most TRAIN_ROWS labelled rows, those with the smallest hash of their id. One
in CALIBRATION of them sets the bias only; the others are dealt to groups of about SHARD_ROWS,
each runs FTRL in a fixed order and the weights are averaged. Then the bias moves so that
THRESHOLD stands where, on the rows set apart, misses (POSITIVE_WEIGHT each) and false alarms
cost least; of cuts that cost the same, in the middle of the widest gap between scores.

Edge cases: null and empty texts score as the bias alone; a null ``doc_id`` is scored but
never learned from; of labels that disagree on a ``doc_id`` the larger counts; without
labelled rows every score is 0; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored, text_batches
from .words import mix, pieces, split, word_hashes

BITS = 20
STEMS = (4, 5, 6, 7, 8)
TRAIN_ROWS = 24_000
SHARD_ROWS = 4_000
EPOCHS = 6
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.5
#: Toxic rows are the fewer; each counts so many times.
POSITIVE_WEIGHT = 2
THRESHOLD = 0.7
CALIBRATION = 5

_SEP = np.ones(256, bool)
_SEP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature of every word, word beginning, pair and skip pair of a piece of text."""
    starts, ends, first = split(data, offsets, _SEP)
    h = word_hashes(data, starts, ends, True)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    rows, feats = [row], [h]
    for gap, salt in ((1, 0x51), (2, 0xA7)):
        if len(h) > gap:
            same = row[:-gap] == row[gap:]
            rows.append(row[:-gap][same])
            feats.append(mix(h[:-gap] * np.uint64(2 * salt + 1) + (h[gap:] ^ np.uint64(salt)))[same])
    for k in STEMS:
        long = ends - starts > k
        rows.append(row[long])
        feats.append(mix(word_hashes(data, starts[long], starts[long] + k, True) + np.uint64(k)))
    return np.concatenate(rows), (np.concatenate(feats) >> np.uint64(64 - BITS)).astype(np.int64)


def ftrl(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias after ``epochs`` passes over rows of feature places."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    bias = np.array([size])
    for _ in range(epochs):
        for places, y in zip(rows, labels.tolist(), strict=True):
            at = np.concatenate([places, bias])
            zi, ni = z[at], n[at]
            w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2)
            w[np.abs(zi) <= L1] = 0
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30)))
            g = (p - y) * (POSITIVE_WEIGHT if y else 1)
            z[at] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[at] += g * g
    w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
    w[np.abs(z) <= L1] = 0
    return w[:size], float(w[size])


def labelled_rows(labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """At most ``max_rows`` rows (doc_id, y): those with the smallest hash of their id.

    Most others go by a bound on the hash before any task gathers rows.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).dropna()
    own = own.groupBy("doc_id").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64("doc_id"))
    share = (max_rows + 6 * max_rows**0.5 + 64) / max(own.count(), 1)
    if share < 1:
        own = own.filter(F.col("h") <= int(-(2**63) + share * 2**64))
    return own.orderBy("h", "doc_id").limit(max_rows).select("doc_id", "y")


def cut_between(logits: np.ndarray, labels: np.ndarray) -> float | None:
    """The logit from which on rows should be called toxic; None without rows of both labels."""
    if len(np.unique(labels)) < 2:
        return None
    order = np.argsort(logits, kind="stable")
    x, y = logits[order], labels[order]
    # A cut before row i misses the toxic rows below and alarms at the others from i on.
    cost = POSITIVE_WEIGHT * np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0]])
    gap = np.concatenate([[0], np.diff(x), [0]])
    able = (gap > 0) | (np.arange(len(gap)) % len(x) == 0)  # not between rows of one score
    best = np.flatnonzero(able & (cost == cost[able].min()))
    i = int(best[gap[best].argmax()])
    return float(x[0] - 1 if i == 0 else x[-1] + 1 if i == len(x) else (x[i - 1] + x[i]) / 2)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id and a 0/1 column)."""
    text_batches(docs.sparkSession)
    chosen = labelled_rows(labels, label, max_rows)
    # At most max_rows rows of 12 bytes are broadcast.
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, data, offsets in pieces(b.column("text")):
                n = len(offsets) - 1
                row, feat = _features(data, offsets)
                key = np.unique((row << BITS) | feat)
                row, feat = key >> BITS, key & ((1 << BITS) - 1)
                at = np.searchsorted(row, np.arange(n + 1))
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(feat, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, n), b.column("y").slice(first, n), lists], names=["doc_id", "y", "places"])

    shards = max(1, -(-chosen.count() // SHARD_ROWS))
    rows = stored(known.mapInArrow(places, "doc_id long, y int, places array<int>"), "features")
    apart = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(CALIBRATION)) == 0

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        pdf = pdf.iloc[np.random.default_rng(7).permutation(len(pdf))]
        w, bias = ftrl([np.asarray(p, np.int64) for p in pdf["places"]], pdf["y"].to_numpy())
        at = np.flatnonzero(w)
        return pd.DataFrame({"place": np.append(at, -1), "w": np.append(w[at], bias)})

    shard = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(shards))
    learned = rows.filter(~apart).withColumn("shard", shard).groupBy("shard").applyInPandas(learn, "place long, w double")
    # At most 2**BITS + 1 places come to the driver, whatever the input.
    total = learned.groupBy("place").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n")).toPandas()
    weights, bias = np.zeros(1 << BITS, np.float32), -30.0
    if len(total):
        parts = total.loc[total["place"] == -1, "n"].iloc[0]
        own = total[total["place"] >= 0]
        weights[own["place"].to_numpy()] = (own["w"] / parts).to_numpy()
        bias = float(total.loc[total["place"] == -1, "w"].iloc[0] / parts)
        at = np.flatnonzero(weights).astype(np.int32)
        value = weights[at]  # the sparse form travels with the task

        def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w = np.zeros(1 << BITS)
            w[at] = value
            for b in batches:
                x = [w[np.asarray(p.values)].sum() + bias for p in b.column("places")]
                yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(x, pa.float64())], names=["y", "logit"])

        # No more rows than one in CALIBRATION of max_rows, about.
        own = rows.filter(apart).mapInArrow(logits, "y int, logit double").toPandas()
        cut = cut_between(own["logit"].to_numpy(), own["y"].to_numpy())
        bias += 0.0 if cut is None else math.log(THRESHOLD / (1 - THRESHOLD)) - cut
    return weights, bias


def _scorer(model: tuple[np.ndarray, float]):
    """A function from an Arrow batch with ``text`` to (first row, scores) of its runs of rows."""
    weights, bias = model
    place = np.flatnonzero(weights).astype(np.int32)
    value = weights[place]  # the sparse form travels with the task

    def run(batch: pa.RecordBatch, dense: dict = {}) -> Iterator[tuple[int, np.ndarray]]:
        if not dense:
            w = np.zeros(1 << BITS, np.float64)
            w[place] = value
            dense["w"] = w
        w = dense["w"]
        for first, data, offsets in pieces(batch.column("text")):
            row, feat = _features(data, offsets)
            used = w[feat] != 0
            key = np.unique((row[used] << BITS) | feat[used])
            total = np.bincount(key >> BITS, w[key & ((1 << BITS) - 1)], len(offsets) - 1) + bias
            yield first, 1 / (1 + np.exp(-np.clip(total, -30, 30)))

    return run


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id and score (0 to 1) of every row of ``docs`` (doc_id, text)."""
    scorer = _scorer(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, s in scorer(b):
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, len(s)), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def without_toxic(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns, in one pass."""
    scorer = _scorer(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, s in scorer(b):
                yield b.slice(first, len(s)).filter(pa.array(s < threshold))

    return docs.mapInArrow(run, docs.schema)


def held_out(folds: int, fold: int):
    """True for rows whose crc32(doc_id as text) modulo ``folds`` is ``fold``."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row; learns only from rows not held out."""
    model = train(docs, labels.filter(~held_out(3, 1)))
    return score(docs, model).select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
