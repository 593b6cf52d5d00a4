"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Each passage gets features: shares of
byte kinds, lengths of words and lines, repetition, and signs of hashed words; a learned
layer encodes them. Gated attention weighs the passages,

    a_k = softmax_k( w . (tanh(V h_k) * sigmoid(U h_k)) ),

and the weighted passage representation is scored. Only document labels are used.

Training takes at most TRAIN_ROWS labelled rows, those with the smallest hash of their id,
dealt to SHARDS groups; each group trains a model and a score is the models' mean. A model
has a few thousand numbers, whatever the input.

Edge cases: null and empty texts are one passage without words; a null ``doc_id`` is scored
but never learned from; of labels that disagree on a ``doc_id`` the larger counts; without
labelled rows every score is 0.5; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import text_batches
from .toxicity import held_out, labelled_rows
from .words import mix, pieces, split, word_hashes

PASSAGE = 64
SIGNS = 16
TRAIN_ROWS = 12_000
SHARDS = 4
WIDTH, GATE = 24, 12
EPOCHS, BATCH, RATE, DECAY = 24, 64, 0.01, 1e-4
THRESHOLD = 0.3

# Kinds of bytes: lower, upper, digit, blank, line end, sentence marks, other marks, beyond ASCII.
_KIND = np.full(256, 6, np.int64)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 0, 1, 2, 7
_KIND[[0x20, 0x09]] = 3
_KIND[[0x0A, 0x0B, 0x0C, 0x0D]] = 4
_KIND[[ord(c) for c in ".,;:!?'\"()-"]] = 5
_KINDS = 8
N_FEATURES = _KINDS + 8 + SIGNS


def passage_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of each passage, and the first passage of each row (one entry more than rows)."""
    starts, ends, first = split(data, offsets)
    n_rows = len(offsets) - 1
    words = np.diff(first)
    count = np.maximum(1, -(-words // PASSAGE))
    at = np.concatenate([[0], np.cumsum(count)])
    n = int(at[-1])
    row = np.repeat(np.arange(n_rows), count)
    lo = first[row] + (np.arange(n) - at[row]) * PASSAGE
    hi = np.minimum(lo + PASSAGE, first[row + 1])
    has = hi > lo
    out = np.zeros((n, N_FEATURES), np.float32)
    if not len(starts):
        return out, at
    last = len(starts) - 1
    # A passage's bytes run to the next passage of its row, or to the row's end.
    a = np.where(has, starts[np.minimum(lo, last)], offsets[row])
    b = np.where(np.arange(n) + 1 < at[row + 1], starts[np.minimum(hi, last)], offsets[row + 1])
    b = np.maximum(a, b)
    size = np.maximum(b - a, 1)
    kind = _KIND[data]
    for k in range(_KINDS):
        run = np.concatenate([[0], np.cumsum(kind == k)])
        out[:, k] = (run[b] - run[a]) / size
    h = word_hashes(data, starts, ends, True)
    length = (ends - starts).astype(np.float64)
    lead = kind[starts]
    tail = kind[ends - 1]
    m = np.maximum(hi - lo, 1)

    def share(x: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(x, dtype=np.float64)])
        return np.where(has, run[hi] - run[lo], 0) / m

    k = _KINDS
    mean = share(length)
    out[:, k] = mean / 10
    out[:, k + 1] = np.sqrt(np.maximum(share(length**2) - mean**2, 0)) / 10
    out[:, k + 2] = share(lead == 1)
    out[:, k + 3] = share((lead >= 5) & (lead != 7))
    out[:, k + 4] = share(tail == 6)
    out[:, k + 5] = np.log1p(hi - lo) / 5
    passage = np.repeat(np.arange(n), np.maximum(hi - lo, 0))
    key = np.unique((passage.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    out[:, k + 6] = np.bincount((key >> np.uint64(40)).astype(np.int64), minlength=n) / m
    out[:, k + 7] = np.log1p(words[row]) / 10
    bits = mix(h)
    for s in range(SIGNS):
        out[:, k + 8 + s] = 2 * share((bits >> np.uint64(s)) & np.uint64(1)) - has
    return out, at


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(p: dict, x: np.ndarray, at: np.ndarray):
    """Scores of bags: x the passages of all, at where each bag begins (and the end)."""
    h = np.maximum(x @ p["E"] + p["e"], 0)
    t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    logit = (t * g) @ p["w"]
    bag = np.repeat(np.arange(len(at) - 1), np.diff(at))
    weight = np.exp(logit - np.maximum.reduceat(logit, at[:-1])[bag])
    weight /= np.add.reduceat(weight, at[:-1])[bag]
    z = np.add.reduceat(weight[:, None] * h, at[:-1], axis=0)
    return _sigmoid(z @ p["c"] + p["b"][0]), (h, t, g, bag, weight, z)


def _gradient(p: dict, x: np.ndarray, at: np.ndarray, y: np.ndarray, share: np.ndarray) -> dict:
    s, (h, t, g, bag, weight, z) = _forward(p, x, at)
    ds = (s - y) * share
    dz = ds[:, None] * p["c"]
    dw = (dz[bag] * h).sum(1)
    dlogit = weight * (dw - np.add.reduceat(weight * dw, at[:-1])[bag])
    dt = dlogit[:, None] * p["w"] * g * (1 - t * t)
    dg = dlogit[:, None] * p["w"] * t * g * (1 - g)
    dh = (weight[:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T) * (h > 0)
    return {"E": x.T @ dh, "e": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ dlogit, "c": z.T @ ds, "b": np.array([ds.sum()])}


def fit(bags: list[np.ndarray], labels: np.ndarray, seed: int = 11) -> dict:
    """Parameters after EPOCHS passes of Adam over shuffled bags; the two labels weigh the same."""
    rng = np.random.default_rng(seed)
    flat = np.concatenate(bags)
    mean, sd = flat.mean(0), flat.std(0) + 1e-3
    p = {"E": rng.normal(0, N_FEATURES**-0.5, (N_FEATURES, WIDTH)), "e": np.zeros(WIDTH), "V": rng.normal(0, WIDTH**-0.5, (WIDTH, GATE)), "U": rng.normal(0, WIDTH**-0.5, (WIDTH, GATE)), "w": rng.normal(0, GATE**-0.5, GATE), "c": rng.normal(0, WIDTH**-0.5, WIDTH), "b": np.zeros(1)}
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    rate = np.array([max((labels == 0).mean(), 0.02), max((labels == 1).mean(), 0.02)])
    balance = 0.5 / rate[labels]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), BATCH):
            pick = order[i : i + BATCH]
            x = (np.concatenate([bags[j] for j in pick]) - mean) / sd
            at = np.concatenate([[0], np.cumsum([len(bags[j]) for j in pick])])
            step += 1
            for k, g in _gradient(p, x, at, labels[pick], balance[pick] / len(pick)).items():
                g = g + DECAY * p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return p | {"mean": mean.astype(np.float64), "sd": sd.astype(np.float64)}


_SHAPES = {"E": (N_FEATURES, WIDTH), "e": (WIDTH,), "V": (WIDTH, GATE), "U": (WIDTH, GATE), "w": (GATE,), "c": (WIDTH,), "b": (1,), "mean": (N_FEATURES,), "sd": (N_FEATURES,)}


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = TRAIN_ROWS) -> list[dict]:
    """One model for each shard of at most ``max_rows`` labelled rows in all."""
    text_batches(docs.sparkSession)
    chosen = labelled_rows(labels, label, max_rows)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, data, offsets in pieces(b.column("text")):
                x, at = passage_features(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(at * N_FEATURES, pa.int32()), pa.array(x.ravel(), pa.float32()))
                n = len(offsets) - 1
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, n), b.column("y").slice(first, n), lists], names=["doc_id", "y", "x"])

    rows = known.mapInArrow(bags, "doc_id long, y int, x array<float>")

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        p = fit([np.asarray(x, np.float64).reshape(-1, N_FEATURES) for x in pdf["x"]], pdf["y"].to_numpy())
        return pd.DataFrame({"numbers": [np.concatenate([p[k].ravel() for k in _SHAPES]).tolist()]})

    shard = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(SHARDS))
    learned = rows.withColumn("shard", shard).groupBy("shard").applyInPandas(learn, "numbers array<double>").collect()  # at most SHARDS rows
    models = []
    for row in learned:
        flat, p, at = np.array(row.numbers), {}, 0
        for k, shape in _SHAPES.items():
            size = int(np.prod(shape))
            p[k] = flat[at : at + size].reshape(shape)
            at += size
        models.append(p)
    return models


def score(docs: DataFrame, models: list[dict]) -> DataFrame:
    """doc_id and the models' mean score (0 to 1) for every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, data, offsets in pieces(b.column("text")):
                x, at = passage_features(data, offsets)
                n = len(offsets) - 1
                s = np.mean([_forward(p, (x - p["mean"]) / p["sd"], at)[0] for p in models], axis=0) if models else np.full(n, 0.5)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, n), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row; learns only from rows not held out."""
    models = train(docs, labels.filter(~held_out(5, 0)))
    return score(docs, models).select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
