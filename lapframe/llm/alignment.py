"""Cross-tokenizer alignment: where the tokens that two tokenizers make of one text begin and end together.

All tokens of both sides lie as byte ranges on one line, a stretch for each document. They are
sorted by start; ``maximum.accumulate`` over their ends tells how far the tokens so far reach, and a new
group begins where a start is not before that. Within a group the overlapping pairs are expanded:
two tilings of a range have fewer overlaps than tokens, so this stays linear. Of overlaps, those
that end at the same byte are the links.

Counts of linked id pairs are taken over the whole corpus. Of two tokens that end together, one's bytes
are a suffix of the other's, so there are no more distinct pairs than all tokens of the two vocabularies have
bytes, times the few tokens that share their bytes (``pair_bound``; about a million
here): the table of counts is broadcast whatever the corpus holds.

Edge cases: a text that is null, empty, or that one of the tokenizers doesn't give back byte for byte has no
tokens: zeros, and an empty hash. Strings of special tokens are plain text. Rows that repeat a doc_id are
documents of their own; a null doc_id stays null. Texts of any length are taken whole. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored, text_batches
from .tokens import Encoder, byte_symbols
from .words import pieces

_BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")


class ByteLevel:
    """Tokens of a byte-level BPE file; ``prefix`` goes before every text."""

    def __init__(self, path: str):
        self.encoder = Encoder(path, plain=True)
        of = {c: bytes([i]) for i, c in enumerate(byte_symbols())}
        size = self.encoder.tokenizer.get_vocab_size()
        names = [self.encoder.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.bytes = [b"".join(of.get(c, c.encode()) for c in name) for name in names]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in turn, and how many each has; a blank goes before each."""
        ids, counts = [], []
        for _, run, offsets in self.encoder.encode(pa.array([b" " + t for t in texts], pa.large_binary()).cast(pa.large_string())):
            ids.append(run)
            counts.append(np.diff(offsets))
        return np.concatenate(ids).astype(np.int64), np.concatenate(counts)


class Pieces:
    """Tokens of a sentence-piece model, which puts a blank before every text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(m[1], 16)]) if (m := _BYTE_PIECE.fullmatch(n)) else n.replace("▁", " ").encode() for n in names]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = self.model.encode([t.decode() for t in texts], num_threads=1)
        counts = np.array([len(f) for f in found], np.int64)
        return np.fromiter((i for f in found for i in f), np.int64, int(counts.sum())), counts


_loaded: dict[tuple[str, str], tuple] = {}


def _tokenizers(a: str, b: str) -> tuple:
    """Both sides with the length of each token, and text of each id before each kind of mark; once for each worker."""
    if (a, b) not in _loaded:
        sides = ByteLevel(a), Pieces(b)
        length = [np.array([len(x) for x in s.bytes], np.int64) for s in sides]
        written = [np.array([f"{i}{mark}" for i in range(len(s.bytes)) for mark in (",", "|;"[k], "")], object) for k, s in enumerate(sides)]
        _loaded[a, b] = sides, length, written
    return _loaded[a, b]


def pair_bound(a: str, b: str) -> int:
    """No corpus links more distinct id pairs than this."""
    sides, length, _ = _tokenizers(a, b)
    same = [max(np.unique(np.array([hash(x) for x in s.bytes]), return_counts=True)[1]) for s in sides]
    return int(length[0].sum() * same[1] + length[1].sum() * same[0])


def coalesce(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Group of each interval: groups break where a start reaches the greatest end so far."""
    order = np.lexsort((end, start))
    reach = np.maximum.accumulate(end[order])
    fresh = np.ones(len(order), bool)
    fresh[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(fresh) - 1
    return group


def overlaps(sa: np.ndarray, ea: np.ndarray, sb: np.ndarray, eb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place in A, place in B) of intervals with a common byte; each side is sorted and doesn't overlap itself."""
    low, high = np.searchsorted(eb, sa, side="right"), np.searchsorted(sb, ea, side="left")
    count = np.maximum(high - low, 0)
    at = np.repeat(np.arange(len(sa)), count)
    return at, np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + low[at]


def _aligned(texts: list[bytes], a: str, b: str) -> dict[str, list | np.ndarray]:
    """Counts, groups and links of a run of texts."""
    sides, length, written = _tokenizers(a, b)
    n = len(texts)
    size = np.array([len(t) + 1 for t in texts], np.int64)
    ids, rows = [], []
    ok = np.array([len(t) > 0 for t in texts])
    for side, lengths in zip(sides, length, strict=True):
        found, count = side.encode(texts)
        at = np.concatenate([[0], np.cumsum(count)])
        row = np.repeat(np.arange(n), count)
        ok &= np.bincount(row, weights=lengths[found], minlength=n).astype(np.int64) == size
        token = side.bytes
        for i in np.flatnonzero(ok).tolist():
            ok[i] = b"".join([token[t] for t in found[at[i] : at[i + 1]].tolist()]) == b" " + texts[i]
        ids.append(found)
        rows.append(row)
    base = np.cumsum(size * ok) - size * ok
    starts, ends = [], []
    for k in (0, 1):
        good = ok[rows[k]]
        ids[k], rows[k] = ids[k][good], rows[k][good]
        end = np.cumsum(length[k][ids[k]])
        ends.append(end)
        starts.append(end - length[k][ids[k]])
    na, nb = len(ids[0]), len(ids[1])
    group = coalesce(np.concatenate(starts), np.concatenate(ends))
    row = np.concatenate(rows)
    ga, gb = overlaps(starts[0], ends[0], starts[1], ends[1])
    together = ends[0][ga] == ends[1][gb]
    ga, gb = ga[together], gb[together]
    # Groups never cross documents: base is a start and an end of both sides.
    of_group = np.zeros(group[-1] + 1 if len(group) else 0, np.int64)
    of_group[group] = row
    # Ids in order of group and side, each with the mark that follows it.
    order = np.argsort(2 * group + np.repeat([0, 1], [na, nb]), kind="stable")
    g, side, r = group[order], (order >= na).astype(np.int64), row[order]
    last = np.append((g[1:] != g[:-1]) | (side[1:] != side[:-1]), True) if len(g) else np.zeros(0, bool)
    mark = last.astype(np.int64)
    closing = np.append(r[1:] != r[:-1], True) if len(r) else np.zeros(0, bool)
    mark[closing] = 2
    shown = np.empty(len(order), object)
    every = np.concatenate(ids)[order]
    for k in (0, 1):
        shown[side == k] = written[k][3 * every[side == k] + mark[side == k]]
    cut = np.searchsorted(r, np.arange(n + 1))
    text = ["".join(shown[i:j].tolist()) for i, j in zip(cut[:-1], cut[1:], strict=True)]
    # Distinct linked id pairs of each document, with how often each occurs there.
    lr, pair = rows[0][ga], (ids[0][ga] << 32) | ids[1][gb]
    by = np.lexsort((pair, lr))
    lr, pair = lr[by], pair[by]
    first = np.flatnonzero(np.append(True, (lr[1:] != lr[:-1]) | (pair[1:] != pair[:-1]))) if len(lr) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(lr)))
    return {
        "n_a": np.bincount(rows[0], minlength=n), "n_b": np.bincount(rows[1], minlength=n), "n_groups": np.bincount(of_group, minlength=n), "n_links": np.bincount(lr, minlength=n),
        "groups": text, "pairs": (np.searchsorted(lr[first], np.arange(n + 1)), pair[first], times),
    }


def align(docs: DataFrame, a: str, b: str, with_groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and the distinct linked pairs of every row of ``docs`` (doc_id, text).

    ``a`` is a byte-level BPE file, ``b`` a sentence-piece model. A pair is (a_id << 32) | b_id with
    the times it occurs in the document. With ``with_groups`` the groups' ids as text come along.
    """
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in pieces(batch.column("text")):
                raw = data.tobytes()
                found = _aligned([raw[i:j] for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], a, b)
                cut, pair, times = found["pairs"]
                cols = [batch.column("doc_id").slice(row, len(offsets) - 1)]
                cols += [pa.array(found[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
                cols.append(pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in found["groups"]], pa.string()))
                pairs = pa.StructArray.from_arrays([pa.array(pair, pa.int64()), pa.array(times, pa.int32())], names=["pair", "times"])
                cols.append(pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pairs))
                names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"]
                if with_groups:
                    cols.append(pa.array(found["groups"], pa.string()))
                    names.append("groups")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<struct<pair:long,times:int>>"
    return own.mapInArrow(run, schema + (", groups string" if with_groups else ""))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, its count over all documents, and whether that is the highest of its B id."""
    per = aligned.select(F.explode("pairs").alias("p")).groupBy(F.col("p.pair").alias("pair")).agg(F.sum("p.times").alias("count"))
    counts = stored(per.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))), "pair_counts")
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(F.broadcast(most), "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, a: str, b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of ``docs``."""
    aligned = stored(align(docs, a, b).withColumn("_row", F.monotonically_increasing_id()), "aligned")
    counts = stored(pair_counts(aligned), "best_pairs")
    links = aligned.select("_row", F.explode("pairs").alias("p")).select("_row", "p.pair", "p.times")
    sums = links.join(F.broadcast(counts), "pair").groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return aligned.drop("pairs").join(sums, "_row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
