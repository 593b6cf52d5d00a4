"""Best-fit packing by the sum-of-squares rule.

Documents become token ids (with an end id), those longer than a sequence are cut, and the
pieces are placed in sequences of a fixed capacity. A piece goes where the sum, over
residual gaps, of the squared number of open bins with that gap becomes smallest; among
equals, to the smallest gap.

Pieces are dealt at random to groups of bounded size, each packed in one task, longest
first. Pieces in bins that a group leaves open are dealt and packed again, in fewer groups,
until one group remains; so no task ever holds more than about a group.

Edge cases: a null text is an empty one (one piece with the end id only); rows that repeat
a ``doc_id``, and null ones, are packed as documents of their own; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored, text_batches
from .tokens import encoder

CAPACITY = 2048
#: Pieces that are packed together, about.
GROUP_SIZE = 4000
_BIN_BITS, _LEVEL_BITS = 16, 56


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each size (0 < size <= capacity), in the given order, and the bins' fills."""
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by gap
    n = np.zeros(capacity + 1, np.int64)
    bins, offsets, fills = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    for i, s in enumerate(sizes.tolist()):
        # Change of the sum of squares when a bin goes from gap g to g-s, for each g from s on;
        # gap 0 and bins that aren't open yet don't count.
        change = 2 * (n[: capacity - s] - n[s:capacity]) + 2
        if s < capacity:
            change[0] = 1 - 2 * n[s]
        change = np.where(n[s:capacity] > 0, change, np.iinfo(np.int64).max)
        new = 2 * n[capacity - s] + 1 if s < capacity else 0
        best = int(change.argmin()) if s < capacity else -1
        if best >= 0 and change[best] <= new:
            gap = best + s
            b = open_bins[gap].pop()
            n[gap] -= 1
        else:
            gap, b = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += s
        if gap > s:
            open_bins[gap - s].append(b)
            n[gap - s] += 1
    return bins, offsets, np.array(fills, np.int64)


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    text_batches(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], np.uint32)
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for row, ids, offsets in enc.encode(batch.column("text")):
                out = []
                for i in range(len(offsets) - 1):
                    own = np.concatenate([ids[offsets[i] : offsets[i + 1]], end]).astype("<u4")
                    for piece, start in enumerate(range(0, len(own), capacity)):
                        raw = own[start : start + capacity].tobytes()
                        out.append((doc_ids[row + i], piece, start, len(raw) // 4, zlib.crc32(raw)) + ((raw,) if keep_ids else ()))
                cols = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * keep_ids
                names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, schema)


def _pack_level(items: DataFrame, level: int, capacity: int) -> DataFrame:
    """Pack (item, grp, size): adds bin (a number of its own at every level), offset in it and fill."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "item"], ascending=[False, True], kind="stable")
        bins, offsets, fills = sum_of_squares(pdf["size"].to_numpy(), capacity)
        bin_id = (np.int64(level) << _LEVEL_BITS) | (pdf["grp"].to_numpy() << _BIN_BITS) | bins
        return pd.DataFrame({"item": pdf["item"], "size": pdf["size"], "bin": bin_id, "offset": offsets, "fill": fills[bins]})

    return stored(items.groupBy("grp").applyInPandas(pack, "item long, size long, bin long, offset long, fill long"), f"packed{level}")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False, group_size: int = GROUP_SIZE) -> DataFrame:
    """Place every piece of ``docs`` (doc_id, text): adds sequence_id and offset to the pieces of cut_pieces."""
    if not 0 < 2 * group_size < 1 << _BIN_BITS:
        raise ValueError("group_size is too large")
    # The number is fixed once the table is written: it names a piece whatever its doc_id.
    pieces = stored(cut_pieces(docs, tokenizer, capacity, end_id, keep_ids).withColumn("item", F.monotonically_increasing_id()), "pieces")
    items, n, level, done = pieces.filter(F.col("length") < capacity).select("item", F.col("length").alias("size")), None, 0, []
    while True:
        left = items.count()
        groups = max(1, -(-left // group_size))
        last = groups == 1 or (n is not None and left > 0.9 * n)  # packing again wouldn't help
        n, level = left, level + 1
        placed = _pack_level(items.withColumn("grp", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(groups)).cast("long")), level, capacity)
        done.append((placed if last else placed.filter(F.col("fill") == capacity)).select("item", "bin", "offset"))
        if last:
            break
        items = placed.filter(F.col("fill") < capacity).select("item", "size")
    where = done[0]
    for more in done[1:]:
        where = where.unionByName(more)
    # A piece that fills a sequence has one of its own, numbered below zero.
    out = pieces.join(where, "item", "left")
    return out.select(*[c for c in pieces.columns if c != "item"], F.coalesce("bin", -F.col("item") - 1).alias("sequence_id"), F.coalesce("offset", F.lit(0)).alias("offset"))
