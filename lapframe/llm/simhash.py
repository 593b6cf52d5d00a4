"""SimHash near-duplicate groups by vantage-point trees.

A fingerprint has a bit for each of 64: whether over half the hashes of a document's 4-word
shingles have it. Fingerprints that differ in at most RADIUS bits link. Equal ones are one class; only
classes are compared.

Whole fingerprints of different texts lie about 32 bits apart, whatever the vantage point, and a shard of a tree over
them would have to be searched for most others. So the trees stand over bands of 21 or 22 bits:
fingerprints that differ in at most four bits differ in at most one bit of some band (``BAND_RADIUS``).
For each band a tree is grown on a bounded sample (TREE_SAMPLE classes; it
decides how even the shards are, never which links are found): a node splits band values at the median
of their Hamming distances to a vantage point. A class has one home shard, and visits shards that its ball
of BAND_RADIUS overlaps: the triangle bound prunes the branches, and of the leaves it leaves those
count in which a value of the ball is at home, at most one for each bit of the band. Of two shards only the one with the
smaller number is visited, so a pair meets once. A shard searches its homes with all that visit: again by
vantage points and triangle bounds, until few are left, which are compared by whole fingerprints.
Shards grow in number with the classes, so none is expected to hold more than about SHARD homes; one that does
(classes that share band values) is cut in blocks of homes and visitors. A shard returns a
spanning forest of its links, not all pairs.

Edge cases: a text that is null or without words has fingerprint zero and links like any other; with fewer than
four words the whole sequence is the one shingle. A null doc_id takes part; a component with no other has a
null component_id. Rows that repeat a doc_id are documents of their own. An empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .store import salted_join, stored, text_batches
from .words import _LOWER, pieces, split

SHINGLE, SEED, RADIUS = 4, 42, 4
#: First bit and bits of each band, and the bits that one of them differs in at most: RADIUS // 3.
BANDS, BAND_RADIUS = ((0, 21), (21, 21), (42, 22)), 1
#: Homes expected in a shard, visitors in a block of one, and most classes that a tree is grown on.
SHARD, VISITORS, TREE_SAMPLE = 1 << 15, 1 << 18, 1 << 17
#: Levels of a tree at least: shards enough for the tasks of any cluster that small tables need.
LEVELS = 8
#: Comparisons at which a shard's search stops splitting.
COMPARED = 1 << 16


def _fingerprint(text: memoryview, starts: list[int], ends: list[int]) -> int:
    n = len(starts)
    if not n:
        return 0
    width = min(SHINGLE, n)
    h = np.fromiter((xxhash.xxh64_intdigest(text[s:e], SEED) for s, e in zip(starts, ends[width - 1 :], strict=False)), np.uint64, n - width + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint ``fp`` (64 bits as a long) of every row of ``docs`` (doc_id, text)."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, data, offsets in pieces(b.column("text")):
                starts, ends, word = split(data, offsets)
                # Words of the whole piece with one blank after each.
                size = ends - starts
                to = np.cumsum(size + 1) - size - 1
                line = np.full(int(to[-1] + size[-1]) if len(to) else 0, 0x20, np.uint8)
                line[np.repeat(to, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = _LOWER[data[np.repeat(starts - np.cumsum(size) + size, size) + np.arange(size.sum())]]
                text, to, until = memoryview(line.tobytes()), to.tolist(), (to + size).tolist()
                fp = [_fingerprint(text, to[i:j], until[i:j]) for i, j in zip(word[:-1].tolist(), word[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, len(fp)), pa.array(np.array(fp, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return own.mapInArrow(run, "doc_id long, fp long")


def _band(fp: np.ndarray, band: int) -> np.ndarray:
    low, bits = BANDS[band]
    return ((fp >> np.uint64(low)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def _distance(a: np.ndarray, b: np.ndarray | np.integer) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


class Tree:
    """A vantage-point tree over band values: inner nodes are numbered from 1, node i has 2i (near) and 2i + 1 (far)."""

    def __init__(self, values: np.ndarray, depth: int):
        self.depth = depth
        self.vantage, self.median = np.zeros(1 << depth, np.uint32), np.zeros(1 << depth, np.int16)
        held = {1: values}
        for node in range(1, 1 << depth):
            mine = held.pop(node)
            if len(mine):
                self.vantage[node] = mine[len(mine) // 2]
                d = _distance(mine, self.vantage[node])
                self.median[node] = np.median(d)
                near = d <= self.median[node]
                held[2 * node], held[2 * node + 1] = mine[near], mine[~near]
            else:
                held[2 * node] = held[2 * node + 1] = mine

    def homes(self, values: np.ndarray) -> np.ndarray:
        """The shard of each value."""
        node = np.ones(len(values), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (_distance(values, self.vantage[node]) > self.median[node])
        return node - (1 << self.depth)

    def visits(self, values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Place of a value and shard, for all shards of values within BAND_RADIUS of it, up to that of its own."""
        at, node = np.arange(len(values)), np.ones(len(values), np.int64)
        for _ in range(self.depth):
            d, m = _distance(values[at], self.vantage[node]), self.median[node]
            near, far = d - BAND_RADIUS <= m, d + BAND_RADIUS > m
            at, node = np.concatenate([at[near], at[far]]), np.concatenate([2 * node[near], 2 * node[far] + 1])
        shard = node - (1 << self.depth)
        lower = shard <= self.homes(values)[at]
        at, shard = at[lower], shard[lower]
        # The bound lets branches pass that the ball doesn't reach: its values' homes decide.
        ball = [values, *[values ^ np.uint32(1 << bit) for bit in range(bits)]]
        reached = np.concatenate([(np.arange(len(values)) << self.depth) | self.homes(v) for v in ball])
        held = np.isin((at << self.depth) | shard, reached)
        return at[held], shard[held]


class Forest:
    """Components of the fingerprints of one shard, as labels."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        a, b = self.label[i], self.label[j]
        while True:
            apart = a != b
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            to = np.arange(len(self.label))
            np.minimum.at(to, np.maximum(a, b), np.minimum(a, b))
            while (further := to[to] != to).any():
                to[further] = to[to[further]]
            self.label, a, b = to[self.label], to[a], to[b]


def search(fp: np.ndarray, values: np.ndarray, homes: np.ndarray, queries: np.ndarray, forest: Forest, depth: int = 0) -> None:
    """Join places in ``homes`` with places in ``queries`` whose fingerprints link and whose band values are within BAND_RADIUS."""
    if not len(homes) or not len(queries):
        return
    if len(homes) * len(queries) > COMPARED and len(homes) > 8 and depth < 40:
        d = _distance(values[homes], values[homes[len(homes) * 7 // 11]])
        median = np.median(d)
        near = d <= median
        if not near.all():
            to = _distance(values[queries], values[homes[len(homes) * 7 // 11]])
            search(fp, values, homes[near], queries[to - BAND_RADIUS <= median], forest, depth + 1)
            search(fp, values, homes[~near], queries[to + BAND_RADIUS > median], forest, depth + 1)
            return
    step = max(1, 16 * COMPARED // len(homes))
    for at in range(0, len(queries), step):
        some = queries[at : at + step]
        q, h = np.nonzero(np.bitwise_count(fp[some][:, None] ^ fp[homes][None, :]) <= RADIUS)
        forest.join(some[q], homes[h])


def shard_links(fp: np.ndarray, home: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between homes of one shard (or block) and all in it."""
    order = np.lexsort((~home, fp))
    fp, home = fp[order], home[order]
    first = np.append(True, fp[1:] != fp[:-1])
    fp, home = fp[first], home[first]
    forest = Forest(len(fp))
    search(fp, _band(fp, band), np.flatnonzero(home), np.arange(len(fp)), forest)
    linked = np.flatnonzero(forest.label != np.arange(len(fp)))
    return fp[forest.label[linked]], fp[linked]


def links(classes: DataFrame) -> DataFrame:
    """Links (a, b) between different ``fp`` of a stored table, enough of them to join what is joined by all."""
    spark = classes.sparkSession
    n = classes.count()
    depth = min(TREE_SAMPLE.bit_length() - 4, max(LEVELS, (n // SHARD).bit_length()))
    sample = np.array([r.fp for r in classes.orderBy(F.xxhash64(F.lit(7), "fp"), "fp").limit(TREE_SAMPLE).select("fp").collect()], np.int64).view(np.uint64)
    trees = [Tree(_band(sample, b), depth) for b in range(len(BANDS))]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column("fp")).view(np.uint64)
            for band, tree in enumerate(trees):
                values = _band(fp, band)
                home, (at, shard) = tree.homes(values), tree.visits(values, BANDS[band][1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), band, np.int32)), pa.array(shard), pa.array(shard == home[at]), pa.array(fp[at].view(np.int64))], names=["band", "shard", "home", "fp"])

    routed = stored(classes.select("fp").mapInArrow(route, "band int, shard long, home boolean, fp long"), "routed")
    sizes = routed.groupBy("band", "shard").agg(F.sum(F.col("home").cast("long")).alias("homes"), F.count(F.lit(1)).alias("all"))
    # At most 2**depth shards for each band; those without homes or visitors need no search.
    sizes = sizes.filter((F.col("homes") > 0) & (F.col("all") > 1))
    sizes = sizes.select("band", "shard", F.ceil(F.col("homes") / (2 * SHARD)).alias("parts"), F.ceil(F.col("all") / VISITORS).alias("blocks"))
    dealt = routed.join(F.broadcast(sizes), ["band", "shard"])
    part = F.pmod(F.xxhash64("fp"), "parts").cast("int")
    block = F.pmod(F.xxhash64(F.lit(1), "fp"), "blocks").cast("int")
    # As a home a fingerprint is in one part and meets all blocks; as a visitor it is in one block and meets all parts.
    as_home = dealt.filter("home").select("band", "shard", part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("block"), "home", "fp")
    as_visitor = dealt.filter("NOT home OR parts > 1 OR blocks > 1").select("band", "shard", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)).alias("part"), block.alias("block"), F.lit(False).alias("home"), "fp")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        a, b = shard_links(table.column("fp").to_numpy().view(np.uint64), table.column("home").to_numpy(), key[0].as_py())
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return as_home.unionByName(as_visitor).groupBy("band", "shard", "part", "block").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs`` (doc_id, text)."""
    prints = stored(fingerprints(docs), "fingerprints")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("lead"), F.count(F.lit(1)).alias("count")), "classes")
    labels = connected_components(links(classes))
    led = labels.withColumnRenamed("v", "fp").join(classes.select("fp", "lead"), "fp")
    heads = stored(led.groupBy("label").agg(F.min("lead").alias("head"), F.count(F.lit(1)).alias("count")), "heads")
    of = stored(salted_join(led.select("fp", "label"), heads.drop("count"), "label", counts=heads).select("fp", "head"), "heads_of")
    of_class = classes.join(of, "fp", "left").select("fp", F.coalesce("head", "lead").alias("component_id"))
    found = salted_join(prints, of_class, "fp", counts=classes)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
