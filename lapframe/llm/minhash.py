"""Near-duplicate groups from bottom-k sketches of one hash function.

A document's set holds the 64-bit hashes of its distinct 5-word shingles; its sketch is the
SKETCH smallest. Documents with one set are one class, compared once. Classes meet in
inverted lists of retained values; an estimate from the two sketches (the share of the
union's sketch that both have) drops most pairs; the rest are confirmed on full sets:
100 * intersection >= 75 * union.

Lists longer than HOT_LIST are never paired out. A class draws its candidates from retained
values that aren't hot: with at least MOSTLY_COLD of one of two linked sets such values, the two
share none of them with a chance below 1e-7. Classes with more hot values than that also
join hot lists. There each member is compared with the list's first and last member, whose pairs are dealt
to several tasks; what is linked so is one component, and only members of different components are compared further:
full sets meet by exact prefixes (of two linked sets, the rarest quarter of each holds a
common value), and sets that meet so form a family. A family's sets are put in blocks by size and
component, and blocks are paired only where sizes allow a link and components differ; so a
component of any size meets its family's strays once, not itself. A pair of blocks is one
matrix product and returns fewer links than it has components. In the same way, of a class's
ordinary candidates the best is confirmed first, and others only if their components still
differ. No link between different components is left out. Work in blocks grows with the square
of those members of a family that are of similar size and still apart after the first links.

Edge cases: a text without words, or null, has an empty set and links with nothing; with
fewer than five words the whole sequence is the one shingle; rows that repeat a ``doc_id`` with
other texts are documents of their own (a row is known by a key of both), equal rows get one
answer; a null ``doc_id`` takes no part and has a null component; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .store import salted_join, stored
from .windows import keyed, only
from .words import mix, phrase_hashes, pieces, split, word_hashes

SHINGLE = 5
SKETCH = 64
CANDIDATES, CANDIDATES_BESIDE_HOT = 16, 32
HOT_LIST = 50
MOSTLY_COLD = 0.6
#: Sets, and values of sets, in a block, about, and columns of a block's matrix.
BLOCK_SETS, BLOCK_VALUES, BLOCK_COLUMNS = 512, 1 << 20, 4096
#: Least estimate that is confirmed: 5.5 standard deviations below 0.75.
LEAST_ESTIMATE = 0.45


def _sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    starts, ends, first = split(data, offsets)
    h = word_hashes(data, starts, ends, True)
    sh = phrase_hashes(h, SHINGLE).view(np.int64)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            yield np.unique(sh[a : b - SHINGLE + 1])
        else:
            yield phrase_hashes(h[a:b], b - a).view(np.int64) if b > a else np.zeros(0, np.int64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64()))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, row key, set size n, set fingerprint (f1, f2) and bottom-k sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, data, offsets in pieces(b.column("text")):
                sets = list(_sets(data, offsets))
                f1 = np.array([int(mix(s.view(np.uint64)).sum(dtype=np.uint64)) for s in sets], np.uint64).view(np.int64)
                f2 = np.array([int(np.bitwise_xor.reduce(mix(s.view(np.uint64) + np.uint64(77)), initial=0)) for s in sets], np.uint64).view(np.int64)
                cols = [b.column("doc_id").slice(first, len(sets)), b.column("key").slice(first, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(f1), pa.array(f2), _lists([s[:SKETCH] for s in sets])]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "key", "n", "f1", "f2", "sketch"])

    return keyed(docs).mapInArrow(run, "doc_id long, key long, n long, f1 long, f2 long, sketch array<long>")


def full_sets(texts: DataFrame) -> DataFrame:
    """Row key, as id, and whole set of each of ``texts`` (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, data, offsets in pieces(b.column("text")):
                sets = list(_sets(data, offsets))
                yield pa.RecordBatch.from_arrays([b.column("key").slice(first, len(sets)), _lists(sets)], names=["id", "hashes"])

    return texts.select("key", "text").mapInArrow(run, "id long, hashes array<long>")


def _enough(a: Column, b: Column) -> Column:
    """Whether the union's sketch lets the two be similar."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, SKETCH)
    return F.size(F.array_intersect(F.array_intersect(a, b), union)) >= LEAST_ESTIMATE * F.size(union)


def _shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def _beside(pairs: DataFrame, own: DataFrame, side: str, hubs: dict[str, DataFrame] | None) -> DataFrame:
    """``pairs`` with the columns that ``own`` has for one side.

    Ids of ordinary lists have few pairs. The ends of a hot list are in as many as it has members: with the
    pairs of each (``hubs``: by side, id and at most how many), theirs are dealt to several tasks.
    """
    return salted_join(pairs, own, side, counts=hubs[side]) if hubs else pairs.join(own, side)


def _estimated(pairs: DataFrame, classes: DataFrame, hubs: dict[str, DataFrame] | None = None) -> DataFrame:
    """Pairs (a, b) whose set sizes and sketches allow a link, with the number of values that both sketches have."""
    for side in "ab":
        own = classes.select(F.col("id").alias(side), F.col("n").alias(f"n{side}"), F.col("sketch").alias(f"s{side}"))
        pairs = _beside(pairs, own, side, hubs)
    sized = pairs.filter((4 * F.col("na") >= 3 * F.col("nb")) & (4 * F.col("nb") >= 3 * F.col("na")))
    return sized.filter(_enough(F.col("sa"), F.col("sb"))).select("a", "b", _shared(F.col("sa"), F.col("sb")).alias("both"))


def _sets_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """The sets of the rows whose keys are in ``ids`` (id)."""
    keys = stored(ids.select(F.col("id").alias("key")).distinct(), "ids")
    return stored(full_sets(only(keyed(docs), keys)).dropDuplicates(["id"]), "sets")


def _confirmed(pairs: DataFrame, docs: DataFrame, with_hubs: bool = False) -> DataFrame:
    """Of stored pairs, those whose full sets have 100 * intersection >= 75 * union."""
    if not pairs.limit(1).count():
        return pairs.select("a", "b")
    hubs = {side: stored(pairs.groupBy(side).count().filter("count > 1"), "pair_counts") for side in "ab"} if with_hubs else None
    sets = _sets_of(pairs.select(F.col("a").alias("id")).union(pairs.select("b")), docs)
    held = pairs.select("a", "b")
    for side in "ba":
        held = _beside(held, sets.select(F.col("id").alias(side), F.col("hashes").alias(f"s{side}")), side, hubs)
    held = held.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), _shared(F.col("sa"), F.col("sb")).alias("both"))
    return held.filter(100 * F.col("both") >= 75 * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def _block_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between components in one block: enough of them to join what belongs together."""
    i, j = int(pdf["bi"].iloc[0]), int(pdf["bj"].iloc[0])
    sides = [pdf[pdf["blk"] == b].sort_values("id") for b in (i, j)]
    sets = [[np.asarray(h, np.int64) for h in side["hashes"]] for side in sides]
    flat = [np.concatenate(s) if s else np.zeros(0, np.int64) for s in sets]
    both = np.intersect1d(*[np.unique(f) for f in flat], assume_unique=True)
    common = np.zeros((len(sets[0]), len(sets[1])), np.float32)
    rows = [np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in sets]
    places = [np.searchsorted(both, f) for f in flat]
    held = [np.flatnonzero((p < len(both)) & (both[np.minimum(p, len(both) - 1)] == f)) if len(both) else np.zeros(0, np.int64) for p, f in zip(places, flat, strict=True)]
    for first in range(0, len(both), BLOCK_COLUMNS):
        m = []
        for k in (0, 1):
            at = held[k][(places[k][held[k]] >= first) & (places[k][held[k]] < first + BLOCK_COLUMNS)]
            x = np.zeros((len(sets[k]), min(BLOCK_COLUMNS, len(both) - first)), np.float32)
            x[rows[k][at], places[k][at] - first] = 1
            m.append(x)
        common += m[0] @ m[1].T
    n = [np.array([len(x) for x in s], np.float64) for s in sets]
    linked = 100 * common.astype(np.float64) >= 75 * (n[0][:, None] + n[1][None, :] - common)
    label = [side["label"].to_numpy() for side in sides]
    ids = [side["id"].to_numpy() for side in sides]
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while root.get(v, v) != v:
            v = root[v]
        return v

    out = []
    for a, b in zip(*np.nonzero(linked & (label[0][:, None] != label[1][None, :])), strict=True):
        x, y = find(int(label[0][a])), find(int(label[1][b]))
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((min(ids[0][a], ids[1][b]), max(ids[0][a], ids[1][b])))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _family_links(ids: DataFrame, labels: DataFrame, docs: DataFrame) -> DataFrame | None:
    """Links between different components (``labels``: v, label) of the classes in ``ids`` (id)."""
    sets = _sets_of(ids, docs)
    values = sets.select("id", F.size("hashes").alias("n"), F.explode("hashes").alias("value"))
    counts = stored(values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "set_values")
    # A set's values that no other has are its rarest, and need no list.
    own = Window.partitionBy("id")
    shared = salted_join(values, counts, "value", counts=counts.withColumnRenamed("df", "count")).withColumn("rank", F.row_number().over(own.orderBy("df", "value"))).withColumn("m", F.count(F.lit(1)).over(own))
    prefix = shared.filter(F.col("rank") + F.col("n") - F.col("m") <= F.floor(F.col("n") / 4) + 1).select("value", "id")
    of = labels.select(F.col("v").alias("id"), "label")
    prefix = stored(prefix.join(of, "id", "left").withColumn("label", F.coalesce("label", "id")), "prefixes")
    lists = prefix.groupBy("value").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("id").alias("first"), F.count(F.lit(1)).alias("count"))
    lists = stored(lists, "prefix_lists")
    open_lists = lists.filter("lo < hi").select("value", "first")
    met = stored(salted_join(prefix, open_lists, "value", counts=lists).filter("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct(), "met")
    if not met.limit(1).count():
        return None
    family = connected_components(met).select(F.col("v").alias("id"), F.col("label").alias("family"))
    member = family.join(of, "id", "left").withColumn("label", F.coalesce("label", "id")).join(sets.select("id", F.size("hashes").alias("n")), "id")
    member = _in_blocks(stored(member, "members"))
    pairs = stored(_block_pairs(member), "block_pairs")
    if not pairs.limit(1).count():
        return None
    # Each block goes to its pairs; a pair's two blocks meet in one task.
    sides = pairs.select("bi", "bj", F.col("bi").alias("blk")).union(pairs.filter("bi <> bj").select("bi", "bj", F.col("bj").alias("blk")))
    shipped = member.select("id", "label", "blk").join(sides, "blk").join(sets, "id").select("bi", "bj", "blk", "id", "label", "hashes")
    return shipped.groupBy("bi", "bj").applyInPandas(_block_links, "a long, b long")


def _in_blocks(member: DataFrame) -> DataFrame:
    """Members (id, family, label, n) with ``band`` and ``blk``: blocks of about BLOCK_SETS sets or BLOCK_VALUES values of one family and band.

    Linked sets differ in size by a factor of 4/3 at most, so they are in one band or in two that follow
    each other. A label with many members in a band has blocks of its own; the others share blocks.
    """
    member = member.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / (math.log(4 / 3) + 1e-6)).cast("int"))
    place = ["family", "band"]
    fill = F.greatest(F.count(F.lit(1)) / BLOCK_SETS, F.sum("n") / BLOCK_VALUES)
    labels = member.groupBy(*place, "label").agg(fill.alias("fill"))
    big = F.col("fill") > 1
    shared = labels.filter(~big).groupBy(*place).agg(F.ceil(F.sum("fill")).alias("parts"))
    split = labels.join(shared, place, "left").select(*place, "label", F.when(big, F.ceil("fill")).alias("own"), "parts")
    member = member.join(split, [*place, "label"])
    number = F.when(F.col("own").isNotNull(), F.pmod(F.xxhash64("id"), "own")).otherwise(F.pmod(F.xxhash64(F.lit(1), "label"), "parts"))
    return member.withColumn("blk", F.xxhash64(*place, F.when(F.col("own").isNotNull(), F.col("label")), number)).select("id", "family", "label", "n", "band", "blk")


def _block_pairs(member: DataFrame) -> DataFrame:
    """Pairs of blocks (bi, bj) that can hold a link between two labels."""
    blocks = member.groupBy("family", "band", "blk").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most"))
    other = blocks.select("family", *[F.col(c).alias(f"{c}2") for c in ("band", "blk", "lo", "hi", "least", "most")])
    near = blocks.withColumn("band2", F.explode(F.array("band", F.col("band") + 1))).join(other, ["family", "band2"])
    near = near.filter((F.col("band") < F.col("band2")) | (F.col("blk") <= F.col("blk2")))
    two = (F.col("lo") < F.col("hi")) | (F.col("lo2") < F.col("hi2")) | (F.col("lo") != F.col("lo2"))
    sized = (4 * F.col("most") >= 3 * F.col("least2")) & (4 * F.col("most2") >= 3 * F.col("least"))
    return near.filter(two & sized).select(F.col("blk").alias("bi"), F.col("blk2").alias("bj"))


def near_rows(docs: DataFrame, null_ids: bool) -> DataFrame:
    """doc_id, row key, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text).

    Of each component the row with the smallest doc_id (then key) is kept. Rows with a null
    doc_id take part if ``null_ids``, and come last; else they are kept.
    """
    rows = stored(sketches(docs), "sketches")
    real = (F.col("n") > 0) if null_ids else (F.col("n") > 0) & F.col("doc_id").isNotNull()
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    classes = rows.filter(real).groupBy("n", "f1", "f2").agg(lead.alias("lead"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("count"))
    classes = stored(classes.withColumn("id", F.col("lead.key")), "classes")

    values = classes.select("id", F.posexplode("sketch").alias("rank", "value"))
    hot = stored(values.groupBy("value").count().filter(F.col("count") > HOT_LIST).select("value", F.lit(True).alias("hot")), "hot_values")
    if hot.limit(1).count():
        marked = values.join(hot, "value", "left")
        # At most SKETCH values of a class come together.
        per = marked.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "value", F.coalesce("hot", F.lit(False)).alias("hot")))).alias("v"))
        cold = F.filter("v", lambda x: ~x.hot)
        per = per.select("id", "v", cold.alias("cold"), F.size("v").alias("all")).withColumn("mixed", F.size("cold") < F.col("all"))
        per = stored(per.select(
            "id",
            F.transform(F.slice("cold", 1, F.when(F.col("mixed"), CANDIDATES_BESIDE_HOT).otherwise(CANDIDATES)), lambda x: x.value).alias("cold"),
            F.when(F.size("cold") < MOSTLY_COLD * F.col("all"), F.transform(F.filter(F.slice("v", 1, CANDIDATES), lambda x: x.hot), lambda x: x.value)).alias("hot"),
        ), "lists")
        listed = per.select("id", F.explode("cold").alias("value"))
        hot_listed = per.select("id", F.explode("hot").alias("value"))
    else:
        listed = classes.select("id", F.explode(F.slice("sketch", 1, CANDIDATES)).alias("value"))
        hot_listed = None

    # Lists of one are the most; a count with map-side sums drops them before rows are paired.
    listed = stored(listed, "listed")
    several = listed.groupBy("value").count().filter(F.col("count") > 1).select("value")
    listed = stored(listed.join(several, "value"), "several")
    pairs = listed.select("value", F.col("id").alias("a")).join(listed.select("value", F.col("id").alias("b")), "value").filter("a < b")
    overlaps = pairs.groupBy("a", "b").count()
    # A set of one or two values can share no more; any other linked pair shares two but for a chance below 1e-7.
    tiny = classes.filter("n <= 4").select("id")
    few = overlaps.filter("count = 1").join(tiny, F.col("b") == F.col("id"), "left_semi").select("a", "b")
    candidates = stored(_estimated(overlaps.filter("count > 1").select("a", "b").unionByName(few), classes), "candidates")

    first = candidates.groupBy("b").agg(F.max_by("a", F.struct("both", -F.col("a"))).alias("a")).select("a", "b")
    if hot_listed is not None:
        ends = stored(hot_listed.groupBy("value").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("count")), "hot_lists")
        star = salted_join(hot_listed, ends.drop("count"), "value", counts=ends)
        star = star.select(F.col("lo").alias("a"), F.col("id").alias("b")).union(star.select(F.col("id").alias("a"), F.col("hi").alias("b"))).filter("a < b").distinct()
        hubs = {side: ends.groupBy(F.col(end).alias(side)).agg(F.sum("count").alias("count")) for side, end in (("a", "lo"), ("b", "hi"))}
        first = first.unionByName(_estimated(star, classes, hubs).select("a", "b")).distinct()
    links = stored(_confirmed(stored(first, "first"), docs, with_hubs=hot_listed is not None), "links")
    labels = connected_components(links)

    def component(ids: DataFrame, side: str) -> DataFrame:
        own = labels.select(F.col("v").alias(side), F.col("label").alias(f"l{side}"))
        return ids.join(own, side, "left").withColumn(f"l{side}", F.coalesce(f"l{side}", side))

    rest = component(component(candidates.select("a", "b"), "a"), "b").filter("la <> lb").select("a", "b")
    more = _confirmed(stored(rest.distinct(), "rest"), docs)
    if hot_listed is not None:
        ends = _family_links(hot_listed.select("id"), labels, docs)
        more = more if ends is None else more.unionByName(ends)
    more = stored(more, "more_links")
    if more.limit(1).count():
        # The components found so far are the vertices now; one without links so far is a class.
        ends = component(component(more, "a"), "b").filter("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b"))
        merged = connected_components(ends)
        last = labels.join(merged.select(F.col("v").alias("label"), F.col("label").alias("last")), "label", "left")
        new = merged.join(labels.select("v"), "v", "left_anti")
        labels = stored(last.select("v", F.coalesce("last", "label").alias("label")).unionByName(new), "all_labels")

    own = rows.select("doc_id", "key", "n", "f1", "f2")
    # A class of one needs no lookup; others find their class by the fingerprint, then its component's first row.
    linked = stored(labels.withColumnRenamed("v", "id").join(classes.select("id", "lead"), "id"), "linked")
    heads = linked.groupBy("label").agg(F.min("lead").alias("head"))
    of_class = classes.join(linked.join(heads, "label").select("id", "head"), "id", "left").select("n", "f1", "f2", F.coalesce("head", "lead").alias("head"))
    found = salted_join(own.filter(real), of_class, "n", "f1", "f2", counts=classes)
    found = found.select("doc_id", "key", "n", F.col("head.doc_id").alias("component_id"), (F.col("key") == F.col("head.key")).alias("kept"))
    alone = own.filter(~real).select("doc_id", "key", "n", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return found.unionByName(alone).withColumnRenamed("n", "n_shingles")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text)."""
    return near_rows(docs, null_ids=False).drop("key")
