"""Vector code compression: every part of a vector becomes the number of its nearest codebook entry.

Distances are found in the Walsh-Hadamard domain. Integer parts and entries, zero-padded to a power of
two P, are transformed; the squared differences of the transforms sum to P times the squared
distance, so they order entries and tell distances exactly, in whole numbers. Coefficients are taken in sequency
order, where the first ones hold most of the difference between smooth parts: an entry whose partial
sum exceeds the full sum of a likely entry is dropped before the rest is added.

Each round is one pass over the table: tasks assign their rows, add up parts by entry, and hand on
one row for each entry and place; the sums meet by key. Only the codebooks (ENTRIES entries as wide
as one vector) go through the driver.

Edge cases: rows with a null vector or with null or non-finite components are dropped; so are rows whose
vector differs in length from that of the smallest kept vec_id, which sets the width. A width
that isn't a multiple of PARTS is filled up with zeros at the end. Equal vec_ids are ordered by their vectors, a
null vec_id comes last. With fewer than ENTRIES rows the codebooks are as short. Components of any finite size are exact: blocks
that could leave 64 bits are computed with unbounded integers. An error beyond 2**63 - 1
is returned as that number. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import salted_join, stored, text_batches

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Coefficients that are added for all entries before any is dropped.
FIRST = 4
#: Partial sums held at once, and labels (a sum each) that are broadcast; more are joined by shuffle.
BLOCK, BROADCAST_LABELS = 1 << 18, 1_000_000
#: Sums are handed on in limbs of so many bits, which add up without overflow.
LIMB = 40
MOST = 2**63 - 1


def sequency_order(p: int) -> np.ndarray:
    """Place in natural (Hadamard) order of each Walsh function by number of sign changes; p is a power of two."""
    s = np.arange(p)
    gray, place = s ^ (s >> 1), np.zeros(p, np.int64)
    for bit in range(p.bit_length() - 1):
        place = (place << 1) | ((gray >> bit) & 1)
    return place


def walsh(x: np.ndarray) -> np.ndarray:
    """Unscaled Walsh-Hadamard transform of each row, zero-padded to a power of two, in sequency order."""
    n, wide = x.shape
    p = 1 << max(0, wide - 1).bit_length()
    y = np.zeros((n, p), x.dtype)
    y[:, :wide] = x
    half = 1
    while half < p:
        pairs = y.reshape(n, p // (2 * half), 2, half)
        y = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, p)
        half *= 2
    return y[:, sequency_order(p)]


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest of ``entries`` for each row of ``x``, both transformed, and the sum of squared differences."""
    n, p = x.shape
    index, total = np.zeros(n, np.int64), np.zeros(n, x.dtype)
    step = max(1, BLOCK // len(entries))
    for at in range(0, n, step):
        rows = x[at : at + step]
        part = np.zeros((len(rows), len(entries)), x.dtype)
        for c in range(min(FIRST, p)):
            part += (rows[:, c, None] - entries[None, :, c]) ** 2
        likely = part.argmin(1)
        full = part[np.arange(len(rows)), likely] + ((rows[:, FIRST:] - entries[likely, FIRST:]) ** 2).sum(1)
        r, e = np.nonzero(part <= full[:, None])
        partial = part[r, e]
        for c in range(FIRST, p):
            partial = partial + (rows[r, c] - entries[e, c]) ** 2
            left = partial <= full[r]
            if not left.all():
                r, e, partial = r[left], e[left], partial[left]
        # Pairs are in order of row and entry, and every row has its likely entry left.
        first = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        best = np.minimum.reduceat(partial, first)
        hit = np.flatnonzero(partial == best[r])
        _, one = np.unique(r[hit], return_index=True)
        index[at : at + step], total[at : at + step] = e[hit[one]], best
    return index, total


def whole_numbers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * value) of finite doubles: 64-bit if all are small, else unbounded integers."""
    if not len(values) or np.abs(values).max() < 2**52 / SCALE:
        return np.floor(values * SCALE).astype(np.int64)
    # Beyond 2**52 a double is whole.
    return np.array([int(v) * SCALE if abs(v) >= 2**52 else int(np.floor(v * SCALE)) for v in values.tolist()], object)


def _fits(p: int, *arrays: np.ndarray) -> bool:
    """Whether sums of squared differences of transforms stay below 2**62."""
    most = max((int(np.abs(a).max()) for a in arrays if a.size), default=0)
    return 4 * most * most * p * p < 2**62


class Codebooks:
    """The entries of each part, and the assignment of blocks of vectors to them."""

    def __init__(self, entries: list[list[list[int]]]):
        self.entries = entries
        self.wide = len(entries[0][0])
        self.padded = 1 << max(0, self.wide - 1).bit_length()

    def assign(self, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each part: the entry of each row of ``q`` (whole numbers), and the squared distance."""
        for part, entries in enumerate(self.entries):
            mine, own = q[:, part * self.wide : (part + 1) * self.wide], np.array(entries, object).reshape(len(entries), self.wide)
            kind = np.int64 if _fits(self.padded, mine, own) else object
            index, total = nearest(walsh(mine.astype(kind)), walsh(own.astype(kind)))
            yield index, total // self.padded

    def text(self) -> str:
        return ",".join(str(v) for part in self.entries for entry in part for v in entry)


def finite(vectors: DataFrame) -> DataFrame:
    """vec_id, label and the vector as doubles, of rows with finite components only."""
    text_batches(vectors.sparkSession)
    own = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    return own.filter(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def _matrix(column: pa.Array, wide: int) -> np.ndarray:
    """The vectors of a batch, filled up to ``wide`` numbers each, as whole numbers."""
    n = len(column)
    flat = whole_numbers(np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)).reshape(n, -1)
    if flat.shape[1] == wide:
        return flat
    full = np.zeros((n, wide), flat.dtype)
    full[:, : flat.shape[1]] = flat
    return full


def _limbs(value: int) -> list[int]:
    """Signed limbs of LIMB bits, lowest first, whose weighted sum is ``value``."""
    out = []
    while not -(1 << LIMB) < value < 1 << LIMB:
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def _sums(vectors: DataFrame, books: Codebooks) -> dict[tuple[int, int], list[int]]:
    """For each part and entry in use: the count of its parts, then their sum at each place."""
    wide = books.wide

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(e), wide + 1), object) for e in books.entries]
        for b in batches:
            if not b.num_rows:
                continue
            q = _matrix(b.column("v"), wide * len(books.entries))
            for part, (index, _) in enumerate(books.assign(q)):
                mine = q[:, part * wide : (part + 1) * wide]
                order = np.argsort(index, kind="stable")
                first = np.flatnonzero(np.append(True, np.diff(index[order]) != 0))
                used = index[order][first]
                sums[part][used, 0] += np.diff(np.append(first, len(index)))
                if wide:
                    sums[part][used, 1:] += np.add.reduceat(mine[order], first, axis=0)
        out = [(part, e, place, limb, v) for part, s in enumerate(sums) for e in np.flatnonzero(s[:, 0]).tolist() for place, total in enumerate(s[e].tolist()) for limb, v in enumerate(_limbs(int(total)))]
        cols = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int32()) for c in cols[:4]], pa.array(cols[4], pa.int64())], names=["part", "entry", "place", "limb", "value"])

    found: dict[tuple[int, int], list[int]] = {}
    totals = vectors.select("v").mapInArrow(run, "part int, entry int, place int, limb int, value long").groupBy("part", "entry", "place", "limb").agg(F.sum("value").alias("value"))
    for r in totals.collect():  # bounded by the size of the codebooks
        found.setdefault((r.part, r.entry), [0] * (wide + 1))[r.place] += r.value << (LIMB * r.limb)
    return found


def codebooks(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """Finite vectors of the common width, and the codebooks after ``rounds`` rounds (none if there is no vector)."""
    kept = finite(vectors)
    order = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    first = kept.orderBy(*order).limit(1).collect()
    if not first:
        return kept, None
    kept = kept.filter(F.size("v") == len(first[0].v))
    wide = -(-len(first[0].v) // PARTS)
    seeds = [r.v for r in kept.orderBy(*order).limit(ENTRIES).select("v").collect()]
    q = [[int(x) for x in whole_numbers(np.array(v, np.float64))] + [0] * (wide * PARTS - len(v)) for v in seeds]
    books = Codebooks([[row[p * wide : (p + 1) * wide] for row in q] for p in range(PARTS)])
    for _ in range(rounds):
        sums = _sums(kept, books)
        books = Codebooks([[[t // sums[p, e][0] for t in sums[p, e][1:]] if (p, e) in sums else entry for e, entry in enumerate(part)] for p, part in enumerate(books.entries)])
    return kept, books


def encode(kept: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code (two hex digits for each part) and error of every row of ``kept``."""
    kinds = kept.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = _matrix(b.column("v"), books.wide * len(books.entries)) if b.num_rows else np.zeros((0, 0), np.int64)
            found = list(books.assign(q)) if b.num_rows else []
            code = ["".join(f"{i:02x}" for i in row) for row in zip(*[index.tolist() for index, _ in found], strict=True)]
            error = [min(MOST, sum(int(d) for d in row)) for row in zip(*[d.tolist() for _, d in found], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(code, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    schema = f"vec_id {kinds['vec_id'].dataType.simpleString()}, label {kinds['label'].dataType.simpleString()}, code string, error long"
    return kept.mapInArrow(run, schema)


def compress(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every finite vector (vec_id, embedding, label)."""
    kept, books = codebooks(vectors)
    if books is None:
        return kept.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    # to_json leaves a null label out, so nulls share a key of their own.
    coded = stored(encode(kept, books).withColumn("_of", F.to_json(F.struct("label"))).drop("label"), "codes")
    wide = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = stored(coded.groupBy("_of").agg(F.least(wide, F.lit(MOST)).cast("long").alias("label_error"), F.count(F.lit(1)).alias("count")), "label_errors")
    own = sums.drop("count")
    held = coded.join(F.broadcast(own), "_of") if sums.count() <= BROADCAST_LABELS else salted_join(coded, own, "_of", counts=sums)
    return held.select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(books.text().encode()).hexdigest()).alias("codebooks_sha256"))


def _sql() -> str:
    """The same in SQL, for vectors whose width is a multiple of PARTS."""
    steps = [
        f"kept AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS r, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q FROM embeddings"
        " WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"cells AS (SELECT r, i // (len(q) // {PARTS}) AS part, i % (len(q) // {PARTS}) AS place, q[i + 1] AS v FROM (SELECT r, q, unnest(range(len(q))) AS i FROM kept))",
        f"book0 AS (SELECT part, r AS entry, place, v FROM cells WHERE r < {ENTRIES})",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"far{k} AS (SELECT c.r, c.part, b.entry, sum((c.v - b.v) * (c.v - b.v)) AS d FROM cells c JOIN book{k} b USING (part, place) GROUP BY ALL)")
        steps.append(f"near{k} AS (SELECT r, part, min(d) AS d, arg_min(entry, (d, entry)) AS entry FROM far{k} GROUP BY ALL)")
        if k < ROUNDS:
            steps.append(f"mean{k} AS (SELECT part, entry, place, ((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS v FROM cells JOIN near{k} USING (r, part) GROUP BY ALL)")
            steps.append(f"book{k + 1} AS (SELECT part, entry, place, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN mean{k} m USING (part, entry, place))")
    steps.append(f"coded AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near{ROUNDS} GROUP BY r)")
    steps.append(f"hashed AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM book{ROUNDS})")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (r), hashed"


SQL = _sql()
