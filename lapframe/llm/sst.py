"""Token-ID output as sorted-string-table shards.

Documents are range-partitioned and sorted by identifier, encoded, and written as shard
files. A shard holds

* data blocks: entries in key order, keys without the prefix they share with the entry
  before, each value a list of token ids; a block is compressed as a whole;
* a sparse index: first key, place, entries and ids before it, for each block;
* a Bloom filter over the keys;
* a footer of fixed size with the places of the parts.

A manifest table, written by Spark once all shards are, names the files that count: what a
lost or repeated task left behind is never read. A lookup asks the filter, searches the
index for its block, and reads one block.

Edge cases: a null text is an empty one (only the end id); a null ``doc_id`` has an empty
key, which sorts first; rows that share a ``doc_id`` are all kept, in order of a hash of their text;
an empty table gives no shard; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import new_folder, stored, text_batches
from .tokens import encoder

MAGIC = b"LFSST001"
BLOCK_BYTES = 1 << 18
#: A shard ends after so many ids or documents, whichever comes first.
SHARD_IDS, SHARD_DOCS = 16_000_000, 1_000_000
#: Schemes of Hadoop's stores that pyarrow knows by another name; file, hdfs, viewfs, gs and abfs(s) are the same.
SCHEMES = {"s3a": "s3", "s3n": "s3"}
#: Keys whose filter bits are set at once.
BLOOM_KEYS = 1 << 16
BLOOM_BITS_PER_KEY, BLOOM_HASHES = 10, 7
_FOOTER = struct.Struct("<QQQQQQ8s")  # index place and length, filter place and length, entries, ids
_ENTRY = struct.Struct("<BBII")  # shared and own key bytes, ids, spare
_INDEX = struct.Struct("<BQQIQQ")  # key length, place, length, entries, entries before, ids before

MANIFEST = "path string, first_key binary, first_hash long, n_docs long, n_tokens long, n_bytes long"
READ = "doc_id long, start long, n_tokens long, ids binary"


def key_of(doc_id: int | None) -> bytes:
    """Bytes that sort as the identifiers do; null first."""
    return b"" if doc_id is None else struct.pack(">Q", doc_id + 2**63)


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - 2**63 if key else None


def _bloom_places(keys: list[bytes], n_bits: int) -> np.ndarray:
    h = np.array([int.from_bytes(k.rjust(8, b"\0"), "big") for k in keys], np.uint64)
    with np.errstate(over="ignore"):
        a = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        b = ((a ^ (a >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)) | np.uint64(1)
        return (a[:, None] + b[:, None] * np.arange(BLOOM_HASHES, dtype=np.uint64)) % np.uint64(n_bits)


class ShardWriter:
    """Builds one shard in memory-bounded blocks, straight to an output stream."""

    def __init__(self, out):
        self.out, self.place = out, 0
        self.keys: list[bytes] = []
        self.index: list[tuple[bytes, int, int, int, int, int]] = []
        self.entries: list[tuple[bytes, np.ndarray]] = []
        self.size = self.n_ids = 0
        self.packer = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        self.entries.append((key, ids))
        self.keys.append(key)
        self.size += 4 * len(ids) + 16
        if self.size >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if not self.entries:
            return
        heads, last = [struct.pack("<I", len(self.entries))], b""
        for key, ids in self.entries:
            shared = next((i for i in range(min(len(key), len(last))) if key[i] != last[i]), min(len(key), len(last)))
            heads.append(_ENTRY.pack(shared, len(key) - shared, len(ids), 0) + key[shared:])
            last = key
        ids = np.concatenate([x for _, x in self.entries])
        wide = 4 if len(ids) and ids.max() > 0xFFFF else 2
        body = bytes([wide]) + b"".join(heads) + ids.astype(f"<u{wide}").tobytes()
        block = self.packer.compress(body)
        self.index.append((self.entries[0][0], self.place, len(block), len(self.entries), len(self.keys) - len(self.entries), self.n_ids))
        self.out.write(block)
        self.place += len(block)
        self.n_ids += len(ids)
        self.entries, self.size = [], 0

    def close(self) -> tuple[int, int, int]:
        """Entries, ids and bytes of the shard."""
        self._flush()
        index = b"".join(_INDEX.pack(len(k), *rest) + k for k, *rest in self.index)
        n_bits = max(64, len(self.keys) * BLOOM_BITS_PER_KEY)
        bits = np.zeros(n_bits, bool)
        if self.keys:
            for i in range(0, len(self.keys), BLOOM_KEYS):
                bits[_bloom_places(self.keys[i : i + BLOOM_KEYS], n_bits).ravel().astype(np.int64)] = True
        bloom = struct.pack("<Q", n_bits) + np.packbits(bits).tobytes()
        footer = _FOOTER.pack(self.place, len(index), self.place + len(index), len(bloom), len(self.keys), self.n_ids, MAGIC)
        self.out.write(index + bloom + footer)
        return len(self.keys), self.n_ids, self.place + len(index) + len(bloom) + len(footer)


class Shard:
    """A shard file opened for lookups and scans."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        index_at, index_len, bloom_at, bloom_len, self.n_docs, self.n_ids, magic = _FOOTER.unpack(self._read(size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        raw, at, self.index = self._read(index_at, index_len), 0, []
        while at < len(raw):
            n, *rest = _INDEX.unpack_from(raw, at)
            at += _INDEX.size
            self.index.append((raw[at : at + n], *rest))
            at += n
        raw = self._read(bloom_at, bloom_len)
        self.n_bits = struct.unpack_from("<Q", raw)[0]
        self.bits = np.frombuffer(raw, np.uint8, offset=8)

    def _read(self, place: int, length: int) -> bytes:
        self.file.seek(place)
        return self.file.read(length)

    def block(self, i: int) -> Iterator[tuple[bytes, int, np.ndarray]]:
        """(key, ids before it in the shard, ids) of a block's entries."""
        _, place, length, n, _, before = self.index[i]
        body = zstandard.ZstdDecompressor().decompress(self._read(place, length))
        wide, at, last, heads = body[0], 5, b"", []
        for _ in range(n):
            shared, own, count, _spare = _ENTRY.unpack_from(body, at)
            at += _ENTRY.size
            last = last[:shared] + body[at : at + own]
            at += own
            heads.append((last, count))
        ids = np.frombuffer(body, f"<u{wide}", offset=at)
        done = 0
        for key, count in heads:
            yield key, before + done, ids[done : done + count]
            done += count

    def may_hold(self, key: bytes) -> bool:
        at = _bloom_places([key], self.n_bits)[0].astype(np.int64)
        return bool(np.all(self.bits[at >> 3] >> (7 - (at & 7)) & 1))

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """Ids of a document, or None: the filter, a binary search of the index, then one block."""
        key = key_of(doc_id)
        if not self.index or not self.may_hold(key):
            return None
        lo, hi = 0, len(self.index)
        while lo < hi:  # the last block whose first key is below, where the first equal key may stand
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.index[mid][0] < key else (lo, mid)
        for i in range(max(0, lo - 1), min(len(self.index), lo + 1)):
            for k, _, ids in self.block(i):
                if k == key:
                    return ids.astype(np.uint32)
        return None


def file_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's store for one of Spark's URIs, and the path in it."""
    scheme, colon, rest = uri.partition(":")
    return pafs.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + colon + rest)


def open_shard(path: str) -> Shard:
    store, at = file_store(path)
    return Shard(store.open_input_file(at))


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write them as shards in ascending doc_id order.

    Returns the manifest: one row for each shard with its path, first key and counts.
    """
    spark = docs.sparkSession
    text_batches(spark)
    folder = folder or new_folder(spark, "shards")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, rows = encoder(tokenizer), np.array([end_id], np.uint32), []
        store, base = file_store(folder)
        store.create_dir(base, recursive=True)
        writer = stream = path = first = None

        def finish():
            n_docs, n_ids, n_bytes = writer.close()
            stream.close()
            rows.append((path, *first, n_docs, n_ids, n_bytes))

        for batch in batches:
            ids_of, hashes = batch.column("doc_id").to_pylist(), batch.column("h").to_pylist()
            for row, ids, offsets in enc.encode(batch.column("text")):
                for i in range(len(offsets) - 1):
                    key = key_of(ids_of[row + i])
                    if writer is None:
                        name = f"{uuid.uuid4().hex}.sst"
                        path, first = f"{folder}/{name}", (key, hashes[row + i])
                        stream = store.open_output_stream(f"{base}/{name}")
                        writer = ShardWriter(stream)
                    writer.add(key, np.concatenate([ids[offsets[i] : offsets[i + 1]], end]))
                    if writer.n_ids >= SHARD_IDS or len(writer.keys) >= SHARD_DOCS:
                        finish()
                        writer = None
        if writer is not None:
            finish()
        columns = list(zip(*rows, strict=True)) or [()] * 6
        kinds = (pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        names = ("path", "first_key", "first_hash", "n_docs", "n_tokens", "n_bytes")
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    dealt = dealt.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    return stored(dealt.mapInArrow(write, MANIFEST), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Every document of the shards: doc_id, ids of all documents before it, its ids (little-endian uint32).

    The running start needs one row per shard, in one task: a shard holds up to 16 million ids or a million documents.
    """
    order = Window.orderBy("first_key", "first_hash", "path").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                shard = open_shard(path)
                for i in range(len(shard.index)):
                    rows = [(id_of(k), base + at, len(ids), ids.astype("<u4").tobytes()) for k, at, ids in shard.block(i)]
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    n = max(1, manifest.count())
    return placed.select("path", "base").repartition(n).mapInArrow(read, READ)


def lookup(manifest: DataFrame, doc_id: int | None) -> np.ndarray | None:
    """Ids of one document, or None: the manifest names the shards whose range can hold it, at most two are asked."""
    below = manifest.filter(F.col("first_key") <= F.lit(bytearray(key_of(doc_id)))).orderBy(F.desc("first_key"), F.desc("first_hash")).limit(2)
    for row in below.select("path").collect():
        if (ids := open_shard(row.path).get(doc_id)) is not None:
            return ids
    return None
