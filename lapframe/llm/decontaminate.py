"""Benchmark decontamination by a prefix-filtered set join, with DataFrame functions only.

Every item gives windows of 13 consecutive words (an item of fewer words is one window). A
window is a chain of word shingles at known places; a document can hold it only if it holds
its rarest shingle. So:

1. one pass over the documents hashes their shingles and keeps those that any item has: first
   by a bitmap of at most BITMAP_WORDS numbers, the same for any count of shingles and so always
   small enough to broadcast, then by an exact join of what is left;
2. shingles are ordered by their count in the documents, and each window keeps its rarest
   as its prefix; windows with a shingle that no document has are out;
3. prefixes are joined with the documents' shingles; length and position bounds drop windows
   that would begin before or end after the document;
4. the windows left are verified: of a chain's shingles, those that cover all its words must stand at their
   places, which is an equi-join by document and place. Texts aren't read again, and what a
   document holds isn't gathered into a row: a document with a million hits is a million small rows.

Edge cases: null and empty texts have no words; a document without words is never
contaminated; rows that repeat a ``doc_id`` are judged on their own texts; an item
without an id makes words hit but isn't counted; empty tables give no rows or no hits;
other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import salted_join, stored

WINDOW = 13
SHINGLE = 4
#: Numbers of 64 bits in a bitmap of shingles: a broadcast of 16 MB.
BITMAP_WORDS = 1 << 20
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BASE = 0  # stands for the row itself among its shingles


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased and no other letter."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    lower = F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(lower, _NOT_WORD), "")


def _shingles(words: Column, n: Column, size: int) -> Column:
    """(sh, place) of each ``size`` consecutive words: their hash, and SHINGLE times the first word's number plus size - 1."""
    h = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.struct(F.xxhash64(F.lit(size), *[F.get(words, i + k) for k in range(size)]).alias("sh"), (i * SHINGLE + (size - 1)).cast("long").alias("place")))
    return F.when(n >= size, h).otherwise(F.array().cast("array<struct<sh:bigint,place:bigint>>"))


def item_windows(items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (wid, words, size), and the ids of the items that have them (wid, item_id as a string)."""
    w = items.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("w")).withColumn("n", F.size("w")).filter("n > 0")
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - window, F.lit(0))))
    w = stored(w.select("item_id", "w", at.alias("i")).select("item_id", F.slice("w", F.col("i") + 1, window).alias("words")).distinct(), "item_windows")
    windows = stored(w.select("words").distinct().select(F.monotonically_increasing_id().alias("wid"), "words", F.size("words").alias("size")), "windows")
    return windows, salted_join(w.filter("item_id IS NOT NULL"), windows.select("words", "wid"), "words").select("wid", "item_id")


def bitmap(keys: DataFrame, key: str) -> DataFrame:
    """At most BITMAP_WORDS rows (word, bits) in which every key has its bit set."""
    bit = keys.select(F.pmod(F.xxhash64(F.lit(7), key), F.lit(64 * BITMAP_WORDS)).alias("bit"))
    return bit.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(bit & 63 AS INT)))").alias("bits"))


def may_be_in(rows: DataFrame, key: str, bits: DataFrame) -> DataFrame:
    """Rows whose key has its bit set: all with a key of the bitmap, and a few others."""
    bit = rows.withColumn("_bit", F.pmod(F.xxhash64(F.lit(7), key), F.lit(64 * BITMAP_WORDS))).withColumn("word", F.shiftright("_bit", 6))
    held = bit.join(F.broadcast(bits), "word").filter("(shiftright(bits, CAST(_bit & 63 AS INT)) & 1L) = 1L")
    return held.select(*rows.columns)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, one_in: int = 20) -> DataFrame:
    """n_words, n_hit, n_items, items_sha256 and contaminated for each row of ``docs`` (doc_id, text)."""
    return judged_rows(docs, items, window, one_in).drop("key")


def judged_rows(docs: DataFrame, items: DataFrame, window: int = WINDOW, one_in: int = 20) -> DataFrame:
    """What ``decontaminate`` says of each row, with the key (hash) of its text.

    contaminated: some word is hit, and at least one word in ``one_in``.
    """
    spark = docs.sparkSession
    windows, named = item_windows(items, window)
    named = stored(named, "window_items")
    sizes = sorted(r.s for r in windows.select(F.least("size", F.lit(SHINGLE)).alias("s")).distinct().collect())  # at most SHINGLE values
    chain = F.array().cast("array<struct<sh:bigint,place:bigint>>")
    for s in sizes:
        chain = F.when(F.least("size", F.lit(SHINGLE)) == s, _shingles(F.col("words"), F.col("size"), s)).otherwise(chain)
    windows = stored(windows.select("wid", "size", F.least("size", F.lit(SHINGLE)).alias("s"), F.transform(chain, lambda x: x.sh).alias("chain")), "chains")
    placed = windows.select("wid", F.posexplode("chain").alias("off", "sh"))
    wanted = stored(placed.select("sh").distinct(), "shingles")

    # A row is told by its doc_id, null included, and its text's hash.
    who = ["id", "none", "key"]
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = d.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), F.xxhash64("text").alias("key"), words_of(F.col("text")).alias("words")).withColumn("n_words", F.size("words"))
    own = F.array(F.struct(F.lit(_BASE).cast("long").alias("sh"), F.lit(-1).cast("long").alias("place")))
    d = d.select(*who, "n_words", F.inline(F.concat(own, *[_shingles(F.col("words"), F.col("n_words"), s) for s in sizes])))
    bits = bitmap(wanted.unionByName(spark.range(_BASE, _BASE + 1).toDF("sh")), "sh")
    probed = stored(may_be_in(d, "sh", bits), "probed")
    rows = probed.filter(F.col("place") < 0).select(*who, "n_words")
    found = salted_join(probed.filter(F.col("place") >= 0), wanted, "sh").dropDuplicates([*who, "place"])
    found = stored(found, "shingle_hits")

    counts = found.groupBy("sh").agg(F.count(F.lit(1)).alias("df"))
    rarest = placed.join(counts, "sh", "left").groupBy("wid").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "off", "sh")).alias("r")).filter("r.df > 0")
    # Shingles side by side, and the last, cover all words of a window; the prefix is known to be there.
    cover = F.filter(F.transform("chain", lambda x, i: F.struct(i.alias("off"), x.alias("sh"))), lambda c: ((c.off % F.col("s") == 0) | (c.off == F.col("size") - F.col("s"))) & (c.off != F.col("off")))
    prefixes = stored(windows.join(rarest.select("wid", "r.off", "r.sh"), "wid").select("wid", "size", "s", "off", "sh", cover.alias("cover")), "prefixes")
    near = salted_join(found, prefixes, "sh").withColumn("start", (F.shiftright("place", 2) - F.col("off")).cast("int"))
    near = near.filter((F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.col("n_words"))).select(*who, "wid", "start", "size", "s", "cover")
    near = stored(near, "candidates")
    check = near.select(*who, "wid", "start", "size", "s", F.size("cover").alias("checks"), F.explode("cover").alias("c"))
    check = check.select(*who, "wid", "start", "size", "checks", ((F.col("start") + F.col("c.off")) * SHINGLE + F.col("s") - 1).cast("long").alias("place"), F.col("c.sh").alias("sh"))
    there = check.join(found.select(*who, "place", "sh"), [*who, "place", "sh"]).groupBy(*who, "wid", "start", "size", "checks").count().filter("count = checks")
    hits = stored(there.select(*who, "wid", "start", "size").unionByName(near.filter(F.size("cover") == 0).select(*who, "wid", "start", "size")), "hits")

    # Words that a hit adds to those of the hits before it.
    reached = F.max(F.col("start") + F.col("size")).over(Window.partitionBy(*who).orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1))
    added = F.greatest(F.lit(0), F.col("start") + F.col("size") - F.greatest("start", F.coalesce(reached, F.lit(0))))
    hit = hits.select(*who, "start", "size").distinct().withColumn("added", added).groupBy(*who).agg(F.sum("added").alias("hit"))
    items_of = salted_join(hits.select(*who, "wid").distinct(), named, "wid").groupBy(*who).agg(F.array_sort(F.collect_set("item_id")).alias("names"))
    out = rows.join(hit.join(items_of, who, "left"), who, "left")
    n_hit = F.coalesce(F.col("hit"), F.lit(0)).cast("long")
    return out.select(
        F.when(~F.col("none"), F.col("id")).alias("doc_id"),
        "key",
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.when(F.col("names").isNull(), 0).otherwise(F.size("names")).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("names", ","), F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * one_in >= F.col("n_words"))).alias("contaminated"),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT item_id, least(len(w), 13) AS size, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS phrase FROM bw),
dw AS (
  SELECT doc_id, size, w, unnest(range(1, len(w) - size + 2)) AS i
  FROM d, (SELECT DISTINCT size FROM win) WHERE len(w) >= size),
occ AS (
  SELECT DISTINCT x.doc_id, x.i, x.size, win.item_id
  FROM (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS phrase FROM dw) x
  JOIN win ON x.phrase = win.phrase AND x.size = win.size),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM occ)) GROUP BY doc_id),
it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""
