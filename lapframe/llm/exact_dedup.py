"""Exact deduplication by content sort, with DataFrame functions only.

Texts are normalised (all white space ``[\\x20\\x09-\\x0D]`` deleted) and written once with a hash.
They are range-partitioned by sampled splitters on the head of the normalised bytes (and the
hash, so that splitters stay short and texts with one head spread out), sorted externally by the
whole bytes, and equal neighbours grouped by full comparison: the row to keep and the number
of rows come from the run of equals.

A run of equals with more than one in HOT_SHARE of all rows is dealt to several sub-ranges that
follow each other, each sorted and compared in the same way; at most HOT_SHARE texts are so
long a run, which hashes tell beforehand. One row of each sub-range, with its text, is then
compared in full with the others', so the run is whole again, and its rows take the result
through a broadcast of at most HOT_SHARE rows.

Edge cases: a null text is empty; an empty table gives no rows; rows that repeat a
``doc_id`` each count and get the same answer; a null ``doc_id`` is kept only where no other
row is as long; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import stored

HOT_SHARE = 65_536
#: Runs of fewer rows are never dealt out.
HOT_ROWS = 256
HEAD_CHARS = 24


def normalised(text: Column) -> Column:
    """The text without white space; null is empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    for c in " \t\n\x0b\f\r":
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row of ``docs`` (doc_id, text)."""
    text = F.col("text").cast("string")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.char_length(text), F.lit(0)).alias("n_cp"), normalised(text).alias("norm"))
    base = base.withColumn("h", F.xxhash64("norm")).withColumn("row", F.monotonically_increasing_id())
    base = stored(base, "normalised")
    least = max(HOT_ROWS, base.count() // HOT_SHARE)
    hot = stored(base.groupBy("h").count().filter(F.col("count") > least).select("h", F.ceil(F.col("count") / least).alias("parts")), "hot_texts")

    dealt = base.join(F.broadcast(hot), "h", "left").withColumn("part", F.pmod(F.xxhash64("row"), F.coalesce("parts", F.lit(1))))
    ranged = dealt.withColumn("head", F.substring("norm", 1, HEAD_CHARS)).repartitionByRange("head", "h", "part")
    run = Window.partitionBy("head", "h", "part", "norm").orderBy(F.desc("n_cp"), F.asc_nulls_last("doc_id"))
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = ranged.withColumn("i", F.row_number().over(run))
    out = first.select(
        "doc_id",
        F.first("doc_id").over(whole).alias("keep_id"),
        F.count(F.lit(1)).over(whole).alias("group_size"),
        F.sha2("norm", 256).alias("text_sha256"),
        F.first("n_cp").over(whole).alias("keep_cp"),
        F.col("parts").isNotNull().alias("dealt"),
        F.when(F.col("parts").isNotNull() & (F.col("i") == 1), F.col("norm")).alias("norm"),
    )
    if hot.limit(1).count():
        out = stored(out, "runs")
        best = F.min(F.struct((-F.col("keep_cp")).alias("n"), F.col("keep_id").isNull().alias("none"), "keep_id"))
        groups = out.filter(F.col("norm").isNotNull()).groupBy("norm").agg(best.alias("best"), F.sum("group_size").alias("group_size"))
        # No more rows than hot hashes, but for texts that share a hash.
        groups = groups.select(F.sha2("norm", 256).alias("text_sha256"), F.col("best.keep_id").alias("keep_id"), "group_size")
        joined = out.filter("dealt").select("doc_id", "text_sha256").join(F.broadcast(groups), "text_sha256")
        out = out.filter("NOT dealt").select("doc_id", "keep_id", "group_size", "text_sha256").unionByName(joined)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_cp,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
w AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_cp DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM w
"""
