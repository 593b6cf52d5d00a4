"""The training-data pipeline: five operators in turn, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from lapframe.llm import decontaminate, exact_dedup, minhash, packing, toxicity
from lapframe.llm.queries import table
from lapframe.llm.store import stored

#: Ids and keys (16 bytes) of rejected documents that are broadcast; more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def _of_text(text: Column) -> Column:
    """A hash of a text; null is empty."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _free(docs: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _match(docs: DataFrame, rows: DataFrame, key: Column, how: str) -> DataFrame:
    """Rows of ``docs`` whose doc_id, null included, and ``key`` together are (not) in ``rows`` (doc_id, key)."""
    of, its = _free(docs, "_id"), _free(docs, "_key")
    ids = stored(rows.select(F.col("doc_id").alias(of), F.col("key").alias(its)).distinct(), "rows")
    small = ids.count() <= BROADCAST_IDS
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(of)) & (key == F.col(its))
    return docs.join(F.broadcast(ids) if small else ids, same, how).select(*docs.columns)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic; it learns from the labels as op7 does.

    Null and empty texts, null ids and repeated rows are judged and kept like any others; without labels
    every document stays; an empty table gives no rows.
    """
    labels = table(spark, sf_dir, "labels").filter(~toxicity.held_out(3, 1))
    return toxicity.without_toxic(docs, toxicity.train(docs, labels))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts: the longest, then the smallest doc_id.

    Rows that share a doc_id only are documents of their own, of rows that share doc_id and text one stays; null
    texts are empty ones; null ids come last; an empty table gives no rows.
    """
    norm = exact_dedup.normalised(F.col("text"))
    # With its doc_id the text's SHA-256 tells rows of equal text apart from all others.
    found = stored(exact_dedup.exact_dedup(docs).withColumnRenamed("text_sha256", "key"), "exact")
    kept = _match(docs, found.filter(~F.col("kept")), F.sha2(norm, 256), "left_anti")
    repeated = stored(found.filter("kept").groupBy("doc_id", "key").count().filter(F.col("count") > 1), "repeated")
    if not repeated.limit(1).count():
        return kept
    # Rows with one doc_id and equal texts: the longest stays.
    several = _match(kept, repeated, F.sha2(norm, 256), "left_semi")
    longest = F.max_by(F.struct(*docs.columns), F.struct(F.char_length("text"), "text"))
    one = several.groupBy("doc_id", F.sha2(norm, 256).alias(_free(docs, "_norm"))).agg(longest.alias("_row")).select("_row.*")
    return _match(kept, repeated, F.sha2(norm, 256), "left_anti").unionByName(one)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near copies.

    Null ids come last; texts without words link with nothing and stay; an empty table gives no rows.
    """
    key = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))  # as in windows.keyed
    return _match(docs, minhash.near_rows(docs, null_ids=True).filter(~F.col("kept")), key, "left_anti")


def reject_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't repeat benchmark items.

    Each row is judged by its own text; null and empty texts stay, and without items all do.
    """
    judged = decontaminate.judged_rows(docs, table(spark, sf_dir, "benchmark"))
    return _match(docs, judged.filter("contaminated"), _of_text(F.col("text")), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document left goes.

    A null or empty text is one piece with the end id; rows with null or repeated ids have pieces of
    their own; an empty table gives no rows.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_exact_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", reject_contaminated),
    ("best_fit_packing", pack),
]

#: SQL can express neither the trained classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in ``sf_dir``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
