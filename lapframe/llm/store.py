"""Where intermediate tables go: the folder that the cluster names for checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. In local mode without one, a folder of our own is set."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="lapframe-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: Rows of texts that go to a Python worker at once: some MB, where 10 000 rows of long texts are hundreds.
TEXT_ROWS = 1000


def text_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session to TEXT_ROWS, unless they are smaller already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXT_ROWS:
        spark.conf.set(name, str(TEXT_ROWS))


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/lapframe/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A key with more than one in so many rows is hot: there are no more hot keys than that.
HOT_SHARE = 4096
#: Keys of fewer rows are never hot.
HOT_ROWS = 1000


def salted_join(big: DataFrame, small: DataFrame, *on: str, counts: DataFrame | None = None) -> DataFrame:
    """Inner join with ``small``, which has each key once; a hot key's rows in ``big`` are dealt to several tasks.

    Keys are counted with sums before the shuffle, unless a stored table ``counts`` (keys, count) has
    the number of rows of all keys that ``big`` has more than once. At most HOT_SHARE are hot; with the number of
    parts that each needs they are broadcast, and ``small`` has their rows once for each part.
    """
    keys = list(on)
    total = big.count() if counts is None else counts.agg(F.sum("count")).first()[0] or 0
    least = max(HOT_ROWS, total // HOT_SHARE)
    hot = (big.groupBy(*keys).count() if counts is None else counts).filter(F.col("count") > least).select(*keys, F.ceil(F.col("count") / least).cast("int").alias("_parts"))
    hot = stored(hot, "hot_keys")
    if not hot.limit(1).count():
        return big.join(small, keys)
    one = F.coalesce("_parts", F.lit(1))
    dealt = big.join(F.broadcast(hot), keys, "left").withColumn("_part", F.when(one == 1, 0).otherwise(F.pmod(F.xxhash64(*big.columns), one)).cast("int")).drop("_parts")
    copies = small.join(F.broadcast(hot), keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), one - 1))).drop("_parts")
    return dealt.join(copies, [*keys, "_part"]).drop("_part")
