"""Canonical tables in and out of storage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_samples(samples: DataFrame, path: str, buckets: int = 0) -> None:
    """Samples as Parquet, sorted by channel and time within files so that scans prune row groups.

    ``buckets`` above 0 deals sessions to that many folders instead of one each: use it for large fleets.
    """
    if buckets:
        samples = samples.withColumn("bucket", _bucket(buckets))
    part = "bucket" if buckets else "session_id"
    samples.repartition(part).sortWithinPartitions(part, "session_id", "channel", "tc").write.mode("overwrite").partitionBy(part).parquet(path)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("session_id"), F.lit(buckets)).cast("int")


def write_small(table: DataFrame, path: str, kind: str = "parquet") -> None:
    """A dimension table (catalog, tracks, channel definitions) as Parquet or JSON lines."""
    table.coalesce(1).write.mode("overwrite").format(kind).save(path)


def read_samples(spark: SparkSession, path: str, sessions: list | None = None, channels: list[str] | None = None, buckets: int = 0) -> DataFrame:
    """Samples, of the sessions and channels wanted; both reach the scan as pushed filters.

    With the ``buckets`` that write_samples dealt them to, only the folders of the wanted sessions' buckets are opened.
    """
    df = spark.read.parquet(path)
    if sessions is not None:
        df = df.filter(F.col("session_id").isin(sessions))
        if buckets:
            wanted = spark.createDataFrame([(s,) for s in sessions], df.select("session_id").schema).select(_bucket(buckets).alias("b")).distinct()
            df = df.filter(F.col("bucket").isin([r.b for r in wanted.collect()]))  # no more than were asked for
    if channels is not None:
        df = df.filter(F.col("channel").isin(channels))
    return df.select("session_id", "channel", "tc", "value")


#: Schemes of Hadoop's stores that pyarrow knows by another name.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}
#: Text logs that one task writes, into a folder of its own.
LOGS_A_TASK = 1000


def write_logs(lines: DataFrame, path: str, ending: str = "log") -> None:
    """A text file for each session, ``session_id=<id>.<ending>``, of its ``lines`` (session_id, o, value) in the order of o.

    Spark's own writers make a folder for each file, and renames and permissions for both, which is slow to write and
    to list; here tasks stream the lines of some thousand sessions into one folder each. A task that is run again writes
    the same files.
    """
    scheme, colon, rest = path.partition(":")
    uri = _SCHEMES.get(scheme, scheme) + colon + rest

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(uri)
        folder = f"{root}/part={TaskContext.get().partitionId()}"
        session, stream, n = None, None, 0
        for batch in batches:
            for own, value in zip(batch["session_id"].to_pylist(), batch["value"].to_pylist(), strict=True):
                if stream is None or own != session:
                    if stream is None:
                        store.create_dir(folder, recursive=True)
                    else:
                        stream.close()
                    session, stream, n = own, store.open_output_stream(f"{folder}/session_id={own}.{ending}"), n + 1
                stream.write(value.encode() + b"\n")
        if stream is not None:
            stream.close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    sessions = lines.select("session_id").distinct().count()
    tasks = max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sessions // LOGS_A_TASK))
    dealt = lines.repartition(tasks, "session_id").sortWithinPartitions("session_id", "o").select("session_id", "value")
    dealt.mapInArrow(write, "n long").agg(F.sum("n")).collect()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder for checkpoints; in local mode without one, a folder of our own."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="lapframe-")
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """A table written to the folder for checkpoints and read again, so that several uses build it once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sorted_join(df: DataFrame) -> DataFrame:
    """``df`` for a join with a table that has rows for each session, lap or track, as it has: both are dealt by the key, and neither is broadcast.

    The planner goes by bytes on disk, and written tables whose sessions are alike take a byte or two a row: it would
    send hundreds of MB by way of the driver.
    """
    return df.hint("merge")
