"""Ordered work on keys of any size: rows are dealt by key and bucket, a stretch of the order.

A window over a whole key (a session, a channel) puts all its rows in one task. Here windows
span one bucket only. What a row needs from beyond its bucket is the last of a kind before it or the first
after it; these come from one row for each bucket, aggregated before the shuffle and looked up over the
buckets of the key, which are few. They join the rows as two edge rows: one ahead of the bucket's rows
(``_side`` -1), one behind them (1). So a bucket without samples is filled from its edges, and a task holds
a bucket's rows however long the key is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

#: Width of a bucket of time: ten minutes in ms, 60 000 rows of a channel of 100 a second.
BUCKET_MS = 600_000.0


def bucket(on: Column, width: float) -> Column:
    return F.floor(on.cast("double") / F.lit(float(width))).cast("long")


def ignoring_nulls(column: str, part: list[str], order: list[str]) -> Column:
    """The next row's value of ``column`` that isn't null, in one pass over the window."""
    quoted = lambda names: ", ".join(n if " " in n else f"`{n}`" for n in names)
    return F.expr(f"lead(`{column}`, 1) IGNORE NULLS OVER (PARTITION BY {quoted(part)} ORDER BY {quoted(order)})")


def first_of(column: str) -> Column:
    """Of structs, the one with the smallest first field and, of these, the largest rest; nulls don't count."""
    return F.expr(f"max_by(`{column}`, CASE WHEN `{column}` IS NOT NULL THEN struct(-`{column}`._on, `{column}`) END)")


def edges(rows: DataFrame, keys: tuple[str, ...], columns: list[str]) -> DataFrame:
    """Two rows for each key and ``_bucket`` of ``rows``: in each of ``columns`` (structs that begin with ``_on``)
    the last before the bucket (``_side`` -1), and the first after it (1)."""
    own = rows.groupBy(*keys, "_bucket").agg(*[F.max(c).alias(c) for c in columns], *[first_of(c).alias(f"_first_{c}") for c in columns])
    by = Window.partitionBy(*keys).orderBy("_bucket")
    ahead = [F.max(c).over(by.rowsBetween(Window.unboundedPreceding, -1)).alias(c) for c in columns]
    behind = [ignoring_nulls(f"_first_{c}", list(keys), ["_bucket"]).alias(f"_next_{c}") for c in columns]
    both = own.select(*keys, "_bucket", *ahead, *behind).withColumn("_side", F.explode(F.array(F.lit(-1), F.lit(1))))
    return both.select(*keys, "_bucket", "_side", *[F.when(F.col("_side") < 0, F.col(c)).otherwise(F.col(f"_next_{c}")).alias(c) for c in columns])


def within(keys: tuple[str, ...], *order: str | Column) -> WindowSpec:
    """Rows of a bucket in order, between its edges."""
    return Window.partitionBy(*keys, "_bucket").orderBy("_side", *order)


def running(spec: WindowSpec) -> WindowSpec:
    return spec.rowsBetween(Window.unboundedPreceding, 0)
