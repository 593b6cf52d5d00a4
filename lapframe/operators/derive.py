"""Derived channels: Spark SQL expressions over aligned channels, and functions over whole sessions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.units import convert_units
from ..sources.storage import kept
from .align import align, grid
from .buckets import BUCKET_MS, bucket
from .reports import finite_channels, finite_only


@dataclass
class Derived:
    """A channel by expression. ``deps`` maps names in the expression to channels, ``units`` some of them to a unit.

    nan_min(a, b) and nan_max(a, b) are functions of the expression: NaN if either is.
    """

    name: str
    expr: str
    deps: dict[str, str]
    rate: float | None = None
    enabled: bool = True
    hold: set[str] = field(default_factory=set)
    units: dict[str, str] = field(default_factory=dict)


def _nan_rules(spark: SparkSession) -> None:
    """SQL functions nan_min and nan_max for expressions; least and greatest alone order NaN as a number."""
    for name, pick in (("nan_min", "least"), ("nan_max", "greatest")):
        rule = f"CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN isnan(a) OR isnan(b) THEN double('NaN') ELSE {pick}(a, b) END"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a DOUBLE, b DOUBLE) RETURNS DOUBLE RETURN {rule}")


def ordered(derived: list[Derived]) -> list[Derived]:
    """Enabled definitions, the first of each name, after those they refer to; cycles are left out."""
    first: dict[str, Derived] = {}
    for d in derived:
        if d.enabled:
            first.setdefault(d.name, d)
    state: dict[str, int] = {}
    out: list[Derived] = []

    def visit(name: str) -> bool:
        if name not in first:
            return True
        if name in state:
            return state[name] == 2
        state[name] = 1
        ok = all([visit(dep) for dep in first[name].deps.values()])
        state[name] = 2 if ok else 3
        if ok:
            out.append(first[name])
        return ok

    for name in first:
        visit(name)
    return out


def derive_channels(samples: DataFrame, derived: list[Derived], strict: bool = True) -> DataFrame:
    """Samples of the derived channels.

    Each is a Spark SQL expression over its dependencies, aligned at their timecodes or on a grid;
    it may refer to other derived channels, not in a cycle. A dependency with a unit (F6) is converted
    from the samples' ``units``; where that can't be, it has no rows. Without dependencies the grid is
    once a second. Values that aren't finite drop the session's whole channel (``strict``) or
    only their rows. A missing channel is NULL.
    """
    _nan_rules(samples.sparkSession)
    units = F.col("units") if "units" in samples.columns else F.lit(None).cast("string").alias("units")
    have, out = samples.select("session_id", "channel", "tc", "value", units), None
    for d in ordered(derived):
        own, names = have, {n: (c, d.units.get(n)) for n, c in d.deps.items()}
        if d.units:
            wanted = samples.sparkSession.createDataFrame([(c, u) for c, u in set(names.values()) if u], "channel string, to_units string")
            there = convert_units(have, F.broadcast(wanted)).withColumn("channel", F.concat("channel", F.lit(" ["), "units", F.lit("]")))
            own = have.unionByName(there)
        label = {n: c if u is None else f"{c} [{u}]" for n, (c, u) in names.items()}
        if d.deps:
            wide = align(own, {label[n]: c not in d.hold for n, (c, _) in names.items()}, d.rate)
        else:
            wide = grid(have, d.rate or 1.0)
        wide = wide.select("session_id", "tc", *[F.col(f"`{c}`").alias(n) for n, c in label.items()])
        made = wide.select("session_id", F.lit(d.name).alias("channel"), "tc", F.expr(d.expr).cast("double").alias("value")).filter("value IS NOT NULL")
        # Written, so that channels that refer to each other don't multiply the plan.
        made = kept(finite_channels(made) if strict else finite_only(made), "derived")
        have = have.filter(F.col("channel") != d.name).unionByName(made.withColumn("units", F.lit(None).cast("string")))
        out = made if out is None else out.unionByName(made)
    return out if out is not None else have.drop("units").limit(0)


_functions: dict[str, Callable] = {}


def register_channel_fn(name: str, fn: Callable) -> None:
    """A function of aligned channels (a frame with columns tc and the channels, in order of tc).

    For apply_channel_fn, a frame to one value a row. For apply_channel_fn_in_chunks, a frame and the state that the
    chunk before left (None at first) to the values and the state for the next.
    """
    _functions[name] = fn


def _samples(pdf: pd.DataFrame, result: str, values: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"session_id": pdf["session_id"], "channel": result, "tc": pdf["tc"], "value": np.asarray(values, "float64")})


def _schema(samples: DataFrame) -> str:
    return f"session_id {samples.schema['session_id'].dataType.simpleString()}, channel string, tc double, value double"


def apply_channel_fn(samples: DataFrame, name: str, channels: dict[str, bool], result: str, halo_ms: float | None = None, width: float = BUCKET_MS) -> DataFrame:
    """``name`` over each session's aligned channels, as samples of channel ``result``.

    Without ``halo_ms`` one call holds one session's aligned rows of these channels: a log, not the fleet. With it, a
    call holds a bucket of ``width`` ms and ``halo_ms`` of rows before and after it, for functions that look no
    further (filters, slopes, moving means): long sessions are spread over tasks.
    """
    fn = _functions[name]
    rows = align(samples, channels)
    if halo_ms is None:

        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("tc").reset_index(drop=True)
            return _samples(pdf, result, fn(pdf))

        return rows.groupBy("session_id").applyInPandas(whole, _schema(samples))
    near = F.sequence(bucket(F.col("tc") - halo_ms, width), bucket(F.col("tc") + halo_ms, width))
    rows = rows.withColumn("_own", bucket(F.col("tc"), width)).withColumn("_bucket", F.explode(near))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("tc").reset_index(drop=True)
        made = _samples(pdf, result, fn(pdf.drop(columns=["_own", "_bucket"])))
        return made[(pdf["_own"] == pdf["_bucket"]).to_numpy()]

    return rows.groupBy("session_id", "_bucket").applyInPandas(run, _schema(samples))


def apply_channel_fn_in_chunks(samples: DataFrame, name: str, channels: dict[str, bool], result: str, rows: int = 10_000) -> DataFrame:
    """``name`` over chunks of at most ``rows`` aligned rows of a session in order of time, each with the state that the one before left.

    For functions that depend on all rows before (running sums, filters with memory). Sessions are dealt to tasks and
    sorted there, on disk if need be; a worker holds one chunk and one state.
    """
    fn = _functions[name]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, state = None, None
        for pdf in batches:
            for _, own in pdf.groupby((pdf["session_id"] != pdf["session_id"].shift()).cumsum(), sort=False):
                if session is None or own["session_id"].iloc[0] != session[0]:
                    session, state = (own["session_id"].iloc[0],), None
                for at in range(0, len(own), rows):
                    chunk = own.iloc[at : at + rows].reset_index(drop=True)
                    values, state = fn(chunk, state)
                    yield _samples(chunk, result, values)

    return align(samples, channels).repartition("session_id").sortWithinPartitions("session_id", "tc").mapInPandas(run, _schema(samples))
