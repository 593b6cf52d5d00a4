"""Units: a dimension table, conversion and comparison."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Quantity, symbol, units per base unit, value of the base unit's zero, aliases.
UNITS = [
    ("length", "m", 1.0, 0.0, []),
    ("length", "mm", 1000.0, 0.0, []),
    ("length", "ft", 1 / (0.0254 * 12), 0.0, []),
    ("length", "mile", 1 / (0.0254 * 12 * 5280), 0.0, ["mi"]),
    ("velocity", "m/s", 1.0, 0.0, []),
    ("velocity", "km/h", 3.6, 0.0, ["kph"]),
    ("velocity", "mph", 100 / 2.54 / 12 / 5280 * 3600, 0.0, ["mile/h"]),
    ("time", "s", 1.0, 0.0, []),
    ("time", "ms", 1000.0, 0.0, []),
    ("time", "min", 1 / 60, 0.0, []),
    ("angle", "rad", 1.0, 0.0, []),
    ("angle", "deg", 180 / math.pi, 0.0, ["degrees"]),
    ("pressure", "Pa", 1.0, 0.0, []),
    ("pressure", "kPa", 1e-3, 0.0, []),
    ("pressure", "bar", 1e-5, 0.0, []),
    ("pressure", "psi", 0.0001450377, 0.0, []),
    ("temperature", "K", 1.0, 0.0, []),
    ("temperature", "C", 1.0, -273.15, []),
    ("temperature", "F", 1.8, -459.67, []),
    ("ratio", "ratio", 1.0, 0.0, []),
    ("ratio", "%", 100.0, 0.0, []),
    ("voltage", "V", 1.0, 0.0, ["volts"]),
    ("voltage", "mV", 1000.0, 0.0, []),
    ("current", "A", 1.0, 0.0, []),
    ("volume", "m^3", 1.0, 0.0, []),
    ("volume", "l", 1000.0, 0.0, []),
    ("volume", "USgal", 264.172052, 0.0, []),
    ("acceleration", "m/s^2", 1.0, 0.0, ["m/s/s"]),
    ("acceleration", "G", 0.10197162129779283, 0.0, []),
    ("angular velocity", "rad/s", 1.0, 0.0, []),
    ("angular velocity", "Hz", 1 / (2 * math.pi), 0.0, []),
    ("angular velocity", "rpm", 30 / math.pi, 0.0, ["revs/min"]),
    ("angular velocity", "deg/s", 180 / math.pi, 0.0, []),
    ("volume flow", "m^3/s", 1.0, 0.0, []),
    ("volume flow", "l/s", 1000.0, 0.0, []),
]


def units_table(spark: SparkSession) -> DataFrame:
    """alias (lower case), quantity, symbol, scale, offset: fewer than 100 rows."""
    rows = {}
    for quantity, symbol, scale, offset, aliases in UNITS:
        for alias in (symbol, *aliases):
            rows.setdefault(alias.lower(), (alias.lower(), quantity, symbol, scale, offset))
    return spark.createDataFrame(list(rows.values()), "alias string, quantity string, symbol string, scale double, offset double")


def convert_units(samples: DataFrame, target: DataFrame) -> DataFrame:
    """``samples`` (…, units, value) in the unit that ``target`` (channel, to_units) names.

    The same unit text, or an alias of it, leaves values as they are; an unknown unit, or one
    of another quantity, leaves the channel without rows.
    """
    spark = samples.sparkSession
    u = units_table(spark)
    src = F.broadcast(u.select(F.col("alias").alias("_a"), F.col("quantity").alias("_qa"), F.col("scale").alias("_sa"), F.col("offset").alias("_oa"), F.col("symbol").alias("_ya")))
    dst = F.broadcast(u.select(F.col("alias").alias("_b"), F.col("quantity").alias("_qb"), F.col("scale").alias("_sb"), F.col("offset").alias("_ob"), F.col("symbol").alias("_yb")))
    x = samples.join(target, "channel").join(src, F.lower("units") == F.col("_a"), "left").join(dst, F.lower("to_units") == F.col("_b"), "left")
    same = (F.lower("units") == F.lower("to_units")) | (F.col("_ya") == F.col("_yb"))
    value = F.when(same, F.col("value")).otherwise((F.col("value") - F.col("_oa")) * (F.col("_sb") / F.col("_sa")) + F.col("_ob"))
    x = x.filter(same | (F.col("_qa") == F.col("_qb")))
    return x.select(*[c for c in samples.columns if c not in ("value", "units")], F.col("to_units").alias("units"), value.alias("value"))


def comparable_units(units: DataFrame) -> DataFrame:
    """For each row of ``units`` (unit), every unit of its quantity, or itself if it is unknown."""
    u = units_table(units.sparkSession)
    own = units.join(F.broadcast(u.select("alias", "quantity")), F.lower("unit") == F.col("alias"), "left").select("unit", "quantity")
    all_ = F.broadcast(u.select("quantity", "symbol").distinct())
    return own.join(all_, "quantity", "left").select("unit", F.coalesce("symbol", "unit").alias("other"))
