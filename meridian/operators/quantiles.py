"""Exact quantiles without a task that holds all values of a group.

Equal values are counted first. The counts are summed in bins: equal ones between a group's least and largest value, cut further by order of magnitude, so that one far outlier doesn't push all
other values into one bin. Both grow with the value, so their pair is in the order of the values. The bins that hold the wanted ranks follow from the sums, and only their distinct values are
ranked: a task sees a bin's distinct values, never a group's rows. Bins follow from the values alone, so a recomputed task finds the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 4096
#: Bins of each doubling of a value's size.
FINE = 1024


def _size_bin(x: Column) -> Column:
    """A bin that never falls as x grows: FINE a doubling, on both sides of zero."""
    up = F.floor(F.least(F.greatest(F.log2(F.abs(x)), F.lit(-1100.0)), F.lit(1100.0)) * FINE) + 1200 * FINE
    return F.when(x > 0, up).when(x < 0, -up).otherwise(F.lit(0)).cast("long")


def bin_of(x: Column, low: Column, high: Column) -> Column:
    """The bin of a value of a group between low and high: its place among BINS equal ones, then its size."""
    even = F.when((high > low) & (high - low < float("inf")), F.floor((x - low) / (high - low) * (BINS - 1))).otherwise(F.lit(0)).cast("long")
    return F.struct(even.alias("even"), _size_bin(x).alias("size"))


def exact_quantiles(df: DataFrame, value: str, shares: list[float], keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, n and one column q0, q1, ... for each share (0 to 1), interpolated between neighbours. Nulls are left out; groups without values have no row. Null keys are a group."""
    k = "meridian_k"
    counts = df.select(*keys, F.col(value).cast("double").alias("x")).where("x is not null").groupBy(*keys, "x").agg(F.count("*").alias("c"))
    counts = counts.withColumn(k, F.to_json(F.struct(*keys)) if keys else F.lit(""))
    span = counts.groupBy(k, *keys).agg(F.min("x").alias("low"), F.max("x").alias("high"), F.sum("c").alias("n"))
    binned = counts.join(span.select(k, "low", "high"), k).withColumn("bin", bin_of(F.col("x"), F.col("low"), F.col("high")))
    up_to = Window.partitionBy(k).orderBy("bin")  # a row a bin
    sums = binned.groupBy(k, "bin").agg(F.sum("c").alias("m")).withColumn("before", F.sum("m").over(up_to) - F.col("m"))
    ranks = []
    for i, q in enumerate(shares):
        at = F.lit(q) * (F.col("n") - 1)
        ranks += [F.struct(F.lit(i).alias("i"), F.lit(s).alias("side"), (F.floor(at) if s == 0 else F.ceil(at)).cast("long").alias("r"), (at - F.floor(at)).alias("part")) for s in (0, 1)]
    wanted = span.select(k, F.inline(F.array(*ranks)))
    inside = (F.col("r") >= F.col("before")) & (F.col("r") < F.col("before") + F.col("m"))
    at_bin = wanted.join(sums, k).where(inside).select(k, "bin", "i", "side", "part", (F.col("r") - F.col("before")).alias("r"))
    by_value = Window.partitionBy(k, "bin").orderBy("x")
    values = binned.join(at_bin.select(k, "bin").distinct(), [k, "bin"]).withColumn("until", F.sum("c").over(by_value))
    found = values.join(at_bin, [k, "bin"]).where((F.col("r") < F.col("until")) & (F.col("r") >= F.col("until") - F.col("c")))
    side = lambda i, s, c: F.max(F.when((F.col("i") == i) & (F.col("side") == s), F.col(c)))
    out = found.groupBy(k).agg(*((side(i, 0, "x") + (side(i, 1, "x") - side(i, 0, "x")) * side(i, 0, "part")).alias(f"q{i}") for i in range(len(shares))))
    return span.join(out, k).select(*keys, "n", *(f"q{i}" for i in range(len(shares))))
