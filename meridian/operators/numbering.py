"""Running numbers over a whole table without a window over all its rows.

Approximate quantiles cut the order into ranges of about equal size; each range numbers its own rows, and the sizes of the ranges before it, a handful of
rows, are added. Which cut points are drawn changes only how even the ranges are, not the numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that a table is cut into.
RANGES = 128


def text_code(x: Column, n: int = 7) -> Column:
    """A whole number of the first n bytes of a text, at most 7: texts in binary order have codes in order, equal where these bytes are."""
    return F.conv(F.rpad(F.hex(F.substring(x.cast("binary"), 1, n)), 2 * n, "0"), 16, 10).cast("long")


def numbered(df: DataFrame, order: str, name: str, ties: tuple[str, ...] = (), ranges: int = RANGES) -> DataFrame:
    """df with the row's number, from 1, in the order of a numeric column and then of `ties`; nulls come first. Rows of one value of `order` share a task, so it should
    tell rows apart by itself or nearly so (a first position, a date, a text's code)."""
    by = F.col(order).cast("double")
    cuts = df.agg(F.percentile_approx(by, [i / ranges for i in range(1, ranges)], 10 * ranges).alias("_cuts"))
    placed = df.join(F.broadcast(cuts), F.lit(True)).withColumn("_range", F.coalesce(F.size(F.filter("_cuts", lambda c: c < by)), F.lit(0))).drop("_cuts")
    placed = placed.withColumn("_range", F.when(by.isNull(), -1).otherwise(F.col("_range")))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))  # at most ranges + 1 rows
    place = F.row_number().over(Window.partitionBy("_range").orderBy(F.col(order).asc_nulls_first(), *ties))
    return placed.withColumn("_place", place).join(F.broadcast(before), "_range").withColumn(name, (F.col("_before") + F.col("_place")).cast("long")).drop("_range", "_place", "_before")


def numbered_groups(df: DataFrame, keys: list[str], order: str, name: str = "group_no") -> DataFrame:
    """The distinct keys with their number, from 1, in order of first appearance: by the least `order` of their rows, then by the keys. Also first_<order>."""
    first = df.groupBy(*keys).agg(F.min(order).alias(f"first_{order}"))
    return numbered(first, f"first_{order}", name, tuple(keys))
