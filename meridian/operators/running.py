"""Running totals within groups of which one may hold most rows.

The order (a day, a number) is cut into ranges at approximate quantiles. Each group's totals by range, a handful of rows a group, give what a range starts with; inside
a range rows are added up on their own. So a hot group is summed by as many tasks as there are ranges, and exactly, if the values are whole or decimal numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that the order is cut into.
RANGES = 64


def running_before(df: DataFrame, keys: list[str], order: str, ties: list[str], value: str, name: str, ranges: int = RANGES, sizes: DataFrame | None = None) -> DataFrame:
    """df with the sum of `value` over the rows of the same keys that come before the row: by the numeric column `order` (nulls first), then by `ties`, which tell rows apart.

    Nulls of `value` add nothing, the first row of a group has 0. Null keys are a group of their own. `sizes`: rows with `order` that are cheaper to read than df and spread alike; they only say
    where the ranges are cut."""
    by = F.col(order).cast("double")
    cuts = (df if sizes is None else sizes).agg(F.percentile_approx(by, [i / ranges for i in range(1, ranges)], 20 * ranges).alias("_cuts"))
    range_no = F.when(by.isNull(), -1).otherwise(F.coalesce(F.size(F.filter("_cuts", lambda c: c < by)), F.lit(0)))
    names = {f"_g{i}": F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("")) for i, k in enumerate(keys)}  # so that null keys meet
    placed = df.join(F.broadcast(cuts), F.lit(True)).withColumns(names | {"_range": range_no}).drop("_cuts")
    group = [*names, "_range"]
    zero = F.lit(0).cast(df.schema[value].dataType)
    totals = placed.groupBy(*group).agg(F.coalesce(F.sum(value), zero).alias("_total"))
    start = totals.withColumn("_start", F.sum("_total").over(Window.partitionBy(*names).orderBy("_range")) - F.col("_total")).drop("_total")
    inside = Window.partitionBy(*group).orderBy(F.col(order).asc_nulls_first(), *ties).rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(start, group).withColumn(name, F.col("_start") + F.coalesce(F.sum(value).over(inside), zero)).drop(*group, "_start")
