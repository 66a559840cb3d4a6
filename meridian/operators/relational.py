"""Joins with checked cardinality, referential integrity, nearest match, cell differences and partition proofs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import is_blank, number


class RuleBroken(ValueError):
    """A precondition or a verification doesn't hold."""


def require(holds: bool, message: str) -> None:
    if not holds:
        raise RuleBroken(message)


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, which fails when it is evaluated if a key repeats. The check is part of the plan: an aggregate by key, no job of its own."""
    rest = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(F.count("*").alias("meridian_n"), *(F.first(c).alias(c) for c in rest))
    holds = F.when(F.col("meridian_n") == 1, True).otherwise(F.raise_error(F.lit(f"keys repeat: {keys}")).cast("boolean"))
    return one.where(holds).select(*df.columns)


def many_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", found: str | None = None) -> DataFrame:
    """Join that keeps the number of left rows; `found` names a column that tells a match."""
    right = assert_unique(right, keys)
    if found:
        right = right.withColumn(found, F.lit(True))
    out = left.join(right, keys, how)
    return out.withColumn(found, F.coalesce(found, F.lit(False))) if found else out


def find_column(columns: list[str], exact: list[str], keyword: str) -> str:
    """The first column with one of the exact names (whatever their case), else the first whose name holds the keyword; RuleBroken if there is none."""
    low = {c.lower(): c for c in reversed(columns)}
    for name in exact:
        if name.lower() in low:
            return low[name.lower()]
    found = next((c for c in columns if keyword.lower() in c.lower()), None)
    if found is None:
        raise RuleBroken(f"no column like {exact} or {keyword}")
    return found


def numeric_or_stop(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as finite numbers; a blank or another text fails the query when it is evaluated, as part of its plan."""
    checked = {}
    for c in columns:
        x = number(F.col(c))
        checked[c] = F.when(x.isNotNull(), x).otherwise(F.raise_error(F.concat(F.lit(f"{c} isn't numeric: "), F.coalesce(F.col(c), F.lit("null")))).cast("string").cast("double"))
    return df.withColumns(checked)


def inner_suffixed(left: DataFrame, right: DataFrame, keys: list[str], suffix: str) -> DataFrame:
    """Many-to-one inner join; the right side's columns that clash get a suffix."""
    right = assert_unique(right, keys)
    clash = [c for c in right.columns if c in left.columns and c not in keys]
    return left.join(right.withColumnsRenamed({c: c + suffix for c in clash}), keys)


def outer_marked(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join with `side`: both, left or right."""
    a, b = left.withColumn("_l", F.lit(1)), right.withColumn("_r", F.lit(1))
    side = F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), "both").when(F.col("_l").isNotNull(), "left").otherwise("right")
    return a.join(b, keys, "full_outer").withColumn("side", side).drop("_l", "_r")


def referential_integrity(child: DataFrame, ckey: str, parent: DataFrame, pkey: str) -> DataFrame:
    """One row: rows, blank keys, matched, orphans, distinct orphan keys, unused parents. Keys are compared as text; blanks match nothing."""
    keys = child.groupBy(F.col(ckey).cast("string").alias("k")).agg(F.count("*").alias("n"))
    owners = parent.select(F.col(pkey).cast("string").alias("k")).where(~is_blank(F.col("k"))).distinct().withColumn("known", F.lit(1))
    both = keys.join(owners, "k", "full_outer")
    blank, n = is_blank(F.col("k")), F.coalesce("n", F.lit(0))
    count = lambda c, v: F.coalesce(F.sum(F.when(c, v)), F.lit(0)).cast("long")
    lost = ~blank & F.col("known").isNull()
    return both.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_rows"),
        count(blank, n).alias("n_blank"),
        count(~blank & F.col("known").isNotNull(), n).alias("n_match"),
        count(lost, n).alias("n_orphan"),
        count(lost, F.lit(1)).alias("n_orphan_keys"),
        count(F.col("known").isNotNull() & F.col("n").isNull(), F.lit(1)).alias("n_unused_parents"),
    )


def nearest(left: DataFrame, right: DataFrame, keys: list[str], left_date: str, right_date: str, order: list[str]) -> DataFrame:
    """Each left row with the right row of the nearest date of its keys; ties go to the earlier date. Unmatched rows stay.

    Both sides' distinct (keys, date) are laid on one line and the neighbours looked up by windows, so a key's rows are never multiplied:
    the work is a sort, not the product of both sides. `order` lists the left columns to keep besides keys and date; right_date is the only
    right column."""
    dates = right.select(*keys, F.col(right_date).alias("_d")).where(F.col("_d").isNotNull()).distinct().withColumn("_r", F.col("_d"))
    line = left.select(*keys, F.col(left_date).alias("_d")).distinct().withColumn("_r", F.lit(None).cast(dict(dates.dtypes)["_r"])).unionByName(dates)
    by = Window.partitionBy(*keys).orderBy("_d")
    line = line.withColumn("_before", F.last("_r", True).over(by.rangeBetween(Window.unboundedPreceding, 0))).withColumn("_after", F.first("_r", True).over(by.rangeBetween(0, Window.unboundedFollowing)))
    back, ahead = F.datediff("_d", "_before"), F.datediff("_after", "_d")
    pick = F.when(F.col("_after").isNull() | (back <= ahead), F.col("_before")).otherwise(F.col("_after"))
    found = line.where(F.col("_r").isNull()).select(*keys, F.col("_d").alias(left_date), pick.alias(right_date))
    return left.select(*keys, left_date, *order).join(found, [*keys, left_date], "left")


def cell_diff(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, column, old, new) of the cells that differ, as text; null-safe."""
    a = before.select(key, *(F.col(c).cast("string").alias(f"o_{c}") for c in columns))
    b = after.select(key, *(F.col(c).cast("string").alias(f"n_{c}") for c in columns))
    cells = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"o_{c}").alias("old_value"), F.col(f"n_{c}").alias("new_value")) for c in columns))
    return a.join(b, key).select(key, F.inline(F.filter(cells, lambda x: ~x["old_value"].eqNullSafe(x["new_value"]))))


def first_row(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables are equal as bags: one aggregate by row over both, no sort."""
    sides = a.withColumn("meridian_w", F.lit(1)).unionByName(b.withColumn("meridian_w", F.lit(-1)))
    return sides.groupBy(*a.columns).agg(F.sum("meridian_w").alias("meridian_w")).where("meridian_w <> 0").limit(1).count() == 0


def partition_proof(raw: DataFrame, kept: DataFrame, removed: DataFrame) -> bool:
    """raw is the disjoint union of kept and removed, as bags."""
    return same_rows(raw, kept.unionByName(removed))
