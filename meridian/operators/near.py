"""Near-duplicate groups by names, without pairs of rows.

Rows that agree on the match columns are compared by a name, trimmed and lower-cased: two are linked if their names are equal or one is a filled strict prefix of the
other. Prefixes of one name are prefixes of each other, so linked names form trees, and the shortest name of a tree is its root. Every distinct
name looks up its own shorter beginnings among the group's names, only at lengths that occur there; the links of a name are then sums of counts over what it has
found and over what has found it. A group costs its distinct names times the lengths that occur, never their square.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cells

#: Rows of a group that meet each other in one block, and pairs that a task should list.
SLICE, PAIRS = 1000, 1 << 21


def near_groups(df: DataFrame, key: str, match: list[str], name: str) -> DataFrame:
    """One row for each row of df: key, representative (the least key of the group's root name), n_members of the group and n_links (other rows that are linked directly).

    A null in a match column or the name links with nothing: such a row is alone. Repeated rows are linked with each other. `key` should be unique; rows of
    one key have a result each."""
    rows = df.select(F.col(key).alias("key"), *(F.col(c).cast("string").alias(f"m{i}") for i, c in enumerate(match)), F.lower(F.trim(F.col(name).cast("string"))).alias("x"))
    by = [f"m{i}" for i in range(len(match))]
    whole = F.lit(True)
    for c in (*by, "x"):
        whole = whole & F.col(c).isNotNull()
    names = rows.where(whole).groupBy(*by, "x").agg(F.count("*").alias("m"), F.min("key").alias("least"))
    several = names.groupBy(*by).agg(F.sort_array(F.collect_set(F.length("x"))).alias("sizes")).where(F.size("sizes") > 1)
    looked = names.select(*by, "x", "m").join(several, by).select(*by, "x", "m", F.explode(F.filter("sizes", lambda n: (n > 0) & (n < F.length("x")))).alias("n"))
    looked = looked.select(*by, "x", "m", F.substring("x", F.lit(1), F.col("n")).alias("short"))
    found = looked.join(names.select(*by, F.col("x").alias("short"), F.col("m").alias("short_m")), [*by, "short"])
    up = found.groupBy(*by, "x").agg(F.sum("short_m").alias("n_up"), F.min_by("short", F.length("short")).alias("root"))
    down = found.groupBy(*by, F.col("short").alias("x")).agg(F.sum("m").alias("n_down"))
    trees = names.join(up, [*by, "x"], "left").join(down, [*by, "x"], "left")
    zero = F.lit(0).cast("long")
    trees = trees.select(*by, "x", "m", "least", F.coalesce("root", "x").alias("root"), (F.col("m") - 1 + F.coalesce("n_up", zero) + F.coalesce("n_down", zero)).alias("n_links"))
    sizes = trees.groupBy(*by, "root").agg(F.sum("m").alias("n_members"), F.min(F.when(F.col("x") == F.col("root"), F.col("least"))).alias("representative"))
    known = trees.select(*by, "x", "root", "n_links").join(sizes, [*by, "root"]).select(*by, "x", "representative", "n_members", "n_links")
    one = F.lit(1).cast("long")
    return rows.join(known, [*by, "x"], "left").select(F.col("key").alias(key), F.coalesce("representative", "key").alias("representative"), F.coalesce("n_members", one).alias("n_members"), F.coalesce("n_links", zero).alias("n_links"))


def near_pairs(df: DataFrame, key: str, match: list[str], name: str, most: int = SLICE, pairs: int = PAIRS) -> DataFrame:
    """All pairs a < b of keys that agree on the match columns, and how their names differ. The result is a group's square, as asked for; no task has to list it alone.

    Groups of one row go no further. Larger ones are cut into slices of about `most` rows, and each two slices meet in a block of their own, dealt over as many tasks as the counted
    pairs ask for. (Left to itself, Spark merges partitions by their small inputs, so a few tasks list everything.)"""
    sizes = df.groupBy(*match).agg(F.count("*").alias("_m")).where("_m > 1").withColumn("_cuts", F.ceil(F.col("_m") / most).cast("int"))
    work = sizes.agg(F.coalesce(F.sum(F.col("_m") * (F.col("_m") - 1.0) / 2), F.lit(0.0))).first()[0]
    parts = int(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(work // pairs + 1, 20_000)))
    rows = df.join(sizes, match).withColumn("_own", F.pmod(F.xxhash64(key), F.col("_cuts")))
    others = F.explode(F.sequence(F.lit(0), F.col("_cuts") - 1))
    block = [*match, "_i", "_j"]
    a = rows.select(*match, F.col("_own").cast("int").alias("_i"), others.alias("_j"), F.col(key).alias("a"), F.col(name).alias("_x")).repartition(parts, *block)
    b = rows.select(*match, others.alias("_i"), F.col("_own").cast("int").alias("_j"), F.col(key).alias("b"), F.col(name).alias("_y")).repartition(parts, *block)
    met = a.hint("merge").join(b, block).where(F.col("a") < F.col("b"))
    return met.select("a", "b", cells.truncation_class(F.col("_x"), F.col("_y")).alias("difference"))
