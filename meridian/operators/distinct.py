"""Distinct counts of any context from mergeable state.

The facts are read once: for each combination of attributes, the ids seen are bits of bitmaps, one for each range of 32,768 ids. A context that leaves attributes out, or
puts values together, merges the bitmaps of its combinations; an id that is in several of them counts once. Counts are exact, and the state is a table that can be kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_state(df: DataFrame, attributes: list[str], key: str) -> DataFrame:
    """(attributes, bucket, bits): the ids of each combination. `key` is a whole number; null ids are in no combination."""
    known = df.where(F.col(key).isNotNull())
    return known.groupBy(*attributes, F.bitmap_bucket_number(key).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(key)).alias("bits"))


def merged(state: DataFrame, attributes: list[str | Column]) -> DataFrame:
    """The state of fewer or coarser attributes."""
    return state.groupBy(*attributes, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def distinct_counts(state: DataFrame, contexts: dict[str, tuple[list[str], Column | None]], name: str = "n") -> DataFrame:
    """(context, attributes, n) of named contexts: the attributes that each keeps (others are null), and a filter on the state's attributes or None. No fact is read again."""
    kept = [f for f in state.columns if f not in ("bucket", "bits")]
    kind = dict(state.dtypes)
    out = None
    for label, (attributes, where) in contexts.items():
        part = merged(state if where is None else state.where(where), attributes)
        count = part.groupBy(*attributes).agg(F.sum(F.bitmap_count("bits")).alias(name))
        shown = count.select(F.lit(label).alias("context"), *(F.col(c) if c in attributes else F.lit(None).cast(kind[c]).alias(c) for c in kept), F.coalesce(name, F.lit(0)).cast("long").alias(name))
        out = shown if out is None else out.unionByName(shown)
    return out
