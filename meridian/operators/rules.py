"""Rules as three booleans, evaluated together: one aggregate for all rules of a table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    name: str
    kind: str
    passes: Column
    applies: Column | None = None
    assessable: Column | None = None


def evaluate(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """rule, kind, n_rows, not_applicable, unassessable, passed, failed."""
    yes = F.lit(True)
    parts = []
    for i, r in enumerate(rules):
        applies, ready, ok = (F.coalesce(c if c is not None else yes, F.lit(False)) for c in (r.applies, r.assessable, r.passes))
        parts += [F.count_if(~applies).alias(f"a{i}"), F.count_if(applies & ~ready).alias(f"b{i}"), F.count_if(applies & ready & ok).alias(f"c{i}"), F.count_if(applies & ready & ~ok).alias(f"d{i}")]
    one = df.agg(F.count("*").alias("n"), *parts)
    rows = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(r.kind).alias("kind"), F.col("n").alias("n_rows"), F.col(f"a{i}").alias("not_applicable"), F.col(f"b{i}").alias("unassessable"), F.col(f"c{i}").alias("passed"), F.col(f"d{i}").alias("failed")) for i, r in enumerate(rules)))
    return one.select(F.inline(rows))
