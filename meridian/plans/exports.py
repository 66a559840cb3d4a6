"""Measures from an independent side: by grouping sets over the fact rows, through an exported file, against the grid of filter contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import files, sinks
from ..sources.scratch import new_path
from .dialect import Dialect, over_star, run
from .registry import QUERIES
from .semantic import MEASURES, SLICES, steps

INDEPENDENT = ("total_fees", "net_flows", "aum_naive", "ending_aum", "ending_clients")
#: Steps that both sides read: fact rows meet their clients once.
SHARED = ("snaps", "fee_rows", "flow_rows")
_SETS = "GROUP BY GROUPING SETS ((), (y), (y, m), (y, tier))"


def _label() -> str:
    """The context that a grouping set's row stands for."""
    return "CASE WHEN grouping(y) = 1 THEN 'Grand Total' WHEN y IS NULL THEN '' WHEN grouping(m) = 0 THEN 'Month=' || CAST(y AS STRING) || '-' || lpad(CAST(m AS STRING), 2, '0') WHEN grouping(tier) = 0 THEN 'Year=' || CAST(y AS STRING) || '|Tier=' || coalesce(tier, '') ELSE 'Year=' || CAST(y AS STRING) END"


def by_grouping_sets(d: Dialect) -> str:
    """(measure, label, x) of the measures that sums, last days and distinct clients give, each from single fact rows; contexts meet no table of days here, and clients are
    counted as such, whatever tiers they have. Rows outside the calendar count in the grand total alone, as under no filter."""
    parts = lambda source, rest: f"(SELECT CASE WHEN in_cal THEN CAST(extract(year FROM day) AS INT) END AS y, CASE WHEN in_cal THEN CAST(extract(month FROM day) AS INT) END AS m, tier, day, in_cal, {rest} FROM {source}) f"
    sums = lambda source, rest, x: f"SELECT {_label()} AS label, {x} AS x FROM {parts(source, rest)} {_SETS}"
    if d.spread:  # sums are exact, so rows are added up by all columns of the sets before each is expanded into four
        sums = lambda source, rest, x: f"SELECT {_label()} AS label, sum(x) AS x FROM (SELECT y, m, tier, {x} AS x FROM {parts(source, rest)} GROUP BY 1, 2, 3) t {_SETS}"
    flows = "sum(CASE txn_type WHEN 'Deposit' THEN amount WHEN 'Withdrawal' THEN -amount END)"
    last = f"SELECT {_label()} AS label, max(CASE WHEN in_cal AND aum IS NOT NULL THEN day END) AS last_day FROM {parts('snaps', 'aum')} {_SETS}"
    if d.spread:
        last = f"SELECT {_label()} AS label, max(x) AS last_day FROM (SELECT y, m, tier, max(CASE WHEN in_cal AND aum IS NOT NULL THEN day END) AS x FROM {parts('snaps', 'aum')} GROUP BY 1, 2, 3) t {_SETS}"
    in_context = "(l.label = 'Grand Total' OR l.label = 'Year=' || CAST(extract(year FROM s.day) AS STRING) OR l.label = 'Year=' || CAST(extract(year FROM s.day) AS STRING) || '|Tier=' || coalesce(s.tier, '') OR l.label = 'Month=' || substr(CAST(s.day AS STRING), 1, 7))"
    wanted = ", ".join(f"'{s[0]}'" for s in SLICES)
    ending = lambda x: f"SELECT l.label, {x} AS x FROM (SELECT * FROM ({last}) z WHERE label IN ({wanted})) l JOIN snaps s ON s.day = l.last_day WHERE {in_context} GROUP BY 1"
    sides = {
        "total_fees": sums("fee_rows", "amount", "sum(amount)"),
        "net_flows": sums("flow_rows", "amount, txn_type", flows),
        "aum_naive": sums("snaps", "aum", "sum(aum)"),
        "ending_aum": ending("sum(s.aum)"),
        "ending_clients": ending("count(DISTINCT s.client_id)"),
    }
    rows = " UNION ALL ".join(f"SELECT '{m}' AS measure, s.label, CAST(v.x AS DECIMAL(38, 2)) AS x FROM slices s LEFT JOIN ({text}) v ON s.label = v.label" for m, text in sides.items())
    return f"SELECT measure, label, x FROM ({rows}) r"


def exported(d: Dialect) -> str:
    """The export: the independent side with planted deviations: within and beyond the tolerance, a blank, a cell left out and one that nobody asked for."""
    moved = "CASE WHEN measure = 'total_fees' AND label = 'Year=1997' THEN x + 0.01 WHEN measure = 'ending_aum' AND label = 'Year=1998' THEN x + 0.02 WHEN measure = 'ending_clients' AND label = 'Year=1999' THEN NULL ELSE x END"
    return f"SELECT measure, label, CAST({moved} AS DECIMAL(38, 2)) AS x FROM ({by_grouping_sets(d)}) i WHERE NOT (measure = 'aum_naive' AND label = 'Year=1996') UNION ALL SELECT 'total_fees', 'Year=1850', CAST(1 AS DECIMAL(38, 2))"


def _judged(d: Dialect) -> str:
    mine = f"SELECT measure, label, tolerance, x FROM cells WHERE measure IN ({', '.join(repr(m) for m in INDEPENDENT)})"
    equal = "CASE WHEN c.x IS NULL AND e.x IS NULL THEN true ELSE coalesce(abs(c.x - CAST(e.x AS DOUBLE)) <= c.tolerance + 1e-9, false) END"
    return f"SELECT coalesce(c.measure, e.measure) AS measure, coalesce(c.label, e.label) AS label, CASE WHEN e.measure IS NULL THEN 'missing' WHEN c.measure IS NULL THEN 'unexpected' WHEN {equal} THEN 'match' ELSE 'differs' END AS status FROM ({mine}) c FULL JOIN ({exported(d)}) e ON c.measure = e.measure AND c.label = e.label"


def cx04_exported(spark, sf_dir) -> DataFrame:
    """CX-04, SRC-05, JN-17: the grid's cells against a file that the grouping sets have filled, both ways."""
    path = new_path(spark, "export")
    sinks.write_csv(run(spark, sf_dir, exported, steps, SHARED).select("measure", F.col("label").alias("slice"), F.col("x").alias("value")), path)
    cells = run(spark, sf_dir, lambda d: "SELECT * FROM cells", steps, SHARED).where(F.col("measure").isin(*INDEPENDENT)).withColumnRenamed("label", "slice")
    values, problems = files.exported_values(spark, path, cells.select("measure", "slice", "kind"))
    known = values.select("measure", "slice", F.col("x").alias("other"))
    equal = F.col("x").eqNullSafe(F.col("other")) | F.coalesce(F.abs(F.col("x") - F.col("other")) <= F.col("tolerance") + 1e-9, F.lit(False))
    judged = known.join(cells.select("measure", "slice", "x", "tolerance"), ["measure", "slice"]).select("measure", F.col("slice").alias("label"), F.when(equal, "match").otherwise("differs").alias("status"))
    return judged.unionByName(problems.select("measure", F.col("slice").alias("label"), F.col("problem").alias("status")))


assert set(INDEPENDENT) <= set(MEASURES)
over_star("cx04_exported", _judged, steps)
QUERIES["cx04_exported"] = cx04_exported  # the same result, by way of the file
