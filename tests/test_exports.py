"""Both sides of the exported measures read the same fact rows."""

from __future__ import annotations

from meridian.plans import exports
from meridian.plans.dialect import run
from meridian.plans.semantic import steps

DATA = "/root/testdata/sf0.001"


def test_fact_rows_meet_their_clients_once(spark):
    """F22, cx04_exported: neither side composes fact rows again."""
    shared = getattr(exports, "SHARED", None)
    for text in (exports.exported, lambda d: "SELECT * FROM cells"):
        df = run(spark, DATA, text, steps, *([shared] if shared else []))
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "l_orderkey" not in plan and "o_custkey" not in plan
