"""What the driver holds of a query doesn't grow with the tables: keys of clients, securities and advisors aren't broadcast, however small their compressed files are."""

from __future__ import annotations

import random
import re

import duckdb
import pytest

from meridian.plans import findings, quality
from meridian.plans.cleaning import CLEAN, COLUMNS, steps
from meridian.plans.dialect import _Duck, _Spark, run
from meridian.plans.star import RELATIONSHIPS, STAR

DATA = "/root/testdata/sf0.001"
ODD = (None, "", " ", "\t", "1", "1.0", " 1", "+1.00", "01", "2", "2 ", "x", "x.0", "1.5")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def broadcast_keys(plan):
    return set(re.findall(r"BroadcastHashJoin \[(?:CASE WHEN RLIKE\(trim\()?(?:cast\()?(\w+)#", plan))


def test_validation_broadcasts_days_only(spark):
    """F1, sv01_star_validation."""
    assert broadcast_keys(plan_of(run(spark, DATA, findings.star_validation, steps))) <= {"fee_date", "snapshot_date", "txn_date", "client_since"}


def test_cross_findings_broadcast_days_only(spark):
    """F3, ag20_severities: the step that it reads."""
    assert broadcast_keys(plan_of(run(spark, DATA, findings.cross_table))) <= {"txn_date"}


@pytest.mark.parametrize("step", ["twin_names", "last_month"])
def test_cleaning_broadcasts_no_client(spark, step):
    """F1, sv01_star_validation: the steps that it reads."""
    text = steps(_Spark({}))
    names = ["twins", "clean_dim_client", *COLUMNS]
    for t in names[1:]:
        spark.range(9).selectExpr(*(f"CAST(id AS STRING) AS {c}" for c in COLUMNS[t.removeprefix("clean_")])).createOrReplaceTempView(t)
    spark.sql(text["twins"]).createOrReplaceTempView("twins")
    try:
        plan = plan_of(spark.sql(text[step]))
        assert "Join" in plan and "Broadcast" not in plan
    finally:
        for t in names:
            spark.catalog.dropTempView(t)


def test_relationships_are_met_without_a_join(spark):
    """F2, dq15_integrity."""
    plan = plan_of(run(spark, DATA, quality.integrity, quality.steps))
    assert "Join" not in plan and "Broadcast" not in plan


@pytest.mark.parametrize("seed", range(4))
def test_relationships_of_odd_keys(spark, seed):
    """F2, dq15_integrity: blanks, nulls, spaces, decimals, repeated keys and empty tables, against the SQL with joins."""
    rng, con = random.Random(seed), duckdb.connect()
    columns = {t: sorted({c for child, ck, parent, pk in RELATIONSHIPS for n, c in ((child, ck), (parent, pk)) if n == t}) for t in STAR}
    names = {f"{p}{t}": t for t in STAR for p in ("", "clean_") if not p or t in CLEAN}
    for name, t in names.items():
        rows = [tuple(rng.choice(ODD) for _ in columns[t]) for _ in range(rng.choice((0, 1, 9, 40)))]
        spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns[t])).createOrReplaceTempView(name)
        con.execute(f"CREATE TABLE {name} ({', '.join(f'{c} VARCHAR' for c in columns[t])})")
        if rows:
            con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(columns[t]))})", rows)
    try:
        got = sorted(map(repr, map(tuple, spark.sql(quality.integrity(_Spark({}))).collect())))
        assert got == sorted(map(repr, con.execute(quality.integrity(_Duck())).fetchall())) and len(got) == 2 * len(RELATIONSHIPS)
    finally:
        for name in names:
            spark.catalog.dropTempView(name)
