"""Every query that has SQL, against DuckDB on the same tables."""

from __future__ import annotations

import math
import os
import re

import duckdb
import pytest

from meridian.catalog import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in sorted(os.listdir(DATA)):
        path = f"{DATA}/{f}" + ("/*.parquet" if os.path.isdir(f"{DATA}/{f}") else "")
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    return f"{float(v):.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted([plain(r[c]) for c in columns] for r in df.collect())
    assert got or name in {"jn18_unused"}
    if name in ORACLE_SQL:
        rel = duck.sql(ORACLE_SQL[name])
        assert sorted(rel.columns) == columns
        order = [rel.columns.index(c) for c in columns]
        assert sorted([plain(r[i]) for i in order] for r in rel.fetchall()) == got


def test_every_key_of_the_sql_is_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_classes_of_the_rules():
    """The rulebook's classes, and every rule once a table."""
    from collections import Counter  # noqa: PLC0415

    from meridian.operators.spec import SPECS  # noqa: PLC0415
    from meridian.plans.dialect import _Duck  # noqa: PLC0415
    from meridian.plans.quality import rules_of  # noqa: PLC0415

    rules = [(t, r[0], r[1]) for t in SPECS for r in rules_of(_Duck(), t)] + [(t, "+".join(k), "hard") for t, s in SPECS.items() for k in s.keys]
    assert Counter(c for *_, c in rules) == {"hard": 44, "inferred": 23, "plausibility": 8}
    assert len({r[:2] for r in rules}) == 75


def test_planted_differences_of_the_export_are_found_and_no_others(spark):
    odd = {(r.measure, r.label): r.status for r in QUERIES["cx04_exported"](spark, DATA).where("status <> 'match'").collect()}
    assert odd == {("ending_aum", "Year=1998"): "differs", ("ending_clients", "Year=1999"): "differs", ("aum_naive", "Year=1996"): "missing", ("total_fees", "Year=1850"): "unexpected"}


def test_plans_stay_small(spark):
    for name in ("cl11_verification", "cl10_change_log", "dq24_rulebook", "dq26_scorecard", "dq25_reconciliations", "sl01_findings", "ag27_rule_examples", "ms01_17_measures", "dq13_dividend_holdings"):
        assert len(QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()) < 100_000, name


def test_differences_are_one_join_a_table(spark):
    plan = QUERIES["cl11_verification"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Join Inner, .*old_key#\d+ = new_key#\d+", plan)) == 4
    assert len(re.findall(r"Join \w+", plan)) < 10  # the others are those of the quarantines and of eight rows in the end


def test_first_rows_of_rules_are_limited_before_the_exchange(spark):
    plan = QUERIES["ag27_rule_examples"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_fences_hold_no_group_in_one_task(spark):
    """Quartiles come from counted bins, written once; rows meet their fences where they are, not by the few groups."""
    for name in ("dq27_iqr", "dq27_row_flags", "dq27_iqr_flags"):
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "percentile" not in plan and "SortMergeJoin" not in plan, name


def test_whole_rows_are_grouped_by_their_hash(spark):
    from meridian.operators.spec import SPECS  # noqa: PLC0415
    from meridian.plans.dialect import _Spark  # noqa: PLC0415
    from meridian.plans.findings import several_rows  # noqa: PLC0415

    text = several_rows(_Spark({}))
    assert not [t for t, s in SPECS.items() if f"GROUP BY {', '.join(s.types)}" in text]
    same = _Spark({}).same(["a", "b"])
    assert spark.sql(f"SELECT count(DISTINCT {same}) AS n FROM VALUES ('1', '23'), ('12', '3'), (NULL, '1'), ('1', NULL), ('1', ''), ('1', '') AS t(a, b)").first().n == 5


def test_customers_are_spread_before_their_events_are_read(spark):
    plan = QUERIES["txt22_events"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [c_custkey" in plan


def test_profile_of_columns_expands_no_row(spark):
    plan = QUERIES["dq_profile_columns"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and "RepartitionByExpression" in plan


def test_ranges_of_running_shares_are_cut_without_a_join(spark):
    plan = QUERIES["wn01_running_excl"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [o_orderkey") == 2  # the totals and the rows themselves


def test_clients_of_a_fact_table_are_counted_without_a_shuffle(spark):
    from meridian.plans.dialect import run  # noqa: PLC0415

    counts = lambda d: " UNION ALL ".join(f"SELECT '{t}' AS t, client_id, count(*) AS n FROM {d.t(t)} GROUP BY 1, 2" for t in ("fact_fees", "fact_transactions", "fact_fees", "fact_transactions"))
    df = run(spark, DATA, counts)
    assert "Exchange hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("shift", [0, 12])
def test_facts_dealt_by_client_are_the_same_rows(spark, tmp_path, shift):
    """Also where line numbers above 9 make keys of two orders equal."""
    from meridian.plans.star import FACTS, facts_by_client, star  # noqa: PLC0415

    for t in ("lineitem", "orders"):
        df = spark.read.parquet(f"{DATA}/{t}.parquet")
        if t == "lineitem":
            df = df.selectExpr(*(f"CASE WHEN l_orderkey % 3 = 0 THEN CAST(l_linenumber + {shift} AS INT) ELSE l_linenumber END AS l_linenumber" if c == "l_linenumber" else c for c in df.columns))
        df.write.parquet(f"{tmp_path}/{t}.parquet")
    for name in FACTS:
        want, got = star(spark, str(tmp_path), name)[name], facts_by_client(spark, str(tmp_path), name, 3)
        assert got.columns == want.columns and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty(), name


def test_keys_of_a_relationship_are_counted_once(spark):
    from meridian.plans.dialect import _Spark  # noqa: PLC0415
    from meridian.plans.quality import integrity  # noqa: PLC0415

    assert not re.search(r"SELECT DISTINCT .{1,400} AS k FROM fact_", integrity(_Spark({})))


def test_profiles_sort_and_expand_no_column(spark):
    for name in ("dq01_profile_snapshots", "dq01_profile_facts"):
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "Expand" not in plan and "TakeOrderedAndProject" in plan, name


def test_kinds_of_keys_and_amounts_are_judged_without_a_shuffle(spark):
    plan = QUERIES["prd06_infer_types"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\((txn_id|fee_id|amount|price)#", plan)
