"""Operators on small tables with known answers."""

from __future__ import annotations

import random
import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from meridian.operators import quantiles
from meridian.operators.distinct import distinct_counts, distinct_state, merged
from meridian.operators.near import near_groups
from meridian.operators.numbering import numbered, numbered_groups, text_code
from meridian.functions import cells
from meridian.operators import relational as rel
from meridian.operators.running import running_before
from meridian.sources import sinks
from meridian.operators.rules import Rule, evaluate


def col(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, s string")
    return [r.x for r in df.select("i", f(F.col("s")).alias("x")).orderBy("i").collect()]


def test_cells(spark):
    assert col(spark, [None, "", " \t", "None", "x"], cells.is_blank) == [True, True, True, False, False]
    assert col(spark, ["45.0", "45", "-3", "", "4 5"], lambda c: cells.parses_as(c, "int")) == [False, True, True, False, False]
    assert col(spark, ["1e400", "inf", "2.5", ".5", None], cells.number) == [None, None, 2.5, 0.5, None]
    assert col(spark, ["2024-02-29", "2023-02-29", "2024-1-5", "2024-01-05x"], cells.strict_date) == [dt.date(2024, 2, 29), None, None, None]
    assert col(spark, ["45.0", "45", " 7.00 ", "7.5"], cells.normalize_key) == ["45", "45", "7", "7.5"]
    assert col(spark, ["revenue in thousands", "In Billions, in millions", "none"], cells.scale_to_millions) == [0.001, 1000.0, None]


def test_blank_arithmetic_and_signals(spark):
    df = spark.createDataFrame([(1, None, None), (2, 5.0, None), (3, None, 2.0), (4, 0.0, 0.0)], "i int, a double, b double")
    got = df.select("i", cells.blank_sub(F.col("a"), F.col("b")).alias("s"), cells.divide(F.col("a"), F.col("b")).alias("d")).orderBy("i").collect()
    assert [(r.s, r.d) for r in got] == [(None, None), (5.0, None), (-2.0, None), (0.0, None)]


def test_nearest_takes_the_earlier_of_two(spark):
    d = dt.date
    left = spark.createDataFrame([("a", d(2024, 1, 10), 1), ("a", d(2023, 1, 1), 2), ("a", d(2025, 1, 1), 3), ("b", d(2024, 1, 1), 4), ("a", d(2024, 1, 15), 5), ("a", None, 6)], "k string, day date, id int")
    right = spark.createDataFrame([("a", d(2024, 1, 5)), ("a", d(2024, 1, 15)), ("a", d(2024, 1, 15)), ("a", None)], "k string, filed date")
    got = {r.id: r.filed for r in rel.nearest(left, right, ["k"], "day", "filed", ["id"]).collect()}
    assert got == {1: d(2024, 1, 5), 2: d(2024, 1, 5), 3: d(2024, 1, 15), 4: None, 5: d(2024, 1, 15), 6: None}


def test_cardinality_is_checked(spark):
    left, right = spark.createDataFrame([(1,), (1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    assert sorted((r.k, r.v, r.hit) for r in rel.many_to_one(left, right, ["k"], found="hit").collect() if r.k == 1) == [(1, "x", True)] * 2
    with pytest.raises(PySparkException, match="keys repeat"):
        rel.many_to_one(right, left.withColumn("w", F.lit(1)), ["k"]).collect()


def test_integrity_differences_and_proofs(spark):
    child = spark.createDataFrame([("1",), ("45.0",), (None,), (" ",), ("9",), ("9",)], "k string")
    r = rel.referential_integrity(child, "k", spark.createDataFrame([(1,), (45,), (7,)], "id int"), "id").first()
    assert (r.n_rows, r.n_blank, r.n_match, r.n_orphan, r.n_orphan_keys, r.n_unused_parents) == (6, 2, 1, 3, 2, 2)
    a = spark.createDataFrame([(1, "x", None), (2, "y", 3)], "id int, s string, n int")
    b = spark.createDataFrame([(1, "x", 5), (2, "z", 3)], "id int, s string, n int")
    assert sorted(map(tuple, rel.cell_diff(a, b, "id", ["s", "n"]).collect())) == [(1, "n", None, "5"), (2, "s", "y", "z")]
    assert rel.partition_proof(a, a.where("id = 1"), a.where("id = 2")) and not rel.partition_proof(a, a, a)
    sides = rel.outer_marked(a.select("id"), b.where("id = 2").select("id"), ["id"])
    assert sorted((r.id, r.side) for r in sides.collect()) == [(1, "left"), (2, "both")]


def test_rules_count_nulls_as_failures(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, -1), (None, 2)], "a int, b int")
    r = evaluate(df, [Rule("positive", "hard", F.col("b") > 0, F.col("a") < 3, F.col("a").isNotNull())]).first()
    assert (r.n_rows, r.not_applicable, r.unassessable, r.passed, r.failed) == (4, 2, 0, 1, 1)


def test_accounting_numbers_units_and_worded_dates(spark):
    assert col(spark, ["(1,234)", "$ 5,678.90", "-", "--", "-1,234", "12%", "n/a", "( 7 )", "", None, "$-3", "1.2.3"], cells.accounting_number) == [-1234.0, 5678.9, 0.0, 0.0, -1234.0, None, None, -7.0, None, None, -3.0, None]
    assert col(spark, ["(In millions, except shares, in thousands)", "$000s", "nothing", "thousands of U.S. dollars"], cells.scale_to_millions) == [1.0, 0.001, None, 0.001]
    assert col(spark, ["September 1, 2026", "9/1/2026", "February 30, 2024", "2026-09-01"], cells.worded_date) == [dt.date(2026, 9, 1), dt.date(2026, 9, 1), None, None]
    assert col(spark, ["PA 19", "", None, "Ab-1"], cells.value_shape) == ["A 9", "<blank>", "<blank>", "A-9"]
    df = spark.createDataFrame([("Smith", "SMI"), ("Smith", "smith "), ("Smith", ""), ("Smith", "Smyth"), ("a", "a")], "a string, b string")
    assert [r[0] for r in df.select(cells.truncation_class(F.col("a"), F.col("b"))).collect()] == ["truncated/extended", "case/whitespace", "other", "other", "identical"]


def test_exact_quantiles_match_numpy(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [("a", float(x)) for x in rng.normal(size=301)] + [("b", float(x)) for x in rng.integers(0, 4, 50)] + [(None, 7.0), ("c", None)] + [("d", 1e9)] + [("d", float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, x double")
    for bins in (4096, 3):
        monkeypatch.setattr(quantiles, "BINS", bins)
        got = {r.g: (r.n, r.q0, r.q1, r.q2) for r in quantiles.exact_quantiles(df, "x", [0.0, 0.25, 0.9], ("g",)).collect()}
        assert set(got) == {"a", "b", "d", None}
        for g in got:
            x = [v for k, v in rows if k == g and v is not None]
            assert got[g][0] == len(x) and np.allclose(got[g][1:], np.quantile(x, [0.0, 0.25, 0.9]))
    assert quantiles.exact_quantiles(df.where("false"), "x", [0.5]).count() == 0


# Numbering and near groups --------------------------------------------------------


@pytest.mark.parametrize("ranges", [1, 3, 128])
def test_numbers_follow_the_whole_order(spark, ranges):
    rng = random.Random(ranges)
    rows = [(rng.choice([None, *range(-50, 50)]), i) for i in range(700)]
    df = spark.createDataFrame(rows, "x int, i int").repartition(6)
    got = sorted((r.no, r.x, r.i) for r in numbered(df, "x", "no", ("i",), ranges).collect())
    assert got == [(k + 1, x, i) for k, (x, i) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])))]
    plan = numbered(df, "x", "no", ("i",), ranges)._jdf.queryExecution().optimizedPlan().toString()
    one_task = [x for x in plan.splitlines() if x.lstrip("+-: ").startswith("Window") and "row_number" in x]
    assert one_task and all("_range" in x for x in one_task)
    assert numbered(df.where("false"), "x", "no", ("i",), ranges).collect() == []


def test_groups_are_numbered_by_first_appearance(spark):
    rows = [(5, "b"), (1, "c"), (3, "b"), (2, "a"), (9, None), (7, "c")]
    got = {r.g: (r.no, r.first_at) for r in numbered_groups(spark.createDataFrame(rows, "at int, g string"), ["g"], "at", "no").collect()}
    assert got == {"c": (1, 1), "a": (2, 2), "b": (3, 3), None: (4, 9)}


def test_text_codes_keep_the_order(spark):
    rng = random.Random(1)
    texts = ["", "a", "ab", "é", "\U0001f600", "abcdefgh", "abcdefgi"] + ["".join(rng.choice("abcé\x01z") for _ in range(rng.randint(0, 9))) for _ in range(200)]
    code = {r.t: r.c for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", text_code(F.col("t")).alias("c")).collect()}
    order = sorted(set(texts), key=lambda t: t.encode())
    assert all(code[a] <= code[b] for a, b in zip(order, order[1:], strict=False)) and code["a"] < code["ab"] and code["abcdefgh"] == code["abcdefgi"]


def brute_near(rows):
    norm = [(m, None if x is None else x.strip(" ").lower()) for _, m, x in rows]
    linked = lambda a, b: None not in (*a, *b) and a[0] == b[0] and (a[1] == b[1] or a[1] != "" != b[1] and (a[1].startswith(b[1]) or b[1].startswith(a[1])))
    out = []
    for i, a in enumerate(norm):
        group, todo = {i}, [i]
        while todo:
            k = todo.pop()
            new = {j for j, b in enumerate(norm) if j not in group and linked(norm[k], b)}
            group |= new
            todo += new
        root = min((norm[j][1] for j in group), key=lambda x: len(x or ""), default=None)
        out.append((rows[i][0], min(rows[j][0] for j in group if norm[j][1] == root), len(group), sum(linked(a, b) for j, b in enumerate(norm) if j != i)))
    return sorted(out)


def test_near_groups_equal_all_pairs(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["m", "n", None]), rng.choice([None, "", " ", "".join(rng.choice("ab") for _ in range(rng.randint(0, 6))), "A" * rng.randint(1, 3) + " "])) for i in range(160)]
    got = near_groups(spark.createDataFrame(rows, "k int, match string, name string"), "k", ["match"], "name")
    assert sorted(map(tuple, got.collect())) == brute_near(rows)


def test_a_near_group_of_100000_members(spark):
    n = 100_000
    df = spark.range(n).select(F.col("id").alias("k"), F.lit("one").alias("match"), F.when(F.col("id") % 2 == 0, F.lit("client")).otherwise(F.concat(F.lit("Client "), F.col("id").cast("string"))).alias("name"))
    r = near_groups(df, "k", ["match"], "name").groupBy("representative", "n_members").agg(F.count("*").alias("n"), F.max("n_links").alias("most"), F.min("n_links").alias("fewest")).collect()
    assert [(x.representative, x.n_members, x.n, x.most) for x in r] == [(0, n, n, n - 1)] and r[0].fewest >= n // 2


def test_near_groups_of_nothing(spark):
    assert near_groups(spark.createDataFrame([], "k int, match string, name string"), "k", ["match"], "name").collect() == []


# Running totals, charts ------------------------------------------------------------


@pytest.mark.parametrize("ranges", [1, 4, 64])
def test_running_totals_of_a_hot_group(spark, ranges):
    rng = random.Random(ranges)
    rows = [(rng.choice(["hot"] * 8 + ["cold", None]), rng.choice([None, *range(30)]), i, rng.choice([None, 1, -2, 7])) for i in range(600)]
    got = running_before(spark.createDataFrame(rows, "g string, at int, i int, v long").repartition(5), ["g"], "at", ["i"], "v", "before", ranges)
    want, seen = {}, {}
    for g, at, i, v in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        want[i] = seen.get(g, 0)
        seen[g] = want[i] + (v or 0)
    assert {r.i: r.before for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert all("_range" in x for x in plan.splitlines() if x.lstrip("+-: ").startswith("Window"))


def test_box_and_scatter_data(spark):
    values = [1.0, 2.0, 3.0, 4.0, 100.0, -50.0, None]
    df = spark.createDataFrame([("a", float(i), v) for i, v in enumerate(values)] + [(None, 9.0, 5.0)], "g string, k double, v double")
    box = {r.g: tuple(r)[1:] for r in sinks.box_data(df, "g", "v").collect()}
    q1, q3 = np.quantile(values[:6], [0.25, 0.75])
    inside = [v for v in values[:6] if q1 - 1.5 * (q3 - q1) <= v <= q3 + 1.5 * (q3 - q1)]
    assert box["a"] == (6, q1, 2.5, q3, min(inside), max(inside), 1, 1) and box[None] == (1, 5.0, 5.0, 5.0, 5.0, 5.0, 0, 0)
    many = spark.range(5000).selectExpr("id", "id % 3 AS g", "id * 2 AS x", "cast(NULL AS int) AS nothing")
    draw = lambda d: sorted(map(tuple, sinks.scatter_data(d, "g", "id", "id", "x", 40).collect()))
    assert draw(many) == draw(many.repartition(7)) and len(draw(many)) == 120
    assert sinks.scatter_data(many, "g", "id", "x", "nothing").collect() == []
    assert "WindowGroupLimit" in sinks.scatter_data(many, "g", "id", "id", "x", 40)._jdf.queryExecution().executedPlan().toString()


def test_distinct_counts_from_bitmaps(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(4), rng.choice([None, 1, 5, 32_768, 32_769, 10**12] + list(range(90)))) for _ in range(500)]
    df = spark.createDataFrame(rows, "g string, y int, id long").repartition(4)
    state = distinct_state(df, ["g", "y"], "id")
    got = {(r.context, r.g, r.y): r.n for r in distinct_counts(state, {"all": ([], None), "g": (["g"], None), "late": (["y"], F.col("y") > 1)}).collect()}
    ids = lambda test: len({i for g, y, i in rows if i is not None and test(g, y)})
    assert got == {("all", None, None): ids(lambda g, y: True)} | {("g", x, None): ids(lambda g, y, x=x: g == x) for x in ("a", "b", None)} | {("late", None, x): ids(lambda g, y, x=x: y == x) for x in (2, 3)}
    again = merged(state, ["g"])
    assert {r.g: r.n for r in again.groupBy("g").agg(F.sum(F.bitmap_count("bits")).alias("n")).collect()} == {g: ids(lambda a, y, g=g: a == g) for g in ("a", "b", None)}
    assert [r.n for r in distinct_counts(distinct_state(df.where("false"), ["g"], "id"), {"all": ([], None)}).collect()] == [0]


def test_exact_quantiles_with_far_outliers_look_into_few_values(spark):
    """One value of 1e300 and one of -1e300 leave the others apart: no bin holds more than a small share of them."""
    x = np.concatenate([np.linspace(1, 1e6, 40_000), [1e300, -1e300, 0.0, -0.0, 5e-324, float("inf")]])
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    got = quantiles.exact_quantiles(df, "x", [0.0, 0.25, 0.5, 0.9]).first()
    assert (got.n, got.q0) == (len(x), -1e300)
    np.testing.assert_allclose([got.q1, got.q2, got.q3], np.quantile(x, [0.25, 0.5, 0.9]), rtol=1e-12)
    fullest = df.groupBy(quantiles.bin_of(F.col("x"), F.lit(-1e300), F.lit(1e300)).alias("bin")).count().agg(F.max("count")).first()[0]
    assert fullest < len(x) / 100


def test_pairs_of_a_hot_group_are_dealt_over_tasks(spark):
    """More tasks than shuffle partitions, each with a bounded share of the pairs, and every pair once."""
    from meridian.operators.near import near_pairs  # noqa: PLC0415

    df = spark.createDataFrame([(i, "hot" if i < 300 else str(i % 150) if i < 500 else None, "Ab" if i % 3 else "abc") for i in range(510)], "k long, g string, n string")
    got = near_pairs(df, "k", ["g"], "n", most=50, pairs=1000)
    rows = df.collect()
    assert sorted((r.a, r.b) for r in got.collect()) == sorted((x.k, y.k) for x in rows for y in rows if x.g is not None and x.g == y.g and x.k < y.k)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert got.rdd.getNumPartitions() >= 40 and max(sizes) < 15_000
