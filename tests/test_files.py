"""Contracted reads and checked writes on small files."""

from __future__ import annotations

import io
import json
import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from meridian.operators import relational as rel
from meridian.operators.relational import RuleBroken
from meridian.operators.spec import STATE_NAMES
from meridian.sources import files, sinks
from meridian.sources.files import InputError

DATA = "/root/testdata/sf0.001"


def put(folder, name, text):
    (folder / name).write_text(text, encoding="utf-8", newline="")
    return f"file://{folder / name}"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_text_tables_keep_what_is_stored(spark, tmp_path):
    path = put(tmp_path, "a.csv", '﻿zip, name\n00123,None\n"",NA\n"a,b","say ""x"""\n')
    assert rows(files.text_table(spark, path)) == sorted([("", "NA"), ("00123", "None"), ("a,b", 'say "x"')], key=str)
    assert files.text_table(spark, path, ["name"]).columns == ["name"]
    with pytest.raises(InputError, match="missing"):
        files.text_tables(spark, f"file://{tmp_path}", ["a", "b"])
    typed = files.typed_table(spark, put(tmp_path, "n.csv", "zip,n\n00123,5\n00124,x\n,\n"), "zip string, n int")
    assert rows(typed) == [("00123", 5), ("00124", None), (None, None)]


def test_contracts_stop_the_read(spark, tmp_path):
    good = put(tmp_path, "g.csv", "id,day\n1,2024-02-29\n2,\n")
    assert [str(r.day) for r in files.contracted_table(spark, good, ["id", "day"], ["day"]).orderBy("id").collect()] == ["2024-02-29", "None"]
    with pytest.raises(InputError, match="lacks"):
        files.contracted_table(spark, good, ["id", "amount"])
    with pytest.raises(InputError, match="YYYY-MM-DD"):
        files.contracted_table(spark, put(tmp_path, "b.csv", "id,day\n1,2024-2-9\n"), ["id"], ["day"])
    dirty = put(tmp_path, "d.csv", "﻿ a , b \n x , y \n , \n")
    assert rows(files.clean_rows(spark, dirty, ["a", "b"])) == [("x", "y")]
    assert files.clean_rows(spark, put(tmp_path, "e.csv", ""), ["a", "b"]).columns == ["a", "b"]
    with pytest.raises(InputError):
        files.clean_rows(spark, dirty, ["c"])


def test_exported_values_are_judged(spark, tmp_path):
    path = put(tmp_path, "v.csv", "measure,slice,value\nm,a,1.5\nm,a,2\nm,b,\nm,c,$3\nn,a,2.5\nx,a,1\nt,a,High\n")
    cells = spark.createDataFrame([("m", "a", "ratio"), ("m", "b", "ratio"), ("m", "c", "ratio"), ("n", "a", "count"), ("t", "a", "text"), ("m", "d", "ratio")], "measure string, slice string, kind string")
    values, problems = files.exported_values(spark, path, cells)
    assert rows(problems) == [("m", "a", "repeated"), ("m", "c", "not a number"), ("m", "d", "missing"), ("n", "a", "not a number"), ("x", "a", "unexpected")]
    assert {(r.measure, r.slice): (r.x, r.word) for r in values.collect()} == {("m", "b"): (None, None), ("t", "a"): (None, "High")}
    with pytest.raises(InputError, match="exactly"):
        files.exported_values(spark, put(tmp_path, "w.csv", "measure,value\n"), cells)


def test_writes_read_back_or_are_not_there(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", None), (2, None, 0.5)], "id int, s string, x double")
    assert rows(sinks.write_checked(df, f"file://{tmp_path}/one", "N/A")) == [("1", "a,b", "N/A"), ("2", "N/A", "0.5")]
    empty = sinks.write_checked(df.where("false"), f"file://{tmp_path}/none")
    assert empty.columns == ["id", "s", "x"] and empty.count() == 0
    folder = f"file://{tmp_path}/all"
    sinks.write_all({"t": df}, folder)
    checks = spark.createDataFrame([("step", "rule", 3)], "step string, requirement string, n_failed long")
    with pytest.raises(RuleBroken, match="nothing is written"):
        sinks.write_all({"t": df.where("id = 1")}, folder, checks)
    assert files.text_table(spark, f"{folder}/t.csv").count() == 2 and len(list(tmp_path.glob("all*"))) == 1
    sinks.write_all({"t": df.where("id = 1")}, folder, checks.where("false"))
    assert files.text_table(spark, f"{folder}/t.csv").count() == 1
    assert sinks.remove_stale(spark, folder) and not sinks.remove_stale(spark, folder)
    assert (sinks.Status.OK, sinks.Status.MISSING) == (0, 3)


def test_json_and_markdown(spark):
    df = spark.createDataFrame([(1, float("nan"), "a|b"), (2, float("inf"), None)], "id int, x double, s string")
    assert [json.loads(r.json) for r in sinks.json_rows(df).orderBy("json").collect()] == [{"id": 1, "x": None, "s": "a|b"}, {"id": 2, "x": None, "s": None}]
    assert json.loads(sinks.json_evidence({"d": df}))["d"][0] == {"id": 1, "x": None, "s": "a|b"}
    with pytest.raises(ValueError, match="more than 1"):
        sinks.json_evidence({"d": df}, most=1)
    text = sinks.markdown("T", df.select("id", "s"))
    assert text.startswith("# T\n\n| id | s |\n|---|---|\n") and "| 1 | a\\|b |" in text and "| 2 | N/A |" in text
    h = sinks.histogram(spark.createDataFrame([(float(i),) for i in (0, 1, 1, 4)], "x double"), "x", 4).orderBy("bin").collect()
    assert [r.n for r in h] == [1, 2, 0, 1] and h[0].mean == 1.5 and sinks.histogram(df.where("false"), "x").count() == 0
    one = sinks.histogram(spark.createDataFrame([(7.0,)], "x double"), "x", 3).orderBy("bin").collect()
    assert [r.n for r in one] == [1, 0, 0]
    assert sinks.to_jsonable({"a": (math.inf, 1)}) == {"a": [None, 1]}


def test_filings_are_fetched_paged_and_scored(spark):
    seen = []

    def opener(request, timeout):
        seen.append((request.get_header("User-agent"), timeout))
        if request.full_url.endswith("bad"):
            raise OSError("refused")
        return io.BytesIO(b'{"form": ["8-K", "10-K"], "filed": ["2024-01-02"]}')

    fetcher = files.Fetcher("me", delay=0, opener=opener)
    text = fetcher.get("http://x/good")
    with pytest.warns(UserWarning, match="refused"):
        assert fetcher.get("http://x/bad") is None
    assert seen == [("me", 30)] * 2
    parsed = files.parallel_rows(spark.createDataFrame([(text,)], "j string"), "j", {"form": "string", "filed": "string"})
    assert [tuple(r) for r in parsed.orderBy("position").collect()] == [(0, "8-K", "2024-01-02"), (1, "10-K", None)]
    recent = spark.createDataFrame([("2024-05-01",)], "filed string")
    pages = spark.createDataFrame([("p1", "2024-01-01"), ("p2", "2023-01-01")], "name string, filing_to string")
    assert [r.name for r in files.pages_needed(recent, pages, "2023-06-01").collect()] == ["p1"]
    assert files.pages_needed(recent, pages, "2024-06-01").count() == 0
    e = spark.createDataFrame([(1, 0, "a", 2), (1, 1, "b", 2), (1, 2, "c", 1), (2, 0, "d", 0)], "k int, position int, url string, s int")
    assert rows(files.best_exhibit(e, ["k"], F.col("s"))) == [(1, "a", 2)]


def test_lookups_coercions_and_cleaning_stop_where_they_must(spark):
    assert rel.find_column(["Id", "Total_Price"], ["amount"], "price") == "Total_Price" and rel.find_column(["Amount"], ["amount"], "x") == "Amount"
    with pytest.raises(RuleBroken):
        rel.find_column(["a"], ["b"], "c")
    t = spark.createDataFrame([("1",), ("x",)], "s string")
    with pytest.raises(PySparkException, match="isn't numeric"):
        rel.numeric_or_stop(t, ["s"]).collect()
    a, b = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(1, "y"), (2, "z")], "k int, v string")
    assert rows(rel.inner_suffixed(a, b, ["k"], "_r")) == [(1, "x", "y")]
    assert rel.same_rows(b, b) and not rel.same_rows(b, b.union(b)) and not rel.same_rows(a, b)


def test_cleaning_logs_what_it_changed_and_stops_on_a_broken_rule(spark, monkeypatch):
    from decimal import Decimal

    from meridian.plans import cleaning

    out = cleaning.clean_star(spark, DATA)
    assert set(out) == {*(f"clean_{t}" for t in cleaning.CLEAN), "quarantine_clients", "quarantine_transactions", "change_log"}
    log = out["change_log"].collect()
    want = {
        "return_ytd": lambda old: format(Decimal(old[:-1]) / Decimal(100), "f"),
        "shares": lambda old: old.removeprefix("-"),
        "security_id": lambda old: old.removesuffix(".0"),
        "state": lambda old: STATE_NAMES[old],
    }
    assert {r.column_name for r in log} == set(want)
    assert [r for r in log if r.new_value != want[r.column_name](r.old_value)] == []
    monkeypatch.setattr(cleaning, "stop_rules", lambda d: "SELECT 'one' AS step, 'never' AS requirement, 1 AS n_failed")
    with pytest.raises(RuleBroken, match="one: never"):
        cleaning.clean_star(spark, DATA)


def test_the_rulebook_has_every_rule_on_both_stages(spark):
    """75 rules a stage, and no rule counts a row twice or leaves one out."""
    from meridian.catalog import QUERIES

    got = QUERIES["dq24_rulebook"](spark, DATA).collect()
    assert {s: sum(r.stage == s for r in got) for s in ("raw", "clean")} == {"raw": 75, "clean": 75}
    assert all(r.n_rows == r.not_applicable + r.unassessable + r.passed + r.failed for r in got)
