"""What Spark makes of the checks of a table is compiled by the JVM, which leaves out methods of more than 8,000 bytes."""

from __future__ import annotations

import contextlib
import io
import re

import pytest

from meridian.operators.spec import SPECS
from meridian.plans import findings, quality
from meridian.plans.dialect import _FIRST, _Spark
from meridian.plans.star import star

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def raw(spark):
    """The star's tables as views, the raw ones in the place of the cleaned ones as well, without adaptive execution, which shows no code."""
    names = [f"{p}{n}" for n in SPECS for p in ("", "clean_")]
    for n, df in star(spark, DATA).items():
        for p in ("", "clean_"):
            df.createOrReplaceTempView(f"{p}{n}")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.enabled")
    for n in (*names, "rule_results", "link_results"):
        spark.catalog.dropTempView(n)


def largest(spark, text):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        spark.sql(text).explain("codegen")
    return max(int(n) for n in re.findall(r"maxMethodCodeSize:(-?\d+)", out.getvalue()))


def test_checks_of_columns_are_compiled(raw):
    """F13, dq03_column_findings."""
    assert 0 < largest(raw, findings.single_table(_Spark({}))) < 8000


def test_scorecard_is_compiled(raw):
    """F10, dq26_scorecard."""
    for name, text in (("rule_results", quality.rulebook(_Spark({}))), ("link_results", quality.integrity(_Spark({})))):
        raw.createDataFrame([], raw.sql(text).schema).createOrReplaceTempView(name)
    assert 0 < largest(raw, quality.scorecard(_Spark({}))) < 8000


def test_first_looks_agree_with_their_patterns(spark):
    texts = [None, "", " ", "\t", "\n", " \n", "\x0b", "\x7f", "\x85", " ", " ", "a", "1e5", "1E5", "!", " a", "a b", "a  b", "  b", "a  ", "\x1f", "é", "~", "e", "a\n"]
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    for pattern in _FIRST:
        for x in ("c", "coalesce(c, '')"):
            assert not df.where(f"NOT ({_Spark({}).match(x, pattern)} <=> ({x} RLIKE r'{pattern}'))").collect(), pattern
