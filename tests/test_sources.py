"""The paged data source and the sink with a commit: retries, pruning, failed tasks, stale results."""

from __future__ import annotations

import json
import os
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from meridian.operators.relational import RuleBroken
from meridian.sources import commits, paged
from meridian.sources.files import InputError

ARRAYS = ("accessionNumber", "filingDate", "form", "items", "primaryDocument")


def block(*rows):
    return dict(zip(ARRAYS, map(list, zip(*rows, strict=True)), strict=True)) if rows else {}


@pytest.fixture
def listing(tmp_path):
    recent = block(("a9", "2024-03-09", "8-K", "5.02", "d9"), ("a8", "2024-03-01", "10-K", None, "d8"))
    pages = {"p2": block(("a7", "2024-02-27", "8-K", "", "d7"), ("a6", "2024-01-02", "8-K", "2.02", "d6")), "p1": block(("a5", "2023-05-05", "8-K", "5.02", "d5")), "p0": {}}
    last = {"p2": "2024-02-27", "p1": "2023-05-05", "p0": "2024-02-28"}
    (tmp_path / "index").write_text(json.dumps({"recent": recent, "pages": [{"name": n, "filingTo": last[n]} for n in pages]}))
    for n, b in pages.items():
        (tmp_path / n).write_text(json.dumps(b))
    return f"file://{tmp_path}"


def load(spark, path, source=None, **options):
    paged.register(spark, source or paged.Filings)
    return spark.read.format((source or paged.Filings).name()).options(path=path, **options).load()


def test_only_the_needed_pages_are_partitions(spark, listing):
    names = lambda **o: [p.name for p in paged.PagesReader({"path": listing, **o}).partitions()]
    assert names() == ["index", "p2", "p1", "p0"]
    assert names(start="2024-03-05") == ["index"]  # the recent list reaches back that far
    assert names(start="2024-03-01") == ["index"]  # it may not, but no older page does
    assert names(start="2024-02-01") == ["index", "p2", "p0"]
    got = {r.accession for r in load(spark, listing, start="2024-02-01").collect()}
    assert got == {"a9", "a8", "a7", "a6"}
    assert load(spark, listing).rdd.getNumPartitions() == 4


def test_a_filter_prunes_pages_and_still_holds(spark, listing):
    os.remove(f"{listing.removeprefix('file://')}/p1")  # would fail if it were read
    df = load(spark, listing, retries="0").where("filed >= '2024-02-01'")
    assert sorted(r.accession for r in df.collect()) == ["a7", "a8", "a9"]


def test_rows_keep_their_place_and_end_with_the_shortest_array(spark, tmp_path):
    short = block(("a", "2024-01-01", "8-K", "x", "d"), ("b", "2024-01-02", "8-K", "y", "e"))
    short["items"] = ["x"]
    (tmp_path / "index").write_text(json.dumps({"recent": short}))
    assert [tuple(r) for r in load(spark, f"file://{tmp_path}").collect()] == [("index", 0, "a", "2024-01-01", "8-K", "x", "d", False)]


def flaky_source():
    """Every page fails as often as its option says before it is given; each request leaves a mark. (Made here, so that the classes travel to the workers.)"""

    class Flaky(paged.PagesReader):
        def __init__(self, options):
            super().__init__(options)
            self.fails = int(options["fails"])

        def ask(self, name):
            folder = self.path.removeprefix("file://")
            asked = len([f for f in os.listdir(folder) if f.startswith(f"asked-{name}-")])
            open(f"{folder}/asked-{name}-{asked}", "w").close()
            return super().ask(name) if asked >= self.fails else None

    class FlakyFilings(paged.Filings):
        @classmethod
        def name(cls):
            return "flaky_filings"

        def reader(self, schema):
            return Flaky(dict(self.options))

    return FlakyFilings


def test_a_failed_page_is_asked_for_again(spark, listing):
    df = load(spark, listing, flaky_source(), fails="2", retries="2", wait="0.01")
    assert sorted(r.accession for r in df.collect()) == ["a5", "a6", "a7", "a8", "a9"]
    folder = listing.removeprefix("file://")
    assert all(len([f for f in os.listdir(folder) if f.startswith(f"asked-{p}-")]) >= 3 for p in ("index", "p0", "p1", "p2"))


def test_a_lost_page_stops_the_read_or_is_listed(spark, listing):
    os.remove(f"{listing.removeprefix('file://')}/p2")
    with pytest.raises(PySparkException, match="p2"):
        load(spark, listing, retries="0").collect()
    got = load(spark, listing, retries="1", wait="0.01", on_failure="list").collect()
    assert [(r.page, r.accession) for r in got if r.failed] == [("p2", None)] and len(got) == 4
    with pytest.raises(PySparkException, match="no index"):
        load(spark, listing + "/none", retries="0").collect()


def test_fingerprints_are_of_bags(spark):
    rng = random.Random(3)
    rows = [(str(rng.randrange(40)), rng.choice(["", "a", "é", None, 'x,"y"'])) for _ in range(300)]
    one = lambda r, n: sorted(map(tuple, commits.fingerprint(spark.createDataFrame(r, "a string, b string").repartition(n)).collect()))
    assert one(rows, 1) == one(rng.sample(rows, len(rows)), 7)
    assert one(rows, 1) != one([*rows[:-1], ("41", rows[-1][1])], 1)
    twice, swapped = [("1", "x"), ("2", "y")], [("1", "y"), ("2", "x")]
    assert one(twice, 1)[1:] == one(swapped, 1)[1:] and one(twice, 1)[0] != one(swapped, 1)[0]  # only whole rows tell these apart
    assert one([("a", None)], 1) != one([("a", "")], 1) and one([("1:", "")], 1) != one([("", "1:")], 1)
    assert [r[1:] for r in one([], 1)] == [(0, "0", "0")] * 3
    plan = commits.fingerprint(spark.createDataFrame(rows, "a string, b string"))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan


def test_tables_are_published_whole_and_replace_earlier_ones(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    a = spark.createDataFrame([(1, 'say "x", y'), (2, None), (3, "two\nlines"), (4, "")], "k int, t string").repartition(3)
    with pytest.raises(InputError, match="published"):
        commits.published(spark, folder, "a")
    commits.publish({"a": a, "none": a.where("k < 0")}, folder)
    read = lambda t: sorted(map(tuple, commits.published(spark, folder, t).collect()))
    assert read("a") == [("1", 'say "x", y'), ("2", ""), ("3", "two\nlines"), ("4", "")] and read("none") == []
    commits.publish({"a": a.where("k = 1")}, folder, checks=spark.createDataFrame([("fine", 0)], "requirement string, n_failed int"))
    assert read("a") == [("1", 'say "x", y')]
    with pytest.raises(InputError, match="no table"):
        commits.published(spark, folder, "none")
    runs = [d for d in os.listdir(f"{tmp_path}/out/a") if d.startswith("run-")]
    assert len(runs) == 1 and not [f for f in os.listdir(f"{tmp_path}/out/a") if f.startswith("pending")]


def test_a_failed_task_or_check_leaves_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    a = spark.range(40).selectExpr("cast(id as string) AS k").repartition(4)
    commits.publish({"a": a}, folder)
    files = lambda: {f"{d}/{x}" for d, _, names in os.walk(tmp_path) for x in names}
    before = files()
    bad = a.withColumn("k", F.when(F.col("k") == "39", F.raise_error(F.lit("planted")).cast("string")).otherwise(F.col("k")))
    with pytest.raises(PySparkException, match="planted"):
        commits.publish({"a": a, "b": bad}, folder)
    with pytest.raises(RuleBroken, match="nothing is written"):
        commits.publish({"a": a.limit(1)}, folder, spark.createDataFrame([("broken", 3)], "requirement string, n_failed int"))
    assert files() == before
    assert commits.published(spark, folder, "a").count() == 40


def test_a_changed_file_isn_t_read(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    commits.publish({"a": spark.createDataFrame([("x",)], "k string")}, folder)
    run = next(d for d in os.listdir(f"{tmp_path}/out/a") if d.startswith("run-"))
    part = next(f for f in os.listdir(f"{tmp_path}/out/a/{run}") if f.endswith(".csv"))
    with open(f"{tmp_path}/out/a/{run}/{part}", "a") as f:
        f.write("more\n")
    with pytest.raises(InputError, match="committed"):
        commits.published(spark, folder, "a")
