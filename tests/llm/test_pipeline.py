"""The pipeline's stages, each against a plain version of what it should keep."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from meridian.llm.secrets import find_secrets
from meridian.llm.source_mix import mix_sources

DATA = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    source = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language_id", "near_copies", "secrets", "source_mix", "bpe"]
    extra = spark.createDataFrame([(10_000, "### 12345 $$$", None, "src0", 13), (10_001, None, None, "src0", 0)], source.schema)
    given = source.unionByName(extra)
    known = corpus_pipeline.language_id(spark, given, DATA)
    assert known.columns == corpus_pipeline.COLUMNS and known.count() == source.count()
    single = corpus_pipeline.near_copies(spark, known, DATA)
    ids = [r.doc_id for r in single.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) < source.count()
    clean = corpus_pipeline.secrets(spark, single, DATA)
    assert clean.count() == len(ids) and not any(find_secrets(r.text) for r in clean.collect())
    mixed = corpus_pipeline.source_mix(spark, clean, DATA)
    assert mixed.columns == corpus_pipeline.COLUMNS
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    done = corpus_pipeline.bpe(spark, mixed, DATA)
    assert done.count() == mixed.count() and done.where("n_tokens is null").count() == 0


def test_run_gives_what_the_stages_give(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    row = lambda d: sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in d.collect())
    assert row(corpus_pipeline.run(spark, DATA)) == row(docs)


def test_the_mix_takes_rows_of_null_and_repeated_ids_as_often_as_it_says(spark):
    rows = [(None if i % 3 == 0 else i // 4, " ".join(f"w{i}x{j}" for j in range(i % 17)), None, ["a", "b", None][i % 5 % 3], 0) for i in range(240)]
    given = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = corpus_pipeline.source_mix(spark, given, DATA).collect()
    assert max(Counter(r.text for r in got).values()) <= 2
    assert {tuple(r) for r in got} <= {tuple(r) for r in given.collect()}
    target = {r.source: r.target for r in mix_sources(given).collect()}
    for source in target:
        assert abs(sum(len(r.text.split()) for r in got if r.source == source) - target[source]) <= 16
    assert sorted(map(str, got)) == sorted(map(str, corpus_pipeline.source_mix(spark, given.repartition(5), DATA).collect()))


def test_the_mix_takes_equal_rows_one_by_one(spark):
    given = spark.createDataFrame([(None, "a b c", None, "s", 5)] * 41 + [(i, "w " * 9, None, "t", 18) for i in range(30)], "doc_id long, text string, lang string, source string, n_chars long")
    target = {r.source: r.target for r in mix_sources(given).collect()}
    got = corpus_pipeline.source_mix(spark, given, DATA).groupBy("source").agg(F.count("*").alias("n")).collect()
    assert {r.source: r.n for r in got}.keys() == target.keys()
    assert all(abs(r.n * {"s": 3, "t": 9}[r.source] - target[r.source]) <= 9 and r.n <= {"s": 82, "t": 60}[r.source] for r in got)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[k for k, _ in corpus_pipeline.STAGES])
def test_stages_take_empty_tables_and_odd_rows(spark, stage):
    """No rows give no rows; null columns, empty and long texts, repeated rows and clashing extra columns pass each stage."""
    names = "doc_id long, text string, lang string, source string, n_chars long"
    empty = spark.createDataFrame([], names)
    assert stage(spark, empty, DATA).count() == 0
    long_text = " ".join(f"palabra{i % 977} y otra" for i in range(60_000))
    rows = [(None, None, None, None, None), (1, "", "es", None, 0), (2, long_text, "es", "a", len(long_text)), (2, long_text, "es", "a", len(long_text)), (None, "el perro come pan en la casa grande de su madre", "es", "a", 48)]
    rows += [(i, "la casa del perro y el pan de cada día", "es", "a", 38) for i in range(3, 9)]
    extra = " , size long, copies int, score double, spans string, root long, n_tokens long, copy int, cls long, text_key long, row_key string"
    wide = spark.createDataFrame([(*r, 1, 1, 0.5, "x", 7, 7, 1, 7, 7, "k") for r in rows], names + extra)
    got = stage(spark, wide, DATA)
    assert got.columns == corpus_pipeline.COLUMNS or "ids_sha256" in got.columns
    assert got.count() >= 1
