"""The registered queries over whole tables: against their SQL, the libraries, or plain versions."""

from __future__ import annotations

import hashlib
import math
import os
import zlib

import duckdb
import numpy as np
import pytest
import xxhash

from meridian.llm import language_id, sharding
from meridian.llm.common import vocabulary
from meridian.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in sorted(os.listdir(DATA)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rel = duck.sql(ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    order = [rel.columns.index(c) for c in columns]
    assert sorted(str([r[c] for c in columns]) for r in df.collect()) == sorted(str([r[i] for i in order]) for r in rel.fetchall())


def test_encoding_and_counts_equal_the_library(spark, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op3_word_bpe"](spark, DATA).collect()}
    counted = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op4_token_counts"](spark, DATA).collect()}
    for d, text in texts.items():
        ids = t.encode(text, add_special_tokens=False).ids
        assert got[d] == (len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))
        assert counted[d] == (len(text.encode()), len(ids), len(ids) > 2048)


def test_languages_equal_a_plain_nearest_centroid(spark, texts):
    """Every prediction again, n-gram by n-gram, with the fitted model; held-out rows by the crc of their id."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    idf, names, centres, _ = language_id.fit(docs.select("doc_id", "text", "lang"))
    got = QUERIES["op5_language_id"](spark, DATA).collect()
    assert len(got) == len(texts)
    for r in got[::5]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        raw = bytes(language_id._LETTER[b] for b in texts[r.doc_id].lower().encode())
        packed = bytes(c for i, c in enumerate(raw) if c != 32 or i == 0 or raw[i - 1] != 32)
        counts = np.zeros(language_id.BUCKETS)
        for n in (1, 2, 3):
            for i in range(len(packed) - n + 1):
                code = n
                for c in packed[i : i + n]:
                    code = code * 256 + c
                counts[int(language_id.mix(np.array([code], np.uint64))[0]) % language_id.BUCKETS] += 1
        x = np.log1p(counts) * idf
        near = centres @ (x / math.sqrt((x * x).sum()))
        assert r.lang_pred == names[int(near.argmax())] and abs(r.score - near.max()) < 1e-4


def test_placement_equals_a_plain_one(spark, texts):
    table = sharding.fill_table(sharding.SHARDS)
    got = QUERIES["op9_sharding"](spark, DATA).collect()
    assert len(got) == len(texts)
    for r in got:
        h = xxhash.xxh64(str(r.doc_id).encode(), seed=42).intdigest()
        slot = (h - (1 << 64) if h >= 1 << 63 else h) % sharding.SIZE
        assert (r.slot, r.shard) == (slot, table[slot])


def test_secrets_equal_the_patterns(spark, texts):
    from tests.llm.test_ops import brute_base  # noqa: PLC0415

    for r in QUERIES["op7_secret_scan"](spark, DATA).collect():
        want = brute_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r.spans.split(","))


def test_pages_equal_what_stands_between_the_article_tags(spark):
    """The given pages have one article element each, of headings and paragraphs only."""
    import html  # noqa: PLC0415
    import re  # noqa: PLC0415

    pages = {r.page_id: r for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = QUERIES["op12_page_text"](spark, DATA).collect()
    assert len(got) == len(pages)
    for r in got:
        inner = re.search("<article>(.*?)</article>", pages[r.page_id].html, re.S)
        blocks = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", b))).split()) for b in re.split("</?(?:p|h1)>", inner[1])]
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, want := "\n\n".join(b for b in blocks if b), len(want))
