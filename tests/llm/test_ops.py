"""Each operator against brute force, and its defined results for odd inputs."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridian.llm import fill_middle, language_id, secrets, sharding, source_audit, token_counts, word_bpe
from meridian.llm.common import components
from meridian.llm.fill_middle import fill_in_middle
from meridian.llm.language_id import identify
from meridian.llm.near_vectors import near_vectors, pairs_above
from meridian.llm.ngram_join import drop_near_copies, jaccard_classes
from meridian.llm.page_text import extract_main, main_text
from meridian.llm.queries import vocabulary
from meridian.llm.secrets import find_secrets, guess_cost, ranks, redact, scan_secrets
from meridian.llm.source_audit import audit_sources
from meridian.llm.source_mix import mix_sources
from meridian.llm.suffix_dedup import remove_repeats, repeated_starts, suffix_array
from meridian.llm.token_counts import count_tokens
from meridian.llm.topk_search import top_k
from meridian.llm.word_bpe import encode_texts

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = "/root/testdata/sf0.001"


def docs(spark, rows, schema=DOCS):
    full = [(*r, *[None] * (5 - len(r))) for r in rows]
    return spark.createDataFrame(full, schema)


def prose(rng, n, words=400):
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(words)]
    return " ".join(rng.choice(vocab) for _ in range(n))


def by(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


ODD = [(1, None), (2, ""), (3, "  \t\n"), (4, "word"), (5, "two words"), (5, "two words"), (None, "no id here at all"), (7, "Ünï çøde \U0001f600 ſK ΣΑΣ σας")]


# Components ---------------------------------------------------------------


def test_components_match_a_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1080)] + [(-5, i) for i in range(2000, 2100)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


# 1. N-gram Jaccard join ----------------------------------------------------


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return set() if not w else {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute_classes(rows, k, num, den):
    sets = [shingle_set(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and den * both >= num * (len(sets[i] | sets[j])):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("k,num,den", [(3, 9, 10), (5, 4, 5)])
def test_jaccard_classes_match_brute_force(spark, k, num, den):
    rng = random.Random(k)
    rows = list(ODD)
    shared = prose(rng, 30)
    for i in range(100, 130):
        base = prose(rng, rng.randint(5, 120)).split()
        if i % 3 == 0:
            base += shared.split()
        rows.append((i, " ".join(base)))
        for j in range(rng.randint(0, 4)):
            edit = list(base)
            for _ in range(rng.randint(0, 3)):
                edit[rng.randrange(len(edit))] = f"new{rng.randrange(99)}"
            rows.append((i + 1000 * (j + 1), (" " * j + "\n").join(edit).upper() if j == 1 else " ".join(edit)))
    df = docs(spark, rows).repartition(5)
    assert by(jaccard_classes(df, k, num, den), "doc_id", "n_shingles", "component_id") == brute_classes(rows, k, num, den)


def test_a_large_group_of_near_copies_is_whole(spark):
    rng = random.Random(9)
    base = prose(rng, 60).split()
    rows = []
    for i in range(250):
        edit = list(base)
        for _ in range(rng.randint(0, 2)):
            edit[rng.randrange(60)] = f"w{rng.randrange(5)}"
        rows.append((i, " ".join(edit)))
    assert by(jaccard_classes(docs(spark, rows).repartition(6), 3, 9, 10), "doc_id", "n_shingles", "component_id") == brute_classes(rows, 3, 9, 10)


def test_jaccard_of_an_empty_table_and_clashing_columns(spark):
    assert jaccard_classes(docs(spark, []), 3, 9, 10).count() == 0
    clash = docs(spark, ODD).selectExpr("doc_id", "text", "1 as n", "2 as cls", "3 as root", "4 as text_key")
    assert by(jaccard_classes(clash, 3, 9, 10), "doc_id", "n_shingles", "component_id") == brute_classes(ODD, 3, 9, 10)


def test_patterned_words_differ_and_very_long_texts_link(spark):
    """Words of two letters that a polynomial modulo a power of two can't tell apart; one text of a megabyte and its near copy."""
    flip = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    other = flip.translate(str.maketrans("ab", "ba"))
    rng = random.Random(31)
    long_text = prose(rng, 160_000).split()
    near = list(long_text)
    near[777] = "changed"
    rows = [(1, flip), (2, other), (3, flip), (4, " ".join(long_text)), (5, " ".join(near)), (6, flip + other), (7, other + flip)]
    got = {r.doc_id: r.component_id for r in jaccard_classes(docs(spark, rows), 3, 9, 10).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7}


def test_prefixes_of_links_meet_under_every_order():
    from meridian.llm import ngram_join

    rng = np.random.default_rng(5)
    for num, den in ((9, 10), (4, 5)):
        for _ in range(60):
            x = np.unique(rng.integers(0, 2**63, rng.integers(1, 60)).astype(np.uint64))
            keep = x[rng.random(len(x)) > 0.1]
            y = np.unique(np.concatenate((keep, rng.integers(0, 2**63, 2).astype(np.uint64))))
            both = len(np.intersect1d(x, y))
            h, bounds = np.concatenate((x, y)), np.array([0, len(x), len(x) + len(y)])
            shared = [len(np.intersect1d(*one)) > 0 for one in ngram_join._prefixes(h, bounds, num, den)]
            assert len(shared) == ngram_join.ORDERS and (all(shared) or den * both < num * (len(x) + len(y) - both))


def test_one_document_of_each_group_stays(spark):
    a = "one two three four five six seven eight nine ten"
    kept = drop_near_copies(docs(spark, [(3, a), (2, a), (9, "else " * 9), (2, a), (None, a), (8, None)]))
    assert by(kept, "doc_id") == [(2,), (8,), (9,), (None,)]


def test_rows_of_one_id_or_of_none_are_told_apart_by_text(spark):
    a, b, c, d = ("one two three four five six seven eight nine ten", "else " * 9, "red green blue black white grey brown pink", "up down left right in out over under")
    rows = [(5, a), (5, b), (6, a), (7, b), (None, c), (None, c), (None, d), (4, d), (4, d), (9, None), (9, ""), (9, ""), (None, None)]
    kept = drop_near_copies(docs(spark, rows).repartition(4))
    assert by(kept, "doc_id", "text") == sorted([(5, a), (5, b), (None, c), (None, d), (4, d), (9, None), (9, ""), (None, None)], key=str)


# 2. Top-k -----------------------------------------------------------------


def brute_top(rows, k, every):
    valid = {i: [math.floor(1024 * x) for x in v] for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in sorted(valid):
        if q % every == 0:
            best = sorted(((-sum(a * b for a, b in zip(valid[q], valid[c])), c) for c in valid if c != q))[:k]
            out += [(q, r, c, -s) for r, (s, c) in enumerate(best, 1)]
    return sorted(out)


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.float32(rng.standard_normal(24) * rng.choice([0.1, 1, 3]))]) for i in range(900)]
    rows += [(i, rows[i % 7][1]) for i in range(900, 960)] + [(2000, None), (2100, []), (2200, [None] * 24), (2300, [float("nan")] * 24), (2400, [float("inf")] * 24), (2500, [0.0] * 24), (None, [1.0] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6).withColumn("norm", F.lit(1))
    got = by(top_k(df, k=10, every=100), "query_id", "rank", "vec_id", "score")
    assert sorted(got) == brute_top(rows, 10, 100)


def test_top_k_of_very_large_components(spark):
    rng = random.Random(22)
    rows = [(i, [rng.choice([1.0, -3e4, 1e6, 1e10, -1e10, 2e13]) * rng.random() for _ in range(4)]) for i in range(60)]
    rows += [(100, [1e307, 1.0, 0.0, 0.0]), (200, [1.7e308, -1e300, 1.0, 2.0]), (300, [1 / 1024, 0.0, 0.0, 0.0]), (301, [6e15, 0.0, 0.0, 0.0]), (302, [-8e15, 7e15, 1.0, 0.0]), (400, [0.0] * 4), (401, [0.0, 0.0, 7.5e15, 1e200])]
    most = int(sys.float_info.max)
    whole = {i: [int(1024 * x // 1) if math.isfinite(1024 * x) else int(math.copysign(most, x)) for x in v] for i, v in rows}
    assert 2**62 < whole[301][0] * whole[300][0] < 2**63  # fits a long
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5, every=10).collect()
    for q in [i for i in whole if i % 10 == 0]:
        score = {c: max(-(2**63) + 2, min(2**63 - 1, sum(map(int.__mul__, whole[q], whole[c])))) for c in whole if c != q}
        want = sorted(score, key=lambda c: (-score[c], c))[:5]
        assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == [(c, score[c]) for c in want], q


def test_top_k_of_few_and_no_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (3, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(by(top_k(df), "query_id", "rank", "vec_id", "score")) == brute_top(rows, 10, 100)
    assert top_k(df.limit(0)).count() == 0


# 3. BPE -------------------------------------------------------------------

HARD = [*ODD, (20, "don't we'll IT'S  'sx 12 345 a1b2!?\x1c x"), (21, "a<|endoftext|>b <|startoftext|><|endoftext|>"), (22, "İstanbul ΑΣ ﬁ é 한국어 ́x"), (23, "x" * 5000), (24, "<|endof text|> <|"), (25, "été " * 300)]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def test_encoding_equals_the_library(spark):
    t = library()
    rows = HARD + [(1000 + i, r.text) for i, r in enumerate(spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect())]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for d, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((d, len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    for hot in (word_bpe.HOT, 50, 0):
        got = encode_texts(docs(spark, rows).repartition(3), vocabulary(), hot_words=hot)
        assert by(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=str)


def test_encoding_an_empty_table(spark):
    assert encode_texts(docs(spark, []), vocabulary()).count() == 0


# 4. Token counts ------------------------------------------------------------


def test_token_counts_equal_the_library_for_any_chunks(spark):
    t = library()
    rng = random.Random(3)
    rows = HARD + [(50, prose(rng, 900)), (51, "".join(rng.choice("ab \n'1é!") for _ in range(3000))), (52, "y" * 900 + " z" * 500 + "q" * 700), (53, "<|endoftext|>" * 90)]
    want = sorted(((d, len((s or "").encode()), n, n > 100) for d, s in rows for n in [len(t.encode(s or "", add_special_tokens=False).ids)]), key=str)
    for chunk, overlap in ((token_counts.CHUNK, token_counts.OVERLAP), (64, 16), (200, 40)):
        got = count_tokens(docs(spark, rows).repartition(3), vocabulary(), limit=100, chunk=chunk, overlap=overlap)
        assert by(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == want, (chunk, overlap)
    assert count_tokens(docs(spark, []), vocabulary()).count() == 0


# 5. Language ID -------------------------------------------------------------


def test_languages_of_held_out_rows(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = identify(d, keep=["doc_id", "lang"]).toPandas()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got["doc_id"]]).all()
    test = got[got["held_out"]]
    assert (test["lang"] == test["lang_pred"]).mean() > 0.97
    assert got["score"].between(0, 1).all() and not got["rejected"].any()


def test_gibberish_and_unlearned_languages_are_rejected_at_their_lengths(spark):
    rng = random.Random(12)
    finnish = "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto ja heidän on toimittava toisiaan kohtaan veljeyden hengessä"
    turkish = "bütün insanlar hür haysiyet ve haklar bakımından eşit doğarlar akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler"
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    far = [" ".join(word() for _ in range(n)) for n in (40, 60, 120, 300, 1000, 3000) for _ in range(5)]
    far += ["".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n)) for n in (400, 4000)]
    far += [" ".join(rng.choice(t.split()) for _ in range(n)) for t in (finnish, turkish) for n in (60, 200, 1000)] + [finnish, turkish]
    train = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = identify(docs(spark, list(enumerate(far))), train=train).collect()
    assert [far[r.doc_id][:40] for r in got if not r.rejected] == [] and len(got) == len(far)
    held = train.where(language_id.held_out()).where("length(text) > 200")
    for n, least in ((20, 0.85), (40, 0.97), (100, 0.98)):
        kept = identify(held.withColumn("text", F.substring("text", 1, n)), train=train).agg(F.avg((~F.col("rejected")).cast("int"))).first()[0]
        assert kept >= least, (n, kept)


def test_a_language_of_many_copies_is_learned(spark):
    rng = random.Random(11)
    rows = [(i, prose(rng, 60), "many") for i in range(1500)]
    few = {f"few{n}": [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(60)) for _ in range(n)] for n, letters in ((1, "klmnop"), (2, "uvwxyz"), (6, "pqrstu"))}
    for lang, texts in few.items():
        rows += [(len(rows) + i, texts[i % len(texts)], lang) for i in range(3000)]
    model = language_id.fit(docs(spark, rows).repartition(5))
    assert {lang: model[1].count(lang) for lang in few} == {"few1": 1, "few2": 2, "few6": 4} and model[1].count("many") == 4
    got = identify(docs(spark, rows), keep=["lang"]).where("lang like 'few%' and lang <> lang_pred or rejected")
    assert got.count() == 0


def test_language_of_odd_rows(spark):
    d = docs(spark, [(i, t, "en") for i, t in enumerate(["the cat and the dog", "the house of the man", "this and that there", "with the other one"])] + [(10, None, "en"), (11, "", "en"), (12, "123 ### !", None), (None, "the end", None), (13, "の中で最も大きい", None)])
    got = {r.doc_id: (r.lang_pred, r.rejected) for r in identify(d).collect()}
    assert got[10] == got[11] == got[12] == ("und", True)
    assert got[None][0] == got[0][0] == "en" and not got[None][1] and got[13] == ("en", True)
    none = identify(d.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in none} == {"und"} and len(none) == 9
    assert identify(docs(spark, [])).count() == 0


def test_prediction_does_not_read_labels(spark):
    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    other = d.select((F.col("doc_id") + 7).alias("doc_id"), "text", F.lit("xx").alias("lang"), F.lit("s").alias("source"))
    a = {(r.text, r.lang_pred, r.score) for r in identify(d, keep=["text"]).collect()}
    assert {(r.text, r.lang_pred, r.score) for r in identify(other, train=d, keep=["text"]).collect()} == a


def test_grams_do_not_cross_rows():
    whole = language_id._grams(np.frombuffer(b"ab  cd", np.uint8), np.array([0, 2, 6]))
    assert (whole[0] == language_id._grams(np.frombuffer(b"ab", np.uint8), np.array([0, 2]))[0]).all()


# 6. Source mix ---------------------------------------------------------------


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, live = share * sum(sizes.values()), {}, list(names)
    while live:
        level = total / sum(weight[s] for s in live)
        full = [s for s in live if level * weight[s] >= most * sizes[s]]
        if not full:
            return target | {s: level * weight[s] for s in live}
        for s in full:
            target[s] = most * sizes[s]
            total -= target[s]
            live.remove(s)
    return target


def test_mix_meets_its_targets(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.choice([0, 1, 5, 40, 200])), None, rng.choice(["a", "b", "B", "é", None, "a", "a"])) for i in range(800)]
    rows += [(None, "x y z", None, "a"), (5000, None, None, "b"), (5001, "solo " * 900, None, "rare")]
    df = docs(spark, rows).repartition(5)
    got = mix_sources(df).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, t, _, s in rows:
        sizes[s] += len((t or "").split())
    want = brute_targets(sizes)
    taken, longest = collections.Counter(), collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
        assert r.taken == r.copies * r.size <= 2 * r.size
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest[s], (s, taken[s], want[s])
    again = mix_sources(df.repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


def brute_multiplier(sizes, target, most=2):
    """Lambda of the tilt, by bisection on the token constraint; sizes without zeros."""
    z = np.array(sizes) / np.mean(sizes)
    got = lambda lam: float((most * np.array(sizes) / (1 + np.exp(np.clip(-lam * z, -700, 700)))).sum())
    low, high = -1e4, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if got(mid) < target else (low, mid)
    return low


def test_rates_solve_the_dual_of_the_token_constraint(spark):
    rng = random.Random(66)
    rows = [(i, prose(rng, rng.choice([1, 3, 9, 40, 400])), None, rng.choice("aaaaabcd")) for i in range(600)]
    got = mix_sources(docs(spark, rows)).collect()
    for source in "abcd":
        part = [r for r in got if r.source == source and r.size]
        total = sum(r.rate * r.size for r in part)
        assert abs(total - part[0].target) <= 1e-5 * part[0].target + 1
        if part[0].target < 2 * part[0].source_size:
            lam, mean = brute_multiplier([r.size for r in part], part[0].target), np.mean([r.size for r in part])
            for r in part:
                assert abs(r.rate - 2 / (1 + math.exp(-lam * r.size / mean))) < 2e-5
        else:
            assert all(r.rate == 2 for r in part)


def test_equal_rows_are_taken_one_by_one(spark, monkeypatch):
    from meridian.llm import source_mix

    rows = [(7, "one two three", None, "a")] * 100 + [(None, "x y", None, "b")] * 90 + [(i, "w " * 5, None, "c") for i in range(50)]
    first = None
    for most in (source_mix.EQUAL_ROWS, 8):
        monkeypatch.setattr(source_mix, "EQUAL_ROWS", most)
        got = sorted((str(r.doc_id), r.source, r.size, r.source_size, r.target, r.taken) for r in mix_sources(docs(spark, rows)).collect())
        assert len(got) == len(rows) and got == (first or got)
        first = got
    for source, size in (("a", 3), ("b", 2), ("c", 5)):
        taken, target = sum(x[5] for x in got if x[1] == source), next(x[4] for x in got if x[1] == source)
        assert abs(taken - target) <= size


def test_mix_does_not_read_columns_named_as_its_results(spark):
    rows = spark.createDataFrame([(i, "a b c", "s", 9, 9, 9.0, 9, 9, 9) for i in range(4)], "doc_id long, text string, source string, size int, taken int, rate double, copies int, number int, m int")
    assert {(r.size, r.source_size) for r in mix_sources(rows).collect()} == {(3, 12)}


def test_mix_of_empty_tables_and_texts(spark):
    assert mix_sources(docs(spark, [])).count() == 0
    got = mix_sources(docs(spark, [(1, None, None, "a"), (2, "", None, None)])).collect()
    assert [(r.size, r.taken) for r in got] == [(0, 0), (0, 0)]
    one = mix_sources(docs(spark, [(i, "w " * (i + 1), None, "s") for i in range(40)])).collect()
    assert abs(sum(r.taken for r in one) - 1.5 * 820) <= 40


# 7. Secrets ------------------------------------------------------------------


def brute_base(text):
    out = []
    for m in re.finditer(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(out)]


def test_base_spans_match_the_patterns(spark):
    rng = random.Random(8)
    bits = ["token", "PassWord", "api_key", "APIKEY", "secret=", ": ", "=", '"', "AKIA", "ABCDEF0123456789", "deadbeef", "0123456789abcdef", "é", " ", "x", "ſecret", "K", "=short", "longvalue-12345", "\n"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))) for i in range(600)] + ODD
    rows += [(9000 + i, r.text) for i, r in enumerate(spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect())]
    got = by(scan_secrets(docs(spark, rows)), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    want = []
    for d, t in rows:
        b = brute_base(t or "")
        kinds = collections.Counter(x.split(":")[0] for x in b)
        want.append((d, kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(",".join(b).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert scan_secrets(docs(spark, [])).count() == 0


def test_guess_cost_orders_values():
    assert guess_cost("password1") < 4 < guess_cost("2024-05-17pass") < 9
    assert guess_cost("aaaaaaaaaaaa") < 3 and guess_cost("qwertyuiop") < 4 and guess_cost("P4ssw0rd") < 4
    assert guess_cost("x7Gq-2mZp9Lw") > 15 and guess_cost("") == 0
    assert guess_cost("x7Gq-2mZp9Lw" * 9, 10) >= 10


def test_guess_spans_are_added_and_clean_text_is_not():
    text = 'pwd = "x7Gq!2mZ#9Lw", password: password123, secret: dragon7love, the token is here'
    spans = find_secrets(text)
    assert [(k, text[s:e]) for k, s, e in spans] == [("guess", "x7Gq!2mZ#9Lw")]
    assert redact(text, spans).startswith('pwd = "[secret]", password')
    assert find_secrets("the key: something else and pass=2024-01-01") == []
    assert redact("abcdef", [("hex", 0, 3), ("hex", 2, 5)]) == "[secret]f"


def test_the_cost_alone_decides_on_values_of_any_kind(spark):
    secret = ["passphrase: Zk!qWv#LxRtB", "pwd=QzXwKjVbNmTr", "bearer: qhwzvkxrtj", "auth_key = 83920174651029", "password: !#%^&*~@+?;", "password=Zk!qWv#LxRtB"]
    plain = ["pwd=********", "passphrase: qwertyuiop", "bearer: 12345678", "credential: 20240517", "bearer: authentication", "secret: Geheimnis", "pwd: contraseña", "pass: développement", "pwd: información", "auth-key: --------", "secret: mypassword"]
    for text in secret:
        [(kind, s, e)] = find_secrets(text)
        assert kind == "guess" and text[s:e] == re.split("[:=] ?", text, maxsplit=1)[1].rstrip(";")
    assert {t: x for t in plain if (x := find_secrets(t))} == {}
    got = scan_secrets(docs(spark, list(enumerate(secret + plain))), redacted=True)
    assert {r.doc_id for r in got.where("redacted like '%[secret]%'").collect()} == set(range(len(secret)))


def brute_cost(value, rank):
    """Recursion over all segmentations, with each kind of segment written out plainly."""

    def brute(x):
        size = 10 * any(map(str.isdigit, x)) + 26 * any(map(str.islower, x)) + 26 * any(map(str.isupper, x)) + 33 * any(not c.isalnum() for c in x)
        return len(x) * math.log10(max(size, 2))

    def one(x):
        low, n, costs = x.lower(), len(x), [brute(x)]
        if n >= 3:
            case = 0 if x == low else 0.3 if x in (low.upper(), low.capitalize()) else 0.3 * n
            for word, extra in ((low, 0), (low.translate(secrets.LOOKS), 0.6)):
                if word in rank:
                    costs.append(math.log10(rank[word] + 1) + extra + case)
            if re.fullmatch(r"(19|20)\d\d", x):
                costs.append(2)
            if secrets.DATE.match(x) and 6 <= n <= 10:
                costs.append(math.log10(365 * 120) + 0.5)
            steps = [secrets.step_of(a, b) for a, b in zip(low, low[1:])]
            if all(steps):
                turns = 1 + sum(a != b for a, b in zip(steps, steps[1:]))
                costs.append(math.log10(secrets.KEYS) + turns * math.log10(2 * n) + case)
            gaps = {ord(b) - ord(a) for a, b in zip(low, low[1:])}
            if low.isalnum() and gaps in ({1}, {-1}):
                costs.append(math.log10(72 * n) + case)
            for unit in range(1, n // 2 + 1):
                if x == x[:unit] * (n // unit) and n % unit == 0:
                    costs.append(brute(x[:unit]) + math.log10(n // unit))
                    break
        return min(costs)

    best = [0.0]
    for e in range(1, len(value) + 1):
        best.append(min(best[s] + one(value[s:e]) + (0.3 if s else 0) for s in range(e)))
    return best[-1]


def test_guess_costs_match_brute_force():
    rng = random.Random(77)
    parts = ["password", "Dragon", "1999", "2024-05-17", "qwerty", "qazwsx", "aaaa", "abab", "321", "Zk!q", "P@ss", "poiuy", "cde", "x7", "__", "N0"]
    rank = ranks()
    for _ in range(150):
        value = "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))[: secrets.SPAN]
        assert abs(guess_cost(value, rank=rank) - brute_cost(value, rank)) < 1e-9, value
    for value in ("ab" * 60, "7" * 100, "abcdefgh" * 9, "Xy9" * 30 + "qwertyuiop", "qwertyuiop" * 5):
        assert guess_cost(value, rank=rank) < brute_cost(value, rank) + 1e-9 or len(value) > secrets.SPAN
        assert guess_cost(value, rank=rank) >= brute_cost(value, rank) - 1e-9


def test_keyboard_walks_and_known_words_are_cheap():
    assert guess_cost("qazwsxedc123") < 9 and guess_cost("zxcvbnm,./") < 7 and guess_cost("qwerfdsa") < 9
    assert guess_cost("sunflower22garden") < secrets.GUESSES <= guess_cost("TrustNoOneAtAllHere")
    assert guess_cost("q" * 50_000) < 8 and guess_cost("x7Gq-2mZp9Lw" * 9_000, 12) >= 12


def test_kept_columns_named_as_results_give_way(spark):
    rows = spark.createDataFrame([(1, "pwd: Zk!qWv#LxRtB", "old", 5, "en", 0.5, True)], "doc_id long, text string, spans string, n_hex long, lang string, score double, rejected boolean")
    [r] = scan_secrets(rows, keep=["doc_id", "spans", "n_hex", "text"], redacted=True).collect()
    assert (r.spans, r.n_hex, r.redacted, r.text) == ("guess:5:17", 0, "pwd: [secret]", "pwd: Zk!qWv#LxRtB")
    for train in (None, rows.limit(0)):
        [r] = identify(rows, train, keep=["doc_id", "score", "rejected", "text"]).collect()
        assert r.text == "pwd: Zk!qWv#LxRtB" and r.score != 0.5


# 8. Suffix arrays --------------------------------------------------------------


def brute_removed(rows, length):
    seen = collections.Counter(t[i : i + length] for _, t in rows for i in range(len(t) - length + 1))
    out = []
    for d, t in rows:
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = True
        kept = bytes(b for b, g in zip(t, gone[1:]) if not g)
        out.append((d, len(t), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("shard", [1 << 20, 1200, 1])
def test_repeats_match_brute_force(spark, shard):
    """All contents in suffix arrays; the minimizers of many contents in parts; and the digests of single strings."""
    rng = random.Random(12)
    passage = prose(rng, 60)
    rows = list(ODD) + [(90, "a" * 700), (91, "ab" * 300), (92, passage + passage), (93, "é" * 150)]
    for i in range(100, 140):
        base = prose(rng, rng.randint(10, 150))
        rows.append((i, base + " " + passage + prose(rng, 20) if i % 4 == 0 else base))
        if i % 5 == 0:
            cut = rng.randrange(len(base))
            rows.append((i + 1000, base[:cut] + "#" + base[cut + 1 :]))
        if i % 7 == 0:
            rows.append((i, base))
    for length in (100, 140):
        got = by(remove_repeats(docs(spark, rows).repartition(4), length, shard=shard), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        assert got == brute_removed([(d, (t or "").encode()) for d, t in rows], length)
    assert remove_repeats(docs(spark, [])).count() == 0


def test_suffix_arrays_are_sorted():
    rng = np.random.default_rng(1)
    for trial in range(120):
        text = np.append(rng.integers(1, 2 + trial % 5, int(rng.integers(1, 160))), 0).astype(np.int32)
        assert suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())  # noqa: B023


def test_repeats_of_400_bytes_match_brute_force(spark):
    """The contract's length, over all documents of the smallest table."""
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, (r.text or "").encode()) for r in source.select("doc_id", "text").collect()]
    assert by(remove_repeats(source, 400), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_removed(rows, 400)


def test_repeats_in_a_very_long_text(spark):
    """A text of several windows; passages repeat across a window's end, and in another text."""
    from meridian.llm import suffix_dedup

    rng = random.Random(88)
    passage, other = prose(rng, 100), prose(rng, 90)
    filler = "".join(f"{rng.getrandbits(64):016x}" for _ in range(150_000))
    edge = suffix_dedup.WINDOW - 200
    text = filler[:edge] + passage + filler[edge:1_500_000] + other + filler[1_500_000:] + passage
    rows = [(1, text), (2, "x" + other + "y"), (None, None), (3, "")]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in remove_repeats(docs(spark, rows), 400).collect()}
    assert got == {1: (len(text), 2 * len(passage) + len(other), 3), 2: (len(other) + 2, len(other), 1), None: (0, 0, 0), 3: (0, 0, 0)}


@pytest.mark.parametrize("symbols", [2048, 0])
def test_suffix_arrays_recurse_at_any_alphabet(symbols, monkeypatch):
    from meridian.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "SYMBOLS", symbols)
    rng = np.random.default_rng(4)
    for size, most in ((3000, 3), (4000, 2500), (2000, 2)):
        text = np.concatenate((np.tile(rng.integers(1, most, size // 4), 4), [0])).astype(np.int32)
        plain = sorted(range(len(text)), key=lambda i: text[i:].tolist())
        assert suffix_array(text).tolist() == plain


def test_minimizers_do_not_depend_on_neighbours():
    from meridian.llm import suffix_dedup

    grams = np.random.default_rng(3).integers(0, 6, 900).astype(np.uint64)
    for width in (1, 5, 64, 337):
        got = suffix_dedup._anchors(grams, width)
        assert got.tolist() == [i + int(np.argmin(grams[i : i + width])) for i in range(len(grams) - width + 1)]


def test_repeats_never_cross_parts():
    assert not repeated_starts([b"abcd", b"efab", b"cdef"], 4).any()
    assert repeated_starts([b"abcdx", b"abcdy"], 4).tolist() == [True] + [False] * 5 + [True] + [False] * 5


# 9. Sharding --------------------------------------------------------------------


def test_the_table_is_even_and_stable():
    names = [f"s{i}" for i in range(20)]
    full, less = sharding.fill_table(names, 4099), sharding.fill_table(names[:-1], 4099)
    count = collections.Counter(full)
    assert max(count.values()) - min(count.values()) <= 1 and len(count) == 20
    moved = sum(a != b for a, b in zip(full, less) if a != "s19")
    assert moved < 0.15 * 4099
    heavy = collections.Counter(sharding.fill_table({"a": 3, "b": 1}, 1009))
    assert abs(heavy["a"] - 3 * heavy["b"]) <= 4
    for bad in ({}, {"a": 0}):
        with pytest.raises(ValueError):
            sharding.fill_table(bad, 7)
    with pytest.raises(ValueError):
        sharding.fill_table(["a"], 8)


def brute_fill(names, size):
    prefs = {n: [(sharding._hash(n, "offset") % size + j * (sharding._hash(n, "skip") % (size - 1) + 1)) % size for j in range(size)] for n in names}
    slots, done = {}, 0
    while done < size:
        for n in sorted(names):
            slot = next((s for s in prefs[n] if s not in slots), None)
            if slot is not None:
                slots[slot] = n
                done += 1
    return [slots[i] for i in range(size)]


def test_the_table_matches_brute_force():
    names = ["x", "y", "z", "w"]
    assert sharding.fill_table(names, 101) == brute_fill(names, 101)


def test_placement_keeps_rows_and_columns(spark, tmp_path):
    d = docs(spark, ODD).withColumn("slot", F.lit("old")).withColumn("shard_no", F.lit(1))
    got = sharding.place(d)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard_no", "slot", "shard"] and got.count() == len(ODD)
    assert len({r.slot for r in got.where("doc_id = 5").collect()}) == 1
    assert sharding.place(docs(spark, [])).count() == 0
    sharding.write_shards(docs(spark, ODD), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(ODD)


# 10. Near vectors -----------------------------------------------------------------


def test_placement_with_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "a", 7, "x", 3), (None, "b", 8, "y", 4)], "doc_id long, shard string, slot int, shard_number string, meridian int")
    table = sharding.fill_table(sharding.SHARDS)
    got = sharding.place(rows)
    assert got.columns == ["doc_id", "shard_number", "meridian", "slot", "shard"]
    assert all(r.shard == table[r.slot] for r in got.collect()) and got.count() == 2
    by_slot = sharding.place(rows, key="slot").select("slot").collect()
    want = rows.select(F.pmod(F.xxhash64(F.col("slot").cast("string")), F.lit(sharding.SIZE)).cast("int").alias("slot")).collect()
    assert sorted(by_slot) == sorted(want)


def brute_near(rows, least):
    unit = {}
    for k, (_, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            unit[k] = np.array(v, np.float64)
    root, links = list(range(len(rows))), collections.Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in unit:
        for b in unit:
            if a < b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] / math.sqrt((unit[a] @ unit[a]) * (unit[b] @ unit[b])) >= least:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    low = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            low[find(k)] = min(low.get(find(k), r[0]), r[0])
    return sorted(((r[0], links[k], low.get(find(k)), r[0] is not None and r[0] == low.get(find(k))) for k, r in enumerate(rows)), key=str)


def test_near_vectors_match_brute_force(spark, monkeypatch):
    from meridian.llm import near_vectors as module

    rng = np.random.default_rng(5)
    rows = []
    for i in range(700):
        centre = np.random.default_rng(i % 23).standard_normal(20)
        rows.append((i, [float(x) for x in np.float32(centre + rng.standard_normal(20) * rng.choice([0.1, 0.4, 1]))], None if i % 31 == 0 else int(i % 3)))
    rows += [(1000 + i, rows[1][1], 1) for i in range(30)] + [(1040, [2 * x for x in rows[1][1]], 1)]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [None] * 20, 1), (2003, [0.0] * 20, 1), (2004, [float("nan")] * 20, 1), (None, rows[2][1], 2), (2005, [1.0, 0.0], 1), (2006, [1.0, 0.1], 1), (1, rows[1][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4).withColumn("tile", F.lit("x"))
    want = brute_near(rows, 0.93)
    assert by(near_vectors(df), "vec_id", "n_links", "component_id", "kept") == want
    monkeypatch.setattr(module, "TILE", 16)
    assert by(near_vectors(df), "vec_id", "n_links", "component_id", "kept") == want
    assert near_vectors(df.limit(0)).count() == 0


def test_near_vectors_of_any_size_and_dimension(spark):
    rng = np.random.default_rng(41)
    base = rng.standard_normal((6, 2600))
    rows = [(i, (base[i % 6] + 0.3 * rng.standard_normal(2600)).tolist(), 1) for i in range(40)]
    got = by(near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")), "vec_id", "n_links", "component_id", "kept")
    assert got == brute_near(rows, 0.93)
    rows = [(1, 1, [1e200, 1e200]), (2, 1, [2e200, 2e200]), (3, 1, [1e-200, 1e-200]), (4, 1, [-1e308, 1e308]), (5, 1, [0.0, 0.0])]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 0, 4), (5, 0, 5)]


def test_quantisation_bounds_lose_no_pair():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((200, 32))
    y = np.concatenate((x[:50] + 0.3 * rng.standard_normal((50, 32)), rng.standard_normal((100, 32)) * [1e-3] * 32))
    i, j, computed = pairs_above(x, y, 0.93)
    cosine = x @ y.T / np.sqrt((x * x).sum(1))[:, None] / np.sqrt((y * y).sum(1))
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*map(np.ndarray.tolist, np.nonzero(cosine >= 0.93)))) and computed < 200


# 11. Fill in the middle ------------------------------------------------------


def brute_middle(doc_id, text, seed, rate, spm):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, z = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return (doc_id, n, "plain", None, None, text)
    p, m, s = "".join(units[:a]), "".join(units[a:z]), "".join(units[z:])
    if h4 % 100 < spm:
        return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize(("chunk", "seed", "rate", "spm"), [(1 << 16, 7, 100, 50), (64, 7, 100, 50), (1000, 3, 60, 20)])
def test_fill_in_middle_equals_brute_force(spark, chunk, seed, rate, spm):
    rng = random.Random(chunk)
    rows = [*ODD, (11, "\n"), (12, "\n\n\n"), (13, "a<P"), (14, "a<<P>x\n"), (15, "é\n\U0001f600\nß"), (16, "<P\n><S"), (17, "<S>"), (18, "no line end\n<"), (19, "<<S\n<P<M")]
    rows += [(i, "".join(rng.choice("ab\n<PSé>") for _ in range(rng.randint(0, 700)))) for i in range(20, 120)]
    rows += [(i, "".join(rng.choice("abcdefghé\U0001f600\n<PS") for _ in range(rng.randint(1000, 9000)))) for i in range(200, 215)]
    rows += [(300, rows[-1][1]), (301, rows[-1][1]), (None, rows[-1][1]), (300, rows[-1][1]), (300, rows[-2][1])]
    got = fill_in_middle(spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, form string, n int"), seed=seed, rate=rate, spm=spm, chunk=chunk).collect()
    assert sorted((str(r[:5]), r.output) for r in got) == sorted((str(w[:5]), w[5]) for w in (brute_middle(*r, seed, rate, spm) for r in rows))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    kept = {(d, sha(t or "")) for d, t in rows}
    assert all(r.output_sha256 == sha(r.output) and (r.doc_id, r.restored_sha256) in kept for r in got)


def test_fill_in_middle_of_a_giant_text(spark):
    text = "line of some words\n" * 200_000 + "x" * 3_000_000 + "\n" * 100_000
    got = fill_in_middle(docs(spark, [(5, text), (6, "x" * 2_000_000)])).collect()
    assert {r.doc_id: tuple(r)[:5] + (r.output,) for r in got} == {5: brute_middle(5, text, 7, 100, 50), 6: brute_middle(6, "x" * 2_000_000, 7, 100, 50)}


def test_blocks_compose_from_every_state(spark):
    """A text's function is that of its parts, wherever it is cut."""
    auto = fill_middle.automaton(fill_middle.MARKS)
    rng = random.Random(8)
    data = np.frombuffer("".join(rng.choice("<PSM>\n a") for _ in range(3000)).encode(), np.uint8)
    every = np.arange(auto.states, dtype=np.uint8)[None, :]
    whole = fill_middle.Scan(auto, data, np.array([0, len(data)]), block=7).composed(every)
    state, units = every.copy(), np.zeros(every.shape, np.int64)
    for s in range(0, len(data), 111):
        part = data[s : s + 111]
        to, n, _, _ = fill_middle.Scan(auto, part, np.array([0, len(part)]), block=5).composed(every)
        units += np.take_along_axis(n, state.astype(np.intp), 1)
        state = np.take_along_axis(to, state.astype(np.intp), 1)
    assert (state == whole[0]).all() and (units == whole[1]).all()


def test_fill_in_middle_of_empty_tables(spark):
    assert fill_in_middle(docs(spark, [])).collect() == []


# 12. Main text of pages ------------------------------------------------------

_LONG = "Word after word of an article that goes on for a while, as articles do. " * 3


def page(body):
    return f"<!DOCTYPE html><html><head><title>Title</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


def article(*blocks):
    return "\n\n".join(" ".join(b.split()) for b in blocks)


MENU = "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav>"
PAGES = {
    "article element, unclosed tags": (page(f"{MENU}<div class='ad'>{_LONG}</div><article><h1>Head &amp; line</h1><p><b>{_LONG}<br><p>Short.</p><p>&eacute;t&#233;</p></article><footer>&copy; us</footer>"), article("Head & line", _LONG, "Short.", "été")),
    "boilerplate in the article": (page(f"<article><h2>H</h2><p>{_LONG}</p><aside>{_LONG}</aside><div class='cookie-notice'>{_LONG}</div><form><p>{_LONG}</p></form><p>End <span class='ad'>buy</span>of it</p><section id='comments'><p>{_LONG}</p></section></article>"), article("H", _LONG, "End of it")),
    "main element, table": (page(f"<header><p>{_LONG}</p></header><main><header><h1>T</h1></header><p>{_LONG}</p><table><tr><td>a<td>b<tr><td>c</table></main><div role='complementary'>{_LONG}</div>"), article("T", _LONG, "a", "b", "c")),
    "only class names": (page(f"<div id='top-menu'><a href=x>Home</a></div><div id='wrap'><div class='post'><h2>Head</h2><p>{_LONG}</p><p>Short.</p><p>{_LONG}</p></div><div class='sidebar'><p>{_LONG}</p></div></div><div class='site-footer'>us</div>"), article("Head", _LONG, "Short.", _LONG)),
    "bare text": ("just &lt;text&gt;\n here", "just <text> here"),
    "odd white space": (page(f"<article><p>a b\t\n c</p><p> \n </p><p>{_LONG}</p></article>"), article("a b c", _LONG)),
    "no article": (page(MENU), ""),
    "cut off": (f"<article><p>{_LONG}</p><p>tail<a href='", article(_LONG, "tail")),
    "odd declarations": (f"<![foo[x]]><article><![CDATA[y]]><!-- c --><p>{_LONG}</p><!-- open <p>gone</p></article>", article(_LONG)),
    "null": (None, ""),
    "empty": ("", ""),
}


def test_pages_of_many_kinds(spark):
    rows = [(i, f"u{i}", h, "clash") for i, (h, _) in enumerate(PAGES.values())] + [(None, None, PAGES["bare text"][0], None)] * 2
    got = extract_main(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    want = [t for _, t in PAGES.values()] + ["just <text> here"] * 2
    assert sorted(map(str, map(tuple, got))) == sorted(str((r[0], r[1], w, len(w))) for r, w in zip(rows, want, strict=True))


def test_random_pages_never_fail():
    rng = random.Random(2)
    bits = "< > </ <! <!-- --> <![ [ ]]> p div article nav &amp; &#x &#99999999; ; \" ' = script </script> text <p> </p> <div> </div> <article> </article> <? /> é \x00 <td> <li>".split(" ")
    for _ in range(2000):
        assert "\n\n\n" not in main_text("".join(rng.choice(bits) for _ in range(rng.randint(1, 40))))


def test_large_odd_pages_take_linear_time():
    for bit in ("<!--", "<p>a", "<div>", "</p ", "<![CDATA[", "<p><b>x"):
        main_text(bit * 20_000)


def test_pages_of_empty_tables(spark):
    assert extract_main(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


# 13. Source divergence audit ---------------------------------------------------


def brute_audit(rows, least, top):
    rows = [(t or "", x or "", s or "") for t, x, s in rows]
    words = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)), x, s) for t, x, s in rows]
    out = []
    for lang in {x for _, x, _ in words}:
        total, docs_with = collections.Counter(), collections.Counter()
        for w, x, _ in words:
            if x == lang:
                total.update(w)
                docs_with.update(set(w))
        kept = [t for t in total if docs_with[t] >= least]
        v = len(kept)
        groups = {s: collections.Counter() for _, x, s in words if x == lang}
        for w, x, s in words:
            if x == lang:
                groups[s].update(t for t in w if docs_with[t] >= least)
        rate = lambda c, n: 1 + 1_000_000_000 * (c + 1) // (n + v)
        n = {s: sum(c.values()) for s, c in groups.items()}
        every = sum(total[t] for t in kept)
        f = lambda p, q: (p - q) ** 2 // q
        for s, c in groups.items():
            pairs = [(o, sum(f(rate(c[t], n[s]), rate(groups[o][t], n[o])) for t in kept)) for o in groups if o != s]
            terms = [(t, f(rate(c[t], n[s]), rate(total[t], every))) for t in kept if c[t] and rate(c[t], n[s]) > rate(total[t], every)]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda i: (-i[1], i[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(items[:most])]
    return sorted(out)


@pytest.mark.parametrize(("least", "top", "few"), [(3, 200, 100_000), (1, 5, 0), (2, 1, 100_000), (10_000, 200, 100_000)])
def test_audit_equals_brute_force(spark, monkeypatch, least, top, few):
    monkeypatch.setattr(source_audit, "FEW_GROUPS", few)
    rng = random.Random(least)
    rows = [(prose(rng, rng.randint(0, 60), 80), rng.choice(["en", "de", None]), rng.choice(["a", "b", "é", "", None])) for _ in range(150)]
    rows += [("hot " * 500 + "Tie tie x1yéZ", "en", "a")] * 4 + [(None, "en", "none"), ("", "xx", "one"), ("...", "xx", "two"), ("Only once", "zz", "s")]
    given = spark.createDataFrame([(*r, 1, "t") for r in rows], "text string, lang string, source string, rank int, part string").repartition(5)
    got = audit_sources(given, least=least, top=top).select("lang", "source", "part", "item", "value", "rank")
    assert sorted(map(tuple, got.collect())) == brute_audit(rows, least, top)


def test_audit_of_empty_tables(spark):
    assert audit_sources(docs(spark, [])).collect() == []


def test_every_code_point_is_encoded_as_by_the_library():
    """Each code point inside a word, and alone before a digit; of planes 4 to 13, in which nothing is assigned, the first 256 each. Texts of a few thousand of them."""
    path = vocabulary()
    t, r = token_counts.tokenizer(path), word_bpe.rules(path)
    every = [chr(i) for i in range(1, 0x110000) if not 0xD800 <= i <= 0xDFFF and (not 4 <= i >> 16 <= 13 or i & 0xFFFF < 256)]
    kind = word_bpe.id_type(path)
    for s in range(0, len(every), 8192):
        text = " ".join(f"a{c}b {c}9" for c in every[s : s + 8192])
        words = r.split(text)
        distinct = sorted(set(words))
        ids = dict(zip(distinct, word_bpe.encode_words(path, distinct), strict=True))
        assert np.frombuffer(b"".join(ids[w] for w in words), kind).tolist() == t.encode(text, add_special_tokens=False).ids
        (_, rare), = word_bpe.codes([text], {}, r)
        assert rare == words
