"""N-gram Jaccard join by prefix filters under several global token orders.

Documents with equal shingle sets form a class; all further work is per class. Every global order of the shingles gives a necessary
condition: two sets with Jaccard >= num/den share a token among the first n - ceil(n * num / den) + 1 of each. Order 0 is the key of the
candidate join: rare shingles first by hash, and the HOT most frequent shingles last by frequency, so that passages which many documents
share stay out of the prefixes. Its candidates are intersected with those of ORDERS further orders before any set is fetched: a pair must share prefix
tokens under every one of them. Only what is left is verified exactly. The frequencies only choose an order; any order gives the same links.

Two sets' parity signatures (bit i: parity of the shingles whose hash falls on i) differ in no more bits than the sets differ in
shingles, so the join on prefix tokens drops a pair whose signatures differ too much without reading the sets, and loses no link. Signatures
of as many bits as a set has shingles then do the same for long sets.

A large group of near copies would make a pair of each two members. So each prefix group is first linked to its leader; then only members
of different components are paired. Links inside a component change nothing and aren't formed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, components, drop, released, table, tidy
from .kernels import U64, mix, shingles, text_parts

WORDS, BITS, ORDERS = 8, 512, 3
#: Shingles that order 0 puts last: at most so many, 16 bytes each, are broadcast.
HOT, HOT_LEAST = 1 << 18, 10
#: Up to so many text hashes, 8 bytes each, are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
SEEDS = [U64(0xA5A5A5A5 * (i + 1) + i) for i in range(ORDERS)]


#: Columns that tell texts apart by 128 bits.
KEYS = ["text_key", "text_key2"]


def _text_keys(text: Column | str) -> list[Column]:
    return [F.xxhash64(text).alias(KEYS[0]), F.xxhash64(F.lit("second"), text).alias(KEYS[1])]


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(U64).view(np.int64))


def _classes(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set; 0 only for the empty set."""
    n = np.diff(bounds)
    total = np.concatenate((np.zeros(1, U64), np.cumsum(h, dtype=U64)))
    other = np.concatenate((np.zeros(1, U64), np.cumsum(mix(h ^ U64(0x5BD1E995)), dtype=U64)))
    key = mix((total[bounds[1:]] - total[bounds[:-1]]) ^ mix(other[bounds[1:]] - other[bounds[:-1]]) + n.astype(U64))
    key[key == 0] = 1
    key[n == 0] = 0
    return key


def _signatures(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    rows = len(bounds) - 1
    row = np.repeat(np.arange(rows), np.diff(bounds))
    odd = (np.bincount(row * BITS + (h >> U64(17) & U64(BITS - 1)).astype(np.int64), minlength=rows * BITS) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(rows, BITS), axis=1).view(np.int64)


def _features(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each document, and rows (null id, count, shingle) of what several classes of one run share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text_key", "text_key2", "n", "cls", *(f"s{i}" for i in range(WORDS))]
        seen: set[int] = set()
        held: list[np.ndarray] = []

        def frequent() -> pa.RecordBatch:
            u, c = np.unique(np.concatenate([*held, np.zeros(0, U64)]), return_counts=True)
            held.clear()
            u, c = u[c >= 3], c[c >= 3]
            none = pa.nulls(len(u), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, pa.array(c.astype(np.int64)), _i64(u), *[none] * WORDS], names)

        for b in batches:
            for at, data, offsets in text_parts(b.column(3)):
                h, bounds = shingles(data, offsets, k)
                key, sig = _classes(h, bounds), _signatures(h, bounds)
                rows = len(bounds) - 1
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(at, rows) for c in range(3)), pa.array(np.diff(bounds).astype(np.int64)), _i64(key), *(pa.array(sig[:, i].copy()) for i in range(WORDS))], names)
                for i, x in enumerate(key.tolist()):
                    if x and x not in seen:
                        seen.add(x)
                        held.append(h[bounds[i] : bounds[i + 1]])
                if sum(map(len, held)) > 1 << 22:
                    yield frequent()
        yield frequent()

    return run


def _prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-n * num // den) + 1


def _postings(k: int, num: int, den: int, hot) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    """(token, cls, n) for each token of order 0's prefix, once for each class of a partition. hot: a broadcast of (shingles ascending, rank)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, rank = hot.value
        seen: set[int] = set()
        for b in batches:
            for _, data, offsets in text_parts(b.column(0)):
                h, bounds = shingles(data, offsets, k)
                n, key = np.diff(bounds), _classes(h, bounds)
                fresh = np.zeros(len(n), bool)
                for i, x in enumerate(key.tolist()):
                    if x and x not in seen:
                        seen.add(x)
                        fresh[i] = True
                if not fresh.any():
                    continue
                row = np.repeat(np.arange(len(n)), n)
                at = np.searchsorted(tokens, h).clip(max=max(0, len(tokens) - 1))
                cold = tokens[at] != h if len(tokens) else np.ones(len(h), bool)
                most = n - -(-n * num // den) + 1
                before = np.concatenate(([0], np.cumsum(cold)))
                pick = cold & fresh[row] & (before[:-1] - before[bounds[:-1]][row] < most[row])
                t, r = [h[pick]], [row[pick]]
                lack = most - (before[bounds[1:]] - before[bounds[:-1]])
                for i in np.flatnonzero(fresh & (lack > 0)):
                    where = bounds[i] + np.flatnonzero(~cold[bounds[i] : bounds[i + 1]])
                    where = where[np.argsort(rank[at[where]], kind="stable")][: lack[i]]
                    t.append(h[where])
                    r.append(np.full(len(where), i))
                rows = np.concatenate(r)
                yield pa.RecordBatch.from_arrays([_i64(np.concatenate(t)), _i64(key[rows]), pa.array(n[rows].astype(np.int64))], ["token", "cls", "n"])

    return run


def _wide(h: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Parity signatures of at least as many bits as a set has shingles; a power of two, so that a longer one folds onto a shorter one."""
    out = []
    for i in range(len(bounds) - 1):
        x = h[bounds[i] : bounds[i + 1]]
        bits = max(BITS, 1 << max(0, len(x) - 1).bit_length())
        out.append(np.packbits((np.bincount((x >> U64(9) & U64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes())
    return out


def _prefixes(h: np.ndarray, bounds: np.ndarray, num: int, den: int) -> list[list[np.ndarray]]:
    """Of each further order, the ascending prefix tokens of each set."""
    out: list[list[np.ndarray]] = []
    for seed in SEEDS:
        order = mix(h ^ seed)
        one = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            n = _prefix_length(b - a, num, den) if b > a else 0
            one.append(np.sort(np.partition(order[a:b], n - 1)[:n] if 0 < n < b - a else order[a:b]))
        out.append(one)
    return out


def _narrow(num: int, den: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs (a, b, sizes, wide signatures) whose signatures allow a link"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            sizes = np.asarray(b.column(2)) + np.asarray(b.column(3))
            for i in range(len(b)):
                x, y = (np.frombuffer(b.column(c)[i].as_buffer(), np.uint8) for c in (4, 5))
                least = min(len(x), len(y))
                x, y = (np.bitwise_xor.reduce(v.reshape(-1, least), axis=0) for v in (x, y))
                if int(np.bitwise_count(x ^ y).sum()) * (den + num) <= int(sizes[i]) * (den - num):
                    good.append(i)
            yield pa.RecordBatch.from_arrays([b.column(c).take(pa.array(good, pa.int64())) for c in (0, 1)], ["a", "b"])

    return run


#: Columns of the prefix tokens under the further orders, as the upper halves of their hashes: what two sets share they share in these, too.
_PREFIXES = [f"prefix{i}" for i in range(ORDERS)]


def _sets(k: int, num: int, den: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, data, offsets in text_parts(b.column(0)):
                h, bounds = shingles(data, offsets, k)
                prefixes = [pa.array([(x >> U64(32)).astype(np.uint32).view(np.int32) for x in one], pa.list_(pa.int32())) for one in _prefixes(h, bounds, num, den)]
                shingled = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), _i64(h))
                yield pa.RecordBatch.from_arrays([_i64(_classes(h, bounds)), shingled, pa.array(np.diff(bounds)), pa.array(_wide(h, bounds), pa.binary()), *prefixes], ["cls", "shingles", "size", "wide", *_PREFIXES])

    return run


def _verify(num: int, den: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for i in range(len(b)):
                x, y = (np.asarray(b.column(c)[i].values).view(U64) for c in (2, 3))
                both = len(np.intersect1d(x, y, True))
                if den * both >= num * (len(x) + len(y) - both):
                    good.append(i)
            yield pa.RecordBatch.from_arrays([b.column(c).take(pa.array(good, pa.int64())) for c in (0, 1)], ["a", "b"])

    return run


def _may_link(x: str, y: str, num: int, den: int) -> Column:
    """Size and signature conditions that every link meets, on the columns n and s0... of x and y."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    differ = sum((F.bit_count(F.col(f"{x}.s{i}").bitwiseXOR(F.col(f"{y}.s{i}"))) for i in range(WORDS)), F.lit(0))
    return (n * den >= m * num) & (m * den >= n * num) & (differ * (den + num) <= (n + m) * (den - num))


def jaccard_classes(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Group documents linked by the Jaccard similarity of their distinct k-word shingles, at least num / den (0 < num < den).

    Returns, for each row, doc_id, n_shingles (set size), n_copies (rows with the same set, itself included) and component_id, the
    smallest doc_id reachable by links. Words are runs without white space, A-Z lowered. A text of fewer than k words is one shingle;
    a null or blank text has an empty set, n_copies 1, and is linked with nothing. Repeated rows count as copies. A null doc_id keeps its
    row and never names a component unless no other id is in it. Other columns of docs are not read. An empty table gives no rows."""
    linked = _linked(docs, k, num, den, key, text)
    return linked.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"))


def _shared(rows: DataFrame, by: str) -> DataFrame:
    """The rows whose token occurs with several values of `by`; they cross one exchange, by token."""
    dealt = rows.repartition("token")
    # The sums look at all columns, so that their exchange is the rows' own.
    others = [c for c in rows.columns if c not in ("token", by)]
    sums = dealt.groupBy("token").agg(F.min(by).alias("least"), F.max(by).alias("most"), *(F.max(c).alias(f"any_{c}") for c in others))
    several = sums.where(" and ".join(["least <> most", *(f"any_{c} is not null" for c in others)])).select("token")
    return dealt.join(several, "token")


def _linked(docs: DataFrame, k: int, num: int, den: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_key and text_key2 (128 bits of hashes of the text), n (set size), component (its smallest doc_id), copies and root (the component itself, null if n is 0) of each row."""
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    texts = docs.select("doc_id", *_text_keys("text"), "text")
    schema = "doc_id long, text_key long, text_key2 long, n long, cls long, " + ", ".join(f"s{i} long" for i in range(WORDS))
    features = table(texts.mapInArrow(released(_features(k)), schema))
    rows = features.where("s0 is not null")
    hot = features.where("s0 is null").groupBy("cls").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_LEAST).orderBy(F.desc("n"), "cls").limit(HOT).toPandas()
    tokens, rank = hot["cls"].to_numpy(np.int64).view(U64), np.argsort(np.argsort(hot["n"].to_numpy(), kind="stable"))
    order = np.argsort(tokens)
    known = spark.sparkContext.broadcast((tokens[order], rank[order]))

    signatures = table(rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in (*KEYS, "n", *(f"s{i}" for i in range(WORDS))))))
    postings = table(docs.select("text").mapInArrow(released(_postings(k, num, den, known)), "token long, cls long, n long"))
    groups = table(_shared(postings, "cls").distinct())
    drop(postings)
    tidy(spark)

    def verified(pairs: DataFrame) -> DataFrame:
        given = pairs = table(pairs)
        wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct().join(signatures.select("cls", *KEYS), "cls").select(*KEYS).distinct()
        if wanted.count() <= BROADCAST_ROWS:
            wanted = F.broadcast(wanted)
        sets = table(texts.join(wanted, KEYS, "left_semi").dropDuplicates(KEYS).select("text").mapInArrow(released(_sets(k, num, den)), "cls long, shingles array<long>, size long, wide binary" + "".join(f", {c} array<int>" for c in _PREFIXES)))
        side = lambda c, *more: sets.select(F.col("cls").alias(c), *(F.col(m).alias(f"{m}_{c}") for m in more))
        pairs = pairs.join(side("a", "size", "wide"), "a").join(side("b", "size", "wide"), "b").select("a", "b", "size_a", "size_b", "wide_a", "wide_b")
        pairs = near = table(pairs.mapInArrow(released(_narrow(num, den)), "a long, b long"))
        pairs = pairs.join(side("a", *_PREFIXES), "a").join(side("b", *_PREFIXES), "b")
        shares = reduce(and_, (F.arrays_overlap(f"{c}_a", f"{c}_b") for c in _PREFIXES))
        pairs = table(pairs.where(shares).select("a", "b"))
        drop(near)
        drop(given)
        linked = table(pairs.join(side("a", "shingles"), "a").join(side("b", "shingles"), "b").select("a", "b", "shingles_a", "shingles_b").mapInArrow(released(_verify(num, den)), "a long, b long"))
        drop(pairs, sets)
        return linked

    bucket = F.floor(F.log(F.col("n").cast("double")) / math.log(den / num))
    led = groups.withColumn("bucket", bucket)
    leader = led.groupBy("token", "bucket").agg(F.min_by("cls", F.xxhash64("token", "cls")).alias("lead"))
    stars = led.join(leader, ["token", "bucket"]).where("lead <> cls").select(F.least("lead", "cls").alias("a"), F.greatest("lead", "cls").alias("b")).distinct()
    x, y = signatures.alias("x"), signatures.alias("y")
    first = verified(stars.join(x, F.col("a") == F.col("x.cls")).join(y, F.col("b") == F.col("y.cls")).where(_may_link("x", "y", num, den)).select("a", "b"))
    roots = table(components(first))
    mixed = groups.select("token", "cls").join(roots, F.col("cls") == F.col("node"), "left").select("token", "cls", F.coalesce("root", "cls").alias("root"))
    mixed = table(_shared(mixed, "root"))
    drop(groups)
    sides = table(mixed.join(signatures.drop("least", "copies", *KEYS), "cls"))
    drop(mixed)
    tidy(spark)
    x, y = sides.alias("x"), sides.alias("y")
    across = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.root") < F.col("y.root")) & _may_link("x", "y", num, den))
    second = verified(across.select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b")).distinct())
    drop(sides, roots)
    links = table(components(first.unionByName(second)))
    drop(first, second)
    joined = signatures.select("cls", "least", "copies").join(links, F.col("cls") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cls"))
    named = joined.join(joined.groupBy("root").agg(F.min("least").alias("component")), "root").select("cls", "component", "copies", "root")
    linked = rows.select("doc_id", *KEYS, "n", "cls").join(named, "cls", "left").select("doc_id", *KEYS, "n", "component", "copies", F.when(F.col("n") > 0, F.col("root")).alias("root"))
    linked = table(linked)
    drop(features, signatures, links)
    return linked


def drop_near_copies(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """Keep one document of each group of linked rows: the one of the smallest doc_id (of several texts under this id, the one of the smallest hash).

    Rows without a doc_id are grouped among themselves: of each group, one of them stays beside the named one. Rows with different texts
    that aren't linked all stay, also under one doc_id. Blank texts are linked with nothing; only rows equal in doc_id and text keep one."""
    blank = F.col("n") == 0
    groups = _linked(docs, k, num, den).groupBy("root", F.col("doc_id").isNull(), *(F.when(blank, F.col(c)) for c in ("doc_id", *KEYS)))
    # One exchange of the texts: equal rows are reduced before it, and the join needs the same partitions.
    names = ["meridian_id", "meridian_none", *(f"meridian_{c}" for c in KEYS)]
    known = lambda key, keys: [x.alias(n) for x, n in zip((F.coalesce(key, F.lit(0).cast("long")), key.isNull(), *keys), names, strict=True)]
    kept = groups.agg(F.min(F.struct("doc_id", *KEYS)).alias("x")).select(*known(F.col("x.doc_id"), [F.col(f"x.{c}") for c in KEYS]))
    keyed = docs.select("*", *known(F.col("doc_id").cast("long"), _text_keys(F.col("text").cast("string")))).dropDuplicates(names)
    return keyed.join(kept, names, "left_semi").drop(*names)
