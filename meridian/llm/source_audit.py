"""Source divergence audit: which terms a source uses more than its language does, and how far the sources of a language are apart.

1. Partitions count terms by group (language and source); one exchange by (language, term) makes postings: a kept term with its count in every source.
   From them come the number V of a language's kept terms, the groups' sums N, and with these all rates p and q, in whole numbers.
2. Term search: a group's terms are put into buckets of equal count. All terms of a bucket have the same p, and the least count in the language among
   them bounds q from below, so f from above. Buckets are evaluated best bound first, in growing rounds, until a group's best unseen bound
   lies strictly below its k-th value; what is never seen can't be among the first k.
3. Pairs: f of a term that only one of two groups has, or neither, follows from the buckets and the rates of absent terms. Postings add the
   difference for terms that both have. Tasks add up by pair before anything is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, drop, released, table

#: Parts of a whole that rates are counted in; documents of a language that a kept term is in; ranks of the term part.
ONE, LEAST, TOP = 1_000_000_000, 3, 200
#: Terms by group that a task holds before it hands them on, and rows of a batch of pairs.
HELD, PAIR_ROWS = 1_500_000, 20_000
#: Groups whose sums are sent to every task at most; more are joined.
FEW_GROUPS = 100_000

_TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, source, occurrences, documents) of (lang, source, text), added up in the task"""
    seen: dict[tuple[str, str], tuple[Counter[str], Counter[str]]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (total, docs) in seen.items():
            n = len(total)
            columns = [pa.array([lang] * n, pa.string()), pa.array(list(total), pa.string()), pa.array([source] * n, pa.string()), pa.array(list(total.values()), pa.int64()), pa.array([docs[t] for t in total], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "term", "source", "n", "df"])
        seen.clear()

    for b in batches:
        for lang, source, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if (lang, source) not in seen:
                seen[lang, source] = Counter(), Counter()
            total, docs = seen[lang, source]
            terms = _TERM.findall(text.translate(_LOWER) if not text.isascii() else text.lower())
            total.update(terms)
            docs.update(set(terms))
        if sum(len(total) for total, _ in seen.values()) > HELD:
            yield from flush()
    yield from flush()


def rate(count: Column, n: Column, v: Column) -> Column:
    """p of a count in a group of sum n, where the language has v terms."""
    return F.lit(1).cast("long") + F.call_function("div", F.lit(ONE).cast("long") * (count + 1), n + v)


def excess(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _rates(count: np.ndarray, n: np.ndarray, v: int) -> np.ndarray:
    return 1 + ONE * (count + 1) // (n + v)


def _far(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """f of p against q; the squares stay below 2**63, as rates are at most ONE + 1."""
    return (p - q) * (p - q) // q


_PAIRS = "lang string, source string, other string, part long"


def _added(lang: str, names: list[str], a: np.ndarray, b: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    """value summed by the pair (a, b) of numbers of sources."""
    pair, where = np.unique(a * len(names) + b, return_inverse=True)
    total = np.zeros(len(pair), np.int64)
    np.add.at(total, where, value)
    name = pa.array(names, pa.string())
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(pair), pa.string()), name.take(pa.array(pair // len(names))), name.take(pa.array(pair % len(names))), pa.array(total)], ["lang", "source", "other", "part"])


def _by_lang(b: pa.RecordBatch, known) -> Iterator[tuple[str, pa.Array, list[str], np.ndarray, int]]:  # noqa: ANN001
    """(lang, its rows, names and sums of its sources, V). known: a broadcast of these by language, or None where they come as the rows' last two columns."""
    langs = b.column(0).to_pylist()
    for lang in dict.fromkeys(langs):
        rows = [i for i, x in enumerate(langs) if x == lang]
        sums, v = known.value[lang] if known else (b.column(b.num_columns - 2)[rows[0]].as_py(), b.column(b.num_columns - 1)[rows[0]].as_py())
        yield lang, pa.array(rows), [x["source"] for x in sums], np.array([x["total"] for x in sums], np.int64), v


def _one_sided(known) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    """What a bucket (lang, source, count, terms, sources, V) adds to its source's pairs, as if no other source had its terms: in place of absent terms on both sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, rows, names, total, v in _by_lang(b, known):
                number = {s: i for i, s in enumerate(names)}
                absent = _rates(np.zeros(len(names), np.int64), total, v)
                own = np.array([number[s] for s in b.column(1).take(rows).to_pylist()])
                count, terms = (np.asarray(b.column(i).take(rows)).astype(np.int64) for i in (2, 3))
                step = max(1, 2_000_000 // len(names))
                for s in range(0, len(rows), step):
                    o, c, m = own[s : s + step, None], count[s : s + step, None], terms[s : s + step, None]
                    p, every = _rates(c, total[o], v), np.broadcast_to(np.arange(len(names)), (len(o), len(names)))
                    here, q = np.broadcast_to(o, every.shape), absent[None, :]
                    both_absent = _far(absent[o], q), _far(q, absent[o])
                    other = (here != every).ravel()
                    yield _added(lang, names, here.ravel()[other], every.ravel()[other], (m * (_far(p, q) - both_absent[0])).ravel()[other])
                    yield _added(lang, names, every.ravel()[other], here.ravel()[other], (m * (_far(q, p) - both_absent[1])).ravel()[other])

    return run


def _both_sided(known) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    """What postings (lang, [(source, count)], sources, V) add to the pairs of their sources, beyond what _one_sided has given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, rows, names, total, v in _by_lang(b, known):
                number = {s: i for i, s in enumerate(names)}
                absent = _rates(np.zeros(len(names), np.int64), total, v)
                lists = b.column(1).take(rows)
                size = np.asarray(lists.value_lengths())
                flat = lists.flatten()
                own = np.array([number[s] for s in flat.field("source").to_pylist()])
                p = _rates(np.asarray(flat.field("n")).astype(np.int64), total[own], v)
                first = np.cumsum(size) - size
                for k in np.unique(size[size > 1]):
                    at = first[size == k]
                    step = max(1, 1_000_000 // int(k))
                    for i in range(int(k)):  # the i-th source of each term against the others
                        for s in range(0, len(at), step):
                            g = (at[s : s + step] + i)[:, None]
                            h = at[s : s + step, None] + np.delete(np.arange(k), i)[None, :]
                            a, z = np.broadcast_to(own[g], h.shape), own[h]
                            value = _far(p[g], p[h]) - _far(p[g], absent[z]) - _far(absent[a], p[h]) + _far(absent[a], absent[z])
                            yield _added(lang, names, a.ravel(), z.ravel(), value.ravel())

    return run


def _search(postings: DataFrame, buckets: DataFrame, top: int) -> DataFrame:
    """(lang, source, term, value) of the `top` terms of each group, ties by term: buckets by their bounds, best first, until unseen bounds are strictly below the k-th value."""
    own, group = ["lang", "source"], Window.partitionBy("lang", "source")
    best = group.orderBy(F.desc("bound"), F.desc("n")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = buckets.where("bound >= 0").withColumn("upto", F.sum("terms").over(best) - F.col("terms"))  # terms in better buckets
    ranked = table(ranked.select(*own, "n", "p", "bound", "upto", "q_sum", "v"))
    first, rows, size = Window.partitionBy(*own).orderBy(F.desc("value"), "term"), None, top
    low, kth = 0, None
    while True:
        new = ranked.where((F.col("upto") >= low) & (F.col("upto") < size)) if low else ranked.where(F.col("upto") < size)
        if kth is not None:
            new = new.join(kth, own, "left").where(F.col("kth").isNull() | (F.col("bound") >= F.col("kth"))).drop("kth")
        if new.isEmpty():
            break
        terms = postings.select("lang", "term", "total", F.explode("posting").alias("x")).select("lang", "term", "total", "x.source", "x.n")
        q = rate(F.col("total"), F.col("q_sum"), F.col("v"))
        valued = terms.join(new, [*own, "n"]).withColumn("q", q).where("p > q").select(*own, "term", excess(F.col("p"), F.col("q")).alias("value"))
        both = valued if rows is None else valued.unionByName(rows)
        was, rows = rows, table(both.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top).drop("rank"))
        if was is not None:
            drop(was)
        kth = rows.groupBy(*own).agg(F.count("*").alias("m"), F.min("value").alias("kth")).where(F.col("m") == top).select(*own, "kth")
        low, size = size, size * 64
    if rows is None:
        rows = postings.sparkSession.createDataFrame([], "lang string, source string, term string, value long")
    return rows


def audit_sources(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST, top: int = TOP) -> DataFrame:
    """The audit of every (lang, source) group: parts `pair` (each other source of the language) and `term` (the group's `top` most excessive terms).

    Terms are runs of ASCII letters and characters beyond ASCII, A-Z lower-cased; a language keeps those in `least` of its documents. With V kept terms and N the sum
    of their counts in a group, p = 1 + floor(10**9 * (count + 1) / (N + V)), q likewise of the language, f = floor((p - q)**2 / q).
    Returns lang, source, part, item, value, rank (from 1, value descending, item by code point ascending). Null text, lang and source count as
    empty strings, which are groups of their own; repeated rows count each time; a group without terms has its pairs, and a language without kept terms
    has pairs of value 0. Other columns, also of the names of results, are not read. An empty table gives no rows."""
    bound_batches(docs.sparkSession)
    given = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))))
    counted = given.mapInArrow(released(_counts), "lang string, term string, source string, n long, df long")
    by_term = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    posted = by_term.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("df").alias("df"), F.collect_list(F.struct("source", "n")).alias("posting"))
    postings = table(posted.where(F.col("df") >= least).drop("df"))
    flat = postings.select("lang", "total", F.explode("posting").alias("x")).select("lang", "total", "x.source", "x.n")
    buckets = table(flat.groupBy("lang", "source", "n").agg(F.count("*").alias("terms"), F.min("total").alias("least_total")))
    kept = postings.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("q_sum"))
    sums = buckets.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("terms")).alias("total"))
    groups = given.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(kept, "lang", "left")
    groups = table(groups.select("lang", "source", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total", "v", "q_sum"))))
    n_groups = groups.count()
    send = F.broadcast if n_groups <= FEW_GROUPS else (lambda d: d)
    p, q = rate(F.col("n"), F.col("total"), F.col("v")), rate(F.col("least_total"), F.col("q_sum"), F.col("v"))
    rated = buckets.join(send(groups), ["lang", "source"]).withColumns({"p": p, "q": q})
    bounded = rated.withColumn("bound", F.when(F.col("p") > F.col("q"), excess(F.col("p"), F.col("q"))).otherwise(F.lit(-1).cast("long")))
    terms = _search(postings, bounded, top)

    langs = groups.groupBy("lang").agg(F.collect_list(F.struct("source", "total")).alias("sums"), F.max("v").alias("v")).where("v > 0")
    one, two = buckets.select("lang", "source", "n", "terms"), postings.where(F.size("posting") > 1).select("lang", "posting")
    known = None
    if n_groups <= FEW_GROUPS:
        known = docs.sparkSession.sparkContext.broadcast({r.lang: ([s.asDict() for s in r.sums], r.v) for r in langs.collect()})
    else:
        one, two = (d.join(langs, "lang") for d in (one, two))
    one, two = one.mapInArrow(released(_one_sided(known)), _PAIRS), two.mapInArrow(released(_both_sided(known)), _PAIRS)
    added = one.unionByName(two).groupBy("lang", "source", "other").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part"))
    mine, theirs = groups.alias("a"), groups.select("lang", F.col("source").alias("other"), F.col("total").alias("other_total")).alias("b")
    zero = F.lit(0).cast("long")
    every = mine.join(theirs, "lang").where("source <> other").withColumns({"p": F.when(F.col("v") > 0, rate(zero, F.col("total"), F.col("v"))), "q": F.when(F.col("v") > 0, rate(zero, F.col("other_total"), F.col("v")))})
    base = F.coalesce(F.col("v") * excess(F.col("p"), F.col("q")), zero)
    pairs = every.withColumn("base", base).join(added, ["lang", "source", "other"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), (F.col("base") + F.coalesce("part", F.lit(0))).cast("long").alias("value"))
    both = pairs.unionByName(terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value"))
    place = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return both.withColumn("rank", F.row_number().over(place)).select("lang", "source", "part", "item", "value", "rank")
