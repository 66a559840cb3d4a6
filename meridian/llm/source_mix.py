"""Mixing sources to target token weights by entropy balancing, in DataFrame operations alone.

Targets: sources in code point order (null last) weigh `weights`, repeated, and share `share` times all words; a target stops at `most` times
its source's words and the excess goes to the others by weight (water-filling: with sources ordered by cap / weight, a prefix of them is
full).

Rates: within each source, the rates between 0 and `most` that meet the token constraint, sum of rate * size = target, and are nearest to `base` copies of
each document by relative entropy (of rate / most and of what is left of it, against base / most). The convex dual has one multiplier per
source, that of its tokens, and its solution tilts the rates exponentially by size: rate / (most - rate) = base / (most - base) * exp(lambda * size
/ mean size). So a source that gives more than `base` of its words gives them first from its long documents, one that gives less takes them first
from these. Newton steps on lambda run for all sources at once over the counts of equal sizes, a compressed form of all documents; a step
at most doubles lambda (and adds 1), and one that leaves the bracket of what is known is replaced by its middle.

Copies: floor(rate), and one more for the documents whose hash, less the rate's fraction, is lowest, up to the source's target. The cut is
found by two rounds of counting in bins, so no source is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, table

WEIGHTS = (5, 2, 1)
STEPS, BINS = 80, 4096
#: Rows that agree in all that the mix sees, numbered in one task.
EQUAL_ROWS = 100_000
WORD = "[^\\x20\\x09-\\x0D]+"


def _targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """source, source_size, target of one row per source. The windows run over rows of sources, not of documents."""
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.row_number().over(rank) - 1, F.lit(len(weights))) + 1).cast("int"))
    x = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    until, every = by_fill.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    x = x.withColumn("total", F.sum("source_size").over(every) * share).withColumn("weights", F.sum("weight").over(every))
    x = x.withColumn("full_cap", F.sum("cap").over(until)).withColumn("full_weight", F.sum("weight").over(until))
    left = F.greatest(F.col("total") - (F.col("full_cap") - F.col("cap")), F.lit(0.0))
    level = left / (F.col("weights") - (F.col("full_weight") - F.col("weight")))
    x = x.withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") >= F.col("cap"))
    # The level of the first source that isn't full holds for all after it.
    x = x.withColumn("final", F.min(F.when(~F.col("full"), F.struct(F.row_number().over(by_fill).alias("r"), F.col("level").alias("level")))).over(every)["level"])
    return x.select("source", "source_size", F.when(F.col("full") | F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("weight"))).alias("target"))


def words_in(text: str = "text") -> Column:
    """The number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _tilted(lam: Column, size: Column, mean: Column, base: float, most: float) -> Column:
    """The share of `most` that a document is taken at."""
    return 1 / (1 + (most - base) / base * F.exp(-lam * size / mean))


def _numbered(rows: DataFrame) -> DataFrame:
    """Every row again, with its number among the rows that equal it; many equal rows are numbered by several tasks."""
    equal = rows.groupBy(*rows.columns).agg(F.count("*").alias("m"))
    few = equal.where(F.col("m") <= EQUAL_ROWS).withColumn("number", F.explode(F.sequence(F.lit(1).cast("long"), "m")))
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / EQUAL_ROWS)))
    many = equal.where(F.col("m") > EQUAL_ROWS).withColumn("part", part).repartition(*rows.columns, "part")
    many = many.withColumn("number", F.explode(F.sequence(F.col("part") * EQUAL_ROWS + 1, F.least("m", (F.col("part") + 1) * EQUAL_ROWS)))).drop("part")
    return few.unionByName(many).drop("m")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, base: float = 1.0, key: str = "doc_id", text: str = "text", source: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """How many words of every document the mix takes (0 < base < most).

    Returns, for each row, doc_id, source, the columns `keep` (none of them named as a result), size (words; null text: 0), source_size, target (both of its source),
    rate, copies (0 to `most`) and taken (copies * size). Each source's taken words come within about one document of its target. Reruns agree: all
    sums are of decimals or longs, and copies follow a hash of doc_id, size, `keep` and the row's number among equal rows, not the order of rows; so equal
    rows, also those without an id, are taken one by one. A null source is a source of its own, the last; a null doc_id is hashed as such.
    Documents of size 0 take nothing. Other columns, also of the names of results, are not read. An empty table gives no rows."""
    sized = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), words_in(text).alias("size"), *keep)
    sized = table(_numbered(sized))
    lengths = table(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    filled = F.sum(F.when(F.col("size") > 0, F.col("n")))
    sources = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), (F.sum(F.col("size") * F.col("n")) / F.nullif(filled, F.lit(0))).alias("mean"))
    goals = table(_targets(sources.select("source", "source_size"), weights, share, float(most)).join(sources.withColumnRenamed("source", "s").drop("source_size"), F.col("source").eqNullSafe(F.col("s"))).drop("s"))

    none = F.lit(None).cast("double")
    open_ = goals.where((F.col("target") > 0) & (F.col("target") < F.col("source_size") * most))
    state = table(open_.select("source", "target", "mean", F.lit(0.0).alias("lam"), none.alias("low"), none.alias("high")))
    given = lengths.where("size > 0")
    for _ in range(STEPS):
        joined = given.join(state.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("p", _tilted(F.col("lam"), F.col("size"), F.col("mean"), base, float(most)))
        words = F.col("size") * F.col("n") * most
        total = lambda x: F.sum(x.cast("decimal(38,6)")).cast("double")
        sums = joined.groupBy("source", "target", "mean", "lam", "low", "high").agg(total(words * F.col("p")).alias("got"), total(words * F.col("size") / F.col("mean") * F.col("p") * (1 - F.col("p"))).alias("slope"))
        moved = sums.withColumn("gap", F.col("got") - F.col("target"))
        moved = moved.withColumn("low", F.when(F.col("gap") < 0, F.col("lam")).otherwise(F.col("low"))).withColumn("high", F.when(F.col("gap") < 0, F.col("high")).otherwise(F.col("lam")))
        reach = 1 + F.abs("lam")
        step = F.greatest(F.least(F.coalesce(F.try_divide(-F.col("gap"), F.col("slope")), -F.signum("gap") * reach), reach), -reach) + F.col("lam")
        inside = F.coalesce(step > F.col("low"), F.lit(True)) & F.coalesce(step < F.col("high"), F.lit(True))
        done = F.abs("gap") <= F.greatest(F.lit(0.5), 1e-9 * F.col("target"))
        was, state = state, table(moved.select("source", "target", "mean", F.when(done, F.col("lam")).when(inside, step).otherwise((F.col("low") + F.col("high")) / 2).alias("lam"), "low", "high", done.alias("done")))
        drop(was)
        if not state.where("not done").limit(1).count():
            break
    solved = goals.join(state.select(F.col("source").alias("s"), "lam"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")

    # Hash less fraction, as a whole number: the lowest ones get the further copy.
    rated = sized.join(solved.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rate = F.when((F.col("target") <= 0) | (F.col("size") == 0), 0.0).when(F.col("lam").isNull(), float(most)).otherwise(most * _tilted(F.col("lam"), F.col("size"), F.col("mean"), base, float(most)))
    unit = 1 << 40
    rated = rated.withColumn("rate", F.round(rate, 6)).withColumn("whole", F.floor("rate"))
    order = F.pmod(F.xxhash64("doc_id", "size", "number", *keep, F.lit(11)), F.lit(unit)) - ((F.col("rate") - F.col("whole")) * unit).cast("long") + unit
    rated = table(rated.withColumn("place", F.when((F.col("size") > 0) & (F.col("whole") < most) & (F.col("rate") > F.col("whole")), order)))
    drop(sized, lengths, state)
    wide = 2 * unit // BINS
    lack = rated.groupBy("source").agg(F.sum(F.col("whole") * F.col("size")).alias("sure")).join(goals.select(F.col("source").alias("s"), "target"), F.col("source").eqNullSafe(F.col("s"))).select("source", (F.col("target") - F.col("sure")).alias("lack"))
    cut = lack.withColumn("base", F.lit(0).cast("long"))
    for width in (wide, max(1, wide // BINS)):
        inside = rated.where("place is not null").join(cut.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).where((F.col("place") >= F.col("base")) & (F.col("place") < F.col("base") + F.lit(width * BINS)))
        bins = inside.groupBy("source", "base", "lack", F.floor((F.col("place") - F.col("base")) / width).alias("bin")).agg(F.sum("size").alias("words"))
        run = Window.partitionBy("source").orderBy("bin")  # at most BINS rows a source
        bins = bins.withColumn("before", F.sum("words").over(run) - F.col("words"))
        # The bin in which the sum passes the lack, or the last one.
        at = bins.where("before <= lack").groupBy("source").agg(F.max_by(F.struct("bin", "before", "words", "base", "lack"), "bin").alias("x"))
        cut = table(at.select("source", (F.col("x.base") + F.col("x.bin") * width).alias("base"), (F.col("x.lack") - F.col("x.before")).alias("lack"), F.col("x.words").alias("words"), F.lit(width).alias("width")))
    # The last bin is taken if that comes closer to the target.
    ends = cut.select(F.col("source").alias("s"), (F.col("base") + F.when(F.col("words") <= 2 * F.col("lack"), F.col("width")).otherwise(0)).alias("end"))
    out = rated.join(ends, F.col("source").eqNullSafe(F.col("s")), "left")
    copies = F.when(F.col("size") == 0, 0).otherwise(F.col("whole") + F.when(F.col("place") < F.col("end"), 1).otherwise(0)).cast("int")
    out = out.withColumn("copies", copies)
    return out.select("doc_id", "source", *keep, "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
