"""Writing results: only after every check has passed, as text that reads back the same, with nothing stale left behind."""

from __future__ import annotations

import json
import math
from datetime import date
from enum import IntEnum

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.quantiles import exact_quantiles
from ..operators.relational import RuleBroken, same_rows
from .files import text_table
from .scratch import new_path


class Status(IntEnum):
    """How a run ended, as its exit code."""

    OK = 0
    MISMATCH = 1
    INVALID = 2
    MISSING = 3


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove_stale(spark: SparkSession, path: str) -> bool:
    """Delete an earlier result, so that it can't be taken for this run's; whether there was one."""
    fs, p = _fs(spark, path)
    return bool(fs.delete(p, True))


def as_text(df: DataFrame, null: str = "") -> DataFrame:
    return df.select(*(F.coalesce(F.col(c).cast("string"), F.lit(null)).alias(c) for c in df.columns))


def write_csv(df: DataFrame, path: str, null: str = "", one_file: bool = False) -> None:
    """Text cells with line feeds, nulls as `null` (N/A in reports). A result without rows leaves a file with its header. one_file: for reports of bounded size."""
    text = as_text(df, null)
    if one_file or text.limit(1).count() == 0:
        text = text.coalesce(1)
    text.write.option("header", True).option("lineSep", "\n").option("emptyValue", "").option("quote", '"').option("escape", '"').csv(path)


def write_checked(df: DataFrame, path: str, null: str = "") -> DataFrame:
    """write_csv(), read again and compared row by row as bags; RuleBroken if they differ."""
    write_csv(df, path, null)
    back = text_table(df.sparkSession, path, lines=True)
    if not same_rows(as_text(df, null), back):
        raise RuleBroken(f"{path} doesn't read back as it was written")
    return back


def write_all(results: dict[str, DataFrame], folder: str, checks: DataFrame | None = None) -> None:
    """Write every result or none: first the checks (rows with n_failed), then each table into a staging folder, read back, and at last one rename. An earlier folder is replaced only then."""
    spark = next(iter(results.values())).sparkSession
    if checks is not None:
        broken = checks.where("n_failed > 0").limit(20).collect()
        if broken:
            raise RuleBroken(f"nothing is written: {[tuple(r) for r in broken]}")
    staging = f"{folder.rstrip('/')}.staging-{new_path(spark).rsplit('-', 1)[-1]}"
    try:
        for name, df in results.items():
            write_checked(df, f"{staging}/{name}.csv")
        remove_stale(spark, folder)
        fs, p = _fs(spark, staging)
        if not fs.rename(p, _fs(spark, folder)[1]):
            raise RuleBroken(f"{folder} couldn't be put in place; the results are in {staging}")
    except Exception:
        remove_stale(spark, staging)
        raise


def to_jsonable(x: object) -> object:
    """Plain JSON values: not-a-number and infinities as null, dates as ISO text, keys as text."""
    if isinstance(x, float):
        return x if math.isfinite(x) else None
    if isinstance(x, date):
        return x.isoformat()
    if hasattr(x, "asDict"):
        return to_jsonable(x.asDict(recursive=True))
    if isinstance(x, dict):
        return {str(k): to_jsonable(v) for k, v in x.items()}
    if isinstance(x, list | tuple):
        return [to_jsonable(v) for v in x]
    return x if x is None or isinstance(x, bool | int | str) else str(x)


def json_evidence(sections: dict[str, DataFrame], most: int = 1000) -> str:
    """Named results of at most `most` rows each as one JSON text; more rows are an error, not a cut."""
    out = {}
    for name, df in sections.items():
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{name} has more than {most} rows")
        out[name] = to_jsonable(rows)
    return json.dumps(out, allow_nan=False, sort_keys=True)


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON text a row, nulls kept; not-a-number and infinities as null."""
    finite = lambda f: F.when(~F.isnan(f.name) & (F.abs(F.col(f.name)) < float("inf")), F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name)
    return df.select(F.to_json(F.struct(*map(finite, df.schema)), {"ignoreNullFields": "false"}).alias("json"))


def markdown(title: str, df: DataFrame, most: int = 200) -> str:
    """A report's table as Markdown; N/A for null."""
    rows = as_text(df, "N/A").limit(most + 1).collect()
    cell = lambda x: x.replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows[:most])]
    return "\n".join([*lines, *([f"", f"More than {most} rows."] if len(rows) > most else [])]) + "\n"


def histogram(df: DataFrame, column: str, bins: int = 100) -> DataFrame:
    """bin (from 0), low, high, n: equal bins between the least and the largest value, which belongs to the last one; empty bins are rows of 0. Also the mean of all, repeated."""
    x = df.select(F.col(column).cast("double").alias("x")).where("x is not null")
    span = x.agg(F.min("x").alias("a"), F.max("x").alias("b"), F.avg("x").alias("mean"))
    place = F.when(F.col("b") > F.col("a"), F.least(F.floor((F.col("x") - F.col("a")) / (F.col("b") - F.col("a")) * bins), F.lit(bins - 1))).otherwise(0)
    counts = x.join(F.broadcast(span.select("a", "b")), F.lit(True)).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = span.where("a is not null").select("a", "b", "mean", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("b") - F.col("a")) / bins
    return every.join(F.broadcast(counts), "bin", "left").select("bin", (F.col("a") + F.col("bin") * width).alias("low"), (F.col("a") + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).alias("n"), "mean")


def box_data(df: DataFrame, group: str, value: str) -> DataFrame:
    """group, n, q1, median, q3, low and high whisker (the outermost values within 1.5 times the middle half's width of it), n_below and n_above them. Quartiles are exact;
    nulls are left out, a null group is a group."""
    rows = df.select(group, F.col(value).cast("double").alias("x")).where("x is not null")
    q = exact_quantiles(rows, "x", [0.25, 0.5, 0.75], (group,)).withColumn("reach", 1.5 * (F.col("q2") - F.col("q0")))
    met = rows.alias("r").join(q.alias("q"), F.col(f"r.{group}").eqNullSafe(F.col(f"q.{group}")))
    x, low, high = F.col("x"), F.col("q0") - F.col("reach"), F.col("q2") + F.col("reach")
    inside = F.when((x >= low) & (x <= high), x)
    return met.groupBy(F.col(f"q.{group}").alias(group), "n", F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3")).agg(F.min(inside).alias("low"), F.max(inside).alias("high"), F.count_if(x < low).alias("n_below"), F.count_if(x > high).alias("n_above"))


def scatter_data(df: DataFrame, group: str, key: str, x: str, y: str, most: int = 200) -> DataFrame:
    """At most `most` rows of each group for a chart of points: those whose keys have the lowest hashes, so any run on any partitioning draws the same ones. Each task
    keeps no more than `most` rows a group before anything is exchanged."""
    rows = df.select(group, key, x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.md5(F.col(key).cast("string").cast("binary")), key))
    return rows.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")
