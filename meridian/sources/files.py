"""Reading text files with a contract: what is stored is what is read, and what breaks the contract stops the read or is listed."""

from __future__ import annotations

import csv
import time
import urllib.request
import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.cells import FLOAT, is_blank, strict_date


class InputError(ValueError):
    """Input that can't support a trustworthy result."""


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def csv_reader(spark: SparkSession, lines: bool = False):  # noqa: ANN201
    """A reader for which an empty cell is an empty text and nothing else is null. lines: cells may hold line feeds; such files can't be split, so it is only for those that need it."""
    return spark.read.option("header", True).option("nullValue", "\u0000").option("emptyValue", "").option("quote", '"').option("escape", '"').option("multiLine", lines).option("mode", "FAILFAST")


def header_of(spark: SparkSession, path: str) -> list[str]:
    """The column names of the file or the folder of files, without a byte order mark and spaces; none of an empty file."""
    first = spark.read.text(path).limit(1).collect()
    if not first:
        return []
    return [c.strip() for c in next(csv.reader([first[0][0].removeprefix("\ufeff")]))]


def text_table(spark: SparkSession, path: str, columns: list[str] | None = None, lines: bool = False) -> DataFrame:
    """Every cell as the text that is stored: no types and no nulls are inferred. `columns` keeps only these, which alone are parsed. Large files are split between
    tasks unless `lines` says that cells may hold line feeds."""
    if not _exists(spark, path):
        raise InputError(f"missing file: {path}")
    names = header_of(spark, path)
    df = csv_reader(spark, lines).schema(StructType([StructField(c, StringType()) for c in names])).csv(path)
    return df.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in (columns or names)))


def text_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """The tables of a folder, one file `name.csv` each; all missing ones are named at once."""
    missing = [n for n in names if not _exists(spark, f"{folder}/{n}.csv")]
    if missing:
        raise InputError(f"missing in {folder}: {missing}")
    return {n: text_table(spark, f"{folder}/{n}.csv") for n in names}


def typed_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Cells as the declared types (a DDL string); a code declared as string keeps its zeros. Blanks are null, other cells of a wrong kind too."""
    want = spark.createDataFrame([], schema).schema
    t = text_table(spark, path, [f.name for f in want])
    return t.select(*(F.when(~is_blank(F.col(f.name)), F.col(f.name).try_cast(f.dataType)).alias(f.name) for f in want))


def contracted_table(spark: SparkSession, path: str, required: list[str], dates: list[str] = ()) -> DataFrame:  # type: ignore[assignment]
    """A table that has the required columns and whose dates are all strict ISO dates; else InputError."""
    lacking = sorted(set(required) - set(header_of(spark, path)))
    if lacking:
        raise InputError(f"{path} lacks {lacking}")
    t = text_table(spark, path)
    if dates:
        bad = t.agg(*(F.count_if(~is_blank(F.col(c)) & strict_date(F.col(c)).isNull()).alias(c) for c in dates)).first().asDict()
        if any(bad.values()):
            raise InputError(f"{path} has dates that aren't YYYY-MM-DD: { {c: n for c, n in bad.items() if n} }")
    return t.withColumns({c: strict_date(F.col(c)) for c in dates})


def clean_rows(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """Trimmed text cells without blank lines and byte order mark. An empty file has no rows; a missing column is fatal."""
    names = header_of(spark, path)
    if not names:
        return spark.createDataFrame([], StructType([StructField(c, StringType()) for c in required]))
    lacking = sorted(set(required) - set(names))
    if lacking:
        raise InputError(f"{path} lacks {lacking}")
    t = text_table(spark, path)
    t = t.select(*(F.trim(F.col(c)).alias(c) for c in t.columns))
    return t.where(~F.concat(*t.columns).eqNullSafe("")).select(*required)


#: Kinds of exported measures whose values must be numbers.
NUMERIC = ("currency", "ratio", "bps", "count")


def exported_values(spark: SparkSession, path: str, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(values, problems) of a file of exactly measure, slice, value. cells: the expected (measure, slice, kind).

    Blank is null; a number is plain decimal text, a count a whole one. Problems: missing, unexpected and repeated cells, values of a wrong syntax."""
    names = header_of(spark, path)
    if sorted(names) != ["measure", "slice", "value"]:
        raise InputError(f"{path} must have exactly the columns measure, slice, value; found {names}")
    t = clean_rows(spark, path, ["measure", "slice", "value"]).groupBy("measure", "slice").agg(F.count("*").alias("n"), F.min("value").alias("value"))
    both = t.join(cells, ["measure", "slice"], "full_outer")
    number = F.when(F.col("value").rlike(FLOAT), F.col("value").try_cast("double"))
    wrong = F.col("kind").isin(*NUMERIC) & (F.col("value") != "") & (number.isNull() | (F.abs(number) == float("inf")) | ((F.col("kind") == "count") & (number != F.floor(number))))
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("kind").isNull(), "unexpected").when(F.col("n") > 1, "repeated").when(F.coalesce(wrong, F.lit(False)), "not a number")
    judged = both.withColumn("problem", problem)
    word = F.when((F.col("kind") == "text") & (F.col("value") != ""), F.col("value"))
    values = judged.where(F.col("problem").isNull()).select("measure", "slice", "kind", F.when(F.col("kind") != "text", number).alias("x"), word.alias("word"))
    return values, judged.where(F.col("problem").isNotNull()).select("measure", "slice", "problem")


# Filings ------------------------------------------------------------------------------------------------------------


class Fetcher:
    """Text of addresses: names its user, waits between requests, gives up after a while, and turns failures into warnings."""

    def __init__(self, agent: str, timeout: float = 30, delay: float = 0.25, opener: Callable = urllib.request.urlopen) -> None:
        self.agent, self.timeout, self.delay, self.opener = agent, timeout, delay, opener

    def get(self, url: str) -> str | None:
        time.sleep(self.delay)
        try:
            with self.opener(urllib.request.Request(url, headers={"User-Agent": self.agent}), timeout=self.timeout) as r:
                return r.read().decode("utf-8", "replace")
        except OSError as e:
            warnings.warn(f"no answer from {url}: {e}", stacklevel=2)
            return None


def parallel_rows(df: DataFrame, column: str, fields: dict[str, str], keep: tuple[str, ...] = ()) -> DataFrame:
    """JSON objects of parallel arrays as rows: the n-th row holds the n-th entry of every array, null where an array is shorter."""
    schema = ", ".join(f"{n} array<{t}>" for n, t in fields.items())
    parsed = df.select(*keep, F.from_json(column, schema).alias("j"))
    return parsed.select(*keep, F.posexplode(F.arrays_zip(*(F.col(f"j.{n}").alias(n) for n in fields))).alias("position", "row")).select(*keep, "position", "row.*")


def wanted_filings(filings: DataFrame, form: str, item: str, start: str, end: str) -> DataFrame:
    """Filings of a form that list an item, inside the window, once each, the newest first. Columns: accession, form, items (parted by commas), filed (ISO text)."""
    listed = F.array_contains(F.transform(F.split("items", ","), lambda x: F.trim(x)), item)
    kept = filings.where((F.col("form") == form) & listed & F.col("filed").between(start, end))
    rest = [c for c in filings.columns if c != "accession"]
    newest = kept.groupBy("accession").agg(F.max(F.struct("filed", *(c for c in rest if c != "filed"))).alias("x"))
    return newest.select("accession", *(F.col(f"x.{c}").alias(c) for c in rest)).select(*filings.columns).orderBy(F.desc("filed"), "accession")


def pages_needed(recent: DataFrame, pages: DataFrame, start: str) -> DataFrame:
    """Older pages (name, filing_to) that may hold filings from `start` on; none if the recent list reaches back that far."""
    oldest = recent.agg(F.min("filed").alias("oldest"))
    return pages.join(F.broadcast(oldest), F.col("oldest").isNull() | (F.col("oldest") > start)).where(F.col("filing_to") >= start).drop("oldest")


def best_exhibit(rows: DataFrame, keys: list[str], score: Column) -> DataFrame:
    """Of each filing the url of the highest positive score; ties go to the first position. Columns: url, position."""
    scored = rows.withColumn("score", score).where("score > 0")
    return scored.groupBy(*keys).agg(F.max_by(F.struct("url", "score"), F.struct(F.col("score"), -F.col("position"))).alias("best")).select(*keys, "best.url", "best.score")


def exact_quarter(statement: DataFrame, ends: DataFrame, keys: list[str]) -> DataFrame:
    """The statement's value at exactly the asked quarter end, null if that quarter isn't there; no other one stands in. Columns: quarter_end, value."""
    return ends.join(statement.select(*keys, "quarter_end", "value"), [*keys, "quarter_end"], "left")


def calendar_table(spark: SparkSession, first: DataFrame) -> DataFrame:
    """Every day of the years from the first to the last date of `first` (columns low, high)."""
    whole = first.select(F.make_date(F.year("low"), F.lit(1), F.lit(1)).alias("a"), F.make_date(F.year("high"), F.lit(12), F.lit(31)).alias("b"))
    return whole.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("day"))


def model_columns(tables: dict[str, DataFrame], keys: dict[str, str]) -> list[tuple[str, int, str, str, bool]]:
    """The model's metadata: (table, position, column, type, whether it is the key)."""
    return [(t, i, f.name, f.dataType.simpleString(), keys.get(t) == f.name) for t, df in tables.items() for i, f in enumerate(df.schema)]


def write_text_csv(df: DataFrame, path: str) -> None:
    """All cells as text with line feeds; nulls as empty cells."""
    df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns)).write.option("header", True).option("lineSep", "\n").option("emptyValue", "").option("quote", '"').option("escape", '"').csv(path)
