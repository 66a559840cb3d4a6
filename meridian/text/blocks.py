"""Texts of releases in blocks: prose, and tables between marks as rows of cells, with the lines before them. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "[TABLE]", "[/TABLE]"
#: Lines before a table that may name it, and their greatest length.
CONTEXT_LINES, CONTEXT_CHARS = 3, 150
_PARTS = "meridian_parts"


def _is_table(part: Column) -> Column:
    return part.rlike(r"^\[TABLE\](\n|$)")


def _lines(part: Column) -> Column:
    return F.filter(F.split(part, "\n"), lambda line: (line != "") & ~line.isin(OPEN, CLOSE))


def _context(before: Column) -> Column:
    lines = _lines(before)
    last = F.slice(lines, F.greatest(F.size(lines) - (CONTEXT_LINES - 1), F.lit(1)), CONTEXT_LINES)
    return F.when(before.isNotNull() & ~_is_table(before), F.filter(last, lambda x: F.length(x) <= CONTEXT_CHARS)).otherwise(F.array().cast("array<string>"))


def blocks(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the columns prose (string) and tables (array of rows and context).

    A line `[TABLE]` opens a table, the next mark ends it. Its rows are its lines with something in them, cells parted by ` | `; its context is what is short of the last lines of the prose
    right before it. Tables without rows are left out. Null for null; an empty text has empty prose and no tables. Columns prose and tables of df are replaced."""
    parts = F.col(_PARTS)
    rows = lambda p: F.transform(_lines(p), lambda line: F.transform(F.split(line, r" \| "), lambda c: F.trim(c)))
    found = F.transform(parts, lambda p, i: F.when(_is_table(p), F.struct(rows(p).alias("rows"), _context(F.get(parts, i - 1)).alias("context"))))
    prose = F.array_join(F.transform(F.filter(parts, lambda p: ~_is_table(p)), lambda p: F.regexp_replace(p, r"^\[/TABLE\](?:\n|$)", "")), "")
    split = df.withColumn(_PARTS, F.split(text, r"(?md)^(?=\[/?TABLE\]$)"))
    return split.withColumns({"prose": prose, "tables": F.filter(found, lambda t: t.isNotNull() & (F.size(t["rows"]) > 0))}).drop(_PARTS)
