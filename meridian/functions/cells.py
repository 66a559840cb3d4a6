"""Column factories for text cells and DAX-like arithmetic: built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INT = r"^[+-]?[0-9]+$"
FLOAT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
#: Texts that stand for a missing value.
NULL_TOKENS = ("na", "n/a", "null", "none", "nan", "-", "?", "missing", "nil")


def is_blank(c: Column) -> Column:
    """Null, empty or white space only; the word None isn't blank."""
    return F.coalesce(c, F.lit("")).rlike(r"^\s*$")


def strict_date(c: Column) -> Column:
    return F.when(c.rlike(DATE), F.try_to_date(c, "yyyy-MM-dd"))


def worded_date(c: Column) -> Column:
    """September 1, 2026 or 9/1/2026 as a date; null for days that don't exist."""
    x = F.trim(c)
    return F.coalesce(F.when(x.rlike(r"^[A-Za-z]+ [0-9]{1,2}, [0-9]{4}$"), F.try_to_date(x, "MMMM d, yyyy")), F.when(x.rlike(r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"), F.try_to_date(x, "M/d/yyyy")))


def number(c: Column) -> Column:
    """The finite number of a text, else null."""
    x = F.when(c.rlike(FLOAT), c.try_cast("double"))
    return F.when(F.abs(x) < float("inf"), x)


def parses_as(c: Column, kind: str) -> Column:
    """Whether a text is of a kind; false for blanks."""
    test = {"int": c.rlike(INT), "float": c.rlike(FLOAT), "date": strict_date(c).isNotNull(), "bool": c.isin("True", "False"), "str": F.lit(True)}[kind]
    return ~is_blank(c) & F.coalesce(test, F.lit(False))


def value_shape(c: Column) -> Column:
    """Runs of letters as A, runs of digits as 9; <blank> for blanks."""
    return F.when(is_blank(c), "<blank>").otherwise(F.regexp_replace(F.regexp_replace(c, "[A-Za-z]+", "A"), "[0-9]+", "9"))


def normalize_key(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"\.0+$", "")


def out_of_bounds(c: Column, low: float | None, high: float | None) -> Column:
    """Outside an open-ended range; false for nulls."""
    parts = [c < low] * (low is not None) + [c > high] * (high is not None)
    test = parts[0]
    for p in parts[1:]:
        test = test | p
    return F.coalesce(test, F.lit(False))


def truncation_class(a: Column, b: Column) -> Column:
    """How two texts differ: identical, case/whitespace, truncated/extended (the shorter one is filled and begins the longer, whatever the case), other."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    begins = lambda s, t: (F.length(s) > 0) & (F.length(s) < F.length(t)) & t.startswith(s)
    return F.when(a == b, "identical").when(x == y, "case/whitespace").when(begins(x, y) | begins(y, x), "truncated/extended").otherwise("other")


def money(c: Column, scale: int = 2) -> Column:
    return c.cast(f"decimal(38,{scale})")


def divide(a: Column, b: Column) -> Column:
    """Null where the divisor is zero or either side is null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def blank_sub(a: Column, b: Column) -> Column:
    """Null only if both sides are."""
    return F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0)))


def signal(c: Column, band: float = 0.02) -> Column:
    return F.when(c.isNull(), None).when(c >= band, "Outperforming").when(c <= -band, "Lagging").otherwise("In line")


def timing(days: Column) -> Column:
    """Class of a signed number of days from a dated record to an event."""
    return F.when(days.isNull(), None).when(F.abs(days) <= 7, "same week").when(days < 0, "before earnings").otherwise("after earnings")


def corrected_skewness(c: Column) -> Column:
    n = F.count(c)
    return F.when(n > 2, F.skewness(c) * F.sqrt((n * (n - 1)).cast("double")) / (n - 2))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's coefficient over rows with both values; null where one of them is constant."""
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return F.try_divide(F.covar_pop(x, y), spread)


def accounting_number(c: Column) -> Column:
    """(1,234) and -1,234 are negative, a lone dash is zero; percentages, placeholders and what has no single number are null."""
    x = F.regexp_replace(c, " ", "")
    digits = F.regexp_replace(x, r"[^0-9.]", "")
    value = F.when(digits.rlike(r"^([0-9]+\.?[0-9]*|\.[0-9]+)$"), digits.try_cast("double"))
    negative = x.contains("(") | x.rlike(r"^\$*-")
    none = x.contains("%") | F.lower(x).isin("n/a", "na", "nm", "n.m.")
    return F.when(x.isin("-", "--"), 0.0).when(none, None).when(negative, -value).otherwise(value)


#: Phrases that state a table's unit, and what turns it into millions.
UNITS = ((r"in millions|\$\s*mm\b|\$\s*millions|millions of (u\.s\. )?dollars", 1.0), (r"in thousands|\$\s*000s?\b|thousands of (u\.s\. )?dollars", 0.001), (r"in billions|\$\s*billions|billions of (u\.s\. )?dollars", 1000.0))


def scale_to_millions(c: Column) -> Column:
    """The factor of the first unit phrase of a text; null if there is none."""
    low = F.lower(c)
    places = F.array(*(F.when(low.rlike(p), F.length(F.regexp_extract(low, f"(?s)^(.*?)(?:{p})", 1))) for p, _ in UNITS))
    # The place in the list of the least place in the text; of equal ones the first.
    which = F.get(F.transform(F.array(places), lambda a: F.array_position(a, F.array_min(a))), F.lit(0))
    return F.get(F.array(*(F.lit(factor) for _, factor in UNITS)), which.cast("int") - 1)


