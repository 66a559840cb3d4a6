"""Figures of releases: the period, the one column of its quarter in a results table, the labelled rows, and the narrative as a fallback.

Everything is built-in functions: headings become arrays of what they say, tables are exploded to rows that are searched in parallel, and one aggregate a release picks
the figure that comes first by table, label and row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells, filings
from .blocks import blocks

#: Characters that are searched for the period, those of the headline, and days from a quarter's end to its filing.
LEAD, HEADLINE, LAG = 3000, 400, 120
#: Labels by measure in the order that wins.
LABELS = {
    "revenue": (r"total (?:net )?revenues?", r"net revenues?", r"revenues?", r"total net sales", r"net sales"),
    "net_income": (r"net income", r"consolidated net income"),
    "eps": (r"diluted (?:earnings|net income) per (?:common )?share", r"(?:earnings|net income) per share,? diluted", r"diluted(?: eps)?"),
}
_SPANS = "six months|nine months|twelve months|full year|year to date"
OTHER_BASIS = f"adjusted|non gaap|excluding|managed|pro forma|annual|{_SPANS}"
LONGER = rf"{_SPANS}|years? ended|(?:^|\s)ytd(?:\s|$)"
OUTLOOK = r"(?i)guidance|outlook|expects?\b|expected|forecast|anticipat"
CHANGE = r"(?i)change|%|\bvs\b|variance|increase|decrease|growth"
QUARTERLY = r"(?i)three months|thirteen weeks|13 weeks|\bquarter"
SAID = {
    "revenue": r"(?i)\brevenues? (?:of|was|were|totaled) \$([\d,.]+) (million|billion)",
    "net_income": r"(?i)\bnet income (?:of|was) \$([\d,.]+) (million|billion)",
    "eps": r"(?i)\$([\d.]+) per diluted share",
}
_SEVERAL, _NO_PERIOD = "the headline names several quarters", "no period or quarter end in the lead"


def _plain(text: Column) -> Column:
    return F.translate(F.lower(text), "-", " ")


def _first(xs: Column) -> Column:
    return F.get(xs, F.lit(0))


def _marked(lead: Column) -> Column:
    """The lead in parts, each but the first one beginning with a mention of a quarter."""
    return F.split(F.regexp_replace(lead, filings._PERIOD, "\u0001$0"), "\u0001")


def with_period(df: DataFrame, prose: str, filed: str) -> DataFrame:
    """df with quarter, year, quarter_end and reason: the first period of the lead, if the headline names no other; else the first quarter's end that a filing of that day can report."""
    lead = F.substring(F.trim(F.regexp_replace(F.col(prose), r"\s+", " ")), 1, LEAD)
    df = df.withColumn("_lead", lead)
    df = df.withColumns({"_parts": _marked(F.col("_lead")), "_ends": F.filter(filings.end_dates_in(F.col("_lead")), lambda d: F.datediff(F.col(filed), d).between(0, LAG))})
    # Lengths of the parts so far are the places of the mentions.
    ahead = F.aggregate("_parts", F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")), lambda a, p: F.struct((a["at"] + F.length(p)).alias("at"), F.array_append(a["starts"], a["at"]).alias("starts")))
    df = df.withColumn("_starts", ahead["starts"])
    mentions = F.transform("_parts", lambda p, i: F.when(i > 0, F.struct(F.get("_starts", i).alias("at"), filings.period_of(p).alias("p"))))
    df = df.withColumn("_periods", F.array_compact(mentions))
    in_head = F.array_distinct(F.transform(F.filter("_periods", lambda m: m["at"] < HEADLINE), lambda m: F.struct(m["p"]["quarter"], m["p"]["year"])))
    several, first = F.size(in_head) > 1, _first(F.col("_periods"))["p"]
    return df.withColumns(
        {
            "quarter": F.when(~several, first["quarter"]),
            "year": F.when(~several, first["year"]),
            "quarter_end": F.when(~several, _first(F.col("_ends"))),
            "reason": F.when(several, _SEVERAL).when((F.size("_periods") == 0) & (F.size("_ends") == 0), _NO_PERIOD),
        }
    ).drop("_lead", "_parts", "_ends", "_starts", "_periods")


def describe(cell: Column) -> Column:
    """What a heading says of its column: quarter, year, end, month and day, a longer span, a quarter's span, a change, or nothing."""
    day = r"\b(\p{Lu}\p{Ll}{2,8})\.? (\d{1,2})(?:, ((?:19|20)\d\d))?"
    worded = F.split(F.regexp_replace(F.regexp_extract(cell, day, 0), day, "$1 $2|$3"), "[|]")
    plain = _plain(cell)
    parts = F.struct(
        filings.period_of(cell).alias("period"), _first(filings.end_dates_in(cell)).alias("end"), worded.alias("worded"),
        F.when(cell.rlike(r"^\s*(?:19|20)\d\d\s*$"), F.trim(cell).try_cast("int")).alias("own"),
        plain.rlike(LONGER).alias("longer"), cell.rlike(CHANGE).alias("change"), cell.rlike(QUARTERLY).alias("quarterly"),
    )

    def said(p: Column) -> Column:
        month, year = F.get(p["worded"], F.lit(0)), F.get(p["worded"], F.lit(1))
        end = F.coalesce(p["end"], F.when(year != "", filings.day_of(F.concat(month, F.lit(", "), year))))
        silent = p["period"].isNull() & p["own"].isNull() & p["end"].isNull() & (month == "") & ~p["longer"] & ~p["change"] & ~p["quarterly"]
        return F.struct(
            p["period"]["quarter"].alias("quarter"), F.coalesce(p["own"], p["period"]["year"]).alias("year"), end.alias("end"), F.when((month != "") & (year == ""), month).alias("day"),
            p["longer"].alias("longer"), p["change"].alias("change"), silent.alias("silent"),
        )

    return filings.once(parts, said)


def _is_data(row: Column) -> Column:
    """A label, and a cell behind it that is an amount and no year."""
    amount = lambda c: F.regexp_replace(c, " ", "").rlike(r"^[($-]*\d[\d,]*(?:\.\d+)?[)%]*$") & ~c.rlike(r"^(?:19|20)\d\d$")
    return (F.size(row) > 1) & F.get(row, F.lit(0)).rlike("[A-Za-z]") & F.exists(_tail(row), amount)


def _tail(row: Column) -> Column:
    return F.slice(row, F.lit(2), F.greatest(F.size(row) - 1, F.lit(0)))


def with_column(df: DataFrame) -> DataFrame:
    """df (a row a table: rows, context, quarter, year, quarter_end) with header, body and `at`: the place (from 0, the label aside) of the one column that is the period's quarter; null if no column or several are.

    A cell of a higher row stands for its share of the columns below. Of several rows that speak of a column the lowest of full width counts first, then the others from the top."""
    n = F.array_position(F.transform("rows", _is_data), True)
    df = df.withColumn("_n", F.when(n == 0, F.size("rows")).otherwise(n - 1).cast("int"))
    df = df.withColumns({"header": F.slice("rows", F.lit(1), F.col("_n")), "body": F.slice("rows", F.col("_n") + 1, F.size("rows"))})
    df = df.withColumn("_said", F.transform("header", lambda r: F.struct(F.transform(r, describe).alias("d"), F.get(r, F.lit(0)).rlike("[A-Za-z]").alias("named"))))
    label = lambda r: F.when(r["named"] & (F.size(r["d"]) > 1) & _first(r["d"])["silent"], 1).otherwise(0)
    df = df.withColumn("_width", F.coalesce(F.array_max(F.transform("_said", lambda r: F.size(r["d"]) - label(r))), F.lit(0)))
    width = F.col("_width")
    fits = lambda k: (k > 0) & (k <= width) & (F.try_mod(width, k) == 0)
    cut = F.transform("_said", lambda r: F.when(_first(r["d"])["silent"] & fits(F.size(r["d"]) - 1), F.slice(r["d"], F.lit(2), F.greatest(F.size(r["d"]) - 1, F.lit(0)))).otherwise(r["d"]))
    df = df.withColumn("_cut", F.filter(cut, lambda d: fits(F.size(d))))
    df = df.withColumn("_levels", F.concat(F.reverse(F.filter("_cut", lambda d: F.size(d) == width)), F.filter("_cut", lambda d: F.size(d) < width)))
    places = F.when(width > 0, F.sequence(F.lit(0), width - 1)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_columns", F.transform(places, lambda i: F.transform("_levels", lambda d: F.get(d, F.floor(i * F.size(d) / width).cast("int")))))
    one = lambda c, f: _first(F.filter(F.transform(c, lambda d: d[f]), lambda x: x.isNotNull()))
    some = lambda c, f: F.exists(c, lambda d: d[f])
    said = lambda c: F.struct(one(c, "quarter").alias("quarter"), one(c, "year").alias("year"), one(c, "end").alias("end"), one(c, "day").alias("day"), (some(c, "longer") | some(c, "change")).alias("other"))
    df = df.withColumn("_columns", F.transform("_columns", said))
    end = lambda c: F.coalesce(c["end"], filings.day_of(F.concat(c["day"], F.lit(", "), c["year"].cast("string"))))
    own = lambda c: ~c["other"] & (F.coalesce((c["quarter"] == F.col("quarter")) & (c["year"] == F.col("year")), F.lit(False)) | F.coalesce(end(c) == F.col("quarter_end"), F.lit(False)))
    df = df.withColumn("_own", F.transform("_columns", own))
    at = F.when(F.size(F.filter("_own", lambda x: x)) == 1, F.array_position("_own", True) - 1).cast("int")
    return df.withColumn("at", at).drop("_n", "_said", "_width", "_cut", "_levels", "_columns", "_own")


def _figure(text: Column, measure: str) -> Column:
    """The number that a sentence gives for a measure, in millions (earnings: a share)."""
    number = F.regexp_replace(F.regexp_replace(F.regexp_extract(text, SAID[measure], 1), r"\.+$", ""), ",", "").try_cast("double")
    return number if measure == "eps" else number * F.when(F.lower(F.regexp_extract(text, SAID[measure], 2)) == "billion", 1000.0).otherwise(1.0)


def releases(df: DataFrame, key: str, text: str, filed: str) -> DataFrame:
    """A row a release: key, quarter, year, quarter_end, revenue and net_income (millions), eps, and the reason why there are none.

    A table counts if exactly one of its columns is the period's quarter and its heading neither looks ahead nor adjusts; amounts need a stated unit. Sentences that look
    ahead or are of another basis say nothing. A revenue that the highlights contradict beyond their rounding is a reason, too. A null text or day gives nulls; repeated rows
    are one. A release's tables are rows of one task at most as long as its text; nothing is collected."""
    d = blocks(df.select(F.col(key).alias("_key"), F.col(filed).cast("date").alias("_filed"), F.when(F.col(filed).isNotNull(), F.col(text)).alias("_text")), "_text")
    d = with_period(d, "prose", "_filed")
    d = d.withColumn("_s", F.filter(F.split("prose", r"\s*\n\s*|(?<=[a-z0-9)][.!?])\s+(?=[A-Z])"), lambda s: (s != "") & ~s.rlike(OUTLOOK)))
    plain = F.filter("_s", lambda s: ~_plain(s).rlike(OTHER_BASIS))
    first = lambda sentences, m: _first(F.filter(sentences, lambda s: s.rlike(SAID[m])))
    d = d.withColumns({f"said_{m}": F.round(_figure(first(plain, m), m), 6) for m in LABELS} | {"shown": first(F.col("_s"), "revenue")})
    whole = ["_key", "quarter", "year", "quarter_end", "reason", *(f"said_{m}" for m in LABELS), "shown"]
    t = with_column(d.select(*whole, F.posexplode_outer("tables").alias("table", "t")).select(*whole, "table", "t.rows", "t.context"))
    flat = F.array_join(F.flatten("header"), " ")
    context = lambda i: F.get("context", F.size("context") - i)
    heading = F.concat_ws(" ", context(1), flat)
    lines = F.array_compact(F.array(flat, context(1), context(2), context(3)))
    t = t.withColumn("_scale", F.when(F.col("at").isNotNull(), _first(F.filter(F.transform(lines, cells.scale_to_millions), lambda x: x.isNotNull()))))
    use = F.col("at").isNotNull() & F.col("reason").isNull() & ~heading.rlike(OUTLOOK) & ~F.lower(heading).rlike("non-gaap|adjusted|pro forma")
    name = lambda r: F.regexp_replace(F.regexp_replace(F.lower(F.get(r, F.lit(0))), r"\((?:\d{1,2}|[a-z])\)|[*†‡]", ""), "^[ :]+|[ :]+$", "")
    named = F.transform("body", lambda r, i: F.struct(i.alias("row"), name(r).alias("name"), cells.accounting_number(F.get(r, F.col("at") + 1)).alias("value")))
    t = t.withColumn("_named", F.when(use, F.filter(named, lambda r: r["value"].isNotNull() & ~_plain(r["name"]).rlike(OTHER_BASIS))))

    def best(m: str) -> Column:
        rank = lambda n: F.coalesce(*(F.when(n.rlike(f"^(?:{p})$"), F.lit(i)) for i, p in enumerate(LABELS[m])))
        scale = F.lit(1.0) if m == "eps" else F.col("_scale")
        hits = F.filter(F.transform("_named", lambda r: F.struct(rank(r["name"]).alias("label"), r["row"].alias("row"), F.round(r["value"] * scale, 6).alias("value"))), lambda h: h["label"].isNotNull() & h["value"].isNotNull())
        return F.array_min(hits)["value"]

    t = t.select(*whole, "table", *(best(m).alias(m) for m in LABELS))
    got = t.groupBy(*whole).agg(*(F.min_by(m, F.when(F.col(m).isNotNull(), F.col("table"))).alias(m) for m in LABELS))
    # Highlights round: they agree if they are off by half of their last digit at most.
    digits = F.regexp_replace(F.regexp_extract("shown", SAID["revenue"], 1), r"\.+$", "")
    step = F.pow(F.lit(10.0), -F.length(F.regexp_extract(digits, r"\.(\d*)$", 1))) * F.when(F.lower(F.regexp_extract("shown", SAID["revenue"], 2)) == "billion", 1000.0).otherwise(1.0)
    contradicted = F.abs(_figure(F.col("shown"), "revenue") - F.col("revenue")) > step / 2 + 1e-9
    final = {m: F.when(F.col("reason").isNull(), F.coalesce(m, f"said_{m}")).alias(m) for m in LABELS}
    nothing = F.coalesce(*final.values()).isNull()
    known = F.col("quarter").isNotNull() | F.col("quarter_end").isNotNull()
    reason = F.coalesce("reason", F.when(contradicted, "highlights name another revenue").when(nothing & known, "no figures of the quarter"))
    return got.select(F.col("_key").alias(key), "quarter", "year", "quarter_end", *final.values(), reason.alias("reason"))
