"""Filing texts by built-in functions: periods, end dates, sections, sentences and executive events. Nothing here runs Python on rows."""

from __future__ import annotations

import calendar
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands for a value that a text doesn't give.
MISSING = "NOT_FOUND"
_NTH = ("first", "second", "third", "fourth")
_MONTHS = tuple(m.lower()[:3] for m in calendar.month_name[1:])

# Periods and days. A mention of a quarter is put together from parts: the quarter, a year, and what marks the year as fiscal. ------------------------------

_QUARTER = f"(?:(?:({'|'.join(_NTH)})[ -]quarter)|Q([1-4])|([1-4])Q)"
_MARK, _YEAR = r"((?:fiscal|fy|year|of|the|[\s'])*)", r"(\d{4}|\d{2})"
_PERIOD = rf"(?i)\b(?:{_QUARTER}{_MARK}{_YEAR}|((?:fiscal|fy)(?:year|[\s'])*){_YEAR}[\s-]+{_QUARTER})\b"
_DAY = r"\p{Lu}\p{Ll}{2,8}\.? \d{1,2}, \d{4}"
_ENDED = rf"(?:[Qq]uarter|[Tt]hree months|(?:[Tt]hirteen|13) weeks)(?:,? which)? end(?:ed|ing|s) (?:on )?({_DAY})"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def day_of(text: Column) -> Column:
    """The date of a text like `Sept. 5, 2024`; null if there is no such day."""
    part = lambda i: F.regexp_extract(text, r"^(\p{L}{3})\p{L}*\.? (\d{1,2}), (\d{4})$", i)
    month = F.array_position(F.array(*map(F.lit, _MONTHS)), F.lower(part(1)))
    return F.when(month > 0, F.try_to_date(F.concat_ws("-", part(3), month.cast("string"), part(2)), "yyyy-M-d"))


def period_of(text: Column) -> Column:
    """(quarter, year, fiscal) of the first quarter that a text names with its year; null if it names none. Two digits are a year of this century."""
    # One match, put into a fixed order of its parts: word, digit, year, mark.
    parts = F.split(F.regexp_replace(F.regexp_extract(text, _PERIOD, 0), _PERIOD, "$1$8|$2$3$9$10|$5$7|$4$6"), "[|]")

    def of(p: Column) -> Column:
        nth, digit, year, mark = (F.get(p, F.lit(i)) for i in range(4))
        quarter = F.when(digit != "", digit.try_cast("int")).otherwise(F.array_position(F.array(*map(F.lit, _NTH)), F.lower(nth)).cast("int"))
        number = year.try_cast("int")
        fiscal = F.lower(mark).rlike("fiscal|fy")
        return F.when(F.size(p) == 4, F.struct(quarter.alias("quarter"), F.when(F.length(year) == 2, number + 2000).otherwise(number).alias("year"), fiscal.alias("fiscal")))

    return once(parts, of)

def periods_in(text: Column) -> Column:
    """All quarters that a text names, in their order."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"({_PERIOD})"), F.lit(1)), period_of)


def end_dates_in(text: Column) -> Column:
    """The days on which quarters end, in their order; what is no day is left out."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(_ENDED), F.lit(1)), day_of), lambda d: d.isNotNull())


# Sections and sentences ---------------------------------------------------------------------------------------------------------------------------------

_CUT = "\u0001"
_DOT = "\u0002"
#: A dot after a single letter, a capitalised word of two or three letters, a month's beginning or a longer short form of a company's name ends no sentence.
_SHORT = r"\b(\p{Lu}|\p{Lu}\p{L}{1,2}|" + "|".join(f"{m.title()}\\p{{Ll}}?" for m in _MONTHS) + r"|Corp|vs)\."


def section_in(text: Column, item: str = "5.02") -> Column:
    """The longest section under the item's heading, without that line and lines of a bare label; null if there is none. Sections end where a line begins with an item or the signatures."""
    parts = F.split(F.regexp_replace(text, r"(?im)^[ \t]*(?=item\s*\d+\.\d\d\b|signatures?\b)", _CUT), _CUT)
    own = F.filter(parts, lambda p: p.rlike(rf"(?i)^item\s*{item.replace('.', '[.]')}\b"))
    longest = F.aggregate(own, F.lit(""), lambda a, p: F.when(F.length(p) > F.length(a), p).otherwise(a))
    body = F.regexp_replace(F.regexp_replace(longest, r"^[^\n]*\n?", ""), r"(?m)^[ \t]*\(?\p{Ll}?\)?[ \t]*\.?[ \t]*(?:\n|$)", "")
    return F.when(F.size(own) > 0, F.regexp_replace(body, r"^\s+|\s+$", ""))


def sentences_in(text: Column) -> Column:
    """The sentences of each line; a note's number behind a full stop is dropped."""
    plain = F.regexp_replace(text, r"(?<=\p{L})\.\d{1,2}(?=\s+\p{Lu})", ".")
    marked = F.regexp_replace(F.regexp_replace(plain, r"(?<=\b\p{Lu})\.(?=\p{Lu}\.)", _DOT), _SHORT, f"$1{_DOT}")
    parts = F.split(marked, r"(?<=[.!?])[ \t]+(?=[\p{Lu}\"(])|\s*\n\s*")
    whole = F.transform(parts, lambda p: F.regexp_replace(F.trim(p), _DOT, "."))
    return F.filter(whole, lambda p: p != "")


# Executive events ---------------------------------------------------------------------------------------------------------------------------------------

_WORD = r"\p{Lu}[\p{L}'-]*\p{Ll}"
#: Two to four name words, of which inner ones may be an initial; no article before a noun.
_FULL = rf"(?!(?:The|This|That|Our|Its|On|In|At|As|Under|Upon|Following)\b){_WORD}(?: (?:\p{{Lu}}\.|{_WORD})){{0,2}} {_WORD}"
_TITLED = rf"(?:Mr|Ms|Mrs|Dr)\. {_WORD}"
_PERSON = rf"({_TITLED}|{_FULL})"
_OFFICE = r"(\p{Lu}[\p{L}-]+(?:(?: of the| of| and|,)? \p{Lu}[\p{L}-]+)*)"
_LEAVING = r"(?:resign|retir|step(?:s|ped|ping)? down|depart|ceas|leav)\w*"
_GIVEN = r"(?:appoint|elect|nam|promot)ed"
_HOLDING = rf"(?:(?:was|were|been|is|be) {_GIVEN}|will serve|will become|became|joins?|succeeds?|assumes?)"


def _title(sentence: Column, after: str) -> Column:
    found = F.regexp_extract(sentence, rf"{after}[^.;]*? (?:as|to) (?:the |its |our |an? )?{_OFFICE}", 1)
    on_board = sentence.rlike(rf"(?i){after}[^.;]* (?:from|on|to) (?:the |its |our )?board\b")
    return F.when(found != "", found).when(on_board, "Director").otherwise(MISSING)


def executive_events(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, event_type, person_name, title, effective_date) of each row's text: who leaves or takes which office, and when (ISO text, or NOT_FOUND).

    The person of a departure is the sentence's subject; of an appointment the one who is named after the verb, or the subject of a passive or a `will serve`. The office is
    the capitalised phrase after `as`; the day is the one said to be effective, or that of a defined term (the "Start Date"). A title with a last name stands for the full
    name with it. Events are merged by person and kind; a departure and an appointment to another office of one person are one event of the kind `both`."""
    whole = F.coalesce(F.col(text), F.lit(""))
    defined = rf"({_DAY}) \((?:the )?[\"“]([\p{{L}} ]*Date)[\"”]\)"
    terms = F.arrays_zip(F.regexp_extract_all(whole, F.lit(defined), F.lit(2)).alias("term"), F.regexp_extract_all(whole, F.lit(defined), F.lit(1)).alias("day"))
    said = df.select(F.col(key).alias("_key"), F.regexp_extract_all(whole, F.lit(f"({_FULL})"), F.lit(1)).alias("names"), terms.alias("terms"), F.posexplode(sentences_in(whole)).alias("place", "s"))
    s = F.col("s")
    subject = F.regexp_extract(s, rf"{_PERSON}(?=,? \p{{Ll}}|, \d)", 1)
    given = F.regexp_extract(s, rf"{_GIVEN} {_PERSON}", 1)
    taken = F.when(given != "", given).when(s.rlike(_HOLDING), subject)
    day = F.regexp_extract(s, rf"(?:effective|beginning|starting)(?: immediately)?(?: as of| on| from)? ({_DAY})", 1)
    term = F.get(F.filter("terms", lambda t: F.contains(s, t["term"])), F.lit(0))["day"]
    when = F.coalesce(F.date_format(day_of(F.when(day != "", day).otherwise(term)), "yyyy-MM-dd"), F.lit(MISSING))
    event = lambda kind, who, title: F.when(F.coalesce(who, F.lit("")) != "", F.struct(F.lit(kind).alias("kind"), who.alias("who"), title.alias("title"), when.alias("day")))
    leaving = event("departure", F.when(s.rlike(_LEAVING), subject), _title(s, _LEAVING))
    taking = event("appointment", taken, _title(s, rf"(?:{_GIVEN}|{_HOLDING})"))
    found = said.select("_key", "names", "place", F.explode(F.array_compact(F.array(leaving, taking))).alias("e")).select("_key", "names", "place", "e.*")
    last = F.regexp_extract("who", rf"^(?:Mr|Ms|Mrs|Dr)\. (.*)$", 1)
    full = F.get(F.filter("names", lambda n: (last != "") & F.endswith(n, F.concat(F.lit(" "), last))), F.lit(0))
    known = lambda c: F.min_by(c, F.when(F.col(c) != MISSING, F.col("place")))
    events = found.withColumn("who", F.when(last == "", F.col("who")).otherwise(F.coalesce(full, "who"))).groupBy("_key", "who", "kind").agg(*(F.coalesce(known(c), F.lit(MISSING)).alias(c) for c in ("title", "day")))
    side = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    person = events.groupBy("_key", "who").agg(*(side(k, c).alias(f"{k}_{c}") for k in ("departure", "appointment") for c in ("title", "day")))
    both = F.col("departure_title") != F.col("appointment_title")
    row = lambda kind, title, d: F.struct(F.lit(kind).alias("event_type"), title.alias("title"), d.alias("effective_date"))
    moved = row("both", F.concat("departure_title", F.lit(" -> "), "appointment_title"), F.when(F.col("departure_day") != MISSING, F.col("departure_day")).otherwise(F.col("appointment_day")))
    one = [F.when(F.col(f"{k}_title").isNotNull(), row(k, F.col(f"{k}_title"), F.col(f"{k}_day"))) for k in ("departure", "appointment")]
    rows = F.when(F.coalesce(both, F.lit(False)), F.array(moved)).otherwise(F.array_compact(F.array(*one)))
    return person.select(F.col("_key").alias(key), F.col("who").alias("person_name"), F.inline(rows)).select(key, "event_type", "person_name", "title", "effective_date")
