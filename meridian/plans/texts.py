"""Filing texts. Where a text can be composed from the tables' own rows, what is read from it must be those rows again; SQL knows them without the text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cells, filings
from ..text.blocks import blocks
from ..text.pages import page_lines
from ..text.releases import releases
from .registry import query, read

_ORDER = "o_orderkey, CAST(quarter(o_orderdate) AS INTEGER) AS quarter, CAST(year(o_orderdate) AS INTEGER) AS year"


def _orders(spark, sf_dir) -> DataFrame:
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    day = F.to_date("o_orderdate")
    return o.select("o_orderkey", "o_custkey", "o_totalprice", F.quarter(day).alias("q"), F.year(day).alias("y"), F.last_day(F.add_months(F.trunc(day, "quarter"), 2)).alias("end"), day.alias("day"))


def _nth(q: str = "q"):  # noqa: ANN202
    return F.element_at(F.array(*map(F.lit, ("first", "second", "third", "fourth"))), F.col(q))


@query()
def txt01_page_text(spark, sf_dir) -> DataFrame:
    """TXT-01, TXT-02, TXT-04: pages as lines with tables, flat, and in blocks."""
    p = blocks(page_lines(read(spark, sf_dir, "pages"), "page_id", "html"))
    return p.select("page_id", "text", F.length("flat").alias("n_flat"), F.length("prose").alias("n_prose"), F.size("tables").alias("n_tables"))


@query("SELECT r_name, n_name, CAST(n_nationkey AS VARCHAR) AS n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey")
def txt04_tables(spark, sf_dir) -> DataFrame:
    """TXT-01, TXT-03, TXT-04, WN-12: a page of tables, one a region under its name, read back to rows; signs in cells of their own join their values."""
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    row = F.concat(F.lit("<tr><td>"), "n_name", F.lit("</td><td></td><td>$</td><td>("), F.col("n_nationkey").cast("string"), F.lit("</td><td>)</td></tr>"))
    tables = n.groupBy("r_name").agg(F.concat_ws("\n", F.array_sort(F.collect_list(row))).alias("rows"))
    table = F.concat(F.lit("<h2>"), "r_name", F.lit("</h2><script>x='<table>'</script><table><tr><td>Nation</td><td>Key</td></tr>"), "rows", F.lit("</table>"))
    page = tables.agg(F.concat(F.lit("<html><head><title>t</title></head><body><p>Start<br>here</p>"), F.concat_ws("", F.collect_list(table)), F.lit("</body></html>")).alias("html"))
    lines = blocks(page_lines(page.withColumn("page_id", F.lit(1)), "page_id", "html"))
    found = lines.select(F.explode("tables").alias("t")).select(F.element_at("t.context", -1).alias("r_name"), F.explode(F.slice("t.rows", 2, 100000)).alias("r"))
    return found.select("r_name", F.col("r")[0].alias("n_name"), F.regexp_extract(F.col("r")[1], r"^\$\((\d+)\)$", 1).alias("n_nationkey"))


@query(f"SELECT {_ORDER}, o_orderkey % 6 < 4 AS fiscal FROM orders")
def txt05_periods(spark, sf_dir) -> DataFrame:
    """TXT-05: the quarter and year of six ways to write them."""
    o, i = _orders(spark, sf_dir), F.col("o_orderkey") % 6
    y, short, n = F.col("y").cast("string"), F.substring(F.col("y").cast("string"), 3, 2), F.col("q").cast("string")
    said = F.when(i == 0, F.concat(_nth(), F.lit(" quarter of fiscal year "), y)).when(i == 1, F.concat(F.lit("fiscal "), y, F.lit(" "), _nth(), F.lit("-quarter"))).when(i == 2, F.concat(F.lit("Q"), n, F.lit(" FY"), y)).when(i == 3, F.concat(F.lit("FY"), y, F.lit(" Q"), n)).when(i == 4, F.concat(_nth(), F.lit("-quarter "), y)).otherwise(F.concat(n, F.lit("Q"), short))
    p = filings.period_of(F.concat(F.lit("Acme today reported results for its "), said, F.lit(". More follows.")))
    found = o.select("o_orderkey", "y", p.alias("p"))
    # Two digits name a year of this century; the last grammar has no other.
    year = F.when((F.col("o_orderkey") % 6 == 5) & (F.col("y") < 2000), F.col("p.year") - 100).otherwise(F.col("p.year"))
    return found.select("o_orderkey", F.col("p.quarter").alias("quarter"), year.cast("int").alias("year"), F.col("p.fiscal").alias("fiscal"))


@query("SELECT o_orderkey, last_day(CAST(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH AS DATE)) AS quarter_end FROM orders", dates=("quarter_end",))
def txt06_end_dates(spark, sf_dir) -> DataFrame:
    """TXT-06: the end of the quarter of four ways to write it."""
    o, i = _orders(spark, sf_dir), F.col("o_orderkey") % 4
    span = F.when(i == 0, "quarter ended").when(i == 1, "three months ending on").when(i == 2, "thirteen weeks ended").otherwise("13 weeks ended")
    return o.select("o_orderkey", F.get(filings.end_dates_in(F.concat(F.lit("For the "), span, F.lit(" "), F.date_format("end", "MMMM d, yyyy"), F.lit(" we saw."))), F.lit(0)).alias("quarter_end"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN -1 WHEN 2 THEN -1 ELSE 0 END * round(o_totalprice, 2) AS amount FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 5 = 0")
def txt11_amounts(spark, sf_dir) -> DataFrame:
    """TXT-11: amounts as accountants write them."""
    o, i = read(spark, sf_dir, "orders", "o_orderkey", "o_totalprice"), F.col("o_orderkey")
    shown = F.format_number("o_totalprice", 2)
    text = F.when(i % 5 == 0, F.concat(shown, F.lit(" %"))).when(i % 4 == 0, F.concat(F.lit("$ "), shown)).when(i % 4 == 1, F.concat(F.lit("("), shown, F.lit(")"))).when(i % 4 == 2, F.concat(F.lit("-"), shown)).otherwise("--")
    return o.select("o_orderkey", cells.accounting_number(text).alias("amount"))


@query("SELECT o_orderkey, CAST(CASE o_orderkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.001 WHEN 2 THEN 1000.0 END AS DOUBLE) AS scale FROM orders")
def txt10_units(spark, sf_dir) -> DataFrame:
    """TXT-10: the unit that a heading states first."""
    i = F.col("o_orderkey") % 4
    text = F.when(i == 0, "(In millions, except shares, which are in thousands)").when(i == 1, "($000s) or in billions").when(i == 2, "Billions of dollars, $ billions").otherwise("Unaudited")
    return read(spark, sf_dir, "orders", "o_orderkey").select("o_orderkey", cells.scale_to_millions(text).alias("scale"))


@query(f"SELECT {_ORDER}, round(o_totalprice / 1000, 3) AS revenue, CASE WHEN o_orderkey % 3 = 0 THEN -round(o_totalprice / 4000, 3) ELSE round(o_totalprice / 4000, 3) END AS net_income, CAST(CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 1.25 END AS DOUBLE) AS eps, CAST(NULL AS VARCHAR) AS reason FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT o_orderkey, NULL, NULL, NULL, NULL, NULL, 'the headline names several quarters' FROM orders WHERE o_orderkey % 7 = 0")
def txt15_releases(spark, sf_dir) -> DataFrame:
    """TXT-07 to TXT-10, TXT-12 to TXT-15: a release composed of each order: a headline, a narrative, a table of this and last year's quarter; ambiguous headlines are rejected."""
    o, key = _orders(spark, sf_dir), F.col("o_orderkey")
    thousands, income = F.round("o_totalprice", 0), F.round(F.col("o_totalprice") / 4, 0)
    # Cells in thousands with three decimals, so that nothing is lost.
    cell = lambda x: F.format_number(x, 3)
    revenue, profit = F.round(F.col("o_totalprice") / 1000, 3) * 1000, F.round(F.col("o_totalprice") / 4000, 3) * 1000
    signed = F.when(key % 3 == 0, F.concat(F.lit("("), cell(profit), F.lit(")"))).otherwise(cell(profit))
    title = F.concat(F.lit("Acme reports "), _nth(), F.lit(" quarter fiscal "), F.col("y").cast("string"), F.lit(" results"))
    title = F.when(key % 7 == 0, F.concat(title, F.lit(" after the first quarter fiscal 1990"))).otherwise(title)
    heading = lambda back: F.concat(F.lit("Q"), F.col("q").cast("string"), F.lit(" FY"), (F.col("y") - back).cast("string"))
    lines = [title, F.lit("We expect revenue of $99,999.0 billion next year."), F.lit("(In thousands, except per share amounts)"), F.lit("[TABLE]"), F.concat(F.lit("Item | "), heading(0), F.lit(" | "), heading(1), F.lit(" | Change")), F.concat(F.lit("Adjusted revenue | 1 | 2 | 3%")), F.concat(F.lit("Revenue | "), cell(revenue), F.lit(" | 5 | 3%")), F.concat(F.lit("Net income | "), signed, F.lit(" | 7 | 2%")), F.when(key % 5 != 0, F.lit("Diluted earnings per share | 1.25 | 0.75 | n/a")).otherwise("Shares used | 9 | 9 | -"), F.lit("[/TABLE]")]
    # Texts are far longer than the rows that they are composed of, so these are spread first, by the key of the aggregate that follows.
    o = o.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")
    found = releases(o.select("o_orderkey", F.concat_ws("\n", *lines).alias("text"), F.date_add("end", 30).alias("filed")), "o_orderkey", "text", "filed")
    return found.select("o_orderkey", "quarter", "year", F.round("revenue", 3).alias("revenue"), F.round("net_income", 3).alias("net_income"), "eps", "reason")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'Order ' || o_orderkey || ' is reported.' || chr(10) || 'It has a customer.' END AS section FROM orders")
def txt16_sections(spark, sf_dir) -> DataFrame:
    """TXT-16: the longest section of the item, past an index that names it."""
    key = F.col("o_orderkey").cast("string")
    head = F.when(F.col("o_orderkey") % 5 == 0, "Item 9.01 Exhibits").otherwise("Item 5.02. Departure of Directors or Certain Officers")
    text = F.concat(F.lit("Index\n"), head, F.lit("\nItem 7.01 Other\nnothing\n"), head, F.lit("\n(b)\nOrder "), key, F.lit(" is reported.\nIt has a customer.\nSIGNATURES\nnobody"))
    return read(spark, sf_dir, "orders", "o_orderkey").select("o_orderkey", filings.section_in(text).alias("section"))


@query("SELECT o_orderkey, CAST(3 + o_orderkey % 3 AS INTEGER) AS n_sentences, 'Mr. A. Smith Jr. of Acme Inc. bought No. ' || o_orderkey || ' on Jan. 5 in the U.S. market.' AS first_sentence FROM orders")
def txt17_sentences(spark, sf_dir) -> DataFrame:
    """TXT-17: abbreviations and initials end no sentence."""
    key = F.col("o_orderkey")
    text = F.concat(F.lit("Mr. A. Smith Jr. of Acme Inc. bought No. "), key.cast("string"), F.lit(" on Jan. 5 in the U.S. market. It was effective immediately.1 In addition it was cheap."), F.repeat(F.lit(" Was it? "), key % 3))
    return read(spark, sf_dir, "orders", "o_orderkey").select("o_orderkey", filings.sentences_in(text).alias("s")).select("o_orderkey", F.size("s").alias("n_sentences"), F.col("s")[0].alias("first_sentence"))


_OFFICES = ("Chief Financial Officer", "General Counsel", "President", "Treasurer")


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'departure' WHEN 1 THEN 'appointment' ELSE 'both' END AS event_type, 'Jane ' || CASE c_custkey % 5 WHEN 0 THEN 'Miller' WHEN 1 THEN 'Brown' WHEN 2 THEN 'Garcia' WHEN 3 THEN 'Tanaka' ELSE 'Novak' END AS person_name, CASE c_custkey % 4 WHEN 0 THEN 'Chief Financial Officer' WHEN 1 THEN 'General Counsel' WHEN 2 THEN 'President' ELSE 'Treasurer' END || CASE WHEN c_custkey % 3 = 2 THEN ' -> Lead Independent Director' ELSE '' END AS title, '2024-03-' || lpad(CAST(1 + c_custkey % 28 AS VARCHAR), 2, '0') AS effective_date FROM customer")
def txt22_events(spark, sf_dir) -> DataFrame:
    """TXT-18 to TXT-22: who leaves or takes which office and when, from sentences composed of each customer; full names, honorifics and defined dates."""
    key = F.col("c_custkey")
    last = F.element_at(F.array(*map(F.lit, ("Miller", "Brown", "Garcia", "Tanaka", "Novak"))), (key % 5 + 1).cast("int"))
    office = F.element_at(F.array(*map(F.lit, _OFFICES)), (key % 4 + 1).cast("int"))
    day = F.concat(F.lit("March "), (key % 28 + 1).cast("string"), F.lit(", 2024"))
    leaves = F.concat(F.lit("Jane "), last, F.lit(" notified the Company that she will resign as "), office, F.lit(", effective "), day, F.lit("."))
    takes = F.concat(F.lit("On January 2, 2024, the Board appointed Jane "), last, F.lit(" as "), office, F.lit(", effective as of "), day, F.lit(' (the "Start Date"). Ms. '), last, F.lit(" is 50 years old."))
    both = F.concat(leaves, F.lit(" Ms. "), last, F.lit(" will serve as Lead Independent Director after that."))
    text = F.when(key % 3 == 0, leaves).when(key % 3 == 1, takes).otherwise(both)
    # Rows are spread before the work, for a file of many customers is small enough for one task.
    customers = read(spark, sf_dir, "customer", "c_custkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")
    return filings.executive_events(customers.select("c_custkey", text.alias("text")), "c_custkey", "text")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'not available' WHEN c_custkey % 3 = 1 THEN 'match' ELSE 'differs' END AS status FROM customer")
def txt24_cross_source(spark, sf_dir) -> DataFrame:
    """TXT-24, JN-05: figures in millions against an external statement's, equal within half a million; a missing one is no match."""
    c = read(spark, sf_dir, "customer", "c_custkey")
    outside = c.where("c_custkey % 3 <> 0").select("c_custkey", (F.lit(100e6) + F.when(F.col("c_custkey") % 3 == 1, 499_999.0).otherwise(500_001.0)).alias("value"))
    gap = F.abs(F.lit(100.0) - F.col("value") / 1e6)
    return c.join(outside, "c_custkey", "left").select("c_custkey", F.when(F.col("value").isNull(), "not available").when(gap < 0.5, "match").otherwise("differs").alias("status"))
