"""Texts of filings on hand-made cases."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from meridian.functions import filings
from meridian.text.blocks import blocks
from meridian.text.pages import page_lines
from meridian.text.releases import releases
from plain import pages as plain_pages
from plain import statements


def of(spark, f, *texts):
    """What a column function makes of texts, in their order."""
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.x for r in df.select("i", f(F.col("t")).alias("x")).orderBy("i").collect()]


PERIODS = "Q3 FY25 and 2Q24, third quarter of fiscal 2025; fiscal 2024 fourth-quarter; first quarter 2026; FY26 Q2"
NAMED = [(3, 2025, True), (2, 2024, False), (3, 2025, True), (4, 2024, True), (1, 2026, False), (2, 2026, True)]


def test_periods_and_end_dates_of_columns(spark):
    found = of(spark, filings.periods_in, PERIODS, "", "no quarter here", "Q5 2024", None)
    assert [[tuple(p) for p in x] if x is not None else None for x in found] == [NAMED, [], [], [], None]
    assert [x and tuple(x) for x in of(spark, filings.period_of, PERIODS, "none", "the fourth quarter of the fiscal year 1999 and Q1 2000")] == [NAMED[0], None, (4, 1999, True)]
    assert of(spark, filings.end_dates_in, "three months ended Sept. 30, 2025 and quarter ending February 30, 2024", "", None) == [[dt.date(2025, 9, 30)], [], None]
    assert of(spark, filings.day_of, "Sept. 5, 2024", "February 30, 2024", "Smarch 1, 2024", "x") == [dt.date(2024, 9, 5), None, None, None]


def test_sections_and_sentences(spark):
    text = "Item 5.02\nItem 9.01 Exhibits\nItem 5.02. Departure of Directors\n(b)\nMr. J. Doe left Acme Inc. He is 50.\nSIGNATURE\nx"
    assert of(spark, filings.section_in, text, "nothing", "", None, "item 5.02 a\nshort\n ITEM 5.02\nlonger one\nhere") == ["Mr. J. Doe left Acme Inc. He is 50.", None, None, None, "longer one\nhere"]
    said = of(spark, filings.sentences_in, "Mr. J. Doe of the U.S. left.2 She stayed! \"Why?\" (No. 5)", "One line\nand two. Three on Sept. 5. Acme Corp. ended", "", None)
    assert said == [["Mr. J. Doe of the U.S. left.", "She stayed!", "\"Why?\" (No. 5)"], ["One line", "and two.", "Three on Sept. 5.", "Acme Corp. ended"], [], None]


def events(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return sorted(map(tuple, filings.executive_events(df, "i", "t").collect()))


def test_events_of_people(spark):
    text = 'On April 20, 2026, Jane Q. Miller notified the Board of her decision to resign as Chief Financial Officer, effective June 1, 2026 (the "Transition Date"). The Board appointed Carlos Di Marco as Chief Financial Officer, effective on the Transition Date.'
    passive = "Ana Silva was appointed as General Counsel and Secretary of the Company. Ms. Silva is 50. Certain Officers met an Investment Bank."
    moved = "Bob Stone will step down as President, effective May 2, 2025. Mr. Stone will serve as Chair of the Board after that."
    got = events(spark, text, "", "Nothing happened here.", None, passive, moved, "Eve Long retired from the board of directors.")
    assert got == [
        (0, "appointment", "Carlos Di Marco", "Chief Financial Officer", "2026-06-01"),
        (0, "departure", "Jane Q. Miller", "Chief Financial Officer", "2026-06-01"),
        (4, "appointment", "Ana Silva", "General Counsel and Secretary of the Company", "NOT_FOUND"),
        (5, "both", "Bob Stone", "President -> Chair of the Board", "2025-05-02"),
        (6, "departure", "Eve Long", "Director", "NOT_FOUND"),
    ]


def pages_of(spark, *htmls):
    df = spark.createDataFrame(list(enumerate(htmls)), "i int, html string")
    return {r.i: r for r in blocks(page_lines(df, "i", "html")).collect()}


PAGE = "<html><head><title>no</title></head><body><p>One\ntwo<br>three</p><!-- x --><script>var a='<p>';</script><p>Unit: in millions</p><table><tr><td>Item</td><td>Q1</td></tr><tr><td>Net</td><td>$</td><td>(</td><td>12</td><td>)</td><td></td></tr><tr><td><table><tr><td>in|ner</td></tr></table></td></tr></table><div>after&nbsp;–it</div>"


def test_pages_become_lines_and_tables(spark):
    got = pages_of(spark, PAGE, "", None, "<p>“It’s”</p><table><tr><td>a</td><td>b</td></tr></table>", "<table><tr><td></td><td>$</td><td>5</td><td>%</td><td>(</td><td>3</td><td>)</td></tr></table>")
    assert got[0].text == "One two\nthree\nUnit: in millions\n\n[TABLE]\nItem | Q1\nNet | $(12)\nin/ner\nin/ner\n[/TABLE]\nafter -it"
    tables = [(list(map(list, t.rows)), list(t.context)) for t in got[0].tables]
    assert tables == [([["Item", "Q1"], ["Net", "$(12)"], ["in/ner"], ["in/ner"]], ["One two", "three", "Unit: in millions"])]
    assert "[TABLE]" not in got[0].prose and got[0].prose.startswith("One two") and got[0].prose.endswith("after -it")
    assert (got[1].text, got[1].flat, got[1].prose, got[1].tables) == ("", "", "", []) and (got[2].text, got[2].flat, got[2].prose, got[2].tables) == (None, None, None, None)
    assert got[3].flat == "\"It's\"\na | b" and [list(r) for r in got[4].tables[0].rows] == [["$5%", "(3)"]]


def test_pages_against_a_tree_a_page(spark):
    """Random markup, with elements left open, closed twice and nested tables, gives what a tree of the page gives."""
    rng = random.Random(7)
    parts = ["<p>", "</p>", "<br>", "<br/>", "<div>", "</div>", "<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<th>", "$", "(", ")", "%", "12", "a|b", " \n", "<script>x</script>", "<b>", "</b>", "&nbsp;", "&amp;", "–", "x y", "<li>", "<img>", "<style>", "</style>"]
    htmls = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(400)]
    got = pages_of(spark, *htmls)
    for i, html in enumerate(htmls):
        prose, tables = plain_pages.split_blocks(plain_pages.page_text(html))
        assert (got[i].text, got[i].flat) == (plain_pages.page_text(html), plain_pages.flat_text(html)), html
        assert (got[i].prose, [{"rows": [list(r) for r in t.rows], "context": list(t.context)} for t in got[i].tables]) == (prose, tables), html


def test_pages_of_one_key_and_repeated_pages(spark):
    df = spark.createDataFrame([(1, "<p>a</p>", 0), (1, "<p>b</p>", 1), (1, "<p>b</p>", 2), (None, "<p>c</p>", 3)], "i int, html string, text int")
    assert sorted(map(str, page_lines(df, "i", "html").select("i", "text").collect())) == ["Row(i=1, text='a')", "Row(i=1, text='b')", "Row(i=None, text='c')"]
    assert page_lines(df.limit(0), "i", "html").collect() == []


def release_texts(n):
    """Releases put together at random: headlines, units, headings of one or two rows, labels, cells, and sentences that mislead."""
    rng = random.Random(11)
    heads = ["Acme reports third quarter 2024 results", "Acme results for the quarter ended September 30, 2024", "Q3 FY24", "Q3 2024 against Q2 2024 results", "Acme reports", "results for the quarter ended June 30, 2019"]
    units = ["(In millions)", "(In thousands, except per share amounts)", "$ billions", "Unaudited", "in thousands, shares in millions", "Guidance", "Adjusted results"]
    headings = [["Item | Q3 2024 | Q3 2023 | Change"], ["Three Months Ended | Nine Months Ended", "Item | 2024 | 2023 | 2024 | 2023"], ["September 30, 2024 | September 30, 2023"], ["Three Months Ended September 30, | Six months", "2024 | 2023 | 2024 | 2023"], ["Q3 2024 | Q3 2024"], ["Third quarter 2024 | Full year 2024"], ["Item | FY24 Q3 | % change"], ["September 30, | September 30,", "2024 | 2023"], []]
    labels = ["Revenue", "Total net revenues (1)", "Net sales", "Net income", "Adjusted net income", "Consolidated net income*", "Diluted", "Diluted earnings per common share", "Costs", "Non-GAAP revenue", "Revenues:", "Net income, full year"]
    values = ["1,234.5", "(12.5)", "$ 88", "-", "n/a", "5%", "-7", "2024", "$(3)", "x", "4.0"]
    said = ["Revenue was $1,234.5 million. Net income of $12 million.", "Diluted came to $1.25 per diluted share.", "We expect revenues of $9 billion.", "Adjusted net income was $5 million", "Revenues totaled $1.2 billion! More follows", "Net income was $3 billion."]
    out = []
    for _ in range(n):
        lines = [rng.choice(heads), *rng.sample(said, rng.randrange(3))]
        for _ in range(rng.randrange(3)):
            heading = rng.choice(headings)
            width = heading[-1].count("|") + 1 if heading else 2
            rows = [" | ".join([rng.choice(labels), *(rng.choice(values) for _ in range(width - rng.randrange(2)))]) for _ in range(rng.randrange(5))]
            lines += [rng.choice(units), "[TABLE]", *heading, *rows, "[/TABLE]", *rng.sample(said, rng.randrange(2))]
        out.append("\n".join(lines))
    return out


def test_releases_against_one_text_at_a_time(spark):
    texts, day = release_texts(600), dt.date(2024, 10, 30)
    df = spark.createDataFrame([(i, t, day) for i, t in enumerate(texts)] + [(-1, None, day), (-2, "x", None), (-3, "", day)], "i int, text string, filed date")
    got = {r.i: r.asDict() for r in releases(df, "i", "text", "filed").collect()}
    for i, text in enumerate(texts):
        assert {k: v for k, v in got[i].items() if k != "i"} == statements.extract(text, day), text
    assert set(got) == {*range(-3, len(texts))} and not any(v for k, v in got[-1].items() if k != "i") and not any(v for k, v in got[-2].items() if k != "i")
    assert got[-3]["reason"] == "no period or quarter end in the lead"
    kinds = {got[i]["reason"] for i in range(len(texts))}
    assert len(kinds) == 5 and sum(got[i]["revenue"] is not None for i in range(len(texts))) > 60
