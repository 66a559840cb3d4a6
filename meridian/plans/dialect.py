"""SQL that Spark runs and DuckDB checks: one text of relational steps, with the cell functions written for each engine on its own."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import FLOAT, INT, NULL_TOKENS
from ..operators.numbering import RANGES
from ..operators.quantiles import exact_quantiles
from ..sources.scratch import kept, state_of
from .registry import ORACLE_SQL, QUERIES
from .star import FACTS, SOURCES, STAR, facts_by_client, star, star_sql

#: Bytes of the driver's lines that a bucket of a fact table is made for.
BUCKET_BYTES = 16 << 20
#: Checks that share an aggregate where rows are spread. Of many more, Spark makes a method of more than 8,000 bytes, which the JVM never compiles, so each row costs several times as much.
TOGETHER = 12
T = TypeVar("T")
_DAY = "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


class Dialect:
    """The cell functions that both engines share through the ones that they don't."""

    #: Whether rows are spread over tasks, so that what is moved and held counts.
    spread = False

    def blank(self, x: str) -> str:
        return self.match(f"coalesce({x}, '')", r"^\s*$")

    def number(self, x: str) -> str:
        """The finite number of a text, else null."""
        return f"CASE WHEN {self.match(x, FLOAT)} AND abs(try_cast({x} AS DOUBLE)) < 1.7976931348623157e308 THEN try_cast({x} AS DOUBLE) END"

    def money(self, x: str) -> str:
        """The exact number of a text with up to six places."""
        return f"CASE WHEN {self.number(x)} IS NOT NULL THEN try_cast({x} AS DECIMAL(30, 6)) END"

    def kind(self, x: str, kind: str) -> str:
        """Whether a text is of a kind; false for blanks."""
        test = {"int": self.match(x, INT), "float": self.match(x, FLOAT), "date": f"{self.date(x)} IS NOT NULL", "bool": f"{x} IN ('True', 'False')", "str": "true"}[kind]
        return f"(NOT ({self.blank(x)}) AND coalesce({test}, false))"

    def valid(self, x: str, kind: str) -> str:
        """Of the kind, and finite if a number."""
        if self.spread and kind in ("int", "float"):  # a number has been matched and isn't blank
            return f"({self.number(x)} IS NOT NULL{' AND ' + self.match(x, INT) if kind == 'int' else ''})"
        return f"({self.kind(x, kind)} AND {self.number(x)} IS NOT NULL)" if kind in ("int", "float") else self.kind(x, kind)

    def key(self, x: str) -> str:
        """A key without spaces around it and without the decimals of a whole number."""
        bare = f"trim({x})"
        return f"CASE WHEN {self.match(bare, r'^[+-]?[0-9]+[.]0+$')} THEN {self.replace(bare, '[.]0+$', '')} ELSE {bare} END"

    def shape(self, x: str) -> str:
        """Runs of letters as A, runs of digits as 9, blanks as such."""
        return f"CASE WHEN {self.blank(x)} THEN '<blank>' ELSE {self.replace(self.replace(x, '[A-Za-z]+', 'A'), '[0-9]+', '9')} END"

    def token(self, x: str) -> str:
        return f"coalesce(lower(trim({x})) IN ({', '.join(repr(t) for t in NULL_TOKENS)}), false)"

    def isin(self, x: str, values: tuple[str, ...]) -> str:
        return f"coalesce({x} IN ({', '.join(repr(v) for v in values)}), false)"

    def outside(self, x: str, low: object, high: object) -> str:
        """Out of an open-ended range; false for nulls."""
        parts = [f"{x} < {low}"] * (low is not None) + [f"{x} > {high}"] * (high is not None)
        return f"coalesce({' OR '.join(parts)}, false)"

    def pct(self, part: str, whole: str) -> str:
        return self.rounded(f"100.0 * CAST({part} AS DOUBLE) / nullif(CAST({whole} AS DOUBLE), 0)", 3)

    def if_(self, test: str) -> str:
        return f"count(*) FILTER (WHERE {test})"


#: Pattern to what a text must be to match it, which costs less than to match it.
_FIRST = {r"^\s*$": r"({x} < '!' OR {x} >= '\u007F')", "[eE]": "(contains({x}, 'e') OR contains({x}, 'E'))", "[^ ] {2,}[^ ]": "contains({x}, '  ')", "[ ]{2,}": "contains({x}, '  ')"}


class _Spark(Dialect):
    """`once` writes what a text (and a step after it) gives, once in the application, and returns the name of its view."""

    spread = True

    def __init__(self, names: dict[str, str], once: Callable[..., str] | None = None) -> None:
        self.names, self._once = names, once

    def t(self, name: str) -> str:
        return self.names.get(name, name)

    def match(self, x: str, pattern: str) -> str:
        """Plain cells are first looked at without the pattern, where that shows that it can't match."""
        found = f"{x} RLIKE r'{pattern}'"
        return f"({_FIRST[pattern].format(x=x)} AND {found})" if pattern in _FIRST and re.fullmatch(r"[\w.]+|coalesce\([\w.]+, ''\)", x) else f"({found})"

    def replace(self, x: str, pattern: str, to: str) -> str:
        return f"regexp_replace({x}, r'{pattern}', '{to}')"

    def date(self, x: str) -> str:
        return f"CASE WHEN {self.match(x, _DAY)} THEN try_to_date({x}, 'yyyy-MM-dd') END"

    def rounded(self, x: str, n: int) -> str:
        """A double to n places as DuckDB rounds it: the scaled double to a whole number, halves away from zero. (Spark's own round takes the shortest decimal text of the double, so halves that
        aren't exact in binary differ.)"""
        return f"round(({x}) * 1e{n}D) / 1e{n}D" if n else f"round({x})"

    def quartiles(self, cells: str, columns: str) -> str:
        """Exact ones of x by group g, from counted bins; a row a group, written once for all queries."""
        found = self._once("quartiles", cells, lambda df: exact_quantiles(df, "x", [0.25, 0.75], ("g",)).select("g", F.col("n").alias("reference_n"), F.col("q0").alias("q1"), F.col("q1").alias("q3")))
        return f"SELECT {columns} FROM {found}"

    def fence(self, x: str, source: str) -> str:
        """The quartiles of a whole table: one row, of nulls if it has no numbers."""
        return f"SELECT max(q1) AS q1, max(q3) AS q3 FROM ({self.quartiles(f'SELECT {chr(39)}(all){chr(39)} AS g, {x} AS x FROM {source}', 'q1, q3')}) z"

    def small(self, name: str) -> str:
        """A hint that a joined table has a row a group."""
        return f"/*+ BROADCAST({name}) */ "

    def once(self, name: str, x: str) -> str:
        return self._once(name, x)

    def by_bucket(self, *names: str) -> str:
        """A hint that joined tables, small beside the fact table, are dealt as its buckets are and hashed there, so that its rows are neither shuffled nor sorted."""
        return f"/*+ {', '.join(f'SHUFFLE_HASH({n})' for n in names)} */ "

    def dealt(self, *names: str) -> str:
        """A hint that joined tables meet the others where their keys are dealt to. (Spark takes a written table for as small as its compressed columns, so it would send whole ones through the driver.)"""
        return f"/*+ MERGE({', '.join(names)}) */ "

    def same(self, columns: list[str]) -> str:
        """What rows have in common if all these columns are equal: 128 bits."""
        return f"unhex({self.row_hash(columns)})"

    def fan(self, source: str, names: str, rows: list[tuple[str, ...]]) -> str:
        """A row of each tuple for every row of the source, which is read once."""
        return f"SELECT stack({len(rows)}, {', '.join(x for r in rows for x in r)}) AS ({names}) FROM {source}"

    def row_hash(self, columns: list[str]) -> str:
        """128 bits of a row of texts; lengths keep cells apart, a null isn't an empty text."""
        return "md5(concat(" + ", ".join(f"coalesce(length({c}) || ':' || {c}, '-')" for c in columns) + "))"

    def joined(self, x: str, by: str, order: str) -> str:
        return f"listagg({x}, '{by}') WITHIN GROUP (ORDER BY {order})"

    def numbered(self, source: str, order: str, name: str) -> str:
        """The rows of a step with their number, from 1, by a numeric column that tells them apart: ranges between approximate quantiles number their own rows."""
        cuts = f"SELECT approx_percentile({order}, array({', '.join(str(i / RANGES) for i in range(1, RANGES))}), {10 * RANGES}) AS cuts FROM {source}"
        placed = f"SELECT s.*, size(filter(cuts, c -> c < {order})) AS range_no FROM {source} s CROSS JOIN ({cuts}) q"
        before = f"SELECT range_no, sum(n) OVER (ORDER BY range_no) - n AS before FROM (SELECT range_no, count(*) AS n FROM ({placed}) p GROUP BY 1) z"
        return f"SELECT p.*, row_number() OVER (PARTITION BY p.range_no ORDER BY {order}) + before AS {name} FROM ({placed}) p JOIN ({before}) b ON p.range_no = b.range_no"

    def running(self, source: str, keys: str, number: str, order: str, value: str, name: str) -> str:
        """The rows of a step with the sum of `value` over the rows of their keys before them: totals by ranges of a numeric column are carried into each range. Keys aren't null."""
        cuts = f"SELECT approx_percentile({number}, array({', '.join(str(i / RANGES) for i in range(1, RANGES))}), {10 * RANGES}) AS cuts FROM {source}"
        placed = f"SELECT s.*, coalesce(size(filter(cuts, c -> c < {number})), -1) AS range_no FROM {source} s CROSS JOIN ({cuts}) q"
        start = f"SELECT {keys}, range_no, sum(t) OVER (PARTITION BY {keys} ORDER BY range_no) - t AS start FROM (SELECT {keys}, range_no, sum({value}) AS t FROM ({placed}) p GROUP BY ALL) z"
        inside = f"coalesce(sum({value}) OVER (PARTITION BY {', '.join('p.' + k for k in keys.split(', '))}, p.range_no ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
        return f"SELECT p.*, start + {inside} AS {name} FROM ({placed}) p JOIN ({start}) b ON {' AND '.join(f'p.{k} = b.{k}' for k in [*keys.split(', '), 'range_no'])}"

    def months(self, a: str, b: str) -> str:
        """Months from a to b, both firsts of months."""
        return f"CAST(months_between({b}, {a}) AS BIGINT)"

    def days(self, a: str, b: str) -> str:
        """Days from a to b."""
        return f"datediff({b}, {a})"

    def day_name(self, d: str) -> str:
        return f"date_format({d}, 'EEEE')"

    def month_name(self, d: str) -> str:
        return f"date_format({d}, 'MMMM')"


class _Duck(Dialect):
    def t(self, name: str) -> str:
        return name

    def match(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, '{pattern}')"

    def replace(self, x: str, pattern: str, to: str) -> str:
        return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"

    def date(self, x: str) -> str:
        return f"CASE WHEN {self.match(x, _DAY)} THEN try_cast({x} AS DATE) END"

    def rounded(self, x: str, n: int) -> str:
        return f"round({x}, {n})"

    def quartiles(self, cells: str, columns: str) -> str:
        shown = {"reference_n": "count(x) AS reference_n", "q1": "quantile_cont(x, 0.25) AS q1", "q3": "quantile_cont(x, 0.75) AS q3"}
        return f"SELECT {', '.join(shown.get(c, c) for c in columns.split(', '))} FROM ({cells}) z WHERE x IS NOT NULL GROUP BY g"

    def fence(self, x: str, source: str) -> str:
        return f"SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM (SELECT {x} AS x FROM {source}) z"

    def small(self, name: str) -> str:
        return ""

    def by_bucket(self, *names: str) -> str:
        return ""

    def dealt(self, *names: str) -> str:
        return ""

    def same(self, columns: list[str]) -> str:
        return ", ".join(columns)

    def fan(self, source: str, names: str, rows: list[tuple[str, ...]]) -> str:
        structs = ", ".join("{" + ", ".join(f"'{n}': {x}" for n, x in zip(names.split(", "), r, strict=True)) + "}" for r in rows)
        return f"SELECT unnest([{structs}], recursive := true) FROM {source}"

    def row_hash(self, columns: list[str]) -> str:
        return "md5(concat(" + ", ".join(f"coalesce(length({c}) || ':' || {c}, '-')" for c in columns) + "))"

    def joined(self, x: str, by: str, order: str) -> str:
        return f"string_agg({x}, '{by}' ORDER BY {order})"

    def numbered(self, source: str, order: str, name: str) -> str:
        return f"SELECT *, row_number() OVER (ORDER BY {order}) AS {name} FROM {source}"

    def running(self, source: str, keys: str, number: str, order: str, value: str, name: str) -> str:
        return f"SELECT *, coalesce(sum({value}) OVER (PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS {name} FROM {source}"

    def months(self, a: str, b: str) -> str:
        return f"CAST(date_diff('month', {a}, {b}) AS BIGINT)"

    def days(self, a: str, b: str) -> str:
        return f"date_diff('day', {a}, {b})"

    def day_name(self, d: str) -> str:
        return f"dayname({d})"

    def month_name(self, d: str) -> str:
        return f"monthname({d})"


class Typed(Dialect):
    """A dialect under which what is parsed from a plain column is a column of its own, written once a row; `source` is a table with those that were asked for."""

    def __init__(self, d: Dialect) -> None:
        self._d, self.columns, self.spread = d, {}, d.spread

    def __getattr__(self, name: str):  # noqa: ANN204
        return getattr(self._d, name)

    def _once(self, kind: str, x: str) -> str:
        text = getattr(self._d, kind)(x)
        if not x.isidentifier():
            return text
        self.columns[f"{kind}_of_{x}"] = text
        return f"{kind}_of_{x}"

    def number(self, x: str) -> str:
        return self._once("number", x)

    def money(self, x: str) -> str:
        return self._once("money", x)

    def date(self, x: str) -> str:
        return self._once("date", x)

    def blank(self, x: str) -> str:
        return self._once("blank", x)

    def source(self, table: str, used: str | None = None) -> str:
        """With those columns that the text `used` names, or with all."""
        columns = self.columns if used is None else {n: self.columns[n] for n in _named(used, self.columns)}
        return f"(SELECT *{''.join(f', {text} AS {name}' for name, text in columns.items())} FROM {table}) typed"


def in_parts(d: Dialect, checks: list[T], column: Callable[[T], str], most: int = TOGETHER) -> list[list[T]]:
    """Checks in parts that are evaluated on their own, those of a column together: each part reads its columns only and is compiled. All in one where rows aren't spread."""
    if not d.spread:
        return [checks] if checks else []
    ordered = sorted(checks, key=column)
    return [ordered[i : i + most] for i in range(0, len(ordered), most)]


Build = Callable[[Dialect], str]
#: Named steps in their order; a text names those that it reads.
Steps = Callable[[Dialect], dict[str, str]]


def _named(text: str, names: Iterable[str]) -> list[str]:
    return [n for n in names if re.search(rf"\b{n}\b", text)]


def needed(build: Build, steps: Steps | None) -> tuple[list[str], list[str], str]:
    """The steps and the tables of the star that a text reads, directly or through steps, and all their text."""
    d = _Duck()
    text, all_steps = build(d), steps(d) if steps else {}
    used: set[str] = set()
    while new := {n for n in _named(text, all_steps) if n not in used}:
        used |= new
        text += "\n" + "\n".join(all_steps[n] for n in new)
    return [n for n in all_steps if n in used], _named(text, STAR), text


def _whole_text(name: str, all_steps: dict[str, str]) -> str:
    """A step's text with that of all steps that it reads."""
    text, done = all_steps[name], {name}
    while new := [n for n in _named(text, all_steps) if n not in done]:
        done |= set(new)
        text += "\n" + "\n".join(f"{n}: {all_steps[n]}" for n in new)
    return text


def run(spark: SparkSession, sf_dir: str, build: Build, steps: Steps | None = None, shared: tuple[str, ...] = ()) -> DataFrame:
    """The result of a text over the star. `shared` names steps that another text reads as well. Cleaned tables, results of checks, and tables and steps that are read more than once are written, once in the application for all queries and anew if the
    driver's files change, so that no plan holds them twice. Fact tables and their cleaned ones are written in buckets by client, so that what joins or groups by client shuffles none of them. Views have names of their own and are gone once the plan is resolved."""
    used, tables, text = needed(build, steps)
    names: dict[str, str] = {}
    texts: dict[str, str] = {}
    state = (sf_dir, state_of(spark, [f"{sf_dir}/{s}.parquet" for s in SOURCES]))
    often = lambda n: n in shared or n.startswith("clean_") or n.endswith(("_results", "_findings")) or len(re.findall(rf"\b{n}\b", text)) > 1

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(s[1] for s in state_of(spark, [f"{sf_dir}/lineitem.parquet"]) if s) // BUCKET_BYTES))

    def view(name: str, definition: str, df: Callable[[], DataFrame]) -> None:
        names[name] = f"meridian_{name}_{uuid.uuid4().hex}"
        buckets = ("client_id", parts) if name.removeprefix("clean_") in FACTS else None
        (kept(spark, (*state, parts, name, definition), df, buckets) if often(name) else df()).createOrReplaceTempView(names[name])

    def sql(x: str) -> DataFrame:
        for n in used:
            x = re.sub(rf"\b{n}\b", names.get(n, n), x)
        return spark.sql(x)

    def once(name: str, x: str, then: Callable[[DataFrame], DataFrame] = lambda df: df) -> str:
        plain = x
        for n, v in names.items():
            plain = plain.replace(v, n)
        steps_text = [_whole_text(n, plain_steps) for n in _named(plain, used)] + [t for n, t in texts.items() if n in plain]
        texts[f"{name}_{len(names)}"] = "\n".join((plain, *steps_text))
        names[key := f"{name}_{len(names)}"] = v = f"meridian_{name}_{uuid.uuid4().hex}"
        kept(spark, (*state, name, plain, *steps_text), lambda: then(sql(x))).createOrReplaceTempView(v)
        return names[key]

    d = _Spark(names, once)
    plain_steps = steps(_Duck()) if steps else {}
    try:
        for n in tables:
            view(n, STAR[n], lambda n=n: facts_by_client(spark, sf_dir, n, parts) if n in FACTS and often(n) else star(spark, sf_dir, n)[n])
        for n in used:
            view(n, _whole_text(n, plain_steps), lambda n=n: sql(steps(d)[n]))
        return sql(build(d))
    finally:
        for v in names.values():
            spark.catalog.dropTempView(v)


def over_star(name: str, build: Build, steps: Steps | None = None, dates: tuple[str, ...] = ()) -> None:
    """Register a query over the star, with the SQL that DuckDB runs over the same cells. `dates`: columns returned as text."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(spark, sf_dir, build, steps).withColumns({c: F.col(c).cast("string") for c in dates})

    query.__name__ = name
    QUERIES[name] = query
    used, tables, _ = needed(build, steps)
    d = _Duck()
    parts = ([star_sql(*tables)] if tables else []) + [f"{n} AS ({steps(d)[n]})" for n in used] + [f"result AS ({build(d)})"]
    shown = f" REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in dates)})" if dates else ""
    ORACLE_SQL[name] = f"WITH {', '.join(parts)} SELECT *{shown} FROM result"
